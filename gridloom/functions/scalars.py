"""Column functions: references, counters, text, units, colours, serial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_number(text: Column, blank_is_zero: bool = True) -> Column:
    """A display text as a number; NULL where it is none. Blank text is 0, or NULL if `blank_is_zero` is off."""
    t = F.trim(text)
    plain = t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    return F.when(plain, t.cast("double")).when(t == "", F.lit(0.0) if blank_is_zero else F.lit(None).cast("double"))


#: Fixed value: what counts as a number in delimited text.
NUMERIC = r"^[-+]?[\d,]*\.?\d+(?:[eE][-+]?\d+)?$"


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def cell_number(text: Column) -> Column:
    """Per-cell type inference of delimited text: thousands commas are dropped, anything else stays text (NULL here)."""
    return F.when(is_numeric(text), F.regexp_replace(text, ",", "").try_cast("double"))


def column_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; seven letters hold any number under 8 billion, beyond it is NULL."""
    n = n.cast("long")

    def step(a: Column, _: Column) -> Column:
        rest = a["rest"] - 1
        return F.struct(F.when(a["rest"] > 0, F.concat(F.char(F.pmod(rest, F.lit(26)) + 65), a["out"])).otherwise(a["out"]).alias("out"), F.when(a["rest"] > 0, F.floor(rest / 26)).otherwise(0).cast("long").alias("rest"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(F.lit("").alias("out"), n.alias("rest")), step)
    return F.when(n < 26**7, end["out"])


def column_number(letters: Column) -> Column:
    chars = F.split(F.upper(letters), "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


def cell_ref(ref: Column) -> Column:
    """struct(r, c) of A1-style text, `$` allowed; NULL if it is none."""
    m = F.upper(F.regexp_replace(ref, r"\$", ""))
    ok = m.rlike(r"^[A-Z]{1,3}[0-9]+$")
    return F.when(ok, F.struct(F.regexp_extract(m, r"([0-9]+)$", 1).cast("long").alias("r"), column_number(F.regexp_extract(m, r"^([A-Z]+)", 1)).alias("c")))


def roman(n: Column) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(3999), n)).cast("int")
    place = lambda one, five, ten: F.array(*(F.lit(x) for x in ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]))
    digit = lambda k: (F.floor(n / k) % 10 + 1).cast("int")
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), F.element_at(place("C", "D", "M"), digit(100)), F.element_at(place("X", "L", "C"), digit(10)), F.element_at(place("I", "V", "X"), digit(1)))


def counter(value: Column, style: Column) -> Column:
    """A list counter in its declared format; bullets and `none` print nothing, other formats decimals."""
    v = F.greatest(F.lit(1), value)
    return F.when(style.isin("bullet", "none"), F.lit("")).when(style == "upperLetter", column_letters(v)).when(style == "lowerLetter", F.lower(column_letters(v))).when(style == "upperRoman", roman(v)).when(style == "lowerRoman", F.lower(roman(v))).when((style == "decimalZero") & (value < 10), F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\n\x0b\x0c]+", " ")


def word_count(text: Column) -> Column:
    t = F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[ \t\r\n\x0b\x0c]+"))).cast("long")


def tsv_field(text: Column) -> Column:
    return F.when(text.rlike('[\\t\\n\\r"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def byte_size(n: Column) -> Column:
    one = lambda x: F.format_string("%d.%d", F.floor(F.floor(x * 10 + 0.5) / 10).cast("long"), (F.floor(x * 10 + 0.5) % 10).cast("long"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KB"))).otherwise(F.concat(one(n / 1048576), F.lit(" MB")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def stem(name: Column) -> Column:
    """A file's name without its folder and extension."""
    own = F.element_at(F.split(name, "/"), -1)
    return F.when(own.rlike(r"^.+\.[^.]*$"), F.regexp_replace(own, r"\.[^.]*$", "")).otherwise(own)


def cell_range(ref: Column) -> Column:
    """struct(sheet, r1, c1, r2, c2) of `'My sheet'!$A$1:B2`: the sheet before the last `!`, its quotes undone; corners in order."""
    at = F.length(ref) - F.locate("!", F.reverse(ref))
    has = ref.contains("!")
    raw = F.trim(F.when(has, F.substring(ref, F.lit(1), at)))
    sheet = F.when(raw.rlike("^'.*'$"), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))).otherwise(raw)
    area = F.when(has, F.substring(ref, at + 2, F.length(ref))).otherwise(ref)
    a, b = cell_ref(F.split(area, ":")[0]), cell_ref(F.element_at(F.split(area, ":"), -1))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(sheet.alias("sheet"), F.least(a["r"], b["r"]).alias("r1"), F.least(a["c"], b["c"]).alias("c1"), F.greatest(a["r"], b["r"]).alias("r2"), F.greatest(a["c"], b["c"]).alias("c2")))


def count_label(n: Column, noun: str) -> Column:
    """`1,234 words`, `1 word`."""
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def iso_shown(text: Column) -> Column:
    """An ISO time as its date, and hours and minutes if it has them; other text as it is."""
    day, time = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}T?(\d{2}:\d{2})", 1)
    return F.when(day == "", text).when(time == "", day).otherwise(F.concat(day, F.lit(" "), time))


def field_shown(instruction: Column, page: Column, pages: Column, slide: Column) -> Column:
    """What a field shows: the page, the number of pages, a slide's number from 1; NULL for any other."""
    t = F.upper(instruction)
    return F.when(t.rlike("NUMPAGES|SECTIONPAGES"), pages).when(t.rlike(r"\bPAGE\b"), page).when(t == "SLIDENUM", slide + 1)


def part_checksum(content: Column) -> Column:
    """CRC-32 of bytes, as archives and PNG chunks carry it."""
    return F.crc32(content)


def sampled_hash(content: Column, samples: int = 4096) -> Column:
    """32-bit FNV-1a over about `samples` evenly spaced bytes, seeded with the length; an unsigned number."""
    n = F.octet_length(content)
    step = F.greatest(F.lit(1), F.floor(n / samples)).cast("int")
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1, step))
    byte = lambda i: F.conv(F.hex(F.substring(content, i + 1, F.lit(1))), 16, 10).cast("long")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # The product of two 32-bit numbers goes by halves, since it may pass 63 bits.
    times = lambda x: low(low(F.shiftright(x, 16) * 16777619) * 65536 + x.bitwiseAND(F.lit(0xFFFF)) * 16777619)
    return F.aggregate(places, low(F.lit(2166136261).bitwiseXOR(n.cast("long"))), lambda h, i: times(h.bitwiseXOR(byte(i))))


def natural_key(text: Column) -> Column:
    """Sort key: numeric text first, by value; then text without case, digit runs by value (without leading zeros, after their length)."""
    num = F.when(text.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(text).cast("double"))
    # A run of digits is led by its length as a character, so that runs of any length compare by value.
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.char(F.length(F.regexp_replace(x, r"^0+(?=\d)", "")) + 32), F.regexp_replace(x, r"^0+(?=\d)", ""))).otherwise(x))
    padded = F.array_join(runs, "")
    return F.struct(F.when(num.isNull(), 1).otherwise(0).alias("is_text"), F.coalesce(num, F.lit(0.0)).alias("num"), padded.alias("txt"))


def resolve_path(base: Column, target: Column) -> Column:
    """A relationship target against its part's folder: `..` pops, `.` and empty parts vanish, a leading / is absolute."""
    full = F.when(target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((x == ".") | (x == ""), a).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")


EMU, TWIP, POINT, HALF_POINT = 1 / 9525, 1 / 15, 4 / 3, 2 / 3


def to_px(value: Column, unit: float) -> Column:
    return value * F.lit(unit)


def odf_length_px(text: Column) -> Column:
    n, unit = F.regexp_extract(text, r"^\s*(-?[\d.]+)", 1).try_cast("double"), F.regexp_extract(text, r"([a-z%]+)\s*$", 1)
    return F.when(unit == "in", n * 96).when(unit == "cm", n * 96 / 2.54).when(unit == "mm", n * 96 / 25.4).when(unit == "pt", n * 4 / 3).when(unit == "pc", n * 16).when(unit == "px", n)


def channel(hex_colour: Column, k: int) -> Column:
    return F.conv(F.substring(hex_colour, 2 + 2 * k, 2), 16, 10).cast("int")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda x: F.lower(F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def mix_colours(a: Column, b: Column, t: Column) -> Column:
    return to_hex(*(channel(a, k) + (channel(b, k) - channel(a, k)) * t for k in range(3)))


def luminance(hex_colour: Column) -> Column:
    return (0.299 * channel(hex_colour, 0) + 0.587 * channel(hex_colour, 1) + 0.114 * channel(hex_colour, 2)) / 255


def text_on(hex_colour: Column) -> Column:
    return F.when(luminance(hex_colour) > 0.62, "#000000").otherwise("#ffffff")


def serial_of(ts: Column) -> Column:
    """A timestamp as a serial of the 1900 system (exact from 1900-03-01)."""
    return (F.unix_micros(ts.cast("timestamp")) / 86_400_000_000 + 25569).cast("double")


def serial_date_text(serial: Column, date1904: bool = False) -> Column:
    """yyyy-mm-dd of a serial, with the day 1900-02-29 that serial 60 names."""
    d = F.floor(serial).cast("int")
    if date1904:
        return F.date_format(F.date_add(F.lit("1904-01-01").cast("date"), d), "yyyy-MM-dd")
    base = F.when(d > 60, F.date_add(F.lit("1899-12-30").cast("date"), d)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), d))
    return F.when(d == 60, "1900-02-29").otherwise(F.date_format(base, "yyyy-MM-dd"))
