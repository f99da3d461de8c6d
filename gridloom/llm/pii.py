"""Operator 8: personal data replaced by keyed surrogates.

Entities of each type get a replacement drawn with a secret key: equal entities get equal ones wherever they stand, and
different ones different ones. A person is named by a title; from there, every mention of the name's words in that text is
replaced, each word by itself, so that full names and surnames agree. Numbers go through a keyed permutation of their digits (a Feistel network), which keeps
the format and cannot collide, and so do the bits of addresses; names keep gender, script and case; secrets keep their length and character classes.
Replacements that meet one another or an entity of the corpus are found by joins and drawn anew.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import itertools
import re
import secrets
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import id_text, stored, uncarried, released

#: Where a session names the secret key; without one each call of surrogates() draws its own.
KEY_SETTING = "spark.gridloom.pii.key"
#: Redrawn entities are broadcast to the rewriting pass up to so many; beyond, texts are joined to their own entities.
MAX_BROADCAST = 100_000
#: Fixed formats have no replacement left once their entities fill half of the format's space; that many redraws tell it.
HOPELESS = 500

#: Letters that names may start with: capitals of any script that has them, and all letters of Hebrew and Arabic.
_CAPITAL = "".join(c for c in map(chr, range(0x2000)) if c.isupper())
_CASELESS = "\u05d0-\u05ea\u0620-\u064a\u0671-\u06d3"
_WORD = rf"[{_CAPITAL}](?:[^\W\d_]+|(?=['’]))(?:['’\-][{_CAPITAL}][^\W\d_]+)*"
#: A name: initials, up to three words, particles between them.
_NAME = rf"(?P<v>(?:[{_CAPITAL}]\. ?){{0,3}}{_WORD}(?: (?:[{_CAPITAL}]\. )?(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ter) ){{0,2}}{_WORD}){{0,2}})"
_PLAIN = rf"(?P<v>[{_CASELESS}]{{2,}}(?: [{_CASELESS}]{{2,}})?)"
#: Titles that a name follows; academic ones say no gender and may follow others.
_ACADEMIC = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "Rev", "Доктор", "доктор", "Профессор", "профессор", "проф", "Δρ"]
_FEMALE = ["Mrs", "Ms", "Miss", "Mme", "Mlle", "Madame", "Frau", "Señora", "Señorita", "Sra", "Srta", "Signora", "Lady", "Dame", "Senhora", "Mevrouw", "Pani", "г-жа", "Госпожа", "госпожа", "пані", "Κα", "Κυρία", "κυρία"]
_MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Lord", "Senhor", "Meneer", "Pan", "г-н", "Господин", "господин", "пан", "Κος", "Κύριος", "κύριος"]
_also = rf"(?:(?:{'|'.join(_ACADEMIC)})\b\.? )*"
_titled = lambda titles: rf"\b(?:{'|'.join(titles)})\b\.? {_also}{_NAME}"

#: Patterns by type, tried in this order at each place. The group `v` is what is replaced, or all of it.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,6}[A-Za-z]{2,24}"),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9]{20,}\b"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)(?P<v>[A-Za-z0-9+/_\-]{8,200})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\w.])(?:3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}|3[0689]\d{2}[ \-]?\d{6}[ \-]?\d{4})(?![\d.]\d)(?!\d)"),
    ("card", r"(?<![\d.])(?:\d{4}[ \-]?){3}\d{4}(?![\d.]\d)(?!\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\b\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\d\-])"),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\d){7,12}(?!\d)"),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f:]*[0-9]))(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])"),
    ("phone", r"(?<![\w.+\-])0\d(?:[ .\-]\d{2}){4}(?![\w\-]|\.\d)"),
    ("phone", r"(?<![\w.+\-/=#])[2-9]\d{9}(?![\w\-/]|[.,]\d)"),
    ("name_f", _titled(_FEMALE)),
    ("name_m", _titled(_MALE)),
    ("name", _titled(_ACADEMIC)),
    ("name_f", rf"(?:السيدة|الآنسة|גב[׳'])\.? {_PLAIN}"),
    ("name_m", rf"(?:السيد|מר) {_PLAIN}"),
    ("name", rf"(?:الدكتور|الدكتورة|ד[״\"]ר) {_PLAIN}"),
]
#: A line without a digit and any of these has no entity. Patterns never cross a line.
LITERALS = ["@", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "::", "السيد", "الآنسة", "الدكتور", "גב", "מר ", "ד״ר", 'ד"ר', *_FEMALE, *_MALE, *_ACADEMIC]
LITERALS = [x for x in LITERALS if not any(y != x and x.startswith(y) for y in LITERALS)]
KEYWORDS = ["passw", "pwd", "secret", "token", "key"]
_DIGIT = re.compile(r"\d").search
#: Syllables that names are built from, by script, and the ends that show gender.
SYLLABLES = {
    "latin": ["ma", "re", "lo", "vi", "da", "ni", "so", "ka", "be", "ri", "ta", "mo", "le", "ju", "an", "el"],
    "cyrillic": ["ма", "ре", "ло", "ви", "да", "ни", "со", "ка", "бе", "ри", "та", "мо", "ле", "ю", "ан", "ел"],
    "greek": ["μα", "ρε", "λο", "βι", "δα", "νι", "σο", "κα", "βε", "ρι", "τα", "μο", "λε", "γι", "αν", "ελ"],
    "hebrew": ["מא", "רי", "לו", "וי", "דא", "ני", "סו", "קא", "בי", "גל", "טא", "מו", "לי", "יו", "אן", "אל"],
    "arabic": ["ما", "ري", "لو", "في", "دا", "ني", "سو", "كا", "بي", "جا", "تا", "مو", "لي", "يو", "نا", "با"],
}
#: A given name's end after a title that says a gender; others have none.
ENDS = {("latin", "name_f"): "na", ("latin", "name_m"): "ren", ("cyrillic", "name_f"): "на", ("cyrillic", "name_m"): "рен", ("greek", "name_f"): "να", ("greek", "name_m"): "νος"}
#: Networks whose addresses stay within them, as base and bits.
LOCAL_NETS = [(10 << 24, 24), (127 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (169 << 24 | 254 << 16, 16)]
NAMES = ("name_f", "name_m", "name", "surname")
_SCRIPTS = [("cyrillic", re.compile("[\u0400-\u052f]")), ("greek", re.compile("[\u0370-\u03ff]")), ("hebrew", re.compile("[\u0590-\u05ff]")), ("arabic", re.compile("[\u0600-\u06ff]"))]
_PART = re.compile(rf"{_WORD}|[{_CASELESS}]{{2,}}")
_ANY = re.compile(rf"[^\W\d_]+(?:['’\-][{_CAPITAL}][^\W\d_]+)*")
_SIMPLE = re.compile(r"[^\W\d_]+")

_FOUND = re.compile("|".join(f"(?P<t{k}>{p.replace('(?P<v>', f'(?P<v{k}>')})" for k, (_, p) in enumerate(PATTERNS)))


def _may_hold(text: str) -> bool:
    if _DIGIT(text) or any(x in text for x in LITERALS):
        return True
    low = text.lower()
    return any(x in low for x in KEYWORDS)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a text, in order and apart. Each word of a name is one: its last is the surname."""
    out: list[tuple[int, int, str, str]] = []
    if not _may_hold(text):
        return out
    at, titled = 0, []
    for line in text.split("\n"):
        if _may_hold(line):
            for m in _FOUND.finditer(line):
                k = int(m.lastgroup[1:])
                g = f"v{k}" if m.groupdict().get(f"v{k}") is not None else f"t{k}"
                kind = PATTERNS[k][0]
                if kind in NAMES:
                    titled.append((kind, [x[0] for x in _PART.finditer(m[g])]))
                else:
                    out.append((at + m.start(g), at + m.end(g), kind, canonical(kind, m[g])))
        at += len(line) + 1
    return sorted(out + _mentions(text, titled, out)) if titled else out


def _mentions(text: str, titled: list[tuple[str, list[str]]], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Every mention in the text of a word of a name that has a title somewhere in it, outside of other entities.

    A single word after a title is a surname unless the text has it as a given name only; a word that is both counts as what
    stands after it says: given if another word of a name follows."""
    surnames = {words[-1] for _, words in titled if len(words) > 1}
    given: dict[str, str] = {}
    for kind, words in titled:
        for w in words[:-1]:
            given[w] = kind if given.get(w, "name") == "name" else given[w]
    for kind, words in titled:
        if len(words) == 1 and words[0] not in given:
            surnames.add(words[0])
    known = surnames | given.keys()
    forms = {w: w for w in known} | {w.upper(): w for w in known if len(w) > 1 and w.upper() not in known}
    spans = []
    for m in _ANY.finditer(text):
        if m[0] in forms:
            spans.append((m.start(), m.end(), forms[m[0]]))
        elif "-" in m[0] or "'" in m[0] or "’" in m[0]:
            spans += [(m.start() + x.start(), m.start() + x.end(), forms[x[0]]) for x in _SIMPLE.finditer(m[0]) if x[0] in forms]
    out, k, taken = [], 0, sorted(taken)
    for j, (s, e, w) in enumerate(spans):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        both = w in surnames and w in given
        follows = both and j + 1 < len(spans) and text[e : spans[j + 1][0]] == " "
        out.append((s, e, given[w] if w not in surnames or follows else "surname", w))
    return out


def canonical(kind: str, value: str) -> str:
    return value.lower() if kind == "email" else re.sub(r"[ \-]", "", value) if kind in ("card", "iban") else re.sub(r"[^\d+]", "", value) if kind == "phone" else ".".join(str(int(x)) for x in value.split(".")) if kind == "ip" else _address6(value) if kind == "ip6" else value


def _address6(value: str) -> str:
    try:
        return str(ipaddress.IPv6Address(value))
    except ValueError:
        return value.lower()


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permuted(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the strings of so many digits."""
    if len(digits) < 2:
        return str((int(digits or 0) + _prf(key, tweak)) % 10) if digits else ""
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for r in range(8):
        m = len(a)
        a, b = b, str((int(a) + _prf(key, tweak, r, len(digits), b)) % 10**m).zfill(m)
    return a + b


def _permuted_bits(x: int, bits: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers of so many bits (even)."""
    half = bits // 2
    a, b = x >> half, x & (1 << half) - 1
    for r in range(8):
        a, b = b, a ^ _prf(key, tweak, "bits", r, b) & (1 << half) - 1
    return a << half | b


def _charwise(value: str, key: bytes, tweak: str) -> str:
    out, stream = [], _prf(key, tweak, value)
    for k, c in enumerate(value):
        if k % 16 == 15:
            stream = _prf(key, tweak, value, k)
        stream, r = divmod(stream, 251)
        if c.isdigit():
            out.append(str(r % 10))
        elif c.isascii() and c.isalpha():
            hexa = re.fullmatch(r"[0-9a-f]+", value) is not None
            out.append(chr(ord("a") + r % (6 if hexa else 26)) if c.islower() else chr(ord("A") + r % 26))
        else:
            out.append(c)
    return "".join(out)


def _syllables(x: int, script: str, n: int) -> str:
    """A word of n syllables, 16 to choose from; x has 128 bits, which serve for 32."""
    out = ""
    for k in range(n):
        out += SYLLABLES[script][x >> 4 * (k % 32) & 15]
    return out


def _iban_check(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(digits) % 97:02}"


def _luhn(body: str) -> str:
    s = sum((d if k % 2 else (2 * d if d < 5 else 2 * d - 9)) for k, d in enumerate(int(c) for c in reversed(body)))
    return str(-s % 10)


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The replacement of a canonical entity; another one for each attempt, and never the entity itself."""
    for n in range(16):
        tweak = f"{kind}/{attempt}/{n}"
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            host = _syllables(_prf(key, "domain", domain), "latin", 5 + attempt // 4)
            out = f"{_charwise(re.sub('[^a-z0-9]', '', local)[:6] or 'x', key, tweak + value)}{_prf(key, tweak, value) % 36**9:x}@{host}.example"
        elif kind == "ip":
            x = int.from_bytes(bytes(map(int, value.split("."))), "big")
            net = next(((base, bits) for base, bits in LOCAL_NETS if x >> bits == base >> bits), None)
            if net and attempt < 4:
                x = net[0] | _permuted_bits(x & (1 << net[1]) - 1, net[1], key, tweak)
            else:
                x = _permuted_bits(x, 32, key, tweak)
                while any(x >> bits == base >> bits for base, bits in LOCAL_NETS):
                    x = _permuted_bits(x, 32, key, tweak)
            out = ".".join(map(str, x.to_bytes(4, "big")))
        elif kind == "card":
            body = value[0] + permuted(value[1:-1], key, tweak)
            out = body + (_luhn(body) if _luhn(value[:-1]) == value[-1] else str((int(value[-1]) + 1) % 10))
        elif kind == "ssn":
            d = permuted(value.replace("-", ""), key, tweak)
            out = f"{d[:3]}-{d[3:5]}-{d[5:]}"
        elif kind == "phone":
            d = value.lstrip("+")
            keep = max(0, len(d) - 10) if value.startswith("+") else 0
            out = ("+" if value.startswith("+") else "") + d[:keep] + permuted(d[keep:], key, tweak)
        elif kind == "iban":
            body = _charwise(value[4:], key, tweak + value[:2])
            check = _iban_check(value[:2], body)
            # Check digits that hold get others that hold; wrong ones stay wrong.
            out = value[:2] + (check if _iban_check(value[:2], value[4:]) == value[2:4] else f"{(int(check) + 1 + int(value[2:4])) % 97:02}") + body
        elif kind == "ip6":
            out = str(ipaddress.IPv6Address(0x20010DB8 << 96 | _prf(key, tweak, value) >> 32))
        elif kind in NAMES:
            script = next((x for x, own in _SCRIPTS if own.search(value)), "latin")
            out = _syllables(_prf(key, tweak, value), script, 4 + attempt)
            out = (out + ENDS.get((script, kind), "")).capitalize()
        elif value[:4] in ("AKIA", "ASIA") or re.match(r"gh[pousr]_|sk-", value):
            out = value[:4] + _charwise(value[4:], key, tweak) if value[:3] != "sk-" else value[:3] + _charwise(value[3:], key, tweak)
        else:
            out = _charwise(value, key, tweak)
        if out != value:
            return out
    return out


def shaped(kind: str, original: str, new: str) -> str:
    """A canonical replacement in the format of what it replaces."""
    if kind in ("card", "phone", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars, "0") if c.isalnum() else c for c in original)
    return new.upper() if (kind == "email" or kind in NAMES and len(original) > 1) and original.isupper() else new


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, value) of every entity of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in find(t)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "start", "end", "kind", "value"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, start int, end int, kind string, value string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v, a = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([surrogate(*x, key) for x in zip(k, v, a)], pa.string())], ["kind", "value", "attempt", "new"])

    return rows.select("kind", "value", "attempt").mapInArrow(released(run), "kind string, value string, attempt int, new string")


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the distinct entities whose first replacement met another entity or replacement. Drawn until
    none does: each attempt lengthens names, so that it ends; a fixed format whose space is full is an error."""
    values = found.select("kind", "value").distinct()
    drawn = stored(_drawn(values.withColumn("attempt", F.lit(0)), key))
    for r in itertools.count(1):
        # Who keeps a replacement that several drew: the least value. Nobody keeps one that is an entity of the corpus.
        first = drawn.groupBy("kind", "new").agg(F.min("value").alias("owner"), F.count("*").alias("c")).filter("c > 1").select("kind", "new", "owner")
        clash = drawn.join(first, ["kind", "new"]).filter(F.col("value") != F.col("owner")).select("kind", "value")
        real = drawn.join(values.withColumnRenamed("value", "new"), ["kind", "new"], "left_semi").select("kind", "value")
        bad = stored(clash.unionByName(real).distinct())
        if bad.isEmpty():
            break
        if r > HOPELESS:
            raise ValueError(f"no distinct replacements left for {sorted(x['kind'] for x in bad.select('kind').distinct().collect())}")
        again = _drawn(bad.withColumn("attempt", F.lit(r)), key)
        drawn = stored(drawn.join(bad, ["kind", "value"], "left_anti").unionByName(again))
    return drawn.filter("attempt > 0").select("kind", "value", "attempt")


def rewrite(text: str, attempts: dict[tuple[str, str], int], key: bytes, memo: dict | None = None) -> tuple[str, int]:
    out, at, found = [], 0, find(text)
    memo = {} if memo is None else memo
    for s, e, kind, value in found:
        if (new := memo.get((kind, value))) is None:
            new = memo[kind, value] = surrogate(kind, value, attempts.get((kind, value), 0), key)
        out += [text[at:s], shaped(kind, text[s:e], new)]
        at = e
    # The words of one name count once.
    n = len(found) - sum(a[2] in NAMES and b[2] in NAMES and text[a[1] : b[0]] == " " for a, b in zip(found, found[1:]))
    return "".join(out) + text[at:] if found else text, n


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or a new one: then surrogates agree within the call and with no other."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def surrogates(docs: DataFrame, key: bytes | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, n_entities) for every row: whole texts with their entities replaced. Texts without any stay as they are,
    null ones are empty, repeated rows repeat, an empty table gives no rows. Other columns, whatever their names, are left out
    but for those to carry.

    Texts are scanned twice and never shuffled. The exceptions are counted before they are broadcast; if they are too
    many, each document is joined to its own."""
    key = key or session_key(docs.sparkSession)
    exceptions = stored(redrawn(entities(docs), key))
    n_carry = int(bool(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            own = b.column(2 + n_carry).to_pylist() if b.num_columns > 2 + n_carry else [None] * b.num_rows
            done = []
            for t, mine in zip(b.column(1).to_pylist(), own):
                if mine is not None:
                    done.append(rewrite(t, {(x["kind"], x["value"]): x["attempt"] for x in mine}, key))
                else:
                    done.append(rewrite(t, shared, key, memo))
                    if len(memo) > 100_000:
                        memo.clear()
            cols = [b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64()), *b.columns[2 : 2 + n_carry]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_entities", *["carry"] * n_carry])

    rows = id_text(docs, carry)
    schema = StructType(StructType().add("doc_id", "long").add("text", "string").add("n_entities", "long").fields + rows.schema.fields[2:])
    if exceptions.count() <= MAX_BROADCAST:
        shared = {(r["kind"], r["value"]): r["attempt"] for r in exceptions.collect()}
    else:
        shared = {}
        own = entities(docs).join(exceptions, ["kind", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("own"))
        rows = rows.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<kind:string,value:string,attempt:int>>")))
        rows = rows.select("doc_id", "text", *["carry"] * n_carry, "own")
    return uncarried(rows.mapInArrow(released(run), schema))
