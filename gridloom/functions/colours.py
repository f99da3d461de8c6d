"""Colours as Column expressions: parsing, hue-saturation-lightness, transforms in order, and the colours that files name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.scalars import channel, to_hex

#: The 64 indexed colours of workbooks; 64 and 65 are the system's black and white.
INDEXED = """000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF
800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF
000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99
3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333""".split()


def parsed(text: Column) -> Column:
    """#rrggbb of #rgb, rrggbb or aarrggbb, in lower case; NULL of anything else."""
    t = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    short = F.concat(*(F.repeat(F.substring(t, k, 1), 2) for k in (1, 2, 3)))
    hexa = t.rlike("^[0-9a-f]+$")
    return F.when(hexa & (F.length(t) == 3), F.concat(F.lit("#"), short)).when(hexa & (F.length(t) == 6), F.concat(F.lit("#"), t)).when(hexa & (F.length(t) == 8), F.concat(F.lit("#"), F.substring(t, 3, 6)))


def alpha(text: Column) -> Column:
    """Opacity, 0 to 1; only aarrggbb says one."""
    t = F.regexp_replace(F.trim(text), "^#", "")
    return F.when(t.rlike("^[0-9a-fA-F]{8}$"), F.conv(F.substring(t, 1, 2), 16, 10).cast("double") / 255).otherwise(F.lit(1.0))


def hsl(colour: Column) -> Column:
    """struct(h, s, l), each 0 to 1, of #rrggbb."""

    def of(x: Column) -> Column:
        r, g, b, hi, lo = (x[k] for k in ("r", "g", "b", "hi", "lo"))
        span, light = hi - lo, (hi + lo) / 2
        turn = F.when(hi == r, F.pmod((g - b) / span, F.lit(6.0))).when(hi == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
        return F.struct(F.when(span == 0, 0.0).otherwise(turn).alias("h"), F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1))).alias("s"), light.alias("l"))

    # Each channel is read once: the arrays of one element bind it.
    rgb = F.array(F.struct(*((channel(colour, k) / 255.0).alias(n) for k, n in enumerate("rgb"))))
    wide = F.transform(rgb, lambda x: F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), F.greatest(x["r"], x["g"], x["b"]).alias("hi"), F.least(x["r"], x["g"], x["b"]).alias("lo")))
    return F.transform(wide, of)[0]


def of_hsl(h: Column, s: Column, light: Column) -> Column:
    """#rrggbb: each channel lies as far from the lightness as its place on the hue's circle says."""
    reach = s * F.least(light, 1 - light)

    def value(n: int) -> Column:
        k = F.pmod(n + h * 12, F.lit(12.0))
        return (light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255

    return to_hex(value(0), value(8), value(4))


def transformed(colour: Column, steps: Column) -> Column:
    """#rrggbb after `steps`, an array of (name, value), in order; lightness and saturation are clamped once at the end.

    Values are shares, hueOff is degrees. Unknown names change nothing, alpha among them: it is no part of the colour."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def step(a: Column, t: Column) -> Column:
        h, s, light, name, v = a["h"], a["s"], a["l"], t["name"], t["value"]
        turned = F.when(name == "hueMod", h * v).when(name == "hueOff", h + v / 360).when(name.isin("inv", "comp"), F.pmod(h + 0.5, F.lit(1.0))).otherwise(h)
        grey = F.when(name == "satMod", s * v).when(name == "satOff", s + v).when(name == "gray", 0.0).otherwise(s)
        lit = F.when(name.isin("lumMod", "shade"), light * v).when(name == "lumOff", light + v).when(name == "tint", light + (1 - light) * v).otherwise(light)
        return F.struct(turned.alias("h"), grey.alias("s"), lit.alias("l"))

    end = F.aggregate(steps, hsl(colour), step)
    done = F.transform(F.array(end), lambda x: of_hsl(F.pmod(x["h"], F.lit(1.0)), clamp(x["s"]), clamp(x["l"])))
    return F.when(F.size(steps) == 0, F.lower(colour)).otherwise(done[0])


def tinted(colour: Column, tint: Column) -> Column:
    """Workbook tint: under 0 towards black, over 0 towards white, by lightness."""
    done = F.transform(F.array(hsl(colour)), lambda x: of_hsl(x["h"], x["s"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(tint < 0, x["l"] * (1 + tint)).otherwise(x["l"] + (1 - x["l"]) * tint)))))
    return F.when(F.coalesce(tint, F.lit(0.0)) == 0, F.lower(colour)).otherwise(done[0])


def resolved(spec: Column, theme: Column, fallback: Column) -> Column:
    """The colour that a JSON of auto, rgb, theme (a slot), tint and indexed names: the first of them that is there."""
    get = lambda name: F.get_json_object(spec, f"$.{name}")
    tint, slot, index = get("tint").cast("double"), get("theme").cast("int"), get("indexed").cast("int")
    by_theme = parsed(F.get(theme, slot))
    table = F.array(*(F.lit(f"#{c.lower()}") for c in INDEXED))
    by_index = F.when(index == 64, "#000000").when(index == 65, "#ffffff").otherwise(tinted(F.get(table, index), tint))
    own = F.when(get("auto").isin("1", "true"), fallback).when(get("rgb").isNotNull(), parsed(get("rgb"))).when(slot.isNotNull(), F.when(by_theme.isNotNull(), tinted(by_theme, tint))).when(index.isNotNull(), by_index)
    return F.coalesce(own, fallback)


def steps_of(pairs: Sequence[tuple[str, float]]) -> Column:
    """Literal steps for transformed()."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in pairs)) if pairs else F.array().cast("array<struct<name:string,value:double>>")
