"""Conditional formatting: range statistics, ranks, thresholds, bars, scales, icons and rule resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import mix_colours


def scanned(df: DataFrame, order: Sequence[str], part: Sequence[str] = (), cap: int = 50_000) -> DataFrame:
    """The first `cap` cells of each block in scan order, blanks among them (0: all)."""
    if not cap:
        return df
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(f"_k <= {cap}").drop("_k")


def stats(df: DataFrame, v: str, part: Sequence[str] = ()) -> DataFrame:
    """count, min, max and average of the finite numbers; 0 where there are none."""
    ok = F.when(F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.col(v).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*part).agg(F.count(ok).alias("n"), zero(F.min(ok)).alias("min"), zero(F.max(ok)).alias("max"), zero(F.avg(ok)).alias("average"))


def with_stats(df: DataFrame, v: str, part: Sequence[str] = ()) -> DataFrame:
    """Every row beside its block's statistics: one aggregate joined back, not a window over the whole range."""
    s = F.broadcast(stats(df, v, part)) if not part else stats(df, v, part)
    return df.crossJoin(s) if not part else df.join(s, list(part))


#: Values that one task sorts to find the one of a given rank.
SORTED = 1_000_000


def ranked_value(num: DataFrame, k: int, n: int) -> float | None:
    """The k-th least of the n numbers v, exactly. A sketch of quantiles narrows the range, counts keep the rank exact, and only
    values of a narrow range are sorted, so that no task holds a share of the table."""
    if not n:
        return None
    k = min(max(k, 1), n)
    while n > SORTED:
        share, near = k / n, 1e-3
        lo, hi = num.agg(F.percentile_approx("v", [max(0.0, share - near), min(1.0, share + near)], 10_000)).first()[0]
        under, inside = num.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))).first()
        if lo == hi and under < k <= under + inside:
            return lo
        if under >= k:
            num, n = num.filter(F.col("v") < lo), under
        elif k > under + inside:
            num, k, n = num.filter(F.col("v") > hi), k - under - inside, n - under - inside
        elif inside == n:
            return _by_counts(num, k)
        else:
            num, k, n = num.filter(F.col("v").between(lo, hi)), k - under, inside
    low = k <= n - k
    got = num.orderBy(F.col("v").asc() if low else F.col("v").desc()).limit(k if low else n - k + 1)
    return got.agg((F.max if low else F.min)("v")).first()[0]


def _by_counts(num: DataFrame, k: int) -> float:
    """The k-th least where a few values make up the range: counted first, then summed in order of value."""
    c = num.groupBy("v").agg(F.count("*").alias("c"))
    run = c.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    return run.filter(F.col("upto") >= k).agg(F.min("v")).first()[0]


def numbers(df: DataFrame, v: str) -> DataFrame:
    return df.filter(F.col(v).isNotNull()).select(F.col(v).cast("double").alias("v"))


def boundary(df: DataFrame, v: str, rank: int = 10, percent: bool = False, bottom: bool = False) -> DataFrame:
    """One row, `edge`: the value of the last cell within the top (or bottom) `rank` cells, or percent of cells.

    A number of cells is a take-ordered within the plan; a share of them is found by rank first."""
    num = numbers(df, v)
    if not percent:
        top = num.orderBy(F.col("v").asc() if bottom else F.col("v").desc()).limit(max(rank, 1))
        return top.agg((F.max if bottom else F.min)("v").alias("edge"))
    n = num.count()
    k = max(1, -(-rank * n // 100))
    return df.sparkSession.createDataFrame([(ranked_value(num, k if bottom else n - k + 1, n),)], "edge double")


def percentile(df: DataFrame, v: str, share: float) -> float | None:
    """The value of nearest rank: that at round(share * (n - 1)), halves up, of the sorted numbers."""
    num = numbers(df, v)
    n = num.count()
    return ranked_value(num, int(share * (n - 1) + 0.5) + 1, n)


def duplicates(df: DataFrame, v: str) -> DataFrame:
    """Adds `n`, how many rows have the value: counted before anything is joined, so that a common value is no one task's."""
    return df.join(df.groupBy(v).agg(F.count("*").alias("n")), v)


def top_n(df: DataFrame, v: str, rank: int = 10, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Adds `hit`: the cells at or beyond the boundary value, ties included."""
    d = df.crossJoin(F.broadcast(boundary(df, v, rank, percent, bottom)))
    return d.withColumn("hit", F.coalesce(F.col(v) <= F.col("edge") if bottom else F.col(v) >= F.col("edge"), F.lit(False))).drop("edge")


def threshold(kind: str, value: float | None, low: Column, high: Column, ranked: Column | None = None) -> Column:
    """A threshold of a scale, bar or icon set. `ranked` is percentile() of value / 100, for that kind only."""
    if kind == "num":
        return F.lit(float(value))
    if kind == "percent":
        return low + (high - low) * (value / 100)
    if kind == "percentile":
        return ranked
    return high if kind == "max" else low


def bar(v: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low))))


def scale(v: Column, low: Column, high: Column, colours: Sequence[str], stops: Sequence[Column] | None = None) -> Column:
    """The colour at v between evenly spaced stops, or between those given, one a colour; a flat range has the last."""
    parts = len(colours) - 1
    if stops is not None:
        out = F.lit(colours[-1])
        for k in reversed(range(parts)):
            a, b = stops[k], stops[k + 1]
            out = F.when(v < b, mix_colours(F.lit(colours[k]), F.lit(colours[k + 1]), F.when(b > a, F.greatest(F.lit(0.0), (v - a) / (b - a))).otherwise(1.0))).otherwise(out)
        return F.when(stops[-1] <= stops[0], F.lit(colours[-1])).otherwise(out)
    t = bar(v, low, high) * parts
    i = F.least(F.floor(t), F.lit(parts - 1)).cast("int")
    a, b = F.array(*(F.lit(c) for c in colours[:-1])), F.array(*(F.lit(c) for c in colours[1:]))
    return F.when(high <= low, F.lit(colours[-1])).otherwise(mix_colours(F.element_at(a, i + 1), F.element_at(b, i + 1), t - i))


def icon(v: Column, edges: Sequence[Column], reverse: bool = False) -> Column:
    """Index of the last boundary at or under v."""
    i = F.lit(0)
    for k, e in enumerate(edges):
        i = F.when(v >= e, F.lit(k)).otherwise(i)
    return (F.lit(len(edges) - 1) - i if reverse else i).cast("int")


def cell_is(v: Column, op: str, a: float, b: float | None = None) -> Column:
    lo, hi = (min(a, b), max(a, b)) if b is not None else (a, a)
    return {"greaterThan": v > a, "greaterThanOrEqual": v >= a, "lessThan": v < a, "lessThanOrEqual": v <= a, "equal": v == a, "notEqual": v != a, "between": v.between(lo, hi), "notBetween": ~v.between(lo, hi)}.get(op, F.lit(False))


def text_is(t: Column, op: str, s: str) -> Column:
    t, s = F.lower(t), s.lower()
    return {"contains": t.contains(s), "notContains": ~t.contains(s), "begins": t.startswith(s), "ends": t.endswith(s), "blank": F.trim(t) == "", "notBlank": F.trim(t) != ""}.get(op, F.lit(False))


def resolve(rules: Sequence[tuple[Column, Column | None, bool]]) -> Column:
    """The effect of the first rule (match, effect or None, stop) that matches and has one; a match without any ends only if it stops."""
    out = F.lit(None).cast("string")
    for match, effect, stop in reversed(rules):
        if effect is not None:
            out = F.when(match & effect.isNotNull(), effect).when(match & F.lit(stop), F.lit(None).cast("string")).otherwise(out)
        elif stop:
            out = F.when(match, F.lit(None).cast("string")).otherwise(out)
    return out
