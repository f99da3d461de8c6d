"""Filters, facets, visibility, extents, outline groups, lookups and exports over a table seen as a sheet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import js_number, natural_key, tsv_field


def in_values(col: Column, values: Sequence[str] | None) -> Column:
    """Values filter on display text: None keeps all, an empty list nothing."""
    return F.lit(True) if values is None else col.isin(list(values)) if values else F.lit(False)


def custom(col: Column, tests: Sequence[tuple[str, str]], both: bool = True, blank_is_zero: bool = True, numeric: bool = False) -> Column:
    """Custom filter: > >= < <= by number, equal and notEqual by text; other operators pass; no tests pass.

    With numeric, col is a number and compared as one, so that the filter reaches the scan; a test that is no number rejects."""
    num, parts = None if numeric else js_number(col, blank_is_zero), []
    for op, v in tests:
        if numeric:
            try:
                want = int(v) if v.strip().lstrip("+-").isdigit() else float(v)
            except ValueError:
                want = None
            cmp = {"greaterThan": col > want, "greaterThanOrEqual": col >= want, "lessThan": col < want, "lessThanOrEqual": col <= want, "equal": col == want, "notEqual": col != want}
            parts.append((cmp[op] if want is not None else F.lit(op == "notEqual")) if op in cmp else F.lit(True))
            continue
        want = js_number(F.lit(v), blank_is_zero)
        cmp = {"greaterThan": num > want, "greaterThanOrEqual": num >= want, "lessThan": num < want, "lessThanOrEqual": num <= want, "equal": col == v, "notEqual": col != v}
        parts.append(F.coalesce(cmp[op], F.lit(False)) if op in cmp else F.lit(True))
    return reduce(lambda a, b: a & b if both else a | b, parts) if parts else F.lit(True)


def facets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(facet, value, n): display text counts per column in one pass and one shuffle; blanks count as ''."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in cols)))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def chip_columns(counts: DataFrame, limit: int = 10) -> DataFrame:
    """Facets with at least two values and at most `limit`, blanks counted once."""
    return counts.groupBy("facet").agg(F.sum(F.when(F.col("value") != "", 1).otherwise(0)).alias("n_distinct"), F.max(F.when(F.col("value") == "", 1).otherwise(0)).alias("blank")).filter(f"n_distinct >= 2 and n_distinct + blank <= {limit}")


def naturally(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(col)), F.col(col))


def visible(df: DataFrame, row: str, hidden: DataFrame, max_rows: int = 0) -> DataFrame:
    """Rows not in `hidden` (one column named as row) and within the first max_rows sheet rows (0: all)."""
    out = df.join(hidden.distinct(), row, "left_anti")
    return out.filter(F.col(row) <= max_rows) if max_rows else out


def cell_search(cells: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return cells.filter(F.lower("text").contains(q)) if q else cells.filter(F.lit(False))


def expand_intervals(defs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Column definitions [min, max] as one row per column; the later definition (ord) wins."""
    each = defs.select(F.explode(F.sequence("min", "max")).alias("c"), "ord", *keep)
    return each.groupBy("c").agg(F.max_by(F.struct(*keep), "ord").alias("d")).select("c", "d.*")


BUCKET = 1024


def covered(cells: DataFrame, rects: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds `rect`, the id of the last rectangle (id, r1, c1, r2, c2) over each cell (r, c), or NULL.

    Rectangles are dealt to row buckets, so that the join has an equality and shuffles like any other."""
    b = rects.select(F.explode(F.sequence(F.floor(F.col("r1") / bucket), F.floor(F.col("r2") / bucket))).alias("rb"), "id", "r1", "c1", "r2", "c2")
    hit = cells.select("r", "c", F.floor(F.col("r") / bucket).alias("rb")).join(b, "rb").filter("r between r1 and r2 and c between c1 and c2")
    return cells.join(hit.groupBy("r", "c").agg(F.max("id").alias("rect")), ["r", "c"], "left")


#: Rows of a range within which runs are found; runs that reach its edges are joined afterwards.
RUN_ROWS = 1 << 16


def outline_groups(rows: DataFrame, max_level: int = 7, part: Sequence[str] = (), run_rows: int = RUN_ROWS) -> DataFrame:
    """(level, first, last) of the maximal runs of rows (r, outline) at or over each level; rows that are missing end a run.

    Runs are found by range of rows, so that a level is not one task; only the pieces, few beside rows, meet by level."""
    each = rows.filter("outline >= 1").select(*part, "r", F.floor(F.col("r") / run_rows).alias("span"), F.explode(F.sequence(F.lit(1), F.least(F.lit(max_level), F.col("outline")))).alias("level"))
    w = Window.partitionBy(*part, "level", "span").orderBy("r")
    runs = each.withColumn("k", F.col("r") - F.row_number().over(w)).groupBy(*part, "level", "span", "k").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    edge = (F.col("first") == F.col("span") * run_rows) | (F.col("last") == (F.col("span") + 1) * run_rows - 1)
    by = Window.partitionBy(*part, "level").orderBy("first")
    cut = runs.filter(edge).withColumn("new", F.coalesce((F.lag("last").over(by) + 1 != F.col("first")).cast("int"), F.lit(1)))
    joined = cut.withColumn("g", F.sum("new").over(by)).groupBy(*part, "level", "g").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.drop("g").unionByName(runs.filter(~edge).select(*part, "level", "first", "last"))


def extent(cells: DataFrame, merges: DataFrame, row_slack: int = 200, col_slack: int = 50) -> DataFrame:
    """(r1, c1, r2, c2) of the used cells, widened by merges up to the slack."""
    e = cells.agg(F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2"))
    m = merges.agg(F.max("r2").alias("mr"), F.max("c2").alias("mc"))
    return e.crossJoin(m).select("r1", "c1", F.greatest("r2", F.least("mr", F.col("r2") + row_slack)).alias("r2"), F.greatest("c2", F.least("mc", F.col("c2") + col_slack)).alias("c2"))


def tsv(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(key, tsv): each group's rows in order as tab-separated text, fields quoted where needed, lines joined by LF."""
    line = F.concat_ws("\t", *(tsv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols))
    got = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("a"))
    return got.select(key, F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("tsv"))
