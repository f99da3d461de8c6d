"""Queries over the test tables, one per operator, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import conditional as C
from gridloom.operators import grid as G

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gridloom.plans import files, more  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from gridloom.plans import files, more  # noqa: F401

    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_FLAG = """
WITH f AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A','R') AND l_quantity > 25),
s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM f),
e AS (SELECT min(v) AS edge FROM (SELECT l_extendedprice AS v FROM f ORDER BY v DESC LIMIT 10))
SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice >= edge AS hit, round((l_extendedprice - lo) / (hi - lo), 6) AS bar
FROM f, s, e"""


@query(_FLAG)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    f = t(spark, d, "lineitem").filter(G.in_values(F.col("l_returnflag"), ["A", "R"]) & (F.col("l_quantity") > 25)).select("l_orderkey", "l_linenumber", "l_extendedprice")
    hit = C.top_n(f, "l_extendedprice", 10)
    s = C.stats(f, "l_extendedprice")
    return hit.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", "l_extendedprice", "hit", F.round(C.bar(F.col("l_extendedprice"), F.col("min"), F.col("max")), 6).alias("bar")).orderBy("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F','P')")
def f1_values_filter(spark, d):
    return t(spark, d, "orders").filter(G.in_values(F.col("o_orderstatus"), ["F", "P"])).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
def f2_custom_filter(spark, d):
    return t(spark, d, "part").filter(G.custom(F.col("p_size"), [("greaterThanOrEqual", "10"), ("lessThan", "20")], numeric=True)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag IN ('A') AND l_linestatus IN ('F') AND l_quantity < 10")
def f3_conjunction(spark, d):
    return t(spark, d, "lineitem").filter(G.in_values(F.col("l_returnflag"), ["A"]) & G.in_values(F.col("l_linestatus"), ["F"]) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT c_acctbal < 0")
def f6_visibility(spark, d):
    """Rows that a filter hides (by their orders) and rows hidden by themselves (by their balance); all rows of the sheet."""
    hidden = t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    flagged = t(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    return G.visible(t(spark, d, "customer"), "c_custkey", hidden.unionByName(flagged)).select("c_custkey", "c_name")


@query("SELECT p_partkey AS r, c, text FROM (SELECT p_partkey, 1 AS c, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL SELECT p_partkey, 3, p_type FROM part) WHERE contains(lower(text), 'an')")
def f8_cell_search(spark, d):
    cells = t(spark, d, "part").select(F.col("p_partkey").alias("r"), F.posexplode(F.array("p_name", "p_brand", "p_type")).alias("c", "text"))
    return G.cell_search(cells.withColumn("c", F.col("c") + 1), " AN ").orderBy("r", "c")


_PARAS = "SELECT doc_id, pos, trim(regexp_replace(p, '[ \\t\\r\\n\\x0b\\x0c]+', ' ', 'g'), ' ') AS para FROM (SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))"


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.btrim(S.collapse_space(F.col("p"))).alias("para"))


@query(f"SELECT doc_id, pos FROM ({_PARAS}) WHERE contains(lower(para), 'licensed under')")
def f9_paragraph_search(spark, d):
    return paragraphs(t(spark, d, "documents")).filter(F.lower("para").contains("licensed under")).select("doc_id", "pos")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the')")
def f10_slide_search(spark, d):
    return t(spark, d, "conversations").filter(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).contains("the")).select("conv_id", "turn")


@query("WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, ((i + 1) % n + 1)::BIGINT AS next_hit, ((i - 1 + 2 * n) % n + 1)::BIGINT AS previous_hit FROM h")
def f11_search_stepping(spark, d):
    w = Window.partitionBy("conv_id")
    h = t(spark, d, "conversations").filter("role = 'user'").withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count("*").over(w))
    return h.select("conv_id", "turn", (F.pmod(F.col("i") + 1, "n") + 1).cast("long").alias("next_hit"), (F.pmod(F.col("i") - 1, "n") + 1).cast("long").alias("previous_hit"))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS is_between, l_quantity <> 5 AS not_equal, contains(lower(l_returnflag), 'a') AS has_a FROM lineitem")
def f12_cf_predicates(spark, d):
    v = F.col("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.cell_is(v, "between", 20, 10).alias("is_between"), C.cell_is(v, "notEqual", 5).alias("not_equal"), C.text_is(F.col("l_returnflag"), "contains", "A").alias("has_a"))


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a2_facets(spark, d):
    return G.facets(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT DISTINCT p_brand FROM part")
def a3_distinct_values(spark, d):
    return G.naturally(t(spark, d, "part").select("p_brand").distinct(), "p_brand")


@query("SELECT facet, n_distinct::BIGINT AS n_distinct FROM (SELECT 'p_brand' AS facet, count(DISTINCT p_brand) AS n_distinct FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE n_distinct BETWEEN 2 AND 30")
def a4_chip_columns(spark, d):
    return G.chip_columns(G.facets(t(spark, d, "part"), ["p_brand", "p_size", "p_type"]), 30).select("facet", "n_distinct")


@query("WITH c AS (SELECT l_quantity AS v FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50000) SELECT count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS average FROM c")
def a1_range_stats(spark, d):
    # A scan cap is a take-ordered over the scan order: no task sorts the range.
    c = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").limit(50_000)
    return C.stats(c, "l_quantity").withColumn("average", F.round("average", 6))


@query("SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def a5_multiplicity(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("n")).filter("n > 1")


_WC = "CASE WHEN para = '' THEN 0 ELSE len(string_split(para, ' ')) END"


@query(f"SELECT doc_id, sum({_WC})::BIGINT AS words, sum(length(para))::BIGINT AS chars, count(*) FILTER (para <> '') AS paragraphs FROM ({_PARAS}) GROUP BY doc_id")
def a6_word_counts(spark, d):
    p = paragraphs(t(spark, d, "documents"))
    return p.groupBy("doc_id").agg(F.sum(S.word_count(F.col("para"))).alias("words"), F.sum(F.length("para")).cast("long").alias("chars"), F.count_if(F.col("para") != "").alias("paragraphs"))


@query("SELECT source, lang AS language FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS k FROM documents GROUP BY source, lang) WHERE k = 1")
def a13_language_mode(spark, d):
    g = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("language"))


@query("SELECT min(l_orderkey) AS r1, 1::BIGINT AS c1, greatest(max(l_orderkey), least(1048576, max(l_orderkey) + 200)) AS r2, greatest(max(l_linenumber), least(60, max(l_linenumber) + 50))::BIGINT AS c2 FROM lineitem")
def a19_extent(spark, d):
    cells = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").cast("long").alias("c"))
    merges = spark.createDataFrame([(1, 4, 1048576, 60)], "r1 long, c1 long, r2 long, c2 long")
    return G.extent(cells, merges)


@query("WITH e AS (SELECT (SELECT min(v) FROM (SELECT o_totalprice AS v FROM orders ORDER BY v DESC LIMIT 10)) AS hi, (SELECT max(v) FROM (SELECT o_totalprice AS v FROM orders ORDER BY v LIMIT (SELECT (count(*) * 2 + 99) // 100 FROM orders))) AS lo) SELECT o_orderkey, o_totalprice >= hi AS top, o_totalprice <= lo AS bottom FROM orders, e")
def w1_top_bottom(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    top = C.top_n(o, "o_totalprice", 10).withColumnRenamed("hit", "top")
    return C.top_n(top, "o_totalprice", 2, percent=True, bottom=True).select("o_orderkey", "top", F.col("hit").alias("bottom"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) + 1e-6 AS above FROM lineitem")
def w2_above_average(spark, d):
    return C.with_stats(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") > F.col("average") + 1e-6).alias("above"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_retailprice) > 1 AS is_duplicate FROM part")
def w3_duplicates(spark, d):
    return C.duplicates(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", (F.col("n") > 1).alias("is_duplicate"))


@query("WITH s AS (SELECT list(s_acctbal ORDER BY s_acctbal) AS a FROM supplier) SELECT a[1] AS p0, round(a[1] + (a[len(a)] - a[1]) * 0.5, 6) AS percent50, a[(floor(0.9 * (len(a) - 1) + 0.5) + 1)::INT] AS percentile90 FROM s")
def w4_thresholds(spark, d):
    v = t(spark, d, "supplier").select("s_acctbal")
    s, lo, hi = C.stats(v, "s_acctbal"), F.col("min"), F.col("max")
    ranked = F.lit(C.percentile(v, "s_acctbal", 0.9))
    return s.select(C.threshold("min", None, lo, hi).alias("p0"), F.round(C.threshold("percent", 50, lo, hi), 6).alias("percent50"), C.threshold("percentile", 90, lo, hi, ranked).alias("percentile90"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS bar, CASE WHEN p_retailprice >= lo + (hi - lo) * 0.67 THEN 2 WHEN p_retailprice >= lo + (hi - lo) * 0.33 THEN 1 ELSE 0 END::INTEGER AS icon FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def w5_bars_and_icons(spark, d):
    p = C.with_stats(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    v, lo, hi = F.col("p_retailprice"), F.col("min"), F.col("max")
    return p.select("p_partkey", F.round(C.bar(v, lo, hi), 6).alias("bar"), C.icon(v, [C.threshold("percent", x, lo, hi) for x in (0, 33, 67)]).alias("icon"))


_MIX = "'#' || " + " || ".join(f"printf('%02x', floor({a} + ({b} - {a}) * tt + 0.5)::INT)" for a, b in (("ar", "br"), ("ag", "bg"), ("ab", "bb")))


@query(f"""WITH x AS (SELECT p_partkey, 2 * (p_size - lo) / (hi - lo) AS u FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)),
y AS (SELECT p_partkey, CASE WHEN u < 1 THEN u ELSE u - 1 END AS tt, CASE WHEN u < 1 THEN 255 ELSE 255 END AS ar, CASE WHEN u < 1 THEN 255 ELSE 235 END AS ag, CASE WHEN u < 1 THEN 255 ELSE 132 END AS ab,
CASE WHEN u < 1 THEN 255 ELSE 99 END AS br, CASE WHEN u < 1 THEN 235 ELSE 190 END AS bg, CASE WHEN u < 1 THEN 132 ELSE 123 END AS bb FROM x) SELECT p_partkey, {_MIX} AS colour FROM y""")
def w6_colour_scale(spark, d):
    p = C.with_stats(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v")), "v")
    return p.select("p_partkey", C.scale(F.col("v"), F.col("min"), F.col("max"), ["#ffffff", "#ffeb84", "#63be7b"]).alias("colour"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'red' WHEN s_acctbal BETWEEN 0 AND 1000 THEN NULL WHEN s_acctbal > 5000 THEN 'green' END AS effect FROM supplier")
def w8_rule_resolution(spark, d):
    v = F.col("s_acctbal")
    return t(spark, d, "supplier").select("s_suppkey", C.resolve([(v < 0, F.lit("red"), False), (C.cell_is(v, "between", 0, 1000), None, True), (v > 5000, F.lit("green"), False)]).alias("effect"))


@query("WITH r AS (SELECT user_id, event_id AS r, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS outline FROM events), e AS (SELECT outline, r, level FROM r, generate_series(1, 3) g(level) WHERE level <= outline), k AS (SELECT level, r, r - row_number() OVER (PARTITION BY level ORDER BY r) AS k FROM e) SELECT level::INTEGER AS level, min(r) AS first, max(r) AS last FROM k GROUP BY level, k")
def w9_outline_groups(spark, d):
    o = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return G.outline_groups(t(spark, d, "events").select(F.col("event_id").alias("r"), o.alias("outline")), 3)


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def w10_prefix_and_neighbours(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lead("event_id").over(w).alias("next_id"), F.lag("event_id").over(w).alias("previous_id"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INTEGER AS ordinal, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM conversations")
def w14_ordinals_and_sections(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("ordinal"), F.coalesce(n, F.lit(0)).cast("long").alias("section"))
