"""Operator 5: a ledger of quality rules, in DataFrame functions only.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are
versioned bit masks applied afterwards, and ablations count documents by bits, never by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_SPLIT, id_text

_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: (name, fails when), in the order of their bits.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "10 * n_capitals > 7 * word_chars"),
]
#: Versions of policies: the rules that reject.
POLICIES: dict[str, list[str]] = {"base": ["few_words", "repeated_words"], "v1": [n for n, _ in RULES]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows found twice or more: windows by hash, their places from neighbours in sorted order, then the union of their spans."""

    def spans(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twin = lambda e, j: F.coalesce(e["v"] == F.get(s, j - 1)["v"], F.lit(False)) | F.coalesce(e["v"] == F.get(s, j + 1)["v"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

    def of(h: Column) -> Column:
        found = let(F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: let(places(s), spans))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: F.transform(F.sequence(F.lit(1), F.size(wh) - window + 1), lambda i: F.xxhash64(F.slice(wh, i, window))))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, of))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_capitals, n_repeat_words). Null texts are empty; an empty text measures 0 throughout."""
    text = F.col("text")
    bare, trimmed = F.translate(text, _SPACE, ""), F.btrim(text, F.lit(_SPACE))
    length = lambda c: F.length(c).cast("long")
    rows = id_text(docs).select(
        "doc_id",
        length(bare).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (length(text) - length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_capitals"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, _SPACE, "") != "").alias("lines"),
    )
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The measurements and `failures`, bit k set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failures", bits)


def mask(policy: str, rules: list[tuple[str, str]] = RULES) -> int:
    return sum(1 << k for k, (n, _) in enumerate(rules) if n in POLICIES[policy])


def verdict(rows: DataFrame, policy: str = "v1") -> DataFrame:
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that would be kept without it. One small aggregate over bit patterns."""
    m, names = mask(policy), F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (n, _) in enumerate(RULES) if n in POLICIES[policy]))
    by = rows.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("f")).agg(F.count("*").alias("n"))
    return by.select("f", "n", F.explode(names).alias("r")).groupBy("r.rule").agg(F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"))


def rule_rows(docs: DataFrame) -> DataFrame:
    """The ledger's measurements with the base rules' verdict and that of policy v1, for every row; null texts are empty and fail
    the base. Whole texts are measured, repeated rows repeat, an empty table gives no rows, other columns are not read."""
    rows = verdict(ledger(docs))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failures").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"), "kept")


ORACLE_OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(generate_series(1, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM p),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM t) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_capitals > 7 * word_chars) AS kept
FROM b
"""
