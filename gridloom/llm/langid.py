"""Operator 3: language by mixture inference over character n-grams.

Each language has trigram likelihoods over hashed buckets. A document is a mixture of languages: expectation-maximisation
finds the proportions; of the nested sets of its strongest languages the one with the best likelihood less a penalty per
language (BIC) is kept; the language with the largest share is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import crc_mod, id_text, lowest, released

BUCKETS = 1 << 14
#: Rows of each lang that the model is fitted on, about; rows with the lowest hashes of doc_id are taken.
FIT_ROWS = 8000
ROUNDS, SMOOTH = 12, 0.5
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.zeros(256, np.uint32)
_KEEP[97:123], _KEEP[65:91], _KEEP[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the bytes of the lower-cased letters; runs of other bytes count as one space."""
    b = _KEEP[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    b = b[(b > 0) | np.append(True, b[:-1] > 0)]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, train=None) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, from whole texts of a bounded sample of the rows of each lang.

    What reaches the driver is one array of counts per language and task. Without labelled rows there are no languages."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if train is None else rows.filter(train)
    # Only langs of more rows are sampled, so that none is lost however rare it is.
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") > fit_rows).collect()}
    sampled = F.lit(True)
    for lang, n in many.items():
        sampled = F.when(F.col("lang") == lang, lowest(fit_rows, n, "doc_id")).otherwise(sampled)
    rows = rows.filter(sampled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "gram", "n"])

    found = rows.select("text", "lang").mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    p = np.full((BUCKETS, len(langs)), SMOOTH)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        p[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return langs, (p / p.sum(axis=0)).astype(np.float64)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p (likelihoods of distinct grams) under counts n, and the log likelihood."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * (p.T @ (n / mixed)) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(text: str, probs: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Index of the main language, its share, and all shares."""
    g, k = grams(text), probs.shape[1]
    if not len(g) or not k:
        return 0, 0.0, np.zeros(k)
    c = np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(c)
    p, n = probs[at], c[at].astype(float)
    share, _ = mixture(p, n)
    order = np.argsort(-share, kind="stable")
    best = (-np.inf, order[:1], np.ones(1))
    for m in range(1, k + 1):
        if m > 1 and share[order[m - 1]] < 0.02:
            break
        use = order[:m]
        part, ll = (np.ones(1), float(n @ np.log(p[:, use[0]]))) if m == 1 else mixture(p[:, use], n)
        if (value := ll - 0.5 * m * np.log(n.sum())) > best[0]:
            best = value, use, part
    out = np.zeros(k)
    out[best[1]] = best[2]
    top = int(out.argmax())
    return top, float(out[top]), out


def predict(docs: DataFrame, langs: list[str], probs: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, shares): score is the main language's share. Texts that are null or have no letter are `und`, 0."""
    model = docs.sparkSession.sparkContext.broadcast(probs.astype(np.float64))  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for b in batches:
            pred, score, shares = [], [], []
            for t in b.column(1).to_pylist():
                top, s, all_s = infer(t, p) if langs and _LETTER.search(t) else (-1, 0.0, np.zeros(len(langs)))
                pred.append(langs[top] if top >= 0 and s > 0 else "und")
                score.append(min(1.0, max(0.0, s)))
                shares.append(np.round(all_s, 6).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, lang_pred string, score double, shares array<double>")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, whole texts, however long; rows of crc32(doc_id as text) mod 4 = 2 are
    held out of the fit. Null texts and null langs teach nothing; with no lang at all every prediction is `und`, 0. Repeated
    rows repeat, an empty table gives no rows, other columns are not read. Equal shares go to the first lang by name."""
    train = crc_mod("doc_id", 4) != 2
    return predict(docs, *fit(docs, train=train)).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
