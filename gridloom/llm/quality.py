"""Operator 7: positive-unlabelled quality classifier.

A logistic model over byte-class, repetition and hashed word features, fitted by the non-negative unbiased risk: trusted
positives are rows labelled 1, unlabelled text is any text. The class prior is estimated from these two alone: a model that
tells positives from unlabelled text ranks held-out rows of both, and the share of unlabelled rows beyond a score bounds the
prior times that of positives; the least such ratio with enough rows is taken. Rows labelled 0 are never used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import blocks, crc_mod, id_text, lowest, text_buffers, uncarried, word_hashes, released

#: Rows the model is fitted on, about: positives, and unlabelled ones.
FIT_POSITIVES, FIT_UNLABELLED = 5000, 10000
STEPS, RATE, L2 = 600, 0.05, 1e-4
#: Steps of the models that only rank rows for the prior.
RANK_STEPS = 200
#: Buckets of hashed words, and how much they weigh beside the other features.
WORD_BUCKETS, WORD_SCALE = 128, 2.0
#: Rows are split in so many parts to score each by a model that has not seen it; chance of the bound on the prior to fail.
FOLDS, PRIOR_MISS = 3, 0.1
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!", b".", b",", b"\n", b" \t\r", b"?;:'\"()-_/"]


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each row of text."""
    out = np.empty((len(offs) - 1, len(_CLASSES) + 8 + WORD_BUCKETS), np.float32)
    for i, j in blocks(offs):
        words, at = word_hashes(raw, offs[i : j + 1], lower=False)
        for d in range(j - i):
            b = raw[offs[i + d] : offs[i + d + 1]]
            hist, w = np.bincount(b, minlength=256), words[at[d] : at[d + 1]]
            n, m = max(len(b), 1), max(len(w), 1)
            share = [hist[list(c)].sum() / n for c in _CLASSES]
            _, seen = np.unique(w, return_counts=True)
            again = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
            pairs = np.unique(w[1:] + w[:-1] * np.uint64(3)) if len(w) > 1 else w
            p = hist[hist > 0] / n
            hashed = np.sqrt(np.bincount((w >> np.uint64(57)).astype(np.int64), minlength=WORD_BUCKETS) / m)
            out[i + d, :-WORD_BUCKETS] = [*(np.sqrt(s) for s in share), np.log1p(len(w)), len(seen) / m, seen.max() / m if len(seen) else 0.0, again, len(pairs) / m, np.log1p(n / m), float(-(p * np.log(p)).sum()), np.log1p(hist[10])]
            out[i + d, -WORD_BUCKETS:] = hashed
    return out


def expand(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x[:, :-WORD_BUCKETS] - mean) / std, -6, 6)
    return np.hstack([z, z * z, WORD_SCALE * x[:, -WORD_BUCKETS:], np.ones((len(z), 1))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(w: np.ndarray, gradient, steps: int = STEPS) -> np.ndarray:
    m, v = 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(w) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """prior * R+(p) + max(0, R-(u) - prior * R-(p)) under logistic loss, and the step to take: the gradient, but where the
    second part is negative, that which raises it again."""
    zp, zu = p @ w, u @ w
    sp, su = _sigmoid(zp), _sigmoid(zu)
    loss = lambda z: np.logaddexp(0, z)
    part = loss(zu).mean() - prior * loss(zp).mean()
    good = prior * ((sp - 1) @ p) / len(p)
    bad = (su @ u) / len(u) - prior * (sp @ p) / len(p)
    return prior * loss(-zp).mean() + max(0.0, part), good + bad if part >= 0 else -bad


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from expanded features of both.

    Scores are of models that have not seen the row. For every score, (share of unlabelled rows at or over it) / (share of
    positives) is at least the prior in expectation; the one of least upper confidence bound is taken."""
    sp, su = np.zeros(len(pos)), np.zeros(len(unl))
    for k in range(FOLDS):
        p, u = np.arange(len(pos)) % FOLDS == k, np.arange(len(unl)) % FOLDS == k
        if p.all() or u.all():
            return 0.5
        a, b = pos[~p], unl[~u]
        w = _adam(np.zeros(pos.shape[1]), lambda w: ((_sigmoid(a @ w) - 1) @ a / len(a) + _sigmoid(b @ w) @ b / len(b)) / 2, RANK_STEPS)  # noqa: B023
        sp[p], su[u] = pos[p] @ w, unl[u] @ w
    edges = np.sort(sp)
    over_p = 1 - np.arange(len(sp)) / len(sp)
    over_u = 1 - np.searchsorted(np.sort(su), edges) / len(su)
    slack = np.sqrt(np.log(4 / PRIOR_MISS) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = int(np.argmin((over_u + slack) / over_p))
    return float(np.clip(over_u[best] / over_p[best], 0.03, 0.97))


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> dict:
    """Minimise the non-negative unbiased risk by Adam on all rows; the prior is estimated if none is given."""
    both = np.vstack([pos, unl])[:, :-WORD_BUCKETS].astype(np.float64)
    mean, std = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = expand(pos, mean, std), expand(unl, mean, std)
    prior = estimated_prior(p, u) if prior is None else prior
    w = _adam(np.zeros(p.shape[1]), lambda w: risk(w, p, u, prior)[1])
    return {"mean": mean, "std": std, "w": w, "prior": prior}


def with_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in features(*text_buffers(b.column(1)))], pa.binary())], ["doc_id", "x"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, x binary")


def _some(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows: those whose doc_id hashes lowest."""
    return df.filter(lowest(rows, df.count(), "doc_id", F.lit(5)))


def fit(docs: DataFrame, labels: DataFrame, train=None) -> dict | None:
    """The model, or None if nothing is labelled 1. Learns from rows labelled 1 and unlabelled ones, of `train` alone if it is
    given; only a bounded sample's features reach the driver (FIT_POSITIVES, FIT_UNLABELLED)."""
    ids = docs.select("doc_id") if train is None else docs.select("doc_id").filter(train)
    known = labels.select("doc_id", "quality").filter("quality = 1").select("doc_id").distinct()
    known = known if train is None else known.filter(train)
    pos = _some(known, FIT_POSITIVES).withColumn("pos", F.lit(1))
    unl = _some(ids, FIT_UNLABELLED).withColumn("pos", F.lit(0))
    want = pos.unionByName(unl).groupBy("doc_id").agg(F.max("pos").alias("p"), F.min("pos").alias("u"))
    texts = docs.select("doc_id", "text").join(F.broadcast(want), "doc_id", "left_semi")
    rows = with_features(texts).join(F.broadcast(want), "doc_id").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    p, u = np.array([r["p"] == 1 for r in rows], bool), np.array([r["u"] == 0 for r in rows], bool)
    return fit_pu(x[p], x[u]) if p.any() and u.any() else None


def score(docs: DataFrame, model: dict | None, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score) and the columns to carry, for every row: the likelihood of label 1 for every whole text, null as empty.
    Without a model all score 0.5. Repeated rows repeat; an empty table gives no rows; other columns are not read. A text to be
    carried goes to Python once, and features exist for a block of rows at a time."""
    own, rest = "text" in carry, [c for c in carry if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if model is not None:
                raw, offs = text_buffers(b.column(1))
                for i, j in blocks(offs):
                    s[i:j] = _sigmoid(expand(features(raw, offs[i : j + 1]), model["mean"], model["std"]) @ model["w"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *b.columns[1 if own else 2 :]], names)

    # A null text is carried as null; text_buffers() takes it as empty.
    rows = id_text(docs, rest, nulls=own)
    schema = StructType(StructType().add("doc_id", "long").add("score", "double").fields + rows.schema.fields[1 if own else 2 :])
    names = schema.names
    return uncarried(rows.mapInArrow(released(run), schema))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; rows of crc32(doc_id as text) mod 3 = 1 are held out of the fit."""
    return score(docs, fit(docs, labels, crc_mod("doc_id", 3) != 1)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
