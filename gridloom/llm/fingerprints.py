"""Operator 1: one-permutation MinHash fingerprints.

Every shingle hash is thrown once: its high bits name one of K bins, its low bits compete for the bin's minimum. Empty
bins borrow by optimal densification: bin i probes the other bins in its own fixed random order and takes the first
that was filled, so that any two documents probe alike. Of each bin only the low b bits are kept, packed; likeness
corrects for the 2^-b chance agreements.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, id_text, shingle_hashes, text_buffers, word_hashes, released

BINS, BITS, WORDS, SEED = 512, 4, 5, 20240229
#: Documents of one bucket are neighbours in doc_id and are streamed by one task; the number of buckets is bounded.
BUCKET_ROWS, MAX_BUCKETS = 2000, 65536
_EMPTY = np.uint64(2**64 - 1)
_PROBES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """order[i]: the bins in bin i's probing order; rank[i, m]: when bin i probes bin m."""
    if bins not in _PROBES:
        order = np.argsort(np.random.default_rng(SEED).random((bins, bins)), axis=1).astype(np.int32)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(bins, dtype=np.int32)[None, :].repeat(bins, 0), axis=1)
        _PROBES[bins] = order, rank
    return _PROBES[bins]


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill each row's empty bins from its filled ones; rows without any stay empty."""
    n, bins = minima.shape
    order, rank = _probes(bins)
    full, out = minima != _EMPTY, minima.copy()
    r, c = np.nonzero(~full & full.any(axis=1)[:, None])
    for a in range(24):
        if not len(r):
            break
        src = order[c, a]
        hit = full[r, src]
        out[r[hit], c[hit]] = minima[r[hit], src[hit]]
        r, c = r[~hit], c[~hit]
    for d in np.unique(r):
        have, want = np.flatnonzero(full[d]), c[r == d]
        out[d, want] = minima[d, have[np.argmin(rank[np.ix_(want, have)], axis=1)]]
    return out


def sketch(shingles: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Each row's bin minima (bins must be a power of two), densified."""
    n, width = len(at) - 1, int(math.log2(bins))
    minima = np.full(n * bins, _EMPTY)
    key = np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) * bins + (shingles >> np.uint64(64 - width)).astype(np.int64)
    np.minimum.at(minima, key, shingles & np.uint64((1 << (64 - width)) - 1))
    return densify(minima.reshape(n, bins))


def pack(minima: np.ndarray, bits: int = BITS) -> list[str]:
    """Low bits of each bin, packed, in hexadecimal; a row without shingles packs to the empty string."""
    low = (minima & np.uint64((1 << bits) - 1)).astype(np.uint8)
    packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1), axis=1)
    empty = (minima == _EMPTY).all(axis=1)
    return ["" if e else row.tobytes().hex() for row, e in zip(packed, empty)]


def fingerprint_column(column: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[str]:
    raw, offs = text_buffers(column)
    out: list[str] = []
    for i, j in blocks(offs):
        out += pack(sketch(*shingle_hashes(*word_hashes(raw, offs[i : j + 1]), words), bins), bits)
    return out


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: share of equal bins, less what chance gives. Two empty prints are alike (1), one is not (0)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8)).reshape(-1, bits) for s in (a, b))
    same, chance = float((x == y).all(axis=1).mean()), 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null and wordless texts have the fingerprint ''. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_column(b.column(1), words, bins, bits), pa.string())], ["doc_id", "fingerprint"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, fingerprint string")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text), partitioned by bucket and sorted: buckets are consecutive ranges of doc_id,
    and each ends with the next bucket's first document (ahead = 1), the last with the very first.

    Only ids are read to find the ranges; texts are shuffled once. What reaches the driver is one row per bucket."""
    from pyspark.ml.feature import Bucketizer

    base = id_text(docs)
    ids = base.select("doc_id")
    n = max(1, min(MAX_BUCKETS, ids.count() // bucket_rows))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    splits = [-math.inf, *cuts, math.inf]
    def put(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("bucket", F.lit(0))
        return Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(df.withColumn("at", F.col("doc_id").cast("double"))).drop("at").withColumn("bucket", F.col("bucket").cast("int"))

    heads = sorted((r["bucket"], r["doc_id"]) for r in put(ids).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect())
    ahead = [(doc, heads[k - 1][0]) for k, (_, doc) in enumerate(heads)]
    extra = docs.sparkSession.createDataFrame(ahead, "doc_id long, before int")  # one row per bucket: bounded
    # A repeated doc_id would double the look-ahead row; the reader below takes the first only.
    rows = put(base).join(F.broadcast(extra), "doc_id", "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(0).alias("ahead")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ahead"))))
    out = rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.ahead", "doc_id", "text")
    return out.repartition("bucket").sortWithinPartitions("bucket", "ahead", "doc_id", F.crc32(F.col("text").cast("binary")))


def edited_pairs(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last floor(n/2) code points replaced by as many first
    ones of the next document in doc_id order, or by all it has), and their likenesses.

    Null and empty texts have the fingerprint ''; rows that repeat a doc_id follow each other by their text's checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held: list[tuple] = []  # the last row so far, without its next

        def pairs(rows: list[tuple]) -> pa.RecordBatch:
            done = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            edited = []
            for (_, _, _, t, _), (_, _, _, u, _) in done:
                half = len(t) // 2
                edited.append(t[: len(t) - half] + u[:half])
            prints = fingerprint_column(pa.array(edited, pa.large_string()), words, bins, bits)
            cols = [[a[2] for a, _ in done], [len(a[3]) for a, _ in done], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [a[4] for a, _ in done], prints, [likeness(a[4], e, bits) for (a, _), e in zip(done, prints)], [likeness(a[4], b[4], bits) for a, b in done]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                prints = fingerprint_column(part.column(3), words, bins, bits)
                rows = held + list(zip(*(part.column(i).to_pylist() for i in range(4)), prints))
                yield pairs(rows)
                held = rows[-1:]

    return with_next(docs).mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
