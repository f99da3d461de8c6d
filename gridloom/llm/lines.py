"""Operator 6: line deduplication.

Line hashes are range-partitioned and sorted by hash, document and position. Each task streams its runs of equal hashes
and hands on the lines of runs that span enough documents; a run cut by a partition's edge is settled from a summary row
per edge. Decisions return as one compressed bitmap per document; text moves once, to meet its bitmap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import ASCII_LOWER, ASCII_UPPER, id_text, stored, uncarried, released

MIN_DOCS, MIN_CHARS = 10, 1
_SPACE = " \t\n\x0b\x0c\r"


def _rows(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, copy, text, carry): copy tells apart rows that repeat a doc_id with another text; equal rows share their decisions."""
    return id_text(docs, carry).select("doc_id", F.xxhash64("text").alias("copy"), "text", *["carry"] * bool(carry))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, doc_id, copy, pos) of every line whose key has min_chars code points: 96 bits of hash of the key."""
    key = lambda x: F.translate(F.btrim(x, F.lit(_SPACE)), ASCII_UPPER, ASCII_LOWER)
    lines = _rows(docs).select("doc_id", "copy", F.posexplode(F.transform(F.split("text", "\n", -1), key)).alias("pos", "key"))
    return lines.filter(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc_id", "copy", "pos")


def _stream(min_docs: int):
    """Rows (kind, h, g, doc_id, copy, pos, n): kind 0 is a decided line, 1 a line of a run that touches an edge, 2 such a run's summary
    (doc_id: its first document, copy: its last, pos: the partition, n: its documents). Memory: the lines of min_docs documents."""
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, held, n, doc, start, opened, out = None, [], 0, None, None, True, []

        def close(last: bool) -> None:
            if key is None:
                return
            if opened or last:
                out.extend((1, *key, *x, 0, x is first_row) for x in held)
                out.append((2, *key, start, doc, part, n, False))

        first_row = None
        for b in batches:
            h, g, d, c, p = (b.column(i).to_pylist() for i in range(5))
            for x in zip(h, g, d, c, p):
                if (k := x[:2]) != key:
                    if key is not None:
                        close(False)
                        opened = False
                    key, held, n, doc, start, first_row = k, [], 0, None, x[2], x[2:]
                if x[2] != doc:
                    n, doc = n + 1, x[2]
                row = first_row if not held and n == 1 and x[2:] == first_row else x[2:]
                if not opened and n >= min_docs:
                    out.extend((0, *key, *y, 0, y is first_row) for y in held)
                    held = []
                    out.append((0, *key, *row, 0, row is first_row))
                elif opened and len(held) >= 4096:
                    out.extend((1, *key, *y, 0, y is first_row) for y in held)
                    held = [row]
                else:
                    held.append(row)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if key is not None:
            # The last run may go on in the next partition: what it has decided stands, the rest waits for the summary.
            close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return run


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, copy, pos) of every line to drop: its key is found in at least min_docs documents; with keep_first the
    first of them, by document and position, stays. A document counts once however often it has the line."""
    hashes = line_hashes(docs, min_chars)
    n = max(hashes.sparkSession.sparkContext.defaultParallelism, int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stored(hashes.repartitionByRange(n, "h", "g", "doc_id", "copy", "pos").sortWithinPartitions("h", "g", "doc_id", "copy", "pos").mapInArrow(released(_stream(min_docs)), "kind int, h long, g int, doc_id long, copy long, pos int, n long, first boolean"))
    edges: dict[tuple[int, int], list] = {}
    for r in found.filter("kind = 2").orderBy("pos").collect():  # at most two rows a partition
        e = edges.setdefault((r["h"], r["g"]), [0, None, r["pos"]])
        e[0] += r["n"] - (e[1] == r["doc_id"])
        e[1] = r["copy"]
    kept = [(h, g, p) for (h, g), (n_docs, _, p) in edges.items() if n_docs >= min_docs]
    known = docs.sparkSession.createDataFrame(kept, "h long, g int, at int")
    pending = found.filter("kind = 1").join(F.broadcast(known.select("h", "g")), ["h", "g"], "left_semi")
    drop = found.filter("kind = 0").unionByName(pending)
    if keep_first:
        firsts = drop.groupBy("h", "g").agg(F.min(F.struct("doc_id", "copy", "pos")).alias("f"))
        drop = drop.join(firsts.select("f.*"), ["doc_id", "copy", "pos"], "left_anti")
    return drop.select("doc_id", "copy", "pos").distinct()


def bitmaps(lines: DataFrame) -> DataFrame:
    """(doc_id, copy, dropped): zlib-compressed bitmaps over line positions, 1 for a line to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for p in b.column(2).to_pylist():
                bits = np.zeros(max(p) + 1, np.uint8)
                bits[p] = 1
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["doc_id", "copy", "dropped"])

    return lines.groupBy("doc_id", "copy").agg(F.collect_list("pos").alias("p")).mapInArrow(released(run), "doc_id long, copy long, dropped binary")


def _kept(text: str, dropped: bytes | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if dropped is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))
    keep = [x for k, x in enumerate(lines) if k >= len(bits) or not bits[k]]
    return "\n".join(keep), len(lines), len(lines) - len(keep)


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, digest: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row: whole texts without their repeated lines, the others joined by \\n.
    With digest, kept_sha256 instead of text. Null and empty texts are one empty line, which has no key; a text may become
    empty. Repeated rows repeat, each with the same lines; an empty table gives no rows. Other columns, whatever their names,
    are left out but for those to carry."""
    maps = bitmaps(repeated_lines(docs, min_docs, min_chars, keep_first))
    name = "kept_sha256" if digest else "text"
    rows = _rows(docs, carry).join(maps, ["doc_id", "copy"], "left").select("doc_id", "text", "dropped", *["carry"] * bool(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                done = [_kept(t, m) for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                last = [hashlib.sha256(t.encode()).hexdigest() if digest else t for t, _, _ in done]
                cols = [part.column(0), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array(last, pa.string()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", name, *["carry"] * (len(cols) - 4)])

    schema = StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add(name, "string")
    return uncarried(rows.mapInArrow(released(run), StructType(schema.fields + rows.schema.fields[3:])))


ORACLE_OP6 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""
