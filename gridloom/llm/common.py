"""Shared pieces of the training-data operators: input shaping, word hashing over Arrow buffers, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and \t..\r, in both the JVM and numpy forms below.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Arrow text is hashed in blocks of whole documents of about this size, which bounds numpy's memory.
BLOCK_BYTES = 1 << 20
#: Texts are tokenised together up to about so many bytes: their distinct words are looked up once, and memory follows this, not the batch.
TOGETHER = 2 << 20
#: Arrow batches hold about so many bytes unless the session says otherwise, so that a Python worker's memory follows neither the
#: number of rows nor their length; a longer text stands alone.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word over so many bytes is hashed by xxh64 instead of the column-wise loop.
LONG_WORD = 48

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_LOW_BYTES = bytes(int(x) for x in _LOW)
_FNV, _BASIS = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, carry: Sequence[str] = (), nulls: bool = False) -> DataFrame:
    """Only the two columns the text operators use: other columns, whatever their names, never reach a plan, but for a struct
    `carry` of those named. Null texts are empty, unless `nulls` leaves them. Sets the session's BATCH_SETTING where it is unset."""
    session = docs.sparkSession
    if not session._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        session.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    both = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"] if nulls else F.coalesce(docs["text"], F.lit("")).alias("text")]
    return docs.select(*both, *([F.struct(*(docs[c] for c in carry)).alias("carry")] if carry else []))


def uncarried(df: DataFrame) -> DataFrame:
    """df with the columns of `carry` in its place."""
    return df.select(*(c for c in df.columns if c != "carry"), "carry.*") if "carry" in df.columns else df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker hands back what its allocators hold: idle workers stay and count in an executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def crc_mod(doc_id: str, m: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def lowest(rows: int, n: int, *hashed):
    """Whether a row is among about `rows` of n, those whose hash is lowest. The share is of 10**15, so that it is not rounded to nothing for any n in use."""
    parts = 10**15
    return F.pmod(F.xxhash64(*hashed), F.lit(parts)) < (parts if rows >= n else rows * parts // n)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a session on this one machine may go without and gets a folder of its own."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read back: lineage is cut, and its size is known to the planner."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._gridloom_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def few_tasks(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df in about `rows` / `per_task` tasks, if it has more: small tables are not spread over the whole cluster."""
    return df.coalesce(max(1, -(-rows // per_task)))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts (one more entry than rows). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def blocks(offs: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges of rows of about `size` bytes each; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive rows, and each row's range in them. A-Z count as a-z if `lower`."""
    base = offs[0]
    b = raw[base : offs[-1]]
    counts = np.zeros(len(offs), np.int64)
    if not len(b):
        return np.zeros(0, np.uint64), counts
    word = ~_SEP[b]
    first = np.zeros(len(b) + 1, bool)
    first[offs - base] = True
    before = np.empty(len(b), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    lens = ends - starts
    h = np.full(len(starts), _BASIS)
    table = _LOW if lower else np.arange(256, dtype=np.uint64)
    at = np.flatnonzero(lens <= LONG_WORD)
    pos, left, k = starts[at], lens[at], 0
    while len(at):
        h[at] = (h[at] ^ table[b[pos + k]]) * _FNV
        k += 1
        keep = left > k
        at, pos, left = at[keep], pos[keep], left[keep]
    for i in np.flatnonzero(lens > LONG_WORD):
        w = b[starts[i] : ends[i]].tobytes()
        h[i] = xxhash.xxh64_intdigest(w.translate(_LOW_BYTES) if lower else w, seed=7)
    counts[:] = np.searchsorted(starts, offs - base)
    return mix(h), counts


_COEF = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles, in order and with repeats; fewer words make one shingle; none make none."""
    counts = np.diff(at)
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(per)), per)
    start = at[row] + np.arange(out[-1]) - out[row]
    end = at[row + 1]
    s = np.zeros(len(row), np.uint64)
    for k in range(n):
        p = start + k
        ok = p < end
        s[ok] += words[p[ok]] * _COEF[k]
    return mix(s + np.minimum(end - start, n).astype(np.uint64)), out
