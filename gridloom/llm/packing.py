"""Operator 10: best-fit packing of tokenised documents, improved by swaps between underfull bins.

Documents are tokenised where they lie. Only (doc_id, piece, length) is dealt into shards of bounded size, each packed by
itself: best fit, longest first; then local search over all underfull bins: an item moves, two items change places, or one
item is exchanged for two, whenever the sum of squared fills grows, until no such change is left.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import TOGETHER, blocks, id_text, released, stored, text_buffers

CAPACITY, END = 4096, 1
#: Pieces packed together by one task. Each shard may end with one bin that is not full, so more costs memory and saves bins.
SHARD_PIECES = 32_768
#: Marks that end a piece within a chunk and a piece at the end of one; no chunk has them.
INNER, OUTER = b" ", b"\n"
_LETTERS, _MARKS = "ßàâäçèéêëíîïñóôöùúûüœá", ".,;:!?#*$%&()=-+_/\"@"
_PLAIN = "^[a-zA-Z0-9" + re.escape(_MARKS) + _LETTERS + _LETTERS.replace("ß", "").upper() + "]+$"
#: Bytes by kind: digits 1, marks 2, the end of a chunk 3, letters (and the bytes of those that have two) 0.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"0123456789")], _KIND[list(_MARKS.encode())], _KIND[list(OUTER)] = 1, 2, 3


class WordTokenizer:
    """Ids by distinct chunks free of white space; a text's ids are its chunks' ids, since no token spans white space."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Merges with word ends, as ranks over bytes: INNER or OUTER stands for the end and joins its byte first. Every rank
        # is there twice, so that the last token of a chunk is known by its own: an odd one.
        model = json.load(open(path, encoding="utf-8"))["model"]
        raw, ends = {bytes([b]): 60_000 + b for b in range(256)}, {bytes([b]): b for b in range(256)}
        back = {c: b for b, c in _byte_alphabet().items()}
        for k, m in enumerate(model["merges"]):
            t = "".join(m.split(" ") if isinstance(m, str) else m)
            (ends if t.endswith("</w>") else raw).setdefault(bytes(back[c] for c in t.removesuffix("</w>")), 1000 + k)
        ranks = {t: 2 * r for t, r in raw.items()} | {t + INNER: 2 * r for t, r in ends.items()} | {t + OUTER: 2 * r + 1 for t, r in ends.items()}
        self.ids = np.zeros(max(ranks.values()) + 1, "<u4")
        for s, i in model["vocab"].items():
            if not s.startswith("<|"):
                t = bytes(back[c] for c in s.removesuffix("</w>"))
                for r in [ranks.get(t + INNER), ranks.get(t + OUTER)] if s.endswith("</w>") else [ranks.get(t)]:
                    if r is not None:
                        self.ids[r] = i
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^ \n]+[ \n]", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks of plain letters, digits and marks one after another, by the ranks, and where each chunk's end."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(chunks)], chunks), OUTER.decode())[0].as_py() + OUTER.decode()
        b = np.frombuffer(joined.lower().encode(), np.uint8)
        kind = _KIND[b]
        # Letters make pieces as long as they go, and marks; each digit is one. OUTER ends the last piece of a chunk.
        inner = np.flatnonzero(((kind[:-1] != kind[1:]) | (kind[:-1] == 1)) & (kind[:-1] != 3) & (kind[1:] != 3))
        out = np.insert(b, inner + 1, INNER[0])
        tokens = np.frombuffer(self.bpe(out.tobytes().decode(), set()), np.uint32)
        return self.ids[tokens], np.flatnonzero(tokens & 1) + 1

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk; those that are not plain are left to the library."""
        plain = pc.match_substring_regex(chunks, _PLAIN)
        rest = [e.ids for e in self.tok.encode_batch(chunks.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        mask, lens = plain.to_numpy(zero_copy_only=False), np.array(list(map(len, rest)), np.int64)
        own, ends = self._plain(chunks.filter(plain)) if mask.any() else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        ids = np.concatenate([own, np.array([i for r in rest for i in r], "<u4")])
        listed = _binary(ids, np.concatenate([[0], ends, len(own) + np.cumsum(lens)]))
        place = np.where(mask, np.cumsum(mask) - 1, len(ends) + np.cumsum(~mask) - 1)
        return listed.take(pa.array(place))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(column)
        at, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(column)
        found = self._chunks(coded.dictionary).take(coded.indices)
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int64)[at - at[0]].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]


def _binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Parts of ids, each from one place of `at` to the next, as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids)])


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's ids and the end id, cut at every `capacity`.
    Null and empty texts are the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        tok, tail = tokenizer(public_tokenizers.path(name)), np.array([end], "<u4").tobytes()
        for b in batches:
            for i, j in blocks(text_buffers(b.column(1))[1], TOGETHER) if b.num_rows else ():
                part, out = b.slice(i, j - i), []
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1))):
                    ids += tail
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        out.append((doc, p, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names[: 5 + with_ids])

    return id_text(docs).mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths: best fit decreasing, then local search."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that have bins
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            room, b = capacity, len(bins)
            bins.append([i])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            bins[b].append(i)
            if not by_room[room]:
                rooms.pop(k)
        if left := room - n:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return improve(bins, lengths, capacity)


class _Offers:
    """What the underfull bins can give, by length: for each length of an item (or sum of a pair) of a bin, the bins that have it, emptiest first.

    A bin of distinct lengths holds at most about 90 of them, so its pairs have at most some 4,000 sums."""

    def __init__(self, bins: int, capacity: int):
        self.n = bins
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]  # sorted fill * n + bin
        self.none = 1 << 40
        self.least, self.second = np.full(capacity + 1, self.none), np.full(capacity + 1, self.none)
        self.owner = np.full(capacity + 1, -1)

    def put(self, b: int, fill: int, sums: set[int], add: bool) -> None:
        key, n = fill * self.n + b, self.n
        for v in sums:
            own = self.by[v]
            if add:
                insort(own, key)
            else:
                own.pop(bisect_left(own, key))
            if not own:
                self.least[v], self.owner[v], self.second[v] = self.none, -1, self.none
            else:
                self.least[v], self.owner[v] = divmod(own[0], n)
                self.second[v] = own[1] // n if len(own) > 1 else self.none

    def best(self, b: int, fill: int, back: int, gain: int, room: int) -> tuple[int, int]:
        """(gain, bin) of the largest gain of more than `gain` and at most `room` for b, which gives `back` in return."""
        at = slice(back + gain + 1, back + room + 1)
        owner = self.owner[at]
        low = np.where(owner == b, self.second[at], self.least[at])
        ok = (low < np.arange(fill + gain + 1, fill + gain + 1 + len(low))).nonzero()[0]
        if not len(ok):
            return 0, -1
        own = self.by[back + gain + 1 + int(ok[-1])]
        a = own[0] % self.n
        return gain + 1 + int(ok[-1]), own[1] % self.n if a == b else a


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Between any two underfull bins an item moves, two change places, or one is exchanged for two, whichever fills the receiving
    bin most, as long as the sum of squared fills grows; until no such change is left or no fewer bins are possible."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least, left = -(-sum(fill) // capacity), sum(map(bool, bins))
    if left <= least:
        return [b for b in bins if b]
    one, two = _Offers(len(bins), capacity), _Offers(len(bins), capacity)
    singles: list[set[int]] = [set()] * len(bins)
    pairs: list[set[int]] = [set()] * len(bins)

    def index(k: int, add: bool) -> None:
        if 0 < fill[k] < capacity:
            if add:
                n = sorted(lengths[i] for i in bins[k])
                singles[k] = set(n)
                pairs[k] = {x + y for x in singles[k] for y in singles[k] if x < y} | {2 * x for x, y in zip(n, n[1:]) if x == y}
            one.put(k, fill[k], singles[k], add)
            two.put(k, fill[k], pairs[k], add)

    for k in range(len(bins)):
        index(k, True)
    changed = True
    while changed and left > least:
        changed = False
        for b in sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k)):
            while 0 < fill[b] < capacity and left > least and (change := _change(b, fill[b], capacity - fill[b], one, two, singles[b], pairs[b])):
                gain, a, give, n_give, take, n_take = change
                index(a, False)
                index(b, False)
                go, come = _items(bins[a], lengths, give, n_give), _items(bins[b], lengths, take, n_take)
                bins[a] = [i for i in bins[a] if i not in go] + come
                bins[b] = [i for i in bins[b] if i not in come] + go
                fill[a] -= gain
                fill[b] += gain
                index(a, True)
                index(b, True)
                left -= not bins[a]
                changed = True
    return [b for b in bins if b]


def _change(b: int, fill: int, room: int, one: _Offers, two: _Offers, singles: set[int], pairs: set[int]) -> tuple[int, int, int, int, int, int] | None:
    """The change that fills b most: (gain, other bin, what that gives, in how many items, what b gives back, in how many)."""
    best = 0, -1, 0, 0, 0, 0
    for offers, n_give, backs, n_back in ((one, 1, (0,), 0), (one, 1, singles, 1), (two, 2, singles, 1), (one, 1, pairs, 2)):
        for y in backs:
            if best[0] == room:
                return best
            gain, a = offers.best(b, fill, y, best[0], room)
            if gain:
                best = gain, a, y + gain, n_give, y, n_back
    return best if best[0] else None


def _items(items: list[int], lengths: list[int], total: int, count: int) -> list[int]:
    """`count` of the items, up to two, that make `total` together."""
    if count == 0:
        return []
    if count == 1:
        return [next(i for i in items if lengths[i] == total)]
    seen: dict[int, int] = {}
    for i in items:
        if (other := seen.get(total - lengths[i])) is not None:
            return [other, i]
        seen[lengths[i]] = i
    raise AssertionError("no such pair")


def packed(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length.

    Full pieces are sequences of their own, numbered below zero by their place in the table, and are not shuffled with the
    rest; nothing but lengths and ids moves. Shards are dealt by place too, so that repeated rows spread over all of them and
    share no sequence by chance. parts must be a table that is read in the same order again (a stored one)."""
    cols = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    shards = max(1, -(-parts.filter(F.col("length") < capacity).count() // shard_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], ignore_index=True)
        shard = int(pdf["shard"].iloc[0])
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        lengths = pdf["length"].tolist()
        if lengths and shard < 0:
            raise ValueError("full pieces need no packing")
        for k, b in enumerate(pack(lengths, capacity)):
            at = 0
            for i in b:
                seq[i], off[i] = (shard << 32) + k, at
                at += lengths[i]
        return pdf.assign(sequence_id=seq, offset=off)[[*cols, "sequence_id", "offset"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in cols) + ", sequence_id long, offset long"
    short = parts.filter(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    full = parts.filter(F.col("length") >= capacity).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.groupBy("shard").applyInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document; null and empty texts
    are the end id alone, repeated rows are packed each for itself, an empty table gives no rows.

    The pieces are stored (a few numbers each), so that texts are tokenised once, however long."""
    return packed(stored(pieces(docs)))
