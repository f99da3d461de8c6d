"""Operator 9: byte-level BPE by a lazily determinised transducer, and streaming decoding.

Every string has exactly one tokenisation whose neighbouring tokens are each what BPE makes of their joined bytes. So
the last token of every prefix follows from the last tokens of shorter prefixes. The merges compile into an automaton
whose state is the longest suffix read that begins a token, and whose output is the tokens that end there; its states
and moves are built when first needed. Of the tokens that end at a byte, the one that fits the token before it is the
last of that prefix. Any later token starts within the state's suffix, so that what all ways back from there share is
settled: that is emitted, and no more than a few times the longest token is ever held. Pieces up to that size are read
many at a time, a byte of each per step, through the same automaton as one table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import TOGETHER, blocks, id_text, released, text_buffers

#: Table sizes; a full one is emptied, which costs time and changes no result.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 32_768, 400_000, 200_000
#: Pairs held as arrays are 2 to this power; one more takes the place of another.
PLACE_BITS = 20
#: Bytes held before settled tokens are looked for.
HOLD = 512
#: The characters of White_Space, which \s names in the splitting pattern.
SPACES = r"\t-\r \x85\xa0  -     　"
#: Texts are cut before a newline or space that something else than white space follows: the pattern always ends a match there,
#: and what it finds on either side does not depend on the other. Bytes that may begin white space are as good as white space here.
_GAP, _MAYBE_SPACE = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[10, 32]] = _MAYBE_SPACE[[9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Bytes by kind. Those of two-byte letters are letters where all characters with that first byte are, or all but \xd7 and \xf7.
LETTER, DIGIT, MARK, GAP, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = MARK
_KIND[ord("'")], _KIND[_GAP] = ODD, GAP
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[0x80:0xC0] = DIGIT, LETTER, LETTER, LETTER
_KIND[[0xC3] + [x for x in range(0xC4, 0xE0) if all(regex.match(r"\p{L}", bytes([x, y]).decode()) for y in range(0x80, 0xC0))]] = LETTER
#: A piece over so many bytes is encoded but not remembered.
LONG_PIECE = 64
#: Pieces are encoded together up to about so many bytes.
GROUP_BYTES = 1 << 18


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, hold: int = HOLD):
        self.ranks, self.max_states, self.hold = ranks, max_states, hold
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        self.sizes[list(self.lengths)] = list(self.lengths.values())
        self.keys, self.oks = np.full(1 << PLACE_BITS, -1, np.int64), np.zeros(1 << PLACE_BITS, bool)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.suffixes: list[bytes] = [b""]
        self.moves: list[dict[int, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        # The same as arrays: moves by state and byte, where a state's ends begin, and all ends one after another.
        self.table, self.at = np.full((1024, 256), -1, np.int32), np.zeros(1024, np.int64)
        self.end_tokens: list[int] = []

    def _build(self, state: int, byte: int) -> int:
        tail = self.suffixes[state] + bytes([byte])
        while tail not in self.starts:
            tail = tail[1:]
        if (s := self.ids.get(tail)) is None:
            s = self.ids[tail] = len(self.suffixes)
            self.suffixes.append(tail)
            self.moves.append({})
            self.ends.append(tuple((self.ranks[tail[j:]], len(tail) - j) for j in range(len(tail)) if tail[j:] in self.ranks))
            if s == len(self.at):
                self.table, self.at = np.vstack([self.table, np.full_like(self.table, -1)]), np.concatenate([self.at, self.at])
            self.at[s] = len(self.end_tokens)
            self.end_tokens += [t for t, _ in self.ends[s]]
        self.moves[state][byte] = self.table[state, byte] = s
        return s

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """BPE as its definition has it, by merges of a rank under `below`: the lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def half(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes t, or (-1, -1) for a byte."""
        if (h := self.halves.get(t)) is None:
            parts = self.merged(self.tokens[t], t) if self.lengths[t] > 1 else []
            h = self.halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return h

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: undoing their merges, latest first, no merge across the gap comes before the one undone."""
        key = a << 32 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            limit, x, y = 1 << 60, a, b
            while True:
                if self.ranks.get(self.tokens[x] + self.tokens[y], 1 << 60) < limit:
                    ok = False
                    break
                single_x, single_y = self.half(x)[1] < 0, self.half(y)[0] < 0
                if single_x and single_y:
                    ok = True
                    break
                # Of equal merges the left one goes first, so that the right one is undone first.
                if single_y or not single_x and x > y:
                    limit, x = x, self.half(x)[1]
                else:
                    limit, y = y + 1, self.half(y)[0]
            self.pairs[key] = ok
        return ok

    def fit(self, keys: np.ndarray) -> np.ndarray:
        """fits() of many pairs. Each has one place in the arrays, which it may lose to another."""
        place = self._place(keys)
        ok = self.oks[place]
        if len(lack := np.flatnonzero(self.keys[place] != keys)):
            new, back = np.unique(keys[lack], return_inverse=True)
            oks = np.array([self.fits(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            at, ok[lack] = self._place(new), oks[back]
            self.keys[at], self.oks[at] = new, oks
        return ok

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)

    def encode_many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers. None is empty."""
        out: dict[bytes, bytes] = {}
        short = []
        for p in pieces:
            if len(p) > self.hold:
                out[p] = np.array(self.encode(p), "<u4").tobytes()
            else:
                short.append(p)
        short.sort(key=len, reverse=True)
        i = 0
        while i < len(short):
            j, size = i, 0
            while j < len(short) and size < GROUP_BYTES:
                size += len(short[j])
                j += 1
            self._encode_block(short[i:j], out)
            i = j
        return out

    def _encode_block(self, pieces: list[bytes], out: dict[bytes, bytes]) -> None:
        """Pieces by falling length, so that those that have a k-th byte come first."""
        if len(self.suffixes) > self.max_states:
            self.reset()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lens) - lens
        states, last = np.zeros(len(pieces), np.int64), np.zeros(len(data), np.int64)
        ends = np.array(self.end_tokens, np.int64)
        for k in range(int(lens[0])):
            m = int(np.searchsorted(-lens, -k))
            at, now = starts[:m] + k, states[:m]
            byte = data[at]
            to = self.table[now, byte].astype(np.int64)
            if len(lack := np.flatnonzero(to < 0)):
                for key in np.unique(now[lack] << 8 | byte[lack]).tolist():
                    self._build(key >> 8, key & 255)
                to[lack] = self.table[now[lack], byte[lack]]
            states[:m] = to
            if len(ends) < len(self.end_tokens):
                ends = np.concatenate([ends, np.array(self.end_tokens[len(ends) :], np.int64)])
            first, left = self.at[to], np.arange(m)
            while len(left):
                t = ends[first[left]]
                before = k - self.sizes[t]
                ok = before < 0
                if len(inner := np.flatnonzero(~ok)):
                    ok[inner] = self.fit(last[starts[left[inner]] + before[inner]] << 32 | t[inner])
                last[at[left[ok]]] = t[ok]
                left = left[~ok]
                first[left] += 1
        used, j, rows = np.zeros(len(data), bool), lens.copy(), np.arange(len(pieces))
        while len(rows):
            p = starts[rows] + j[rows] - 1
            used[p] = True
            j[rows] -= self.sizes[last[p]]
            rows = rows[j[rows] > 0]
        ids, to = last[used].astype("<u4").tobytes(), (4 * np.cumsum(np.add.reduceat(used, starts, dtype=np.int64))).tolist()
        a = 0
        for p, b in zip(pieces, to):
            out[p] = ids[a:b]
            a = b

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) > self.hold:
            return [t for part in self.stream(piece) for t in part]
        last: list[int] = []
        self._read(0, piece, last, -1)
        return self._path(last, len(last))

    def _read(self, state: int, data: bytes, last: list[int], sent: int) -> int:
        """Append the last tokens of the prefixes that end in data; sent is the token emitted before those in `last`."""
        if len(self.suffixes) > self.max_states:
            tail = self.suffixes[state]
            self.reset()
            state = 0
            for byte in tail:
                state = self._build(state, byte)
        moves, ends, known, fits, i = self.moves, self.ends, self.pairs.get, self.fits, len(last)
        for byte in data:
            s = moves[state].get(byte)
            state = self._build(state, byte) if s is None else s
            i += 1
            for t, n in ends[state]:
                if n >= i:
                    if n > i:
                        continue
                    a = sent
                    if a < 0:
                        break
                else:
                    a = last[i - n - 1]
                ok = known(a << 32 | t)
                if ok or ok is None and fits(a, t):
                    break
            last.append(t)
        return state

    def _path(self, last: list[int], j: int) -> list[int]:
        out, lengths = [], self.lengths
        while j:
            out.append(t := last[j - 1])
            j -= lengths[t]
        out.reverse()
        return out

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one piece of any length, emitted as they are settled."""
        state, last, sent = 0, [], -1
        for k in range(0, len(data), self.hold):
            state = self._read(state, data[k : k + self.hold], last, sent)
            i = len(last)
            ways = set(range(max(0, i - len(self.suffixes[state])), i + 1))
            while len(ways) > 1:
                ways.remove(j := max(ways))
                ways.add(j - self.lengths[last[j - 1]])
            if settled := ways.pop():
                out = self._path(last, settled)
                yield out
                sent, last = out[-1], last[settled:]
        yield self._path(last, len(last))


class Utf8Stream:
    """Bytes to text piecemeal: a state machine over UTF-8 whose state is how many bytes of the open character came."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def pending(data: bytes) -> int:
        """Bytes at the end that begin a character and do not finish it."""
        for k in range(1, min(3, len(data)) + 1):
            c = data[-k]
            if c & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= c <= 0xDF else 3 if 0xE0 <= c <= 0xEF else 4 if 0xF0 <= c <= 0xF4 else 1
            return k if need > k else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        k = self.pending(data)
        self.open, data = (data[-k:], data[:-k]) if k else (b"", data)
        return data.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.fst, self.max_pieces = Transducer(ranks), max_pieces
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACES}").replace(r"\s", rf"[{SPACES}]").replace(r"\S", rf"[^{SPACES}]"))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        table = [b""] * (max(self.fst.tokens) + 1)
        for i, t in self.fst.tokens.items():
            table[i] = t
        self.table = pa.array(table, pa.large_binary())

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, each given once."""
        if len(self.known) >= self.max_pieces:
            # Pieces that are met again move over from the older half.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = [known.get(p) for p in pieces]
        lack = [k for k, x in enumerate(out) if x is None]
        new = [k for k in lack if pieces[k] not in older]
        ids = self.fst.encode_many([pieces[k] for k in new])
        for k in lack:
            p = pieces[k]
            out[k] = x = ids[p] if p in ids else older[p]
            if len(p) <= LONG_PIECE:
                known[p] = x
        return out

    @staticmethod
    def _strange(segments: pa.Array) -> np.ndarray:
        """Which segments have more than known kinds of characters, with at most one space or newline in front."""
        raw, offs = _buffers(segments)
        first, kind = offs[:-1], _KIND[raw]
        odd = kind >= GAP
        odd[first] = kind[first] == ODD
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        return np.add.reduceat(odd, first, dtype=np.int64) > 0

    @staticmethod
    def _runs(segments: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of segments that are not strange, one after another, and where each segment's end: runs of one kind, a space with what follows it."""
        raw, offs = _buffers(segments)
        kind, start = _KIND[raw], np.ones(len(raw) + 1, bool)
        start[1:-1] = kind[1:] != kind[:-1]
        start[offs[:-1][raw[offs[:-1]] == 32] + 1] = False
        start[offs] = True
        at = np.flatnonzero(start)
        return _binary(raw, at), np.searchsorted(at, offs[1:])

    def _ids(self, segments: pa.Array) -> pa.Array:
        """The ids of each segment; pieces of strange ones are found by the pattern."""
        strange = self._strange(segments)
        rest = [[p.encode() for p in self.pattern.findall(s.decode())] for s in segments.filter(pa.array(strange)).to_pylist()]
        pieces, ends = self._runs(segments.filter(pa.array(~strange)))
        coded = pa.concat_arrays([pieces, pa.array([p for r in rest for p in r], pa.large_binary())]).dictionary_encode()
        _, offsets, data = pa.array(self._found(_listed(coded.dictionary)), pa.large_binary()).take(coded.indices).buffers()
        at = np.concatenate([[0], ends, len(pieces) + np.cumsum(list(map(len, rest)), dtype=np.int64)])
        listed = _binary(data, np.frombuffer(offsets, np.int64)[at])
        return listed.take(pa.array(np.where(strange, len(ends) + np.cumsum(strange), np.cumsum(~strange)) - 1))

    def encode_all(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return
        raw, offs = text_buffers(column)
        for i, j in blocks(offs, TOGETHER):
            b, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if not len(b):
                yield from [b""] * (j - i)
                continue
            # Segments begin at rows and at cuts; the end of a row is no cut.
            cut = np.zeros(len(b) + 1, bool)
            cut[: len(b) - 1] = _GAP[b[:-1]] & ~_MAYBE_SPACE[b[1:]]
            cut[at[1:][at[1:] > 0] - 1] = False
            cut[at] = True
            starts = np.flatnonzero(cut)
            segments = _binary(b, starts).dictionary_encode()
            _, offsets, data = self._ids(segments.dictionary).take(segments.indices).buffers()
            ends = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, at)].tolist()
            for x, y in zip(ends, ends[1:]):
                yield data[x:y].to_pybytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text as it becomes certain; bytes that are not UTF-8 come as U+FFFD."""
        stream, table = Utf8Stream(), self.table
        ids = ids if isinstance(ids, np.ndarray) else np.array(list(ids), np.int64)
        for k in range(0, len(ids), chunk):
            yield stream.feed(table.take(pa.array(ids[k : k + chunk])).buffers()[2].to_pybytes())
        yield stream.close()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each row starts and the last one ends; rows as they come from a filter or a dictionary."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] else np.zeros(0, np.uint8), offs - offs[0]


def _binary(data: np.ndarray | pa.Buffer, at: np.ndarray) -> pa.Array:
    """Parts of data, each from one place of `at` to the next."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def _listed(column: pa.Array) -> list[bytes]:
    raw, offs = _buffers(column)
    data, offs = raw.tobytes(), offs.tolist()
    return [data[x:y] for x, y in zip(offs, offs[1:])]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker. The file is read where the package is installed, on every machine."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Codec(ranks, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids binary): every whole text's ids as little-endian unsigned 32-bit integers. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(c.encode_all(b.column(1))), pa.binary())], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, ids binary")


def decoded(ids: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(name))
        for b in batches:
            texts = ["".join(c.decode(np.frombuffer(x or b"", "<u4"))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids of every text and the text decoded from them, as digests, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(name))
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in c.encode_all(b.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in c.decode(np.frombuffer(ids, "<u4")):
                    digest.update(part.encode())
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
