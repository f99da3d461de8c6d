"""Operator 2: near duplicates by bottom-k sketches of one hash function.

Documents with equal shingle sets are first collapsed into classes. A class's sketch is its K lowest shingle hashes. Inverted
lists are keyed by retained values, of each class by the rarest among its INDEX lowest: linked classes share so many of those
that they meet in a list of a rare one. Pairs that meet are counted (their overlap); union sketches then estimate them, full
sets decide, and components follow: first each class is compared with the partner of most overlap, then only what is still
apart. Lists up to LIST classes give all their pairs; in longer ones a class first meets the list's pivot and its neighbours
by size, and what that leaves out is compared afterwards, block by block, where it could still join components.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, dropped, id_text, shingle_hashes, stored, text_buffers, word_hashes, released
from gridloom.llm.graph import components

WORDS, PERCENT = 5, 80
#: Values of a sketch, and those of them that may key inverted lists.
K, INDEX = 64, 32
#: Chances to overlook a link of just the least similarity: in the lists, and by the estimate.
LISTS_MISS, ESTIMATE_MISS = 1e-9, 1e-8
LIST, NEAR = 32, 2
#: Classes and shingles of a block of a long list: they bound a task's memory.
CELL_ROWS, CELL_SHINGLES = 2048, 1 << 20
#: Lists over this share of all entries, and over HOT_LEAST, are dealt over several tasks; there are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_LEAST, HOT_PARTS = 1e-4, 4096, 64
#: Pairs of one class that meet in one task; a class with more is copied to several.
PAIRS = 1000
_MAX = np.uint64(2**64 - 1)


def least_common(k: int, percent: int, miss: float) -> int:
    """So many of the lowest k values of a union are common to both sets, if percent of all are, but for a chance of `miss`."""
    p, tail = percent / 100, 0.0
    for x in range(k + 1):
        tail += comb(k, x) * p**x * (1 - p) ** (k - x)
        if tail > miss:
            return max(1, x)
    return k


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    raw, offs = text_buffers(column)
    for i, j in blocks(offs):
        s, at = shingle_hashes(*word_hashes(raw, offs[i : j + 1]), words)
        for k in range(j - i):
            yield np.unique(s[at[k] : at[k + 1]])


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, sig, sketch): the size, a 128-bit signature and the K lowest hashes of each whole text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, low = [], [], []
            for s in _sets(b.column(1), words):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(s[:K].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])

    return id_text(docs).mapInArrow(released(run), "doc_id long, n_shingles long, sig binary, sketch binary")


def entries(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, id, n): of each class (id, n, sketch) its rarest values among the INDEX lowest, as many as must hold one that a
    linked class retains too (the prefix filter: all order values by frequency, then by value). Values of one class only,
    and classes that share too few values with any other, are left out."""
    least = least_common(INDEX, percent, LISTS_MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [np.frombuffer(x, np.int64)[:INDEX] for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(low)), [len(v) for v in low]))
            key = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["key", "id", "n"])

    every = classes.select("id", "n", "sketch").mapInArrow(released(run), "key long, id long, n long")
    often = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    mine = Window.partitionBy("id")
    size = F.least(F.col("n"), F.lit(INDEX))
    # The whole of a linked set is among the values only if it has at most INDEX itself.
    need = F.when(F.col("n") * 100 <= INDEX * percent, F.ceil(F.col("n") * percent / 100)).otherwise(least)
    ranked = every.join(often, "key").withColumn("own", F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("c", "key")))
    return ranked.filter((F.col("own") >= need) & (size - F.col("own") + F.col("rank") <= size - need + 1)).select("key", "id", "n")


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, first, near, held, a, b = None, None, deque(maxlen=NEAR), [], [], []

        def pair(x: tuple[int, int], y: tuple[int, int]) -> None:
            if x[0] != y[0] and 100 * min(x[1], y[1]) >= percent * max(x[1], y[1]):
                a.append(min(x[0], y[0]))
                b.append(max(x[0], y[0]))

        for batch in batches:
            for key, salt, i, n, hot, hot_n in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (key, salt) != run_key:
                    run_key, held, first = (key, salt), [], (hot, hot_n) if hot is not None else (i, n)
                    near.clear()
                x = i, n
                if hot is None and len(held) < LIST:
                    for y in reversed(held):
                        if 100 * y[1] < percent * n:
                            break
                        pair(x, y)
                    held.append(x)
                else:
                    for y in near:
                        pair(x, y)
                    pair(x, first)
                near.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []

    return run


def long_lists(entries: DataFrame) -> DataFrame:
    """(key, c): inverted lists of over LIST classes."""
    return entries.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > LIST)


def candidates(entries: DataFrame, long: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, overlap), a < b: pairs of classes that meet in inverted lists, and in how many; in a long one, those that meet
    its pivot or are nearby by size."""
    cut = max(HOT_LEAST, int(entries.count() * HOT_SHARE))
    hot = entries.join(F.broadcast(long.filter(F.col("c") > cut).select("key")), "key").groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"))
    hot = hot.select("key", F.col("p.id").alias("hot"), F.col("p.n").alias("hot_n"))
    dealt = entries.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.floor(F.log(1.25, F.col("n").cast("double"))) * HOT_PARTS + F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).cast("int"))
    dealt = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "id").select("key", "salt", "id", "n", "hot", "hot_n")
    return dealt.mapInArrow(released(_pairs(percent)), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("overlap"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """(a, b): for every class in pairs (a, b, overlap) the pair of most overlap; ties go by hash, so that no class attracts all."""
    both = pairs.select("a", "b", "overlap", F.explode(F.array("a", "b")).alias("x"))
    best = both.groupBy("x").agg(F.max(F.struct("overlap", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def _common(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Of each pair of sketches, the common values among the lowest K of their union, scaled to K for small sets."""
    pad = lambda s: np.frombuffer(s.ljust(8 * K, b"\xff"), np.uint64)
    s = np.sort(np.hstack([np.array([pad(v) for v in x]), np.array([pad(v) for v in y])]), axis=1)
    twin = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] != _MAX)
    new = s != _MAX
    new[:, 1:] &= ~twin
    rank = np.cumsum(new, axis=1)
    return (twin & (rank[:, 1:] <= K)).sum(axis=1) * K / np.maximum(1, np.minimum(rank[:, -1], K))


def _with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with both classes' values (id, value). y moves once a pair and x once for PAIRS of its pairs, so that
    a class with very many pairs neither lies in one task nor is copied for each."""
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > PAIRS).select("a", F.ceil(F.col("c") / PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(many, "a", "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int"))
    copies = values.withColumnsRenamed({"id": "a", "value": "x"}).join(many, "a", "left")
    copies = copies.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    with_y = dealt.select("a", "b", "salt").join(values.withColumnsRenamed({"id": "b", "value": "y"}), "b")
    return with_y.join(copies, ["a", "salt"]).select("a", "b", "x", "y")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs that share enough of the lowest K values of their union."""
    least = least_common(K, percent, ESTIMATE_MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                p = b.slice(k, 2048)
                yield p.select([0, 1]).filter(pa.array(_common(p.column(2).to_pylist(), p.column(3).to_pylist()) >= least))

    return _with_values(pairs, classes.select("id", F.col("sketch").alias("value"))).mapInArrow(released(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _with_values(pairs, sets).mapInArrow(released(run), "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, value) of the documents with these ids. ids is a stored table: the planner knows its size, and sends it to the texts
    or shuffles both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _sets(b.column(1), words)], pa.binary())], ["id", "value"])

    texts = id_text(docs).withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")
    return texts.mapInArrow(released(run), "id long, value binary").groupBy("id").agg(F.first("value").alias("value"))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def still_apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(comp.withColumnsRenamed({"id": side, "component": f"c{side}"}), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.filter("ca <> cb").drop("ca", "cb")


def links(docs: DataFrame, classes: DataFrame, found: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, component) by links among the pairs found (a, b, overlap). Each class is compared with the partner of most
    overlap; of the other pairs those still apart are estimated, and again each class compared with one; then all that are left."""
    pick = stored(best_partners(found))
    near = stored(estimated(pick, classes, percent))
    ids = stored(_ids(near))
    sets = stored(full_sets(docs, ids, words))
    sure = stored(verified(near, sets, percent))
    comp = components(sure)
    left = stored(estimated(still_apart(found, comp).join(pick, ["a", "b"], "left_anti").select("a", "b"), classes, percent))
    dropped(pick, near)
    if left.isEmpty():
        dropped(ids, sets, sure, left)
        return comp
    more = stored(_ids(left).join(ids, "id", "left_anti"))
    sets2 = stored(full_sets(docs, more, words).unionByName(sets.join(_ids(left), "id", "left_semi")))
    dropped(ids, sets, more)
    pick = stored(best_partners(left.withColumn("overlap", F.lit(1))))
    sure2 = stored(sure.unionByName(verified(pick, sets2, percent)))
    comp2 = components(sure2)
    last = verified(still_apart(left, comp2).join(pick, ["a", "b"], "left_anti"), sets2, percent)
    out = components(sure2.unionByName(last))
    dropped(sure, comp, left, sets2, pick, sure2, comp2)
    return out


def apart(entries: DataFrame, long: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, component, n, shared, major, sizes): the entries of long lists in which links between components can still be
    found, with the lower ones of such keys of their class (shared). A link that is left was in no list of up to LIST
    classes, and the two classes share one list at least."""
    e = entries.join(long.select("key"), "key").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by = e.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    lists = by.groupBy("key").agg(F.sum("c").alias("m"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "component")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    lists = lists.select("key", F.col("top.component").alias("major"), F.array(F.col("m") - F.col("top.c"), F.col("s") - F.col("top.s"), "top.c", "top.s").alias("sizes"))
    e = e.join(lists, "key").withColumn("shared", F.collect_list("key").over(Window.partitionBy("id")))
    return e.select("key", "id", "component", "n", F.filter("shared", lambda k: k < F.col("key")).alias("shared"), "major", "sizes")


def _bits(rows: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """A row of bits for each of m sets, a bit for each value that several of them have."""
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    bit = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    rows, bit = rows[keep], bit[at[keep]]
    out = np.zeros((m, (int(bit.max()) >> 6) + 1 if len(bit) else 1), np.uint64)
    np.bitwise_or.at(out, (rows, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class _Cell:
    """The classes of one cell: rows (id, component, block, n, shared, values), values being a sketch or a full set."""

    def __init__(self, split: bool, rows: list[tuple], percent: int):
        m = len(rows)
        self.split, self.percent, self.least = split, percent, least_common(K, percent, ESTIMATE_MISS)
        self.root, self.block, self.n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        self.own = self.root.copy()
        self.sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        self.low = np.minimum(self.n, K)
        self.sketch = _bits(np.repeat(np.arange(m), self.low), np.concatenate([s[:K] for s in self.sets]), m)
        before = [np.array(r[4], np.int64) for r in rows]
        self.earlier = _bits(np.repeat(np.arange(m), [len(b) for b in before]), np.concatenate(before), m)

    def near(self, i: int) -> np.ndarray:
        """Later classes of other components that pass the estimate with class i. A pair is compared in the least of the lists that it shares."""
        n, root, at = self.n, self.root, slice(i + 1, None)
        ok = (root[at] != root[i]) & (100 * np.minimum(n[at], n[i]) >= self.percent * np.maximum(n[at], n[i]))
        if self.split:
            ok &= self.block[at] != self.block[i]
        js = np.flatnonzero(ok) + i + 1
        js = js[~(self.earlier[js] & self.earlier[i]).any(axis=1)]
        common = np.bitwise_count(self.sketch[js] & self.sketch[i]).sum(axis=1, dtype=np.int64)
        return js[common * K >= self.least * np.minimum(K, self.low[js] + self.low[i] - common)]

    def possible(self) -> np.ndarray:
        """Which classes have any such partner."""
        out = np.zeros(len(self.root), bool)
        for i in range(len(out) - 1):
            if len(js := self.near(i)):
                out[i] = out[js] = True
        return out

    def links(self) -> Iterator[tuple[int, int]]:
        """Links by full sets, as pairs of components; none that follows from those before."""
        flat = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(self.n)])
        mark = np.zeros(int(flat.max()) + 1, bool)
        for i in range(len(self.root) - 1):
            js = self.near(i)
            if not len(js):
                continue
            mark[flat[start[i] : start[i + 1]]] = True
            both = np.array([np.count_nonzero(mark[flat[start[j] : start[j + 1]]]) for j in js])
            mark[flat[start[i] : start[i + 1]]] = False
            for j in js[100 * both >= self.percent * (self.n[js] + self.n[i] - both)]:
                if self.root[j] != self.root[i]:
                    yield int(self.own[i]), int(self.own[j])
                    self.root[self.root == self.root[j]] = self.root[i]


_CELL = "key long, lo int, hi int, id long, component long, block int, n long, shared array<long>"


def _by_cell(percent: int, verify: bool):
    """Over rows of _CELL with their values, sorted by cell: the rows that may have a link, or links as pairs of components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())]) if verify else pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64()), ("component", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))])

    def settled(cell: tuple, rows: list[tuple]) -> list[tuple]:
        if len({r[1] for r in rows}) < 2:
            return []
        c = _Cell(cell[1] != cell[2], rows, percent)
        return list(c.links()) if verify else [(*cell, *r[:5]) for r, ok in zip(rows, c.possible()) if ok]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for b in batches:
            found: list[tuple] = []
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (key, lo, hi) != cell:
                    found += settled(cell, rows) if cell else []
                    cell, rows = (key, lo, hi), []
                rows.append(tuple(row))
            yield batch(found)
        if cell:
            yield batch(settled(cell, rows))

    return run


def rest(docs: DataFrame, classes: DataFrame, entries: DataFrame, long: DataFrame, comp: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of components with a link that long lists have left out. A list's classes outside its largest component
    are compared with all of its classes of other components. Lists are dealt in blocks of at most about CELL_ROWS classes
    and CELL_SHINGLES shingles, two blocks to a cell. Sketches alone go to the cells; full sets follow only for classes that
    pass the estimate with another there. A cell hands on fewer pairs than it has classes."""
    e = stored(apart(entries, long, comp))
    blocks_of = lambda c, s: F.greatest(F.lit(1), F.ceil(F.col("sizes")[c] / CELL_ROWS), F.ceil(F.col("sizes")[s] / CELL_SHINGLES)).cast("int")
    one = (F.col("sizes")[0] + F.col("sizes")[2] <= CELL_ROWS) & (F.col("sizes")[1] + F.col("sizes")[3] <= CELL_SHINGLES)
    cells = e.withColumn("minors", blocks_of(0, 1)).withColumn("majors", blocks_of(2, 3)).withColumn("h", F.xxhash64("id"))
    cells = cells.withColumn("block", F.when(one, 0).when(F.col("component") == F.col("major"), F.col("minors") + F.pmod("h", F.col("majors"))).otherwise(F.pmod("h", F.col("minors"))).cast("int"))
    others = F.when(F.col("block") >= F.col("minors"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    pair = F.transform(F.when(one, F.array(F.lit(0))).otherwise(others), lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi")))

    def dealt(rows: DataFrame, values: DataFrame) -> DataFrame:
        got = rows.join(values, "id").select("key", F.explode("cells").alias("cell"), "id", "component", "block", "n", "shared", "value")
        got = got.select("key", "cell.lo", "cell.hi", "id", "component", "block", "n", "shared", "value")
        return got.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    rows = cells.select("key", "id", "component", "block", "n", "shared", pair.alias("cells"))
    near = stored(dealt(rows, classes.select("id", F.col("sketch").alias("value"))).mapInArrow(released(_by_cell(percent, False)), _CELL))
    sets = stored(full_sets(docs, near.select("id").distinct(), words))
    out = stored(dealt(near.withColumn("cells", F.array(F.struct("lo", "hi"))), sets).mapInArrow(released(_by_cell(percent, True)), "a long, b long"))
    dropped(e, near, sets)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents are linked if 100 * |A & B| >= percent * |A | B| over
    their sets of word shingles (A-Z as a-z; fewer words make one shingle). Texts without words, null ones too, stand alone.
    Rows that repeat a doc_id repeat in the result; an empty table gives none. Other columns are not read, whatever their
    names. Whole texts are hashed, however long. Shingles are compared as 64-bit hashes."""
    sk = stored(sketches(docs, words))
    classes = stored(sk.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")))
    lists = stored(entries(classes, percent))
    long = stored(long_lists(lists))
    found = stored(candidates(lists, long, percent))
    comp = links(docs, classes, found, words, percent)
    dropped(found)
    of = classes.select("sig", "id").join(comp, "id", "left").select("sig", F.coalesce("component", "id").alias("component"))
    if not long.isEmpty():
        joined = components(rest(docs, classes, lists, long, comp, words, percent))
        of = of.join(joined.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left").select("sig", F.coalesce("low", "component").alias("component"))
    of = stored(of)
    dropped(classes, lists, long, comp)
    out = sk.select("doc_id", "n_shingles", "sig").join(of, "sig", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
