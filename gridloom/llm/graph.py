"""Connected components: edges are contracted within tasks; what several tasks share goes through alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, few_tasks, stored, released

#: Edges that one task contracts: 16 bytes each, and about ten times that while it works.
TASK_EDGES = 1_000_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in the edges (a, b), and the least id that each reaches by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root, up := root[root]):
            root = up


def _contract(whole: bool):
    """Stars of each task's edges, a few million edges at a time; with the centres themselves if `whole`."""

    def out(ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        keep = np.ones(len(ids), bool) if whole else ids != low
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(low[keep], pa.int64())], ["id", "component"] if whole else ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, low, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > TASK_EDGES:
                ids, low = contracted(np.concatenate([ids, *(h[0] for h in held)]), np.concatenate([low, *(h[1] for h in held)]))
                held, n = [], 0
                if not whole and len(ids) > 2 * TASK_EDGES:
                    yield out(ids, low)
                    ids, low = ids[:0], low[:0]
        if held or len(ids):
            yield out(*contracted(np.concatenate([ids, *(h[0] for h in held)]), np.concatenate([low, *(h[1] for h in held)])))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component), a stored table, for every id in edges (a, b): component is the least id reachable. No neighbour list
    is ever collected; one task alone settles them only while at most TASK_EDGES are left. No edges give no rows."""
    e = stored(edges.select("a", "b").mapInArrow(released(_contract(False)), "u long, v long"))
    n, mark = e.count(), None
    while n > TASK_EDGES:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.mapInArrow(released(_contract(False)), "u long, v long").distinct())
        dropped(e)
        e = now
        found = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        n, mark = found[0], found
    if n <= TASK_EDGES:
        out = stored(few_tasks(e, 1, 1).mapInArrow(released(_contract(True)), "id long, component long"))
    else:
        out = stored(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
    dropped(e)
    return out
