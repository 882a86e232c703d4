"""Connected components as distributed union-find, for operators 3 and 7.

Every partition first unites its own edges (a union-find in the task's memory, flushed at a bound), which turns them
into a forest; then large-star and small-star steps, each one grouping and one join of narrow rows, hang every node on
its component's smallest one.  Nothing is collected; each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import release, written

#: Edges that a task unites at once.
TASK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with root the smallest node that the edges connect it to, for every node that is not its own root."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            break
        low, high = np.minimum(px, py), np.maximum(px, py)
        np.minimum.at(parent, high, low)  # unite by the smaller root
        while (parent != (up := parent[parent])).any():
            parent = up
    own = parent != np.arange(len(nodes))
    return nodes[own], nodes[parent[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def united():
            return forest(*(np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= TASK_EDGES:
                a, b = united()
                if len(a) > TASK_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
                held, size = [(a, b)], len(a)
        a, b = united()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable by the edges (a, b), both bigint; only nodes with edges."""
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(_contracted(edges.where("a is not null and b is not null and a <> b")))
    before = state(now)
    while True:
        # large-star: a node's larger neighbours hang on its smallest one
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        # small-star: a node and its smaller neighbours hang on the smallest of them; large holds (larger, smaller)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = written(small)
        release(large)
        release(now)
        after = state(new)
        if after == before:
            out = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.stored_at = new.stored_at
            return out
        now, before = new, after
