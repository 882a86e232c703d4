"""Operator 5: exact top-k inner products through a pivot-distance index.

One more component, sqrt(M^2 - |x|^2) with M the largest length, puts every vector on a sphere; there the largest inner
product is the nearest vector, and the triangle inequality holds.  Vectors are keyed by their nearest pivot and their
distance to it.  A query visits the pivots' cells nearest first and expands the annulus [d(q,p) - r, d(q,p) + r] of
each, r being the distance of its k-th best so far; a cell with nothing in that annulus is passed over, and a query
stops when no cell can hold a better vector.  Pivots are fitted on a bounded sample, but every vector is indexed and
the result is exact (recall 1).

Distribution: vectors are dealt by a hash of their id over shards, queries over groups; each (shard, group) pair is
one bounded task, and per-shard results of k rows a query are merged.  Inner products are of integers, computed in
doubles while those are exact and in whole numbers otherwise.

Defined results: vectors that are null, hold a null or a non-finite component, or have a null id take no part; shorter
vectors count as padded with zeros; rows repeated with one id and vector are one query, and never their own
candidates; scores beyond 64 bits saturate; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.common import written

SAMPLE, PIVOTS, SHARD_ROWS, GROUP_QUERIES, BLOCK = 4096, 32, 65_536, 8_192, 256
SLACK = 1e-9  # relative room for rounding in distances, on the safe side


def integer_vectors(table: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) with components floor(scale * x)."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return table.where(fine).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q @ x.T
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in x], object).reshape(x.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """k-means centres of the sample (on the sphere's inside: distances to any fixed point obey the triangle inequality)."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(8):
        near = ((centres**2).sum(1)[None, :] - 2 * sample @ centres.T).argmin(1)
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(0)
    return centres


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, square - (x**2).sum(1)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T))


class Cells:
    """A shard's vectors by nearest pivot, within a cell by distance to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, distance: np.ndarray):
        order = np.lexsort((distance, pivot))
        self.ids, self.x, self.distance = ids[order], x[order], distance[order]
        self.pivots, first = np.unique(pivot[order], return_index=True)
        self.edges = np.append(first, len(order))

    def search(self, qid: np.ndarray, q: np.ndarray, to_pivots: np.ndarray, square: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, vector id, score) of the k best of each query among this shard, by annuli expanded cell by cell."""
        m = len(q)
        row, got, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth = np.full(m, -np.inf)
        base = (q**2).sum(1) + square
        inner, outer = self.distance[self.edges[:-1]], self.distance[self.edges[1:] - 1]
        reach = to_pivots[:, self.pivots]
        least = np.maximum(0, np.maximum(reach - outer, inner - reach))  # no vector of the cell is nearer
        for c in np.argsort(least.mean(0), kind="stable"):
            radius = np.sqrt(np.maximum(0, base - 2 * kth)) * (1 + SLACK) + SLACK * np.sqrt(base)
            alive = np.flatnonzero(least[:, c] <= radius)
            if not len(alive):
                continue
            a, b = self.edges[c], self.edges[c + 1]
            low = a + np.searchsorted(self.distance[a:b], reach[alive, c] - radius[alive], "left")
            high = a + np.searchsorted(self.distance[a:b], reach[alive, c] + radius[alive], "right")
            alive = alive[low < high]
            if not len(alive):
                continue
            for s in range(int(low.min()), int(high.max()), 4096):
                e = min(s + 4096, int(high.max()))
                scores = products(q[alive], self.x[s:e])
                r, j = np.nonzero((scores >= kth[alive, None]) & (self.ids[None, s:e] != qid[alive, None]))
                if not len(r):
                    continue
                row, got, score = np.append(row, alive[r]), np.append(got, self.ids[s + j]), np.append(score.astype(scores.dtype), scores[r, j])
                order = np.lexsort((got, -score, row))
                row, got, score = row[order], got[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, got, score, rank = (v[rank < k] for v in (row, got, score, rank))
                full = rank == k - 1
                kth[row[full]] = score[full]
        return row, got, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs are (id bigint, v array<double>) with whole components."""
    facts = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).first()
    rows, width, square = facts[0], max(1, facts[1] or 1), float(facts[2] or 0)
    asked = written(queries.select("id", "v").distinct())
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    width = max(width, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    shards = max(8, -(-rows // SHARD_ROWS))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    centres = fit_pivots(lifted(matrix(sample.column(0), width), square), pivots)

    def index(batches):
        for b in batches:
            d = distances(lifted(matrix(b.column(1), width), square), centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "v", "pivot", "distance"])

    indexed = vectors.select("id", "v").mapInArrow(index, "id bigint, v array<double>, pivot int, distance double")
    deal = lambda df, own, other, n, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            cells = Cells(left.column("id").to_numpy(), matrix(left.column("v"), width), left.column("pivot").to_numpy(), left.column("distance").to_numpy())
            qid, q = right.column("id").to_numpy(), matrix(right.column("v"), width)
            far = distances(np.column_stack([q, np.zeros(len(q))]), centres)
            order = np.argsort(far.argmin(1), kind="stable")  # queries of one cell together
            for s in range(0, len(order), BLOCK):
                part = order[s : s + BLOCK]
                r, got, score = cells.search(qid[part], q[part], far[part], square, k)
                out.append((qid[part][r], got, score.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    left = deal(indexed, "shard", "part", shards, groups).groupBy("shard", "part")
    right = deal(asked, "part", "shard", groups, shards).groupBy("shard", "part")
    best = left.cogroup(right).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
