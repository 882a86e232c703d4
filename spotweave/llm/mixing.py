"""Operator 4: mixing sources to target weights by cube-method balanced sampling.

Each source's target share gives every document of it the same expected number of copies.  The whole part is taken
outright; for the fraction, the cube method draws a balanced sample: inclusion probabilities move through the null
space of the constraints (token total and document total) until all but as many units as constraints are decided, a
small landing problem.  Sources are cut into blocks by a hash of the id; each block's flight leaves at most two
undecided documents, which fly again together, level by level, until one block a source remains; there the landing
decides the last two.  Only (id, source, size) travels, and no group exceeds a block.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take
part in the document total only; equal rows are units of their own, told apart by their place in the block; an empty
table gives no rows.  The draw depends on ids, sizes and the seed alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.common import fresh, small, written

BLOCK_DOCUMENTS = 1024
NEAR = 1e-9


def words_in(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """(source, docs, source_size, target, copies): weights repeat over sources by code point, null last.

    Shares of the whole size, none above `most` times its source's size, the excess reshared by weight: the level at
    which sum(min(level * weight, cap)) is the whole, found from sources sorted by cap over weight.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weights_left)
    # the first source whose cap is not reached sets the level of all that follow
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    by = by.withColumn("target", target)
    return by.select("source", "docs", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"))


def flight(p: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The cube method's flight: p moves along null vectors of the balancing rows (m x n) until at most m entries are
    neither 0 nor 1; expectations stay and sum(balance * p) stays."""
    p = p.copy()
    m = len(balance)
    undecided = [i for i in range(len(p)) if NEAR < p[i] < 1 - NEAR]
    draws = iter(rng.random(len(undecided) + 1).tolist())
    held, at = [], 0
    while True:
        while len(held) <= m and at < len(undecided):
            held.append(undecided[at])
            at += 1
        if len(held) <= m:
            return p
        a = balance[:, held]
        # a null vector of the m x (m + 1) rows; cross product for the usual two constraints
        u = np.cross(a[0], a[1]) if m == 2 else np.linalg.svd(a)[2][-1]
        if not u.any():
            u = np.linalg.svd(a)[2][-1]
        x = p[held]
        up = down = np.inf
        for v, q in zip(u.tolist(), x.tolist(), strict=True):
            if v > 0:
                up, down = min(up, (1 - q) / v), min(down, q / v)
            elif v < 0:
                up, down = min(up, -q / v), min(down, (q - 1) / v)
        x = x + u * (up if next(draws) * (up + down) < down else -down)
        p[held] = np.clip(np.where(x < NEAR, 0, np.where(x > 1 - NEAR, 1, x)), 0, 1)
        held = [i for i in held if 0 < p[i] < 1]


def landing(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The few undecided units: of all their samples the likeliest by probability and nearness to the token total, by draw."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    options = np.array(np.meshgrid(*[[0, 1]] * len(left))).reshape(len(left), -1).T
    chance = np.prod(np.where(options == 1, p[left], 1 - p[left]), axis=1)
    off = np.abs(options @ sizes[left] - p[left] @ sizes[left])
    chance = chance / (1 + off / max(1.0, sizes[left].mean()))
    out = p.copy()
    out[left] = options[rng.choice(len(options), p=chance / chance.sum())]
    return out


def balanced_copies(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(row columns, drawn 0 or 1) of every row of (id, source, size, docs, copies): the fraction of copies, drawn."""

    def step(last: bool):
        def run(g: pa.Table) -> pa.Table:
            g = g.take(pc.sort_indices(g, [("id", "ascending"), ("size", "ascending")], null_placement="at_end"))
            first = {c: g.column(c)[0].as_py() for c in ("level", "block", "size", "salt")}
            rng = np.random.default_rng([seed, first["level"], first["block"], first["size"], first["salt"] & 0x7FFFFFFF])
            order = rng.permutation(len(g))
            p, size = g.column("p").to_numpy()[order], g.column("size").to_numpy()[order].astype(float)
            p = flight(p, np.vstack([size, np.ones(len(size))]), rng)
            p = landing(p, size, rng) if last else p
            out = np.empty(len(p))
            out[order] = p
            return g.set_column(g.column_names.index("p"), "p", pa.array(out))

        return run

    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK_DOCUMENTS)))
    fraction = F.col("copies") - F.floor("copies")
    state = docs.withColumn("p", fraction).withColumn("units", F.col("docs")).withColumn("level", F.lit(0)).withColumn("salt", F.xxhash64("source").cast("bigint"))
    done, most = None, docs.agg(F.max("docs")).first()[0] or 0
    while True:
        state = state.withColumn("block", F.pmod(F.xxhash64("id", "size", F.lit(seed), "level"), blocks(F.col("units"))).cast("bigint"))
        last = most <= BLOCK_DOCUMENTS
        flown = written(state.groupBy("source", "block").applyInArrow(step(last), state.schema))
        settled = flown.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done.withColumn("drawn", F.col("p").cast("int"))
        # each block leaves two units at most: the next level has so many fewer
        state = flown.where("p > 0 and p < 1").drop("block").withColumn("level", F.col("level") + 1).withColumn("units", 2 * blocks(F.col("units")))
        most = 2 * -(-most // BLOCK_DOCUMENTS)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """(id, source, size, source_size, target, copies_taken, taken) of every row."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sizes = written(sizes)
    plan = written(targets(sizes, weights, most))
    planned = sizes.join(small(plan, 100_000), sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    drawn = balanced_copies(planned, seed)
    copies = (F.floor("copies") + F.col("drawn")).cast("bigint")
    return drawn.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies_taken"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.  Rows are told apart by id, source and text together; of rows
    repeated with all three, each draws for itself."""
    key, number, copies, each = (fresh(docs, c) for c in ("row_key", "row_number", "row_copies", "row_each"))
    parts = [F.concat(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(c.cast("string"), F.lit(""))) for c in (F.col(id_col), F.col("source"), F.col(text_col))]
    keyed = docs.withColumn(key, F.substring(F.unhex(F.sha2(F.concat_ws("\x00", *parts), 256)), 1, 16))
    drawn = mix_sources(keyed.select(key, "source", F.col(text_col).alias("text")), weights, most, key, seed)
    same = Window.partitionBy(key)
    drawn = written(drawn.select(key, F.col("copies_taken").alias(copies), F.row_number().over(same.orderBy(F.desc("copies_taken"))).alias(number), F.count(F.lit(1)).over(same).alias("rows")))
    out = keyed.join(small(drawn.where(f"rows = 1 and {copies} > 0").select(key, copies)), key)
    several = drawn.where("rows > 1").drop("rows")
    if not several.isEmpty():
        some = keyed.join(small(several.select(key).distinct()), key, "left_semi").withColumn(number, F.row_number().over(same.orderBy(F.lit(0))))
        out = out.unionByName(some.join(small(several.where(f"{copies} > 0")), [key, number]).drop(number))
    return out.withColumn(each, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*docs.columns)
