"""Reads rebuilt from a reference: spans across fixed-size chunks, mismatches and offsets, spliced spots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.letters import numbers, points, text
from spotweave.functions.sequence import FORWARD, REVERSE, reverse_complement

DEFAULT_CHUNK = 5000


def span_start(position: Column, chunk: int) -> tuple[Column, Column]:
    """(1-based chunk row, offset within it) of a 0-based reference position."""
    return F.floor(position / chunk) + 1, position % chunk


def chunk_size(references: DataFrame, declared: int | None = None) -> int:
    """The column's value, else the longest of the first 256 chunks, else the default."""
    if declared:
        return declared
    derived = references.orderBy("row_id").limit(256).agg(F.max("seq_len")).first()[0]
    return derived or DEFAULT_CHUNK


def fetched_spans(alignments: DataFrame, references: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Alignments (align_id, ref_start, ref_len) with `ref_bases`, cut from the chunks that the span crosses.

    One equi-join on the chunk's row; a span is gathered from its few pieces, never a chunk from its many spans."""
    first, _ = span_start(F.col("ref_start"), chunk)
    last, _ = span_start(F.col("ref_start") + F.greatest(F.col("ref_len"), F.lit(1)) - 1, chunk)
    cut = alignments.select("align_id", "ref_start", "ref_len", F.explode(F.sequence(first, last)).alias("row_id"))
    joined = cut.join(references.select("row_id", "bases"), "row_id")
    begin = (F.col("row_id") - 1) * chunk
    low = F.greatest(F.col("ref_start"), begin)
    high = F.least(F.col("ref_start") + F.col("ref_len"), begin + F.length("bases"))
    piece = F.col("bases").substr((low - begin + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    parts = joined.groupBy("align_id").agg(F.array_sort(F.collect_list(F.struct("row_id", piece.alias("piece")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    return alignments.join(parts, "align_id", "left").withColumn("ref_bases", F.coalesce(text, F.lit(""))).drop("parts")


def restored_text(reference: pa.Array, has_mismatch: pa.Array, mismatch: pa.Array, has_offset: pa.Array, offsets: pa.Array) -> pa.Array:
    """`restored` over whole arrays: cursors are running sums within each row."""
    (ref, ref_at), (other, other_at) = points(reference), points(mismatch)
    flags, edges = numbers(has_mismatch)
    moves, moves_at = numbers(has_offset)
    steps, steps_at = numbers(offsets)
    absent = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in (reference, has_mismatch, mismatch)])
    size = np.where(absent, 0, np.diff(edges))
    row = np.repeat(np.arange(len(size)), size)
    edge = np.cumsum(size) - size
    place = np.arange(len(row)) - edge[row]
    if (np.diff(moves_at)[(np.diff(moves_at) < size) & ~has_offset.is_null().to_numpy(zero_copy_only=False)]).size:
        raise ValueError("fewer offset flags than mismatch flags")
    taken = flags[edges[row] + place] == 1
    moved = np.append(moves, 0)[np.where(place < np.diff(moves_at)[row], moves_at[row] + place, len(moves))] == 1

    def before(x: np.ndarray) -> np.ndarray:
        """The sum of a row's earlier entries."""
        total = np.cumsum(x) - x
        return total - total[edge[row]]

    if moved.any():
        k = before(moved.astype(np.int64))
        if (moved & (k >= np.diff(steps_at)[row])).any():
            raise ValueError("fewer offsets than their flags")
        step = np.where(moved, np.append(steps, 0)[np.where(moved, steps_at[row] + k, len(steps))], 0)
        at = place + before(step) + step + 1
    else:
        at = place + 1
    # positions as SQL counts them: from 1, 0 like 1, negative ones from the end
    length = np.diff(ref_at)[row]
    at = np.where(at > 0, at - 1, np.where(at == 0, 0, length + at))
    m = before(taken.astype(np.int64))
    shown = np.where(taken, m < np.diff(other_at)[row], (at >= 0) & (at < length))
    source = np.concatenate([ref, other])
    letters = source[np.where(taken, len(ref) + other_at[row] + m, ref_at[row] + at)[shown]]
    return text(letters, np.bincount(row[shown], minlength=len(size)), absent)


def restored(reference: Column, has_mismatch: Column, mismatch: Column, has_offset: Column, offsets: Column) -> Column:
    """A read over its reference: a flagged position takes the next mismatch letter; a flagged offset first moves the
    reference cursor.  All but the letters are arrays, one entry a position (offsets: one entry a flag)."""
    return F.arrow_udf(restored_text, "string")(reference, has_mismatch, mismatch, has_offset, offsets)


def spliced(spots: DataFrame, aligned: DataFrame) -> DataFrame:
    """(row_id, read): each spot's reads in order, aligned ones (alignment id > 0) from `aligned`, turned round where
    they are reverse, the rest cut from the spot's own bases in turn.

    spots: row_id, cmp_read, read_len, read_type, align_id (arrays); aligned: align_id, bases."""
    n, kind = F.element_at("read_len", F.col("pos") + 1), F.element_at("read_type", F.col("pos") + 1)
    # bases of earlier unaligned reads of the spot come before this one's
    earlier = F.aggregate(F.sequence(F.lit(0), F.col("pos")), F.lit(0).cast("bigint"), lambda s, k: s + F.when((k < F.col("pos")) & (F.element_at(F.col("ids"), k + 1) <= 0), F.element_at("read_len", k + 1)).otherwise(0))
    rows = spots.select("row_id", "cmp_read", "read_len", "read_type", F.col("align_id").alias("ids"), F.posexplode("align_id").alias("pos", "align_id"))
    rows = rows.select("row_id", "pos", "align_id", n.cast("int").alias("n"), kind.alias("kind"), F.col("cmp_read").substr((earlier + 1).cast("int"), n.cast("int")).alias("own"))
    joined = rows.join(aligned.select("align_id", F.col("bases").alias("other")), "align_id", "left")
    turned = F.when(F.col("kind").bitwiseAND(FORWARD) != 0, F.col("other")).when(F.col("kind").bitwiseAND(REVERSE) != 0, reverse_complement(F.col("other"))).otherwise(F.raise_error(F.lit("an aligned read has no direction")))
    piece = F.when(F.col("align_id") > 0, turned).otherwise(F.col("own"))
    gathered = joined.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("parts"))
    return gathered.select("row_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("read"))
