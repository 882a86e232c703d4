"""Spots to reads to output slots: filters, numbering and routing as one window over each spot."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.sequence import BIOLOGICAL, is_biological


@dataclass(frozen=True)
class ReadFilter:
    min_length: int = 0
    skip_technical: bool = True


def exploded(spots: DataFrame) -> DataFrame:
    """A row a read of spots (row_id, read, quality, read_len array, read_type array): running offsets cut the bases.

    Reads from the first that overruns the spot's bases on are left out; missing types count as biological.
    """
    lengths = F.transform("read_len", lambda n: n.cast("bigint"))
    rows = spots.withColumn("ends", F.aggregate(lengths, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))))
    rows = rows.select("*", F.posexplode("ends").alias("pos", "end")).where(F.col("end") <= F.length("read"))
    n = F.element_at("read_len", F.col("pos") + 1).cast("int")
    start = (F.col("end") - n + 1).cast("int")
    return rows.select(
        "row_id", (F.col("pos") + 1).alias("mate_idx"), n.alias("read_len"), F.try_element_at("read_type", F.col("pos") + 1).cast("int").alias("read_type"),
        F.col("read").substr(start, n).alias("bases"), F.col("quality").substr(start, n).alias("quality"),
    )


def keep(read_len: Column, read_type: Column, rule: ReadFilter) -> Column:
    out = read_len > 0
    if rule.skip_technical:
        out &= is_biological(read_type)
    return out & (read_len >= rule.min_length) if rule.min_length else out


def routed(reads: DataFrame, mode: str = "split3", rule: ReadFilter = ReadFilter(), spot: str = "spot_id") -> DataFrame:
    """Kept reads with `slot`.

    split3: by rank among the spot's survivors where at least two are biological, else unpaired.
    split_files: by the read's own number, unless the spot has one read only.  Other modes: single.
    """
    by = Window.partitionBy(spot)
    if mode == "split_files":
        reads = reads.withColumn("spot_reads", F.count(F.lit(1)).over(by))
    kept = reads.where(keep(F.col("read_len"), F.col("read_type"), rule))
    if mode == "split3":
        kept = kept.withColumn("emit_idx", F.row_number().over(by.orderBy("mate_idx")) - 1)
        kept = kept.withColumn("bio_reads", F.count(F.when(is_biological(F.col("read_type")), 1)).over(by))
        slot = F.when(F.col("bio_reads") < 2, "unpaired").otherwise(F.concat(F.lit("read"), (F.col("emit_idx") + 1).cast("string")))
    elif mode == "split_files":
        slot = F.when(F.col("spot_reads") < 2, "unpaired").otherwise(F.concat(F.lit("read"), F.col("mate_idx").cast("string")))
    else:
        slot = F.lit("single")
    return kept.withColumn("slot", slot)


def routed_arrays(spot: np.ndarray, number: np.ndarray, read_len: np.ndarray, read_type: np.ndarray, mode: str = "split3", rule: ReadFilter = ReadFilter()) -> tuple[np.ndarray, list[str]]:
    """(kept, slot) of reads that lie spot by spot in one batch, a missing type (-1) counting as biological: the rules of
    `routed` where whole spots are at hand, so that no window needs to bring them together."""
    biological = (read_type & BIOLOGICAL == BIOLOGICAL) | (read_type < 0)
    kept = (read_len > 0) & (biological | (not rule.skip_technical)) & (read_len >= rule.min_length)
    new = np.concatenate([[True], spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    of = lambda x: np.bincount(group, x, minlength=int(new.sum())).astype(np.int64)
    if mode == "split3":
        rank = np.cumsum(kept)
        rank -= (rank - kept)[np.flatnonzero(new)][group]
        single, shown = of(kept & biological)[group] < 2, rank
    elif mode == "split_files":
        single, shown = of(np.ones(len(spot)))[group] < 2, number
    else:
        return kept, ["single"] * len(spot)
    names = [f"read{k}" for k in range(int(shown.max()) + 1)] if len(shown) else []
    return kept, ["unpaired" if s else names[k] for s, k in zip(single.tolist(), shown.tolist(), strict=True)]


def slot_counts(routed_reads: DataFrame) -> DataFrame:
    return routed_reads.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("read_len").cast("bigint").alias("bases"))


def pair_violations(counts: DataFrame) -> DataFrame:
    """How far the numbers of first and second mates are apart."""
    one, two = (F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("n"))), F.lit(0)) for s in ("read1", "read2"))
    return counts.agg(F.abs(one - two).cast("bigint").alias("violations"))


def drop_reasons(reads: DataFrame, rule: ReadFilter) -> DataFrame:
    """Why reads are left out, the first reason that holds."""
    reason = F.when(F.col("read_len") == 0, "empty").when(~is_biological(F.col("read_type")) if rule.skip_technical else F.lit(False), "technical").when(F.col("read_len") < rule.min_length, "short").otherwise("kept")
    return reads.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stream_class(reads: DataFrame, spot: str = "spot_id") -> DataFrame:
    """Per spot: whether a survivor follows a dropped read, whether split-3 keeps three or more, direction bits, technical reads."""
    by = Window.partitionBy(spot)
    alive = (F.col("read_len") > 0) & is_biological(F.col("read_type"))
    rows = reads.withColumn("dropped_before", F.max((~alive).cast("int")).over(by.orderBy("mate_idx").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.groupBy(spot).agg(
        F.max((alive & (F.coalesce("dropped_before", F.lit(0)) == 1)).cast("int")).alias("split_files_changed"),
        (F.sum(alive.cast("int")) >= 3).cast("int").alias("split3_changed"),
        F.max((F.col("read_type").bitwiseAND(6) != 0).cast("int")).alias("orientation_bits"),
        F.max((~is_biological(F.col("read_type"))).cast("int")).alias("has_technical"),
        F.max("mate_idx").alias("max_slots"),
    )


def change_class(files: Column, split3: Column, orientation: Column) -> Column:
    return F.when((files == 1) & (split3 == 1), "SPLIT_FILES+SPLIT3").when(files == 1, "SPLIT_FILES").when(split3 == 1, "SPLIT3").when(orientation == 1, "READTYPE_ORIENTATION").otherwise("UNAFFECTED")
