"""Histograms, integrity counters and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counters of a run, the fatal ones first.
FATAL = ("quality_length", "quality_invalid", "overrun", "blob_mismatch", "paired_mismatch", "bio_bases", "spot_count", "histogram", "truncated")
ADVISORY = ("all_zero_quality", "quality_absent")


def histogram(reads: DataFrame, quality: str = "quality", offset: int = 33) -> DataFrame:
    """(phred, n) over all characters of ASCII qualities; partial sums before the shuffle, at most 256 groups."""
    letters = reads.select(F.explode(F.filter(F.split(quality, ""), lambda c: c != "")).alias("c"))
    by_letter = letters.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return by_letter.select((F.ascii("c") - offset).cast("int").alias("phred"), "n")


def histogram_differences(expected: DataFrame, seen: DataFrame, first: int = 8) -> DataFrame:
    """The first bins (phred, n) whose counts differ."""
    both = expected.withColumnRenamed("n", "expected").join(seen.withColumnRenamed("n", "seen"), "phred", "full")
    both = both.select("phred", F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"), F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen"))
    return both.where("expected <> seen").orderBy("phred").limit(first)


def diagnosis(counters: dict[str, Column]) -> dict[str, Column]:
    """any, any_fatal and a `k=v` line of counters by name."""
    known = [c for c in (*FATAL, *ADVISORY) if c in counters]
    positive = lambda names: F.greatest(F.lit(0), F.lit(0), *(counters[c] for c in names if c in counters)) > 0
    return {"any": positive(known), "any_fatal": positive(FATAL), "summary": F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), counters[c].cast("string")) for c in known))}


def reconciled(seen: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(counter, expected, seen) of a one-row table's columns that are not as expected."""
    pairs = F.array(*(F.struct(F.lit(k).alias("counter"), F.lit(v).cast("bigint").alias("expected"), F.col(k).cast("bigint").alias("seen")) for k, v in expected.items()))
    return seen.select(F.inline(pairs)).where(~F.col("expected").eqNullSafe(F.col("seen")))
