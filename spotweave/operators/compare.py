"""Differences between two sets of reads or runs: classes, confusion matrices, positions, verdicts, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses from the worst to the best.
STATUSES = ("FAIL_MISSING", "FAIL_SEQ", "FAIL_COUNT", "FAIL_QUAL", "FAIL_CONTENT", "PASS_CONTENT", "PASS_MD5")


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def differences(a: Column, b: Column) -> Column:
    """array<struct<pos, a, b>> of positions (from 0) where two strings of one length differ."""
    pairs = F.zip_with(letters(a), letters(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["a"].alias("a"), p["b"].alias("b")))
    return F.filter(placed, lambda p: p["a"] != p["b"])


def substitutions(a: Column, b: Column) -> Column:
    """The differences of two strings of one length, null if there are none or the lengths differ; equal strings, which
    are most, are not taken apart.  A condition within the expression, since a filter would compute both strings again."""
    return F.when((a != b) & (F.length(a) == F.length(b)), differences(a, b))


def record_class(a: Column, b: Column) -> Column:
    diffs = differences(a, b)
    masked, flipped = F.exists(diffs, lambda p: (p["a"] == "N") | (p["b"] == "N")), F.exists(diffs, lambda p: (p["a"] != "N") & (p["b"] != "N"))
    return F.when(a == b, "IDENTICAL").when(F.length(a) != F.length(b), "LENGTH_DIFF").when(masked & flipped, "MIXED").when(masked, "N_MASK_ONLY").otherwise("BASE_FLIP")


def bucket(position: Column, length: Column, n: int) -> Column:
    return F.least(F.floor(position * n / length), F.lit(n - 1)).cast("int")


def compared(left: DataFrame, right: DataFrame, keys: list[str], n_masking: bool = False, ignore_quality: bool = False) -> DataFrame:
    """One row of counters over two record streams (bases, quality) joined on their place."""
    a = left.select(*keys, F.col("bases").alias("sa"), F.col("quality").alias("qa"), F.lit(1).alias("la"))
    b = right.select(*keys, F.col("bases").alias("sb"), F.col("quality").alias("qb"), F.lit(1).alias("lb"))
    both = a.join(b, keys, "full")
    paired = F.col("la").isNotNull() & F.col("lb").isNotNull()
    kind = record_class(F.col("sa"), F.col("sb"))
    wrong = paired & ~kind.isin(*(["IDENTICAL", "N_MASK_ONLY"] if n_masking else ["IDENTICAL"]))
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    out = both.agg(
        total(paired).alias("records"), total(wrong).alias("sequence_mismatches"), total(paired & (F.col("qa") != F.col("qb"))).alias("quality_mismatches"),
        total(paired & (F.length("sa") != F.length("qa"))).alias("quality_length_errors"), total(~paired).alias("unpaired"),
    )
    bad = F.col("sequence_mismatches") + F.col("quality_length_errors") + F.col("unpaired") + (F.lit(0) if ignore_quality else F.col("quality_mismatches"))
    return out.withColumn("equal", bad == 0)


def confusion(pairs: DataFrame, a: str = "bases", b: str = "bases_b") -> DataFrame:
    """(base_a, base_b, n) over differing positions of records of one length; other letters are OTHER."""
    known = lambda c: F.when(c.isin("A", "C", "G", "T", "N"), c).otherwise("OTHER")
    rows = pairs.select(F.inline(substitutions(F.col(a), F.col(b))))
    return rows.groupBy(known(F.col("a")).alias("base_a"), known(F.col("b")).alias("base_b")).agg(F.count(F.lit(1)).alias("n"))


def position_histogram(pairs: DataFrame, n: int, a: str = "bases", b: str = "bases_b") -> DataFrame:
    """(bucket, n) for every bucket of the read's length, also those without differences."""
    rows = pairs.select(F.length(a).alias("len"), F.explode(substitutions(F.col(a), F.col(b))).alias("d"))
    counts = rows.groupBy(bucket(F.col("d.pos"), F.col("len"), n).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_shares(table: DataFrame, column: str = "class") -> DataFrame:
    """(class, n, percent) of all rows."""
    counts = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, "n", (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a proportion."""
    p, n = hits / n, n.cast("double")
    middle, half = p + F.lit(z * z) / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return F.greatest(F.lit(0.0), (middle - half) / (1 + F.lit(z * z) / n)), F.least(F.lit(1.0), (middle + half) / (1 + F.lit(z * z) / n))


def masked_fraction(counts: DataFrame) -> DataFrame:
    """N_MASK_ONLY among records that differ, four decimals, 0 without any."""
    part = F.sum(F.when(F.col("class") == "N_MASK_ONLY", F.col("n")))
    whole = F.sum(F.when(F.col("class") != "IDENTICAL", F.col("n")))
    return counts.agg(F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4).alias("fraction"))


def rates_by(table: DataFrame, hit: Column, a: str, b: str) -> DataFrame:
    """Counts, hits and rate by (a, b) and by a alone, in one grouping; unknown keys count under 'unknown'."""
    known = table.select(F.coalesce(a, F.lit("unknown")).alias(a), F.coalesce(b, F.lit("unknown")).alias(b), hit.cast("int").alias("_hit"))
    out = known.groupingSets([[a, b], [a]], a, b)
    out = out.agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").cast("bigint").alias("hits"), F.grouping_id().alias("_g"))
    return out.select(a, F.when(F.col("_g") == 0, F.col(b)).otherwise("*").alias(b), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def weighted_rate(rates: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """The rate over a population: each stratum's rate times its share of the totals (key, total)."""
    return rates.join(totals, key).agg((F.sum(F.col("total") * F.col("rate")) / F.sum("total")).alias("rate"))


def stratified(table: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum, in an order drawn by the seed; the same rows whenever it runs."""
    order = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return table.dropDuplicates([key]).withColumn("_k", order).where(F.col("_k") <= n).drop("_k")


def shuffled_top(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first n rows in an order drawn by the seed."""
    return table.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def evenly_spaced(n: int, k: int) -> list[int]:
    """k row numbers from 1 to n, as evenly as whole numbers allow."""
    return [1] if k == 1 else sorted({1 + i * (n - 1) // (k - 1) for i in range(k)})


def verdict(old: Column, new: Column, truth: Column) -> Column:
    """Of a digest before and after a change against the true one."""
    was, now = old.eqNullSafe(truth), new.eqNullSafe(truth)
    return F.when(truth.isNull(), F.when(old.eqNullSafe(new), "UNCHANGED").otherwise("CHANGED_OK")).when(now & ~was, "FIXED").when(was & ~now, "REGRESSED").when(~was & ~now, "STILL_BROKEN").otherwise("UNCHANGED")


def file_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, state) of two sets of (name, digest): same, differs, missing_left or missing_right."""
    both = left.withColumnRenamed("digest", "dl").withColumn("l", F.lit(1)).join(right.withColumnRenamed("digest", "dr").withColumn("r", F.lit(1)), "name", "full")
    return both.select("name", F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("dl").eqNullSafe(F.col("dr")), "same").otherwise("differs").alias("state"))


def pair_status(md5_equal: Column, counts_equal: Column, bases_equal: Column, quality_equal: Column, content_equal: Column) -> Column:
    return F.when(md5_equal, "PASS_MD5").when(~counts_equal, "FAIL_COUNT").when(~bases_equal, "FAIL_SEQ").when(~quality_equal, "FAIL_QUAL").when(~content_equal, "FAIL_CONTENT").otherwise("PASS_CONTENT")


def worst_status(table: DataFrame, key: str, status: str = "status") -> DataFrame:
    """A key's worst status."""
    severity = F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col(status))
    return table.groupBy(key).agg(F.min_by(status, severity).alias(status))


def cost_regressions(costs: DataFrame, ratio: float, least: float) -> DataFrame:
    """Rows (name, before, after) dearer both by the ratio and by the absolute amount."""
    return costs.where((F.col("after") > F.col("before") * ratio) & (F.col("after") - F.col("before") > least)).select("name", "before", "after", (F.col("after") / F.col("before")).alias("ratio"))
