"""Page maps: run-length and dictionary encoded rows expanded with higher-order functions.

A page map is struct<lengths array<int>, leng_runs array<int>, kind string, map array<int>>: `kind` is identity, repeats
(map: how many rows each record serves) or offsets (map: where each row's data begins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_rows(leng_runs: Column) -> Column:
    return F.aggregate(leng_runs, F.lit(0).cast("bigint"), lambda s, n: s + n)


def row_lengths(lengths: Column, leng_runs: Column) -> Column:
    """Each length as often as its run."""
    return F.flatten(F.zip_with(lengths, leng_runs, lambda n, r: F.array_repeat(n, r)))


def running(values: Column) -> Column:
    """Exclusive running sums of an array, in one pass with the sum carried along."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
    return F.aggregate(values, start, step, lambda s: s["out"])


def row_extents(page_map: Column) -> Column:
    """array<struct<off, len>> of all logical rows; the offset moves on once a record, not once a row it serves."""
    lengths = row_lengths(page_map["lengths"], page_map["leng_runs"])
    # repeats: the k-th record has the length of the first row that it serves
    served = running(page_map["map"])
    records = F.transform(served, lambda at: F.element_at(lengths, (at + 1).cast("int")))
    repeated = F.flatten(F.zip_with(running(records), F.zip_with(records, page_map["map"], lambda n, r: F.struct(n.alias("n"), r.alias("r"))), lambda o, x: F.array_repeat(F.struct(o.alias("off"), x["n"].cast("bigint").alias("len")), x["r"])))
    plain = F.zip_with(running(lengths), lengths, lambda o, n: F.struct(o.alias("off"), n.cast("bigint").alias("len")))
    listed = F.zip_with(page_map["map"], lengths, lambda o, n: F.struct(o.cast("bigint").alias("off"), n.cast("bigint").alias("len")))
    return F.when(page_map["kind"] == "repeats", repeated).when(page_map["kind"] == "offsets", listed).otherwise(plain)


def expanded(blobs: DataFrame, data: str = "data", page_map: str = "page_map", start: str = "start_id") -> DataFrame:
    """(row_id, value) of every logical row; a row beyond the data is an error."""
    rows = blobs.select(F.col(start).alias("_start"), F.col(data).alias("_data"), F.posexplode(row_extents(F.col(page_map))).alias("_k", "_e"))
    end = F.col("_e.off") + F.col("_e.len")
    value = F.substring(F.col("_data"), (F.col("_e.off") + 1).cast("int"), F.col("_e.len").cast("int"))
    sound = F.when(end > F.length("_data"), F.raise_error(F.lit("a page map reaches beyond its data"))).otherwise(value)
    return rows.select((F.col("_start") + F.col("_k")).alias("row_id"), sound.alias("value"))


def padded(value: Column, width: Column, trailing: bool = False) -> Column:
    """A trimmed binary row filled with zero bytes to its width, before it or after it; longer rows are an error."""
    fill = F.unhex(F.lit("00"))
    out = F.rpad(value, width, fill) if trailing else F.lpad(value, width, fill)
    return F.when(F.length(value) > width, F.raise_error(F.lit("a row is wider than its column"))).otherwise(out)
