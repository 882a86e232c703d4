"""Row ranges, blobs and byte ranges: prefix sums, range joins, islands and overlays.

Range joins against locators become equi-joins: both sides are cut at a fixed grid of row ids, so that neither a cross
product nor a broadcast of the locators is needed and a partition holds one stretch of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(blobs: DataFrame, order: str = "blob", size: str = "id_range", out: str = "before", bucket: int = 1 << 16) -> DataFrame:
    """The exclusive running sum of `size` in the order of an integer key, without sorting all rows in one task.

    Keys are cut into buckets; sums of buckets (few rows) are accumulated, and within a bucket a window runs."""
    cut = blobs.withColumn("_bucket", F.floor(F.col(order) / bucket))
    sums = cut.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(sums, "_bucket").withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_bucket", "_base")


def find_blob(rows: DataFrame, blobs: DataFrame, row: str = "row_id", grid: int = 1024) -> DataFrame:
    """Rows with the blob [start_id, start_id + id_range) that holds them."""
    cells = F.sequence(F.floor(F.col("start_id") / grid), F.floor((F.col("start_id") + F.col("id_range") - 1) / grid))
    cut = blobs.where("id_range > 0").withColumn("_cell", F.explode(cells))
    inside = (F.col(row) >= F.col("start_id")) & (F.col(row) < F.col("start_id") + F.col("id_range"))
    return rows.withColumn("_cell", F.floor(F.col(row) / grid)).join(cut, "_cell").where(inside).drop("_cell")


def range_problems(blobs: DataFrame, expected_rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Blobs that overlap the one before or leave a gap after it, and a total that is not as expected."""
    w = Window.partitionBy(*(by or [])).orderBy("start_id")
    end = F.lag(F.col("start_id") + F.col("id_range")).over(w)
    rows = blobs.withColumn("_end", end)
    found = rows.where("_end is not null and _end <> start_id").select("start_id", F.when(F.col("start_id") < F.col("_end"), "overlap").otherwise("gap").alias("problem"))
    if expected_rows is not None:
        total = blobs.agg(F.min("start_id").alias("start_id"), F.sum("id_range").alias("n")).where(F.coalesce("n", F.lit(0)) != expected_rows)
        found = found.unionByName(total.select("start_id", F.lit("total").alias("problem")))
    return found


def merged_ranges(ranges: DataFrame, gap: int = 1 << 20, by: list[str] | None = None) -> DataFrame:
    """Byte ranges (start, end) coalesced where at most `gap` apart: islands of a running maximum, in each `by` group.

    Repeated ranges count once: they lie together in the window's order, so that no table of all ranges is held."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.struct("start", "end")
    if keys:
        # a number told keeps adaptive execution from joining partitions, which a task would sort and gather at once
        ranges = ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = ranges.withColumn("_again", F.lag(own).over(w).eqNullSafe(own)).where(~F.col("_again")).drop("_again")
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlaid(base: DataFrame, overlay: DataFrame, grid: int = 1024) -> DataFrame:
    """Overlay blobs, and those base blobs that none of them overlaps."""
    if overlay.isEmpty():
        return base
    cells = lambda df: df.where("id_range > 0").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_id") / grid), F.floor((F.col("start_id") + F.col("id_range") - 1) / grid))))
    a, b = cells(base).alias("a"), cells(overlay).alias("b")
    over = (F.col("a._cell") == F.col("b._cell")) & (F.col("a.start_id") < F.col("b.start_id") + F.col("b.id_range")) & (F.col("b.start_id") < F.col("a.start_id") + F.col("a.id_range"))
    hit = a.join(b, over, "left_semi").select("start_id").distinct()
    return base.where("id_range > 0").join(hit, "start_id", "left_anti").unionByName(overlay)


_SPAN = re.compile(r"^(\d*)(-?)(\d*)$")


def parse_row_ranges(text: str) -> list[tuple[int | None, int | None]]:
    """`5`, `5-20`, `100-`, `-50`, comma-separated: (first, last), None where open."""
    out: list[tuple[int | None, int | None]] = []
    for part in (p.strip() for p in text.split(",")):
        m = _SPAN.match(part)
        if not part or not m or part == "-":
            raise ValueError(f"not a row range: {part!r}")
        a, dash, b = m.groups()
        low, high = (int(a) if a else None), (int(b) if b else None)
        out.append((low, high) if dash else (low, low))
    return out


def spans(ranges: list[tuple[int | None, int | None]], first: int, count: int) -> list[tuple[int, int]]:
    """Closed spans within the table's rows: reversed closed ones turned round, ends clamped, those outside left out."""
    last = first + count - 1
    out = []
    for a, b in ranges:
        if a is not None and b is not None:
            a, b = min(a, b), max(a, b)
        a, b = first if a is None else max(a, first), last if b is None else min(b, last)
        if a <= b:
            out.append((a, b))
    return out


def rows_of_ranges(table: DataFrame, text: str, row: str = "row_id") -> DataFrame:
    """The table's rows in the order of the ranges, a row as often as ranges name it."""
    spark = table.sparkSession
    facts = table.agg(F.min(row), F.count(F.lit(1))).first()
    if not facts[1]:
        return table.withColumn("ordinal", F.lit(None).cast("bigint"))
    wanted = spans(parse_row_ranges(text), facts[0], facts[1])
    before, listed = 0, []
    for a, b in wanted:
        listed.append((a, b, before))
        before += b - a + 1
    names = spark.createDataFrame(listed, "lo bigint, hi bigint, before bigint")
    # as few spans as the text names: matched to rows by bounds
    hit = table.join(F.broadcast(names), (F.col(row) >= F.col("lo")) & (F.col(row) <= F.col("hi")))
    return hit.withColumn("ordinal", F.col("before") + F.col(row) - F.col("lo")).drop("lo", "hi", "before")


def selected_columns(available: list[str], requested: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    unknown = [c for c in requested or [] if c not in available]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return [c for c in (requested or available) if c not in (exclude or [])]


def as_of(rows: DataFrame, events: DataFrame, row: str, start: str, value: str, by: list[str] | None = None, bucket: int = 1 << 16) -> DataFrame:
    """Rows with the `value` of the event of greatest `start` not after them; before the first, that of the first.

    One union and one window in buckets of the key, each begun with the last value of the buckets before it."""
    keys = by or []
    cut = lambda c: F.floor(F.col(c) / bucket)
    marks = events.select(*keys, F.col(start).alias("_at"), F.col(value).alias("_v"), cut(start).alias("_bucket"))
    last = marks.groupBy(*keys, "_bucket").agg(F.max_by("_v", "_at").alias("_last"))
    both = rows.withColumn("_at", F.col(row)).withColumn("_bucket", cut(row)).withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(events.schema[value].dataType))
    marks = marks.withColumn("_kind", F.lit(0))
    both = both.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    # buckets (few) carry the last value before them
    index = here.select(*keys, "_bucket").distinct().join(last, [*keys, "_bucket"], "full")
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    index = index.withColumn("_carried", carried).select(*keys, "_bucket", "_carried")
    out = here.join(index, [*keys, "_bucket"], "left")
    if keys:
        out = out.join(events.groupBy(*keys).agg(F.min_by(value, start).alias("_first")), keys, "left")
    else:
        out = out.withColumn("_first", F.lit(events.agg(F.min_by(value, start)).first()[0]))
    return out.withColumn("as_of", F.coalesce("_here", "_carried", "_first")).select(*rows.columns, "as_of")


def template_name(template: Column, x: Column, y: Column) -> Column:
    """$X and $Y replaced by coordinates, missing ones by 0."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return F.replace(F.replace(template, F.lit("$X"), value(x)), F.lit("$Y"), value(y))
