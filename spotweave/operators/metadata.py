"""Metadata trees as tables: path-keyed nodes, lookups and the facts read off them.

A tree is a table (path, depth, pos, value binary, attrs map<string, string>), pos being its depth-first order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators.catalog import default_reads, platform_name, platform_of_schema


def subtree(nodes: DataFrame, root: str = "", max_depth: int | None = None) -> DataFrame:
    """Nodes at and below a path, to a depth counted from it, in depth-first order."""
    out = nodes.where((F.col("path") == root) | F.col("path").startswith(f"{root}/")) if root else nodes
    base = root.count("/") + 1 if root else 0
    return (out.where(F.col("depth") <= base + max_depth) if max_depth is not None else out).orderBy("pos")


def node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def little_endian(value: Column) -> Column:
    """The unsigned number of up to eight little-endian bytes."""
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))), ""), 16, 10).cast("bigint")


def statistic(nodes: DataFrame, name: str) -> DataFrame:
    return node(nodes, f"STATS/TABLE/{name}").select(little_endian(F.col("value")).alias("value"))


def expected_histogram(nodes: DataFrame) -> DataFrame:
    """(phred, n) of the nodes STATS/QUALITY/PHRED_n."""
    number = F.regexp_extract("path", r"^STATS/QUALITY/PHRED_(\d+)$", 1)
    return nodes.where(number != "").select(number.cast("int").alias("phred"), little_endian(F.col("value")).alias("n"))


def read_description(text: Column) -> Column:
    """`B|151|` as struct<type, length>; null if it is none."""
    parts = F.split(text, "\\|")
    n = F.try_element_at(parts, F.lit(2))
    return F.when(F.try_element_at(parts, F.lit(1)).isin("B", "T"), F.struct(parts[0].alias("type"), F.coalesce(n.try_cast("int"), F.lit(0)).alias("length")))


def platform(nodes: DataFrame) -> DataFrame:
    """(platform, nreads): the platform's static column, else the schema's name."""
    number = F.max(F.when(F.col("path") == "col/PLATFORM/row", little_endian(F.substring("value", 1, 1))))
    schema = F.max(F.when(F.col("path") == "schema", F.element_at("attrs", "name")))
    found = nodes.agg(F.coalesce(platform_name(number), platform_of_schema(schema)).alias("platform"))
    return found.withColumn("nreads", default_reads(F.col("platform")))


def is_lite(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.coalesce(F.bool_or(F.col("path").contains("SOFTWARE/delite")), F.lit(False)).alias("lite"))


def software(nodes: DataFrame, path: str) -> DataFrame:
    take = lambda k: F.element_at("attrs", k)
    return node(nodes, path).select(F.coalesce(take("tool"), take("name")).alias("name"), F.coalesce(take("vers"), take("version")).alias("version"), take("date").alias("date"))


def loaded_at(nodes: DataFrame) -> DataFrame:
    return node(nodes, "LOAD/timestamp").select(F.timestamp_seconds(little_endian(F.col("value"))).alias("loaded_at"))


def children(toc: DataFrame, path: str) -> DataFrame:
    """Entries (path, ...) right below a path."""
    prefix = f"{path}/" if path else ""
    return toc.where(F.col("path").startswith(prefix) & ~F.col("path").substr(F.lit(len(prefix) + 1), F.length("path")).contains("/"))


def tables(toc: DataFrame) -> DataFrame:
    return toc.select(F.regexp_extract("path", "^tbl/([^/]+)", 1).alias("name")).where("name <> ''").distinct()


def columns(toc: DataFrame, name: str | None = None) -> DataFrame:
    base = f"tbl/{name}/col" if name else "col"
    return toc.select(F.regexp_extract("path", f"^{base}/([^/]+)", 1).alias("name")).where("name <> ''").distinct()


def kind(toc: DataFrame) -> DataFrame:
    """database, table or null."""
    some = lambda p: F.coalesce(F.bool_or(F.col("path").startswith(p)), F.lit(False))
    return toc.agg(F.when(some("tbl/"), "database").when(some("col/"), "table").alias("kind"))


def default_table(toc: DataFrame) -> DataFrame:
    """CONSENSUS before SEQUENCE before the first by name."""
    rank = F.when(F.col("name") == "CONSENSUS", 0).when(F.col("name") == "SEQUENCE", 1).otherwise(2)
    return tables(toc).agg(F.min_by("name", F.struct(rank.alias("r"), F.col("name"))).alias("name"))
