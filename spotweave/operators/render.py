"""Rows rendered as text: delimited, JSON, plain, hex; tables written as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotweave.functions.sequence import field_csv

# Kinds of columns by name; every other column is raw bytes.
KINDS = {
    "string": ("READ", "CMP_READ", "QUALITY", "ORIGINAL_QUALITY", "CMP_QUALITY", "NAME", "SPOT_NAME", "SPOT_GROUP", "LABEL", "CS_KEY", "NAME_FMT"),
    "array<bigint>": ("READ_LEN", "READ_START", "LABEL_LEN", "LABEL_START", "POSITION"),
    "array<smallint>": ("READ_TYPE", "READ_FILTER", "RD_FILTER"),
    "smallint": ("PLATFORM", "NREADS", "SPOT_FILTER"),
    "bigint": ("SPOT_ID", "CLIP_QUALITY_LEFT", "CLIP_QUALITY_RIGHT", "TRIM_LEN", "TRIM_START"),
    "int": ("X", "Y"),
}


def column_type(name: str) -> str:
    upper = name.upper()
    if upper.startswith(("CLIP_QUALITY_", "TRIM_")):
        return "bigint"
    return next((kind for kind, names in KINDS.items() if upper in names), "binary")


def cell(df: DataFrame, name: str, join: str = ";") -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    return F.array_join(c.cast("array<string>"), join) if isinstance(kind, T.ArrayType) else c.cast("string")


def delimited(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """(value): one line a row; arrays joined by ';', binary as hex, fields quoted where they must be, null empty."""
    return df.select(F.concat_ws(delimiter, *(F.coalesce(field_csv(cell(df, c), delimiter), F.lit("")) for c in df.columns)).alias("value"))


def plain(df: DataFrame, row: str = "row_id") -> DataFrame:
    """(value): `row N: COL="v", COL=[a, b]`."""

    def shown(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            return F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))
        return F.concat(F.lit(f"{c}=["), F.coalesce(cell(df, c, ", "), F.lit("")), F.lit("]")) if isinstance(kind, T.ArrayType) else F.concat(F.lit(f"{c}="), F.coalesce(cell(df, c), F.lit("")))

    return df.select(F.concat(F.lit("row "), F.col(row).cast("string"), F.lit(": "), F.concat_ws(", ", *(shown(c) for c in df.columns if c != row))).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*(F.lower(F.hex(c)).alias(c) if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_records(records: DataFrame, path: str, compression: str = "none", order: list[str] | None = None) -> None:
    """(slot, value) rows as text files, a folder a slot; Spark's commit makes them visible at once.

    Rows are dealt by ranges of the order columns, so that files of a slot follow one another in that order."""
    out = records
    if order:
        out = out.repartitionByRange(*order).sortWithinPartitions("slot", *order)
    out.select("slot", "value").write.partitionBy("slot").option("compression", compression).mode("overwrite").text(path)
