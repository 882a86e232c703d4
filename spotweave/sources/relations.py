"""Archives as relations: members, metadata, blobs, decoded rows, reads and reports of validation.

Spark lists the files; tasks read directories, indexes and blobs by byte range.  Rows are planned as a table of row
windows (one a blob of the leading column), so that predicates on archives and rows choose blobs before any is read, and
the windows are dealt over tasks whatever archive they lie in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.sources.archive import FormatError
from spotweave.sources.columns import FALLBACKS, Archive, arrow_rows, arrow_type, cached, decoded_array, gathered, masked_rows, parts
from spotweave.sources.columns import Column as Physical

ROW_BATCH = 4096
#: Rows of an archive whose blobs one task reads, and bytes of archives a task.
STRETCH, TASK_BYTES = 8192, 4 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of every file below a path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sra").load(path).select("path")


def _told(df: DataFrame, schema: str, tell: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Rows that a function makes of every row."""
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]
    kinds = pa.schema([(n, _arrow(c.split(" ", 1)[1])) for n, c in zip(names, schema.split(", "), strict=True)])

    def run(batches):
        for b in batches:
            rows = [r for one in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in tell(*one)]
            for k in range(0, len(rows), ROW_BATCH):
                columns = zip(*rows[k : k + ROW_BATCH], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "map<string,binary>": pa.map_(pa.string(), pa.binary())}
    return plain[kind]


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, kind, offset, size, target): offset in the archive file, of files only."""

    def tell(name: str):
        a = Archive(name)
        return [(name, e.path, e.kind, a.data + e.offset if e.kind in ("file", "chunked") else None, e.size, e.target) for e in a.toc]

    return _told(files(spark, path), "archive string, path string, kind string, offset bigint, size bigint, target string", tell)


def archive_metadata(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """(archive, position, path, depth, value, attributes) of the table's metadata, depth first."""
    tell = lambda name: [(name, k, *row) for k, row in enumerate(Archive(name).metadata(table))]
    return _told(files(spark, path), "archive string, position bigint, path string, depth int, value binary, attributes map<string,binary>", tell)


def archive_blobs(spark: SparkSession, path: str, table: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(archive, column, start_id, id_range, offset, size): all blobs, offset within the column's data."""

    def tell(name: str):
        a = Archive(name)
        base = a.base(table)
        for c in columns or a.columns(table):
            if f"{base}/{c}/idx1" in a.members:
                column = Physical.open(a, f"{base}/{c}")
                yield from ((name, c, b.start_id, b.id_range, b.page * column.page, b.size) for b in column.blobs)

    return _told(files(spark, path), "archive string, column string, start_id bigint, id_range bigint, offset bigint, size bigint", tell)


def column_statistics(blobs: DataFrame) -> DataFrame:
    """(archive, column, rows, blobs, first_row, first_size) of a table of blobs."""
    first = F.min_by("size", "start_id").alias("first_size")
    return blobs.groupBy("archive", "column").agg(F.sum("id_range").alias("rows"), F.count(F.lit(1)).alias("blobs"), F.min("start_id").alias("first_row"), first)


def _kind_of(column: str) -> str:
    kind = arrow_type(column)
    return "string" if pa.types.is_string(kind) else "array<bigint>" if pa.types.is_list(kind) else "binary"


def _tasks(spark: SparkSession, path: str) -> int:
    """How many tasks share the archives: a number by their bytes, since adaptive execution would put the table of row
    windows, which is small, into a task or two."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sra").load(path).agg(F.sum("length")).first()[0]
    return max(spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES + 1)


def _windows(spark: SparkSession, path: str, table: str | None, first: int | None, last: int | None, only: Column | None) -> DataFrame:
    """(archive, lo, hi) of the blobs of READ within first and last, those of a stretch of an archive in one task, in order."""
    windows = archive_blobs(spark, path, table, ["READ"]).where(only if only is not None else F.lit(True))
    last_of = F.col("start_id") + F.col("id_range") - 1
    lo = F.greatest("start_id", F.lit(first if first is not None else -(2**62)))
    hi = F.least(last_of, F.lit(last if last is not None else 2**62))
    windows = windows.select("archive", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    stretch = F.xxhash64("archive", F.floor(F.col("lo") / STRETCH))
    return windows.repartition(_tasks(spark, path), stretch).sortWithinPartitions("archive", "lo")


def _decoded(windows: DataFrame, schema: str, columns: list[str], table: str | None, shape: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Batches (archive, row_id, columns) of the windows, as `shape` makes them: neighbours of an archive are decoded
    together, and an archive's directory and indexes are read once for all windows that follow each other."""
    reading = [*columns, *(["ALTREAD"] if "READ" in columns and "ALTREAD" not in columns else [])]

    def run(batches):
        name, opened = None, {}

        def rows(lo: int, hi: int):
            got = {c: opened[c].array(lo, hi, opened[c].path.rsplit("/", 1)[1]) if opened[c] else pa.nulls(hi - lo + 1, arrow_type(c)) for c in reading}
            if "READ" in got and opened["ALTREAD"]:
                got["READ"] = masked_rows(got["READ"], got["ALTREAD"])
            n = hi - lo + 1
            place = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name])).dictionary_decode()
            b = pa.RecordBatch.from_arrays([place, pa.array(np.arange(lo, hi + 1)), *(got[c] for c in columns)], names=["archive", "row_id", *columns])
            for at in range(0, n, ROW_BATCH):
                yield shape(b.slice(at, ROW_BATCH)) if shape else b.slice(at, ROW_BATCH)

        for archive, lo, hi in _joined(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if archive != name:
                a = cached(archive)
                a.require_plain(table)
                base, name = a.base(table), archive
                found = {c: next((f"{base}/{p}" for p in FALLBACKS.get(c, (c,)) if f"{base}/{p}/idx1" in a.members), None) for c in reading}
                opened = {c: Physical.open(a, p) if p else None for c, p in found.items()}
            yield from rows(lo, hi)

    return windows.mapInArrow(run, schema)


def _joined(windows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Windows of an archive that follow each other made one, of ROW_BATCH rows at most."""
    held = None
    for name, lo, hi in windows:
        if held and held[0] == name and held[2] + 1 == lo and hi - held[1] < ROW_BATCH:
            held = (name, held[1], hi)
            continue
        if held:
            yield held
        held = (name, lo, hi)
    if held:
        yield held


def archive_rows(spark: SparkSession, path: str, columns: list[str], table: str | None = None, first: int | None = None, last: int | None = None, only: Column | None = None) -> DataFrame:
    """(archive, row_id, columns) of the rows from first to last, both included, of the archives that `only` allows.

    Bases come with N where ALTREAD masks them; a column that an archive lacks is null; an archive whose reads are stored
    against a reference is refused."""
    wanted = list(dict.fromkeys(columns))
    schema = ", ".join(["archive string", "row_id bigint", *(f"{c} {_kind_of(c)}" for c in wanted)])
    return _decoded(_windows(spark, path, table, first, last, only), schema, wanted, table)


#: Columns of reads, with the stored column that each is cut from.
READ_COLUMNS = {"read_len": ("READ_LEN", "int"), "read_type": ("READ_TYPE", "int"), "read_filter": ("READ_FILTER", "int"), "bases": ("READ", "string"), "quality": ("QUALITY", "string")}
SHOWN = np.concatenate([np.arange(33, 127), np.arange(94, 256)]).astype(np.uint8)


def archive_reads(spark: SparkSession, path: str, columns: list[str], table: str | None = None, route: Callable[..., dict[str, pa.Array]] | None = None, routes: str = "") -> DataFrame:
    """(archive, spot_id, mate_idx, columns): a row a read, cut from spots by READ_LEN; quality is ASCII; stored columns
    that are asked for come with every read of the spot.

    `route` adds columns (`routes`, their schema) to the reads of whole spots, and may leave reads out by a column `keep`."""
    needed = ["read_len", *(["read_type"] if route else [])]
    stored = list(dict.fromkeys(READ_COLUMNS[c][0] if c in READ_COLUMNS else c for c in (*needed, *columns)))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        cells = {c: b.column(k + 2) for k, c in enumerate(stored)}
        lengths, edges = parts(cells["READ_LEN"])
        count = np.diff(edges)
        spot = np.repeat(np.arange(b.num_rows), count)
        mate = np.arange(len(spot)) - edges[spot]
        ends = np.cumsum(lengths)
        begin = ends - lengths
        begin -= begin[edges[spot]]

        def read(c: str) -> pa.Array:
            source, kind = READ_COLUMNS[c]
            values, marks = parts(cells[source])
            missing = cells[source].is_null().to_numpy(zero_copy_only=False)[spot]
            size = np.diff(marks)[spot]
            if kind == "int":
                if source == "READ_LEN":
                    return pa.array(lengths).cast(pa.int32())
                absent = mate >= size
                return pa.array(np.append(values, 0)[np.where(absent, len(values), marks[spot] + mate)], mask=absent).cast(pa.int32())
            low = np.minimum(begin, size)
            high = np.minimum(begin + lengths, size)
            if source == "QUALITY":
                if len(values) and int(values.max()) >= 128:
                    text = SHOWN[values].tobytes().decode("latin-1")
                    return pa.array([None if no else text[a:z] for a, z, no in zip(marks[spot] + low, marks[spot] + high, missing, strict=True)], pa.string())
                values = SHOWN[values]
            return arrow_rows("READ", *gathered(values, marks[spot] + low, high - low), missing)

        out = {"archive": b.column(0).take(pa.array(spot)), "spot_id": b.column(1).take(pa.array(spot)), "mate_idx": pa.array((mate + 1).astype(np.int32))}
        got = {c: read(c) for c in dict.fromkeys((*needed, *(c for c in columns if c in READ_COLUMNS)))}
        if route:
            got |= route(spot, mate + 1, got)
        out |= {c: got[c] if c in got else cells[c].take(pa.array(spot)) for c in (*columns, *(r.split(" ")[0] for r in routes.split(", ") if r))}
        done = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        return done.filter(got["keep"]) if "keep" in got else done

    kinds = [f"{c} {READ_COLUMNS[c][1] if c in READ_COLUMNS else _kind_of(c)}" for c in columns]
    schema = ", ".join(["archive string", "spot_id bigint", "mate_idx int", *kinds, *([routes] if routes else [])])
    return _decoded(_windows(spark, path, table, None, None, None), schema, stored, table, cut)


def validated(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """(archive, spots, expected_spots, md5, errors): every blob of every column is verified and decoded."""

    held: dict = {}

    def one(name: str, column: str, start: int, count: int, offset: int, size: int):
        if held.get("of") != (name, column):  # blobs of a column come one after the other
            a = cached(name)
            physical = Physical.open(a, f"{a.base(table)}/{column}")
            held.update(of=(name, column), physical=physical, blobs={b.start_id: b for b in reversed(physical.blobs)})
        physical = held["physical"]
        try:
            _, raw = next(iter(physical.raw([held["blobs"][start]])))
            rows = decoded_array(column, raw, physical.checksum, count)
            error = None if len(rows) == count else f"{column} {start}: {len(rows)} of {count} rows"
        except FormatError as e:
            error = f"{column} {start}: {e}"
        return [(name, column, count, error)]

    def file_of(name: str):
        a = cached(name)
        digest, at = hashlib.md5(), 0
        while chunk := a.file.read_at(min(1 << 20, a.file.size() - at), at):
            digest.update(chunk)
            at += len(chunk)
        spots = next((int.from_bytes(v, "little") for p, _, v, _ in a.metadata(table) if p == "STATS/TABLE/SPOT_COUNT"), None)
        return [(name, spots, digest.hexdigest())]

    stretch = F.xxhash64("archive", "column", F.floor(F.col("start_id") / STRETCH))
    blobs = archive_blobs(spark, path, table).repartition(_tasks(spark, path), stretch).sortWithinPartitions("archive", "column", "start_id")
    checked = _told(blobs, "archive string, column string, rows bigint, error string", one)
    spots = F.sum(F.when(F.col("column") == "READ", F.col("rows"))).alias("spots")
    checked = checked.groupBy("archive").agg(spots, F.array_sort(F.collect_list("error")).alias("errors"))
    whole = _told(files(spark, path).repartition(_tasks(spark, path), "path"), "archive string, expected_spots bigint, md5 string", file_of)
    differ = F.when(~F.col("spots").eqNullSafe(F.col("expected_spots")) & F.col("expected_spots").isNotNull(), F.array(F.lit("spot count differs"))).otherwise(F.array().cast("array<string>"))
    return checked.join(whole, "archive").select("archive", "spots", "expected_spots", "md5", F.concat("errors", differ).alias("errors"))
