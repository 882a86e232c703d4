"""Queries over archives: the derived reads are written as archives, and everything is read back from those files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions import defline
from spotweave.operators import metadata, quality, routing
from spotweave.plans import derived
from spotweave.plans.derived import READS_SQL
from spotweave.plans.queries import query
from spotweave.session import scratch
from spotweave.sources import relations, writer

#: Spot ids of one archive.
SPOTS = 8192

SPOTS_SQL = f"""{READS_SQL},
    cut as (select *, length(bases_b) as n, substr(quality, 1, length(bases_b)) as q from reads),
    spots as (select spot_id, 'A' || lpad(cast(spot_id // {SPOTS} as varchar), 6, '0') as archive, row_number() over (partition by spot_id // {SPOTS} order by spot_id) as row_id,
        max(x) as sx, max(y) as sy, sum(n)::bigint as spot_len, string_agg(bases_b, '' order by mate_idx) as sbases, string_agg(q, '' order by mate_idx) as squality,
        list(n order by mate_idx) as lengths, count(*) as mates from cut group by spot_id),
    archived as (select s.archive, s.row_id as row_id, c.spot_id, c.mate_idx, c.n as read_len, c.read_type, c.read_filter, c.bases_b as bases, c.q as quality, s.sx as x, s.sy as y from cut c join spots s using (spot_id))"""


def spots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of archives from reads in the order of their spots: a spot with its reads one after the other, numbered from 1
    in each archive.  Bases of a spot follow each other already, so that only edges are set anew."""
    archive, count, before = None, 0, None

    def numbered(number: np.ndarray) -> np.ndarray:
        nonlocal archive, count
        new = np.concatenate([[number[0] != archive], number[1:] != number[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(number)), -count))
        out = np.arange(len(number)) - first + 1
        archive, count = number[-1], int(out[-1])
        return out

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal before
        spot, mate = (b.column(c).to_numpy() for c in ("spot_id", "mate_idx"))
        if ((spot[1:] == spot[:-1]) & (mate[1:] < mate[:-1])).any():
            b = b.take(pa.array(np.lexsort([mate, spot])))
        starts = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        edges = np.append(starts, len(spot))
        ids, number = spot[starts], spot[starts] // SPOTS
        if (np.diff(ids) < 0).any() or before is not None and ids[0] <= before:
            raise ValueError("spots out of order")
        before = ids[-1]
        names = {n: "A" + str(n)[:6].rjust(6, "0") for n in np.unique(number).tolist()}

        def joined(c: str) -> pa.Array:
            values, lengths = writer.flat(b.column(c))
            ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
            return pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values))

        most = lambda c: pa.array(np.maximum.reduceat(writer.flat(b.column(c))[0], starts))
        listed = lambda values: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
        cells = [
            pa.array([names[n] for n in number.tolist()]), pa.array(numbered(number)), joined("bases"), joined("quality"), listed(writer.flat(b.column("bases"))[1]),
            *(listed(writer.flat(b.column(c))[0]) for c in ("read_type", "read_filter")), most("x"), most("y"), pa.array(ids).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cells, names=["archive", "row_id", "READ", "QUALITY", "READ_LEN", "READ_TYPE", "READ_FILTER", "X", "Y", "NAME"])

    held = None
    for b in batches:
        b = pa.concat_batches([held, b]) if held is not None else b
        spot = b.column("spot_id").to_numpy()
        # the last spot may go on in the next batch
        last = int(np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))[-1]) if len(spot) else 0
        if last:
            yield rows(b.slice(0, last))
        held = b.slice(last)
    if held is not None and held.num_rows:
        yield rows(held)


_places: dict[tuple[str, str], str] = {}


def place(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the archives of these tables, written once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _places:
        target = scratch(spark)
        reads = derived.reads(spark, sf_dir, SPOTS).where("spot_id is not null")
        quality = F.col("quality").substr(F.lit(1), F.length("bases_b")).alias("quality")
        own = reads.select("spot_id", "mate_idx", F.col("bases_b").alias("bases"), quality, "read_type", "read_filter", "x", "y")
        own.mapInArrow(lambda batches: writer.stored(spots(batches), target), writer.REPORT).write.format("noop").mode("overwrite").save()
        _places[key] = target
    return _places[key]


def named(df: DataFrame) -> DataFrame:
    """Archives by their name instead of their path."""
    file = F.substring_index("archive", "/", -1)
    return df.withColumn("archive", file.substr(F.lit(1), F.length(file) - len(".sra")))


@query(f"with {SPOTS_SQL} select archive, row_id as spot_id, mate_idx, read_len, read_type, read_filter, bases, quality, cast(spot_id as varchar) as name, x, y from archived")
def archive_reads(spark, d):
    reads = relations.archive_reads(spark, place(spark, d), ["read_len", "read_type", "read_filter", "bases", "quality", "NAME", "X", "Y"])
    return named(reads).select("archive", "spot_id", "mate_idx", "read_len", "read_type", "read_filter", "bases", "quality", F.col("NAME").alias("name"), F.col("X")[0].alias("x"), F.col("Y")[0].alias("y"))


@query(f"with {SPOTS_SQL} select archive, row_id, sbases as bases, spot_len from spots where row_id between 100 and 299")
def archive_window(spark, d):
    """A window of rows: the blobs outside it are not read."""
    rows = relations.archive_rows(spark, place(spark, d), ["READ", "READ_LEN"], first=100, last=299)
    return named(rows).select("archive", "row_id", F.col("READ").alias("bases"), F.aggregate("READ_LEN", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("spot_len"))


@query(f"""with {SPOTS_SQL}, per as (select archive, count(*) as n from spots group by 1), c(col) as (values ('ALTREAD'), ('NAME'), ('QUALITY'), ('READ'), ('READ_FILTER'), ('READ_LEN'), ('READ_TYPE'), ('X'), ('Y'))
    select archive, col as "column", n as rows, ceil(n / {writer.BLOB_ROWS}.0)::bigint as blobs, 1 as first_row from per, c""")
def archive_columns(spark, d):
    return named(relations.column_statistics(relations.archive_blobs(spark, place(spark, d)))).select("archive", "column", "rows", "blobs", "first_row")


@query(f"""with {SPOTS_SQL}, per as (select archive from spots group by 1) select archive, 18 + 1 as files, 9 + 4 as directories from per""")
def archive_members(spark, d):
    toc = named(relations.archive_members(spark, place(spark, d)))
    return toc.groupBy("archive").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("directories"))


@query(f"""with {SPOTS_SQL} select archive, count(*) as spots, sum(spot_len)::bigint as bases, 'spotweave' as loader from spots group by 1""")
def archive_statistics(spark, d):
    """Counters and the loader's name from the metadata tree."""
    nodes = named(relations.archive_metadata(spark, place(spark, d)))
    counter = lambda name: F.max(F.when(F.col("path") == f"STATS/TABLE/{name}", metadata.little_endian(F.col("value")))).cast("bigint")
    loader = F.max(F.when(F.col("path") == "SOFTWARE/loader", F.decode(F.element_at("attributes", "name"), "UTF-8")))
    return nodes.groupBy("archive").agg(counter("SPOT_COUNT").alias("spots"), counter("BASE_COUNT").alias("bases"), loader.alias("loader"))


@query(f"with {SPOTS_SQL} select archive, count(*) as spots, count(*) as expected_spots, 32 as md5_length, 0 as errors from spots group by 1")
def archive_validation(spark, d):
    """Every blob verified and decoded, spots reconciled with the metadata."""
    out = named(relations.validated(spark, place(spark, d)))
    return out.select("archive", "spots", "expected_spots", F.length("md5").alias("md5_length"), F.size("errors").alias("errors"))


KEPT = """
    kept as (select *, cast(row_number() over (partition by spot_id order by mate_idx) as int) - 1 as emit_idx, count(*) over (partition by spot_id) as bio_reads
        from archived where read_len > 0 and read_type & 1 = 1),
    routed as (select *, case when bio_reads < 2 then 'unpaired' else 'read' || (emit_idx + 1) end as slot from kept)"""


def slots(spark: SparkSession, sf_dir: str, columns: list[str], mode: str = "split3", rule: routing.ReadFilter = routing.ReadFilter()) -> DataFrame:
    """(archive, spot_id, mate_idx, columns, slot): archives decoded, cut, filtered and routed; a spot lies whole in its
    batch, and is routed there."""

    def route(spot: np.ndarray, number: np.ndarray, got: dict[str, pa.Array]) -> dict[str, pa.Array]:
        kept, slot = routing.routed_arrays(spot, number, got["read_len"].to_numpy(), got["read_type"].fill_null(-1).to_numpy(), mode, rule)
        return {"keep": pa.array(kept), "slot": pa.array(slot, pa.string())}

    return named(relations.archive_reads(spark, place(spark, sf_dir), columns, route=route, routes="slot string"))


@query(f"""with {SPOTS_SQL}, {KEPT}, b as (select *, archive || '.' || row_id || ' ' || spot_id || ' length=' || read_len as body from routed)
    select archive, row_id as spot_id, mate_idx, slot, '@' || body || chr(10) || bases || chr(10) || '+' || body || chr(10) || quality as record from b""")
def archive_fastq(spark, d):
    r = slots(spark, d, ["read_len", "bases", "quality", "NAME"])
    body = defline.default_body(F.col("archive"), F.col("spot_id"), F.col("NAME"), F.col("read_len"))
    return r.select("archive", "spot_id", "mate_idx", "slot", defline.fastq_record(body, F.col("bases"), F.col("quality")).alias("record"))


@query(f"""with {SPOTS_SQL}, c as (select *, count(*) over (partition by spot_id) as spot_reads from archived)
    select archive, case when spot_reads < 2 then 'unpaired' else 'read' || mate_idx end as slot, count(*) as n, sum(read_len)::bigint as bases from c where read_len >= 10 and read_type & 1 = 1 group by 1, 2""")
def archive_split_files(spark, d):
    r = slots(spark, d, ["read_len"], "split_files", routing.ReadFilter(10))
    return r.groupBy("archive", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("read_len").cast("bigint").alias("bases"))


@query(f"""with {SPOTS_SQL} select (unicode(c) - 33)::int as phred, count(*) as n from (select unnest(string_split(quality, '')) as c from archived) where c <> '' group by 1""")
def archive_quality_histogram(spark, d):
    return quality.histogram(relations.archive_reads(spark, place(spark, d), ["quality"]))


@query(f"""with {SPOTS_SQL}, {KEPT}, n as (select archive, count(*) filter (slot = 'read1') as r1, count(*) filter (slot = 'read2') as r2, count(*) as n, count(distinct spot_id) as s from routed group by 1)
    select archive, r1::bigint as read1, r2::bigint as read2, abs(r1 - r2)::bigint as violations, n = s as single_end from n""")
def archive_pair_checks(spark, d):
    """Mates per archive, their difference, and whether no spot has two reads."""
    r = slots(spark, d, [])
    out = r.groupBy("archive").agg(*(F.count_if(F.col("slot") == f"read{k}").alias(f"read{k}") for k in (1, 2)), F.count(F.lit(1)).alias("n"), F.count_distinct("spot_id").alias("s"))
    return out.select("archive", "read1", "read2", F.abs(F.col("read1") - F.col("read2")).alias("violations"), (F.col("n") == F.col("s")).alias("single_end"))


@query(f"""with {SPOTS_SQL} select archive, row_id, sum(spot_len)::bigint as consumed, sum(length(squality))::bigint as decoded from spots group by 1, 2""")
def archive_boundaries(spark, d):
    """What reads consume of every spot against what its blob decoded to."""
    rows = named(relations.archive_rows(spark, place(spark, d), ["QUALITY", "READ_LEN"]))
    return rows.select("archive", "row_id", F.aggregate("READ_LEN", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("consumed"), F.length("QUALITY").cast("bigint").alias("decoded"))


@query(f"""with {SPOTS_SQL} select row_id || ',' || sbases || ',' || array_to_string(lengths, ';') || ',' || spot_id as line from spots""")
def archive_dump_csv(spark, d):
    rows = relations.archive_rows(spark, place(spark, d), ["READ", "READ_LEN", "NAME"])
    return rows.select(F.concat_ws(",", F.col("row_id").cast("string"), "READ", F.array_join(F.col("READ_LEN").cast("array<string>"), ";"), "NAME").alias("line"))


@query(f"""with {SPOTS_SQL} select '{{"row_id":' || row_id || ',"READ":"' || sbases || '","READ_LEN":[' || array_to_string(lengths, ',') || '],"NAME":"' || spot_id || '"}}' as line from spots""")
def archive_dump_json(spark, d):
    rows = relations.archive_rows(spark, place(spark, d), ["READ", "READ_LEN", "NAME"])
    return rows.select(F.to_json(F.struct("row_id", "READ", "READ_LEN", "NAME")).alias("line"))
