"""Run catalogs: accessions, mirrors, file reports, sizes, download plans, completion markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.functions.sequence import accession_kind, assign_slots, fastq_bytes, ftp_to_https, run_accession, split_or_empty

# Platforms that are declined, platform names by id, names found in schema texts (first match wins).
UNSUPPORTED_PLATFORMS = ("LS454", "ABI_SOLID", "ION_TORRENT", "HELICOS", "CAPILLARY")
PLATFORMS = {1: "LS454", 2: "ILLUMINA", 3: "ABI_SOLID", 4: "COMPLETE_GENOMICS", 5: "HELICOS", 6: "PACBIO_SMRT", 7: "ION_TORRENT", 8: "CAPILLARY", 9: "OXFORD_NANOPORE", 10: "DNBSEQ", 11: "ELEMENT"}
SCHEMA_PLATFORMS = {"Illumina": "ILLUMINA", "_454_": "LS454", "ABI": "ABI_SOLID", "Helicos": "HELICOS", "PacBio": "PACBIO_SMRT", "Nanopore": "OXFORD_NANOPORE", "IonTorrent": "ION_TORRENT"}
MIB, GIB = 1 << 20, 1 << 30


def platform_name(number: Column) -> Column:
    names = F.create_map(*(x for k, v in PLATFORMS.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(names, number.cast("int"))


def platform_of_schema(schema: Column) -> Column:
    out = F.lit(None).cast("string")
    for piece, name in reversed(SCHEMA_PLATFORMS.items()):
        out = F.when(schema.contains(piece), name).otherwise(out)
    return out


def default_reads(platform: Column) -> Column:
    """Reads a spot that a platform implies, else null."""
    return F.when(platform == "ILLUMINA", 2).when(platform.isin("PACBIO_SMRT", "OXFORD_NANOPORE"), 1)


def is_unsupported(platform: Column) -> Column:
    """Whether a platform is declined; an unknown one (null) is not."""
    return F.coalesce(platform.isin(*UNSUPPORTED_PLATFORMS), F.lit(False))


def is_aligned_schema(schema: Column) -> Column:
    return schema.contains("align:db") | schema.contains("align:tbl")


def mirror_priority(service: Column) -> Column:
    return F.when(service.isin("s3", "s3-direct"), 0).when(service == "gs", 1).when(service.contains("sra-ncbi"), 2).when(service == "ncbi", 3).otherwise(4)


def best_mirror(mirrors: DataFrame, key: str = "accession") -> DataFrame:
    """(key, url, service): of each key's mirrors (service, url, pos) the first of the best priority."""
    order = F.struct(mirror_priority(F.col("service")).alias("p"), F.col("pos"))
    return mirrors.groupBy(key).agg(F.min_by(F.struct("url", "service"), order).alias("m")).select(key, "m.url", "m.service")


def free_locations(locations: Column) -> Column:
    return F.filter(locations, lambda x: ~F.coalesce(x["ceRequired"], F.lit(False)) & ~F.coalesce(x["payRequired"], F.lit(False)))


def etag_md5(etag: Column) -> Column:
    bare = F.replace(etag, F.lit('"'), F.lit(""))
    return F.when(bare.rlike("^[0-9a-fA-F]{32}$"), F.lower(bare))


def lenient_size(text: Column) -> Column:
    return text.try_cast("bigint")


def listed_accessions(lines: DataFrame) -> DataFrame:
    """Accessions of a text file (value): trimmed, without blank lines and comments."""
    text = F.trim("value")
    return lines.select(text.alias("accession")).where((F.col("accession") != "") & ~F.col("accession").startswith("#"))


def first_occurrences(table: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key, that of the lowest position."""
    return table.groupBy(key).agg(F.min(position).alias(position))


def expanded_runs(inputs: DataFrame, projects: DataFrame) -> DataFrame:
    """(accession, pos): runs themselves, studies and projects by their runs (project, run), first occurrences only."""
    told = inputs.withColumn("kind", accession_kind(F.col("input")))
    runs = told.where("kind = 'run'").select(run_accession(F.col("input")).alias("accession"), "pos")
    inside = told.where("kind in ('study', 'bioproject')").join(projects, F.upper(F.trim("input")) == F.col("project")).select(F.col("run").alias("accession"), "pos")
    return first_occurrences(runs.unionByName(inside), "accession", "pos")


def missing(requested: DataFrame, found: DataFrame, key: str = "accession") -> DataFrame:
    return requested.join(found, key, "left_anti")


def resolved(requested: DataFrame, direct: DataFrame, located: DataFrame, info: DataFrame) -> DataFrame:
    """Requests with size and md5 from the direct probe, else from the locator, and the run's facts."""
    d = direct.select("accession", F.col("size").alias("_s1"), F.col("md5").alias("_m1"))
    s = located.select("accession", F.col("size").alias("_s2"), F.col("md5").alias("_m2"))
    out = requested.join(d, "accession", "left").join(s, "accession", "left").join(info, "accession", "left")
    return out.withColumn("size", F.coalesce("_s1", "_s2")).withColumn("md5", F.coalesce("_m1", "_m2")).withColumn("source", F.when(F.col("_s1").isNotNull(), "direct").when(F.col("_s2").isNotNull(), "located")).drop("_s1", "_s2", "_m1", "_m2")


def run_lengths(average: Column, reads: Column) -> Column:
    """A spot's average length dealt over its reads, the rest to the last."""
    each = F.floor(average / reads).cast("bigint")
    return F.when(reads > 0, F.transform(F.sequence(F.lit(1), reads.cast("int")), lambda k: F.when(k < reads, each).otherwise(average - each * (reads - 1)).cast("bigint")))


def report_files(report: DataFrame) -> DataFrame:
    """(accession, slot, url, md5, size) of file reports (run_accession and three ';'-lists); rows whose lists differ in
    number, that are empty or that have a size of 0 are left out."""
    ftp, md5, size = (split_or_empty(F.col(c)) for c in ("fastq_ftp", "fastq_md5", "fastq_bytes"))
    rows = report.select("run_accession", ftp.alias("ftp"), md5.alias("md5"), F.transform(size, lambda x: x.try_cast("bigint")).alias("size"))
    fine = (F.size("ftp") > 0) & (F.size("ftp") == F.size("md5")) & (F.size("ftp") == F.size("size")) & F.forall("size", lambda n: F.coalesce(n, F.lit(0)) > 0)
    rows = rows.where(fine).withColumn("slot", assign_slots(F.col("ftp"))).withColumn("url", F.transform("ftp", ftp_to_https))
    return rows.select(F.col("run_accession").alias("accession"), F.inline(F.arrays_zip("slot", "url", "md5", "size")))


def chunk_bytes(size: Column, configured: int = 0, medium: int = 256 * MIB, large: int = 2 * GIB) -> Column:
    """A download's chunk: as configured, else 8, 16 or 64 MiB by the file's size."""
    return F.lit(configured).cast("bigint") if configured else F.when(size < medium, 8 * MIB).when(size < large, 16 * MIB).otherwise(64 * MIB).cast("bigint")


def chunks(files: DataFrame, chunk: Column, size: str = "size") -> DataFrame:
    """Inclusive byte ranges (start, end) of files; an empty file has none."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1, chunk)
    rows = files.where(F.col(size) > 0).withColumn("_chunk", chunk).withColumn("start", F.explode(starts))
    return rows.withColumn("end", F.least(F.col("start") + F.col("_chunk") - 1, F.col(size) - 1)).drop("_chunk")


def backoff_ms(attempt: Column, base: int = 500, cap: int = 30_000) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap))).cast("bigint")


def expected_bytes(runs: DataFrame, mirrored: DataFrame, keep_archive: bool = True) -> DataFrame:
    """(accession, bytes): the mirrored files' sizes, else the archive's and an estimate of its FASTQ."""
    sizes = mirrored.groupBy("accession").agg(F.sum("size").alias("_files"))
    archive = F.col("size") if keep_archive else F.lit(0)
    return runs.join(sizes, "accession", "left").select("accession", F.coalesce("_files", archive + F.coalesce(fastq_bytes(F.col("spots"), F.col("read_lengths"), True), F.lit(0))).alias("bytes"))


def needs_confirmation(sizes: DataFrame, threshold: int = 100 * GIB) -> DataFrame:
    return sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")).withColumn("confirm", F.col("bytes") > threshold)


def still_complete(markers: DataFrame, runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Accessions whose marker (accession, version, config, size, files array<struct<name, bytes>>) matches the wanted run
    (accession, version, config, size) and all whose output files (accession, name, bytes) are there as told."""
    same = markers.join(runs, ["accession", "version", "config", "size"])
    files = same.select("accession", F.inline_outer("files"))
    there = outputs.withColumn("_there", F.lit(True))
    checked = files.join(there, ["accession", "name", "bytes"], "left")
    return checked.groupBy("accession").agg(F.bool_and(F.col("name").isNotNull() & F.coalesce("_there", F.lit(False))).alias("ok")).where("ok").select("accession")


def run_info(csv_rows: DataFrame) -> DataFrame:
    """Typed run facts of a run-info table read as strings; rows without a run are left out."""
    n = lambda c, t="bigint": F.col(c).try_cast(t)
    reads = F.when(F.upper("LibraryLayout") == "PAIRED", 2).otherwise(1)
    rows = csv_rows.where(F.coalesce(F.trim("Run"), F.lit("")) != "")
    return rows.select(F.trim("Run").alias("accession"), n("spots").alias("spots"), n("bases").alias("bases"), F.upper("Platform").alias("platform"), reads.alias("nreads"), run_lengths(n("avgLength"), reads).alias("read_lengths"))


def in_input_order(results: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(results, "accession", "left").orderBy("pos")


def ranked(table: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
