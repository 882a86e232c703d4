"""Reads, blobs and run catalogs derived from the supplied tables, as stand-ins for archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotweave.session import table

HEX = "0123456789abcdef"


def reads(spark: SparkSession, sf_dir: str, together: int = 1) -> DataFrame:
    """spot_id, mate_idx, read_len, read_type, read_filter, bases, quality, bases_b (a perturbed copy), x, y.

    together: so many consecutive spot ids share a partition, and come in order there."""
    line, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey"]
    if together > 1:
        # the window finds its spots within these partitions: one shuffle, of narrow rows
        line, keys = line.withColumn("_stretch", F.floor(F.col("l_orderkey") / together)).repartition("_stretch"), ["_stretch", *keys]
    order = Window.partitionBy(*keys).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    slots = line.select(
        F.col("l_orderkey").alias("spot_id"), F.row_number().over(order).alias("mate_idx"), (F.col("l_quantity").cast("int") % 45).alias("read_len"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 3).otherwise(5).alias("read_type"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("read_filter"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"),
    )
    s, m = F.col("spot_id").cast("string"), F.col("mate_idx").cast("string")
    slots = slots.withColumn("hx", F.concat(F.md5(F.concat(s, F.lit("."), m)), F.md5(F.concat(m, F.lit("."), s))))
    # letters are translated one by one: only those that a read keeps, and once for both copies
    n, cut = F.col("read_len"), lambda c, k: c.substr(F.lit(1), k)
    slots = slots.withColumn("head", cut(F.col("hx"), n)).withColumn("whole", F.translate("head", HEX, "ACGT" * 4))
    hx, head, whole = F.col("hx"), F.col("head"), F.col("whole")
    tail = lambda c: F.concat(F.lit("N"), c.substr(F.lit(2), F.lit(63)))
    digit = F.substring(hx, 64, 1)
    other = F.when(digit == "0", tail(whole)).when(digit == "1", F.translate(head, HEX, "CCGT" + "ACGT" * 3)).when(digit == "2", tail(F.translate(head, HEX, "ACGTACGTCCGTACGT"))).otherwise(whole)
    return slots.select(
        "spot_id", "mate_idx", "read_len", "read_type", "read_filter", "x", "y", whole.alias("bases"),
        F.translate(cut(F.reverse(hx), n), HEX, "#,5:?ADFIIIIIII?").alias("quality"),
        cut(other, F.when(F.substring(hx, 63, 1) == "0", F.greatest(n - 1, F.lit(0))).otherwise(n)).alias("bases_b"),
    )


READS_SQL = """
    slots as (select l_orderkey as spot_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as mate_idx,
        cast(l_quantity as int) % 45 as read_len, case l_returnflag when 'R' then 0 when 'A' then 3 else 5 end as read_type,
        case l_linestatus when 'O' then 0 else 1 end as read_filter, l_partkey as x, l_suppkey as y from lineitem),
    hashed as (select *, md5(spot_id || '.' || mate_idx) || md5(mate_idx || '.' || spot_id) as hx from slots),
    reads as (select spot_id, mate_idx, read_len, read_type, read_filter, x, y,
        substr(translate(hx, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, read_len) as bases,
        substr(translate(reverse(hx), '0123456789abcdef', '#,5:?ADFIIIIIII?'), 1, read_len) as quality,
        substr(case substr(hx, 64, 1) when '0' then 'N' || substr(translate(hx, '0123456789abcdef', 'ACGTACGTACGTACGT'), 2, 63)
            when '1' then translate(hx, '0123456789abcdef', 'CCGTACGTACGTACGT')
            when '2' then 'N' || substr(translate(hx, '0123456789abcdef', 'ACGTACGTCCGTACGT'), 2, 63)
            else translate(hx, '0123456789abcdef', 'ACGTACGTACGTACGT') end, 1,
            case substr(hx, 63, 1) when '0' then greatest(read_len - 1, 0) else read_len end) as bases_b from hashed)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob, start_id, id_range: 64 rows a blob, over row ids of orders."""
    rows = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / 64)
    out = rows.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("blob"))
    return out.select("blob", (F.col("blob") * 64 + 1).alias("start_id"), F.least(F.lit(64), F.col("n") - F.col("blob") * 64).cast("bigint").alias("id_range"))


BLOBS_SQL = """
    numbered as (select row_number() over (order by o_orderkey) as row_id from orders),
    blobs as (select (row_id - 1) // 64 as blob, min(row_id) as start_id, count(*) as id_range from numbered group by 1)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, layout, average, spots, size, customer: a run an order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("SRR"), F.lpad((F.col("o_orderkey") + 1000000).cast("string"), 7, "0")).alias("accession"), F.when(F.col("o_orderstatus") == "F", "PAIRED").otherwise("SINGLE").alias("layout"),
        (F.floor("o_totalprice") % 300).cast("bigint").alias("average"), F.col("o_orderkey").alias("spots"), F.floor("o_totalprice").cast("bigint").alias("size"), F.col("o_custkey").alias("customer"),
    )


RUNS_SQL = """
    runs as (select 'SRR' || lpad(cast(o_orderkey + 1000000 as varchar), 7, '0') as accession, case when o_orderstatus = 'F' then 'PAIRED' else 'SINGLE' end as layout,
        cast(floor(o_totalprice) as bigint) % 300 as average, o_orderkey as spots, cast(floor(o_totalprice) as bigint) as size, o_custkey as customer from orders)"""


def mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, service, url, pos: a mirror an order's line."""
    line = table(spark, sf_dir, "lineitem")
    service = F.element_at(F.array(*(F.lit(s) for s in ("ncbi", "s3", "gs", "x.sra-ncbi.1", "other", "s3-direct", "ena"))), F.col("l_linenumber"))
    accession = F.concat(F.lit("SRR"), F.lpad((F.col("l_orderkey") + 1000000).cast("string"), 7, "0"))
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = line.select(accession.alias("accession"), service.alias("service"), F.concat(F.lit("ftp://h/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("url"), pos.alias("pos"))
    return rows


MIRRORS_SQL = """
    mirrors as (select 'SRR' || lpad(cast(l_orderkey + 1000000 as varchar), 7, '0') as accession, ['ncbi', 's3', 'gs', 'x.sra-ncbi.1', 'other', 's3-direct', 'ena'][l_linenumber] as service,
        'ftp://h/' || l_partkey || '/' || l_suppkey as url, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, seq_len, bases: 40 chunks of 500 bases, the last shorter."""
    rows = spark.range(1, 41).withColumnRenamed("id", "row_id")
    text = F.translate(F.call_function("repeat", F.md5(F.col("row_id").cast("string")), F.lit(16)), HEX, "ACGT" * 4)
    n = F.when(F.col("row_id") == 40, 123).otherwise(500)
    return rows.select("row_id", n.cast("bigint").alias("seq_len"), text.substr(F.lit(1), n).alias("bases"))


REFERENCES_SQL = """
    refs as (select r as row_id, substr(translate(repeat(md5(cast(r as varchar)), 16), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, case when r = 40 then 123 else 500 end) as bases from range(1, 41) t(r)),
    genome as (select string_agg(bases, '' order by row_id) as g from refs)"""
