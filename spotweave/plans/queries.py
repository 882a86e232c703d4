"""Queries over the reference's operators, on tables derived from the supplied ones, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions import defline
from spotweave.functions import sequence as sq
from spotweave.operators import catalog, compare, intervals, metadata, pagemap, quality, render, restore, routing
from spotweave.plans import derived
from spotweave.plans.derived import BLOBS_SQL, MIRRORS_SQL, READS_SQL, REFERENCES_SQL, RUNS_SQL
from spotweave.session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KEPT_SQL = """
    kept as (select *, cast(row_number() over (partition by spot_id order by mate_idx) as int) - 1 as emit_idx, count(*) over (partition by spot_id) as bio_reads
        from reads where read_len > 0 and read_type & 1 = 1),
    routed as (select *, case when bio_reads < 2 then 'unpaired' else 'read' || (emit_idx + 1) end as slot from kept)"""


@query(f"with {READS_SQL}, {KEPT_SQL} select slot, count(*) as n, cast(sum(read_len) as bigint) as bases from routed group by slot")
def split3_routing(spark, d):
    return routing.slot_counts(routing.routed(derived.reads(spark, d)))


@query(f"""with {READS_SQL}, c as (select *, count(*) over (partition by spot_id) as spot_reads from reads)
    select case when spot_reads < 2 then 'unpaired' else 'read' || mate_idx end as slot, count(*) as n, cast(sum(read_len) as bigint) as bases
    from c where read_len >= 10 and read_type & 1 = 1 group by 1""")
def split_files_routing(spark, d):
    return routing.slot_counts(routing.routed(derived.reads(spark, d), "split_files", routing.ReadFilter(10)))


@query(f"""with {READS_SQL}, {KEPT_SQL} select abs(coalesce(sum(case when slot = 'read1' then 1 end), 0) - coalesce(sum(case when slot = 'read2' then 1 end), 0))::bigint as violations from routed""")
def pair_violations(spark, d):
    return routing.pair_violations(routing.slot_counts(routing.routed(derived.reads(spark, d))))


@query(f"""with {READS_SQL} select case when read_len = 0 then 'empty' when read_type & 1 = 0 then 'technical' when read_len < 5 then 'short' else 'kept' end as reason, count(*) as n from reads group by 1""")
def filter_reasons(spark, d):
    return routing.drop_reasons(derived.reads(spark, d), routing.ReadFilter(5))


@query(f"""with {READS_SQL}, {KEPT_SQL}, b as (select *, 'RUN1.' || spot_id || ' x' || x || ' length=' || read_len as body from routed)
    select spot_id, mate_idx, slot, '@' || body || chr(10) || bases || chr(10) || '+' || body || chr(10) || quality as record from b""")
def fastq_records(spark, d):
    r = routing.routed(derived.reads(spark, d))
    body = defline.default_body(F.lit("RUN1"), F.col("spot_id"), F.concat(F.lit("x"), F.col("x").cast("string")), F.col("read_len"))
    return r.select("spot_id", "mate_idx", "slot", defline.fastq_record(body, F.col("bases"), F.col("quality")).alias("record"))


@query(f"""with {READS_SQL} select spot_id, mate_idx, '>RUN1.' || spot_id || ' length=' || read_len || chr(10) || bases as record from reads where read_len > 0 and read_type & 1 = 1""")
def fasta_records(spark, d):
    r = routing.routed(derived.reads(spark, d), "split_spot")
    body = defline.default_body(F.lit("RUN1"), F.col("spot_id"), None, F.col("read_len"))
    return r.select("spot_id", "mate_idx", defline.fasta_record(body, F.col("bases")).alias("record"))


@query(f"""with {READS_SQL} select spot_id, mate_idx, 'RUN1/' || spot_id || '/' || mate_idx || ':' || case when read_filter = 0 then '' else cast(x as varchar) end || '$' || read_len as body from reads""")
def templated_deflines(spark, d):
    columns = {"run": F.lit("RUN1"), "spot_id": F.col("spot_id"), "read_id": F.col("mate_idx"), "spot_name": F.when(F.col("read_filter") != 0, F.col("x")), "read_len": F.col("read_len")}
    return derived.reads(spark, d).select("spot_id", "mate_idx", defline.compile_template("@$ac/$si/$ri:$sn$$$rl", columns).alias("body"))


@query(f"""with {READS_SQL}, {KEPT_SQL} select distinct slot, 'RUN1' || case when slot like 'read%' then '_R' || substr(slot, 5) else '' end || '.fasta.gz' as name from routed""")
def output_filenames(spark, d):
    slots = routing.routed(derived.reads(spark, d)).select("slot").distinct()
    return slots.select("slot", defline.output_filename(F.lit("RUN1"), F.col("slot"), ".fasta.gz", "_R").alias("name"))


@query(f"""with {READS_SQL} select spot_id, mate_idx, translate(reverse(bases_b), 'ACGTMRWSYKVHDBN', 'TGCAKYWSRMBDHVN') as turned from reads""")
def reverse_complement(spark, d):
    return derived.reads(spark, d).select("spot_id", "mate_idx", sq.reverse_complement(F.col("bases_b")).alias("turned"))


@query(f"""with {READS_SQL}, q as (select spot_id, mate_idx, read_len, case when mate_idx % 3 = 0 then substr(quality, 1, greatest(read_len - 2, 0)) when mate_idx % 3 = 1 then replace(quality, 'I', chr(32)) else quality end as q from reads)
    select spot_id, mate_idx, case when length(q) <> read_len then rpad(substr(q, 1, read_len), read_len, '?') else regexp_replace(q, '[^!-~]', '?', 'g') end as repaired, regexp_matches(q, '[^!-~]') as invalid from q""")
def quality_repair(spark, d):
    q, n = F.col("quality"), F.col("mate_idx") % 3
    rows = derived.reads(spark, d).withColumn("q", F.when(n == 0, q.substr(F.lit(1), F.greatest(F.col("read_len") - 2, F.lit(0)))).when(n == 1, F.replace(q, F.lit("I"), F.lit(" "))).otherwise(q))
    return rows.select("spot_id", "mate_idx", sq.repair_quality(F.col("q"), F.col("read_len")).alias("repaired"), sq.has_invalid_quality(F.col("q")).alias("invalid"))


@query(f"""with {READS_SQL} select ascii(c) - 33 as phred, count(*) as n from (select unnest(string_split(quality, '')) as c from reads where quality <> '') group by 1""")
def quality_histogram(spark, d):
    return quality.histogram(derived.reads(spark, d))


@query(f"""with {READS_SQL}, a as (select ascii(c) - 33 as phred, count(*) as n from (select unnest(string_split(quality, '')) as c from reads where quality <> '') group by 1),
    b as (select ascii(c) - 33 as phred, count(*) as n from (select unnest(string_split(quality, '')) as c from reads where quality <> '' and read_type & 1 = 1) group by 1)
    select phred, coalesce(a.n, 0) as expected, coalesce(b.n, 0) as seen from a full join b using (phred) where coalesce(a.n, 0) <> coalesce(b.n, 0) order by phred limit 8""")
def histogram_differences(spark, d):
    r = derived.reads(spark, d)
    return quality.histogram_differences(quality.histogram(r), quality.histogram(r.where("read_type & 1 = 1")))


PACKED_SQL = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(l_orderkey || '-' || l_partkey) as h, cast(l_quantity as int) as n from lineitem"


def packed(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))).alias("h"), F.col("l_quantity").cast("int").alias("n"))


@query(f"""with p as ({PACKED_SQL}) select l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(translate(h, '0123456789abcdef', 'NACMGRSVTWYHKDBN'), 1, n) as bases,
    substr(array_to_string(list_transform(string_split(h, ''), lambda c: ['AA','AC','AG','AT','CA','CC','CG','CT','GA','GC','GG','GT','TA','TC','TG','TT'][instr('0123456789abcdef', c)]), ''), 1, n) as pairs from p""")
def unpacked_bases(spark, d):
    p = packed(spark, d)
    binary = F.unhex("h")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sq.unpack_4na(binary, F.col("n")).alias("bases"), sq.unpack_2na(binary, F.col("n")).alias("pairs"))


@query(f"""with {READS_SQL}, m as (select spot_id, mate_idx, bases, list_transform(range(1, read_len + 1), lambda i: case when i % 7 = spot_id % 7 then instr('0123456789abcdef', substr(md5(cast(spot_id as varchar)), 1 + i % 32, 1)) - 1 else 0 end) as mask from reads)
    select spot_id, mate_idx, array_to_string(list_transform(range(1, length(bases) + 1), lambda i: substr('NACMGRSVTWYHKDBN', 1 + ((case substr(bases, i, 1) when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end) | mask[i])::int, 1)), '') as merged from m""")
def ambiguity_merge(spark, d):
    r = derived.reads(spark, d)
    n, code = F.col("read_len"), lambda c: F.ascii(c) - F.when(F.ascii(c) > 57, 87).otherwise(48)
    # the hash's digits from the second on, over and over: hashed once a read
    digits = F.call_function("repeat", F.md5(F.col("spot_id").cast("string")), (F.floor(n / 32) + 2).cast("int")).substr(F.lit(2), n)
    mask = F.when(n > 0, F.transform(F.split(digits, ""), lambda c, i: F.when((i + 1) % 7 == F.col("spot_id") % 7, code(c)).otherwise(0))).otherwise(F.array().cast("array<int>"))
    return r.select("spot_id", "mate_idx", sq.merge_ambiguity(F.col("bases"), mask).alias("merged"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, [0,1,1,2,2,3,3,4,4,5,5,6,7,8,9,10,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28,29,30,31,32,33,34,35,36,37,38,39,40][greatest(-6, least(40, l_linenumber * 7 - 12)) + 7]::int as phred,
    chr(33 + least(l_linenumber * 9, 222)) || chr(33) as ascii, repeat(case when l_linestatus = 'O' then '?' else '$' end, l_linenumber) as lite from lineitem""")
def quality_codes(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sq.log_odds_to_phred(n * 7 - 12).cast("int").alias("phred"),
        sq.phred_to_ascii(F.array(n * 9, F.lit(0))).alias("ascii"), sq.lite_quality(n, F.col("l_linestatus") == "O").alias("lite"),
    )


@query(f"""with {BLOBS_SQL} select blob, start_id, id_range, coalesce(sum(id_range) over (order by blob rows between unbounded preceding and 1 preceding), 0)::bigint as before from blobs""")
def blob_prefix_sums(spark, d):
    return intervals.prefix_sums(derived.blobs(spark, d), bucket=64).withColumn("before", F.col("before").cast("bigint"))


@query(f"""with {BLOBS_SQL} select (select min(start_id) from blobs) as first_row, (select sum(id_range)::bigint from blobs) as rows, (select count(*) from blobs) as blobs""")
def column_statistics(spark, d):
    return derived.blobs(spark, d).agg(F.min("start_id").alias("first_row"), F.sum("id_range").alias("rows"), F.count(F.lit(1)).alias("blobs"))


@query(f"""with {BLOBS_SQL}, w as (select distinct l_partkey as row_id from lineitem) select row_id, blob, start_id, id_range from w join blobs on row_id >= start_id and row_id < start_id + id_range""")
def blob_of_row(spark, d):
    return intervals.find_blob(table(spark, d, "lineitem").select(F.col("l_partkey").alias("row_id")).distinct(), derived.blobs(spark, d), grid=256)


@query(f"""with {BLOBS_SQL}, p as (select blob, case when blob % 10 = 3 then start_id + 5 when blob % 10 = 7 then start_id - 5 else start_id end as start_id, id_range from blobs),
    e as (select *, lag(start_id + id_range) over (order by start_id) as before from p)
    select start_id, case when start_id < before then 'overlap' else 'gap' end as problem from e where before is not null and before <> start_id""")
def blob_range_problems(spark, d):
    k = F.col("blob") % 10
    moved = derived.blobs(spark, d).withColumn("start_id", F.when(k == 3, F.col("start_id") + 5).when(k == 7, F.col("start_id") - 5).otherwise(F.col("start_id")))
    return intervals.range_problems(moved)


@query("""with r as (select distinct l_suppkey as grp, l_partkey * 10 as s, l_partkey * 10 + cast(l_quantity as bigint) as e from lineitem),
    m as (select *, max(e) over (partition by grp order by s, e rows between unbounded preceding and 1 preceding) as before from r),
    i as (select *, sum(case when before is null or s > before + 20 then 1 else 0 end) over (partition by grp order by s, e rows unbounded preceding) as island from m)
    select grp, min(s) as start, max(e) as "end" from i group by grp, island""")
def coalesced_ranges(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("bigint")).alias("end"))
    return intervals.merged_ranges(line, 20, ["grp"])


@query(f"""with {BLOBS_SQL}, o as (select start_id + 10 as start_id, 30::bigint as id_range, 'overlay' as tier from blobs where blob % 5 = 2),
    b as (select start_id, id_range, 'base' as tier from blobs)
    select * from b where not exists (select 1 from o where b.start_id < o.start_id + o.id_range and o.start_id < b.start_id + b.id_range) union all select * from o""")
def overlay_merge(spark, d):
    b = derived.blobs(spark, d)
    overlay = b.where("blob % 5 = 2").select((F.col("start_id") + 10).alias("start_id"), F.lit(30).cast("bigint").alias("id_range"), F.lit("overlay").alias("tier"))
    return intervals.overlaid(b.select("start_id", "id_range", F.lit("base").alias("tier")), overlay, 128)


@query("""with t as (select row_number() over (order by c_custkey) as row_id, c_name from customer), n as (select count(*) as c from t),
    s as (select 0 as k, 5 as lo, 5 as hi union all select 1, 10, 20 union all select 2, (select c from n) - 3, (select c from n) union all select 3, 1, 4 union all select 4, 15, 18),
    o as (select *, coalesce(sum(hi - lo + 1) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as before from s)
    select row_id, c_name, before + row_id - lo as ordinal from o join t on row_id between lo and hi""")
def row_range_scan(spark, d):
    c = table(spark, d, "customer")
    n = c.count()
    rows = c.select((F.col("c_custkey") + 1).alias("row_id"), "c_name")
    return intervals.rows_of_ranges(rows, f"5,20-10,{n - 3}-,-4,15-18")


@query(f"""with {READS_SQL}, t as (select distinct (spot_id // 50) * 50 as start_id from reads where spot_id % 50 < 7 and spot_id >= 50), names as (select start_id, 'M1:' || start_id || ':$X:$Y' as template from t),
    r as (select spot_id, mate_idx, x, y, coalesce((select arg_max(template, start_id) from names where start_id <= spot_id), (select arg_min(template, start_id) from names)) as t from reads)
    select spot_id, mate_idx, replace(replace(t, '$X', cast(x as varchar)), '$Y', cast(y as varchar)) as name from r""")
def tile_names(spark, d):
    r = derived.reads(spark, d)
    start = (F.floor(F.col("spot_id") / 50) * 50).alias("start_id")
    names = r.where("spot_id % 50 < 7 and spot_id >= 50").select(start).distinct()
    names = names.select("start_id", F.concat(F.lit("M1:"), F.col("start_id").cast("string"), F.lit(":$X:$Y")).alias("template"))
    found = intervals.as_of(r.select("spot_id", "mate_idx", "x", "y"), names, "spot_id", "start_id", "template", bucket=512)
    return found.select("spot_id", "mate_idx", intervals.template_name(F.col("as_of"), F.col("x"), F.col("y")).alias("name"))


@query(f"""with {READS_SQL} select spot_id, mate_idx, read_len, bases, quality from reads""")
def spot_slicing(spark, d):
    r = derived.reads(spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("mate_idx", "read_len", "read_type", "bases", "quality")))
    spots = r.groupBy(F.col("spot_id").alias("row_id")).agg(ordered.alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    spots = spots.select("row_id", F.array_join(pick("bases"), "").alias("read"), F.array_join(pick("quality"), "").alias("quality"), pick("read_len").alias("read_len"), pick("read_type").alias("read_type"))
    return routing.exploded(spots).select(F.col("row_id").alias("spot_id"), "mate_idx", "read_len", "bases", "quality")


@query(f"""with {READS_SQL}, b as (select spot_id // 64 as blob, sum(read_len)::bigint as told, sum(length(bases))::bigint as bases, sum(length(quality))::bigint as qualities from reads group by 1)
    select *, told = bases and bases = qualities as sound from b""")
def blob_length_checks(spark, d):
    r = derived.reads(spark, d).groupBy(F.floor(F.col("spot_id") / 64).alias("blob"))
    out = r.agg(F.sum("read_len").alias("told"), F.sum(F.length("bases")).cast("bigint").alias("bases"), F.sum(F.length("quality")).cast("bigint").alias("qualities"))
    return out.withColumn("sound", (F.col("told") == F.col("bases")) & (F.col("bases") == F.col("qualities")))


@query(f"""with {READS_SQL}, l as (select spot_id, list(read_len order by mate_idx) as n from reads group by spot_id), f as (select spot_id, unnest(n) as len, generate_subscripts(n, 1) as k, n from l)
    select spot_id, cast(k - 1 as bigint) as row_id, coalesce(list_sum(n[1:k - 1]), 0)::bigint as off, len::bigint as len from f""")
def page_map_extents(spark, d):
    r = derived.reads(spark, d).groupBy("spot_id").agg(F.array_sort(F.collect_list(F.struct("mate_idx", "read_len"))).alias("r"))
    n = F.transform("r", lambda x: x["read_len"])
    page_map = F.struct(n.alias("lengths"), F.transform(n, lambda x: F.lit(1)).alias("leng_runs"), F.lit("identity").alias("kind"), F.array().cast("array<int>").alias("map"))
    return r.select("spot_id", F.posexplode(pagemap.row_extents(page_map)).alias("k", "e")).select("spot_id", F.col("k").cast("bigint").alias("row_id"), "e.off", "e.len")


@query(f"""with {REFERENCES_SQL}, a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 13 + l_suppkey) % 19000 as ref_start, cast(l_quantity as bigint) * 20 as ref_len from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(substr(g, cast(ref_start + 1 as bigint), ref_len)) as span from a, genome""")
def reference_spans(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 19000).alias("ref_start"), (F.col("l_quantity").cast("bigint") * 20).alias("ref_len"))
    # an alignment is known by its span here: rows of one span share it
    spans = line.select("ref_start", "ref_len").distinct().withColumn("align_id", F.col("ref_start") * 10000 + F.col("ref_len"))
    refs = derived.references(spark, d)
    got = restore.fetched_spans(spans, refs, restore.chunk_size(refs)).select("ref_start", "ref_len", F.md5("ref_bases").alias("span"))
    return line.join(got, ["ref_start", "ref_len"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "span")


@query(f"""with {READS_SQL}, f as (select spot_id, mate_idx, read_len, bases, bases_b from reads where length(bases_b) = read_len)
    select spot_id, mate_idx, array_to_string(list_transform(range(1, read_len + 1), lambda i: case when (i + spot_id) % 5 = 0 then substr(bases_b, i, 1) else substr(bases, i, 1) end), '') as read from f""")
def restored_reads(spark, d):
    # a generator in place of a filter: a filter would be moved below the letters and make them again
    cells = F.array(F.struct("spot_id", "mate_idx", "read_len", "bases", "bases_b"))
    r = derived.reads(spark, d).select(F.inline(F.when(F.length("bases_b") == F.col("read_len"), cells)))
    n = F.col("read_len")
    # every fifth position counts: stretches of one pattern, and every fifth letter from the first such on
    five = F.array(*(F.lit(k) for k in (0, 0, 0, 0, 1)))
    ahead = F.pmod(F.col("spot_id"), F.lit(5)).cast("int")
    flags = F.slice(F.flatten(F.array_repeat(five, F.ceil(n / 5).cast("int") + 1)), ahead + 1, F.greatest(n, F.lit(0)))
    letters = F.regexp_replace(F.col("bases_b").substr(5 - ahead, n), "(.).{0,4}", "$1")
    none = F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)))
    return r.select("spot_id", "mate_idx", restore.restored(F.col("bases"), flags, letters, none, F.array().cast("array<int>")).alias("read"))


@query(f"""with {READS_SQL}, p as (select spot_id, mate_idx, case when read_type in (3, 5) and spot_id % 3 <> 0 then (case when read_type & 2 <> 0 then bases else translate(reverse(bases), 'ACGT', 'TGCA') end) else bases end as piece from reads)
    select spot_id as row_id, string_agg(piece, '' order by mate_idx) as read from p group by spot_id""")
def spliced_spots(spark, d):
    r = derived.reads(spark, d).withColumn("align_id", F.when(F.col("read_type").isin(3, 5) & (F.col("spot_id") % 3 != 0), F.col("spot_id") * 100 + F.col("mate_idx")).otherwise(0))
    rows = F.array_sort(F.collect_list(F.struct("mate_idx", "read_len", "read_type", "align_id", "bases")))
    spots = r.groupBy(F.col("spot_id").alias("row_id")).agg(rows.alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    own = F.array_join(F.transform(F.filter("r", lambda x: x["align_id"] <= 0), lambda x: x["bases"]), "")
    spots = spots.select("row_id", own.alias("cmp_read"), pick("read_len").alias("read_len"), pick("read_type").alias("read_type"), pick("align_id").alias("align_id"))
    return restore.spliced(spots, r.where("align_id > 0").select("align_id", "bases"))


DIFF_SQL = """
    paired as (select spot_id, mate_idx, bases, bases_b, list_filter(range(1, length(bases) + 1), lambda i: substr(bases, i, 1) <> substr(bases_b, i, 1)) as d from reads),
    classed as (select *, case when bases = bases_b then 'IDENTICAL' when length(bases) <> length(bases_b) then 'LENGTH_DIFF'
        when len(list_filter(d, lambda i: substr(bases_b, i, 1) = 'N')) > 0 and len(list_filter(d, lambda i: substr(bases_b, i, 1) <> 'N')) > 0 then 'MIXED'
        when len(list_filter(d, lambda i: substr(bases_b, i, 1) = 'N')) > 0 then 'N_MASK_ONLY' else 'BASE_FLIP' end as class from paired)"""


@query(f"""with {READS_SQL}, {DIFF_SQL}, c as (select class, count(*) as n from classed group by class) select class, n, 100.0::double * n / sum(n) over () as percent from c""")
def record_classes(spark, d):
    return compare.class_shares(derived.reads(spark, d).select(compare.record_class(F.col("bases"), F.col("bases_b")).alias("class")))


@query(f"""with {READS_SQL}, {DIFF_SQL}, p as (select substr(bases, i, 1) as base_a, substr(bases_b, i, 1) as base_b from (select *, unnest(d) as i from paired where length(bases) = length(bases_b))) select base_a, base_b, count(*) as n from p group by all""")
def base_confusion(spark, d):
    return compare.confusion(derived.reads(spark, d))


@query(f"""with {READS_SQL}, {DIFF_SQL}, p as (select least((i - 1) * 10 // length(bases), 9) as bucket from (select *, unnest(d) as i from paired where length(bases) = length(bases_b)))
    select b::int as bucket, count(p.bucket) as n from range(10) t(b) left join p on p.bucket = b group by b""")
def mismatch_positions(spark, d):
    return compare.position_histogram(derived.reads(spark, d), 10)


@query(f"""with {READS_SQL}, {DIFF_SQL}, c as (select class, count(*) as n from classed group by class) select round(sum(case when class = 'N_MASK_ONLY' then n else 0 end) / sum(case when class <> 'IDENTICAL' then n end)::double, 4) as fraction from c""")
def n_mask_fraction(spark, d):
    classes = derived.reads(spark, d).groupBy(compare.record_class(F.col("bases"), F.col("bases_b")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return compare.masked_fraction(classes)


@query(f"""with {READS_SQL}, {DIFF_SQL}, b as (select spot_id, mate_idx, class, q from classed join (select spot_id, mate_idx, quality as q from reads) using (spot_id, mate_idx) where mate_idx <> 5)
    select count(*) as records, sum((class not in ('IDENTICAL', 'N_MASK_ONLY'))::int)::bigint as sequence_mismatches, 0::bigint as quality_mismatches,
    0::bigint as quality_length_errors, (select count(*) from reads where mate_idx = 5) as unpaired, false as equal from b""")
def fastq_comparison(spark, d):
    r = derived.reads(spark, d)
    other = r.where("mate_idx <> 5").select("spot_id", "mate_idx", F.col("bases_b").alias("bases"), "quality")
    return compare.compared(r, other, ["spot_id", "mate_idx"], n_masking=True)


CHANGE_SQL = """
    alive as (select *, read_len > 0 and read_type & 1 = 1 as a from reads),
    before as (select *, max((not a)::int) over (partition by spot_id order by mate_idx rows between unbounded preceding and 1 preceding) as gone from alive),
    streams as (select spot_id, max((a and coalesce(gone, 0) = 1)::int) as split_files_changed, (sum(a::int) >= 3)::int as split3_changed, max((read_type & 6 <> 0)::int) as orientation_bits,
        max((read_type & 1 = 0)::int) as has_technical, max(mate_idx) as max_slots from before group by spot_id)"""


@query(f"with {READS_SQL}, {CHANGE_SQL} select * from streams")
def stream_classes(spark, d):
    return routing.stream_class(derived.reads(spark, d))


@query(f"""with {READS_SQL}, {CHANGE_SQL}, c as (select case when split_files_changed = 1 and split3_changed = 1 then 'SPLIT_FILES+SPLIT3' when split_files_changed = 1 then 'SPLIT_FILES' when split3_changed = 1 then 'SPLIT3'
    when orientation_bits = 1 then 'READTYPE_ORIENTATION' else 'UNAFFECTED' end as class, count(*) as n from streams group by 1),
    t as (select *, sum(n) over () as total, 1.96::double as z from c), w as (select *, n / total::double as p from t)
    select class, n, greatest(0, ((p + z*z/(2*total)) - z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total)) as low,
    least(1, ((p + z*z/(2*total)) + z * sqrt(p*(1-p)/total + z*z/(4*total*total))) / (1 + z*z/total)) as high from w""")
def change_intervals(spark, d):
    s = routing.stream_class(derived.reads(spark, d))
    kind = routing.change_class(F.col("split_files_changed"), F.col("split3_changed"), F.col("orientation_bits"))
    shares = compare.class_shares(s.select(kind.alias("class"))).withColumn("total", F.round(F.col("n") * 100 / F.col("percent")))
    low, high = compare.wilson(F.col("n"), F.col("total"))
    return shares.select("class", "n", low.alias("low"), high.alias("high"))


GROUP_SQL = "select c_custkey, n_name as platform, c_mktsegment as layout, c_acctbal < 0 as hit from customer left join nation on c_nationkey = n_nationkey and n_nationkey % 6 <> 0"


def grouped(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey % 6 <> 0").select("n_nationkey", F.col("n_name").alias("platform"))
    c = table(spark, d, "customer")
    return c.join(nation, c["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", "platform", F.col("c_mktsegment").alias("layout"), (F.col("c_acctbal") < 0).alias("hit"))


@query(f"""with g as ({GROUP_SQL}), k as (select coalesce(platform, 'unknown') as platform, coalesce(layout, 'unknown') as layout, hit from g)
    select platform, case when grouping(layout) = 0 then layout else '*' end as layout, count(*) as n, sum(hit::int)::bigint as hits, sum(hit::int) / count(*)::double as rate from k group by grouping sets ((platform, layout), (platform))""")
def rates_by_platform(spark, d):
    return compare.rates_by(grouped(spark, d), F.col("hit"), "platform", "layout")


@query(f"""with g as ({GROUP_SQL}), r as (select layout, avg(hit::int) as rate from g group by layout), t as (select layout, count(*) * length(layout) as total from g group by layout)
    select sum(total * rate) / sum(total) as rate from r join t using (layout)""")
def population_rate(spark, d):
    g = grouped(spark, d)
    rates = g.groupBy("layout").agg(F.avg(F.col("hit").cast("int")).alias("rate"))
    return compare.weighted_rate(rates, g.groupBy("layout").agg((F.count(F.lit(1)) * F.length(F.first("layout"))).alias("total")), "layout")


@query(f"""with g as ({GROUP_SQL}), k as (select *, row_number() over (partition by platform, layout order by md5('42:' || c_custkey), c_custkey) as k from g) select c_custkey, platform, layout from k where k <= 3""")
def stratified_sample(spark, d):
    return compare.stratified(grouped(spark, d), ["platform", "layout"], "c_custkey", 3, 42).select("c_custkey", "platform", "layout")


@query("select c_custkey from customer where c_acctbal > 0 order by md5('7:' || c_custkey), c_custkey limit 50")
def seeded_sample(spark, d):
    return compare.shuffled_top(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey", 50, 7)


VERDICT_SQL = "select o_orderkey, o_custkey % 3 as old, o_orderkey % 3 as new, case when o_orderkey % 7 = 0 then null else 1 end as truth, o_orderpriority as split from orders"


@query(f"""with v as ({VERDICT_SQL}) select split, case when truth is null then case when old = new then 'UNCHANGED' else 'CHANGED_OK' end when new = truth and old <> truth then 'FIXED' when old = truth and new <> truth then 'REGRESSED'
    when old <> truth and new <> truth then 'STILL_BROKEN' else 'UNCHANGED' end as verdict, count(*) as n from v group by all""")
def verdicts(spark, d):
    o = table(spark, d, "orders")
    v = compare.verdict(F.col("o_custkey") % 3, F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 7 != 0, F.lit(1)))
    return o.groupBy(F.col("o_orderpriority").alias("split"), v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select c_name as name, md5(c_mktsegment) as digest from customer where c_custkey % 5 <> 0), b as (select c_name as name, md5(case when c_custkey % 3 = 0 then 'x' else c_mktsegment end) as digest from customer where c_custkey % 7 <> 0)
    select name, case when a.digest is null then 'missing_left' when b.digest is null then 'missing_right' when a.digest = b.digest then 'same' else 'differs' end as state from a full join b using (name)""")
def file_set_comparison(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    left = c.where(k % 5 != 0).select(F.col("c_name").alias("name"), F.md5("c_mktsegment").alias("digest"))
    right = c.where(k % 7 != 0).select(F.col("c_name").alias("name"), F.md5(F.when(k % 3 == 0, "x").otherwise(F.col("c_mktsegment"))).alias("digest"))
    return compare.file_sets(left, right)


@query("""with s as (select l_orderkey as key, ['PASS_MD5','PASS_CONTENT','FAIL_CONTENT','FAIL_QUAL','FAIL_COUNT','FAIL_SEQ','FAIL_MISSING'][l_linenumber] as status from lineitem)
    select key, arg_min(status, list_position(['FAIL_MISSING','FAIL_SEQ','FAIL_COUNT','FAIL_QUAL','FAIL_CONTENT','PASS_CONTENT','PASS_MD5'], status)) as status from s group by key""")
def worst_statuses(spark, d):
    names = F.array(*(F.lit(s) for s in ("PASS_MD5", "PASS_CONTENT", "FAIL_CONTENT", "FAIL_QUAL", "FAIL_COUNT", "FAIL_SEQ", "FAIL_MISSING")))
    return compare.worst_status(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.element_at(names, F.col("l_linenumber")).alias("status")), "key")


@query("""select p_name as name, p_retailprice as before, p_retailprice * (1 + p_size / 50.0::double) as after, p_retailprice * (1 + p_size / 50.0::double) / p_retailprice as ratio from part
    where p_retailprice * (1 + p_size / 50.0::double) > p_retailprice * 1.5 and p_retailprice * (1 + p_size / 50.0::double) - p_retailprice > 700""")
def cost_regressions(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("before"), (F.col("p_retailprice") * (1 + F.col("p_size") / F.lit(50.0))).alias("after"))
    return compare.cost_regressions(p, 1.5, 700)


@query(f"""with {MIRRORS_SQL}, o as (select *, row_number() over (partition by accession order by case when service in ('s3', 's3-direct') then 0 when service = 'gs' then 1 when service like '%sra-ncbi%' then 2 when service = 'ncbi' then 3 else 4 end,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from mirrors) select accession, url, service from o where k = 1""")
def best_mirrors(spark, d):
    return catalog.best_mirror(derived.mirrors(spark, d))


@query("""with t as (select o_orderkey, case o_orderkey % 5 when 0 then ' srr' || (1000000 + o_orderkey) when 1 then 'ERP' || (100000 + o_orderkey) when 2 then 'prjna' || o_orderkey when 3 then 'SRR12' else 'drr' || (100000 + o_orderkey) || ' ' end as t from orders)
    select o_orderkey, case when regexp_matches(upper(trim(t)), '^PRJ(NA|EB|DB)[0-9]+$') then 'bioproject' when regexp_matches(upper(trim(t)), '^[SED]RP[0-9]{6,9}$') then 'study' when regexp_matches(upper(trim(t)), '^[SED]RR[0-9]{6,9}$') then 'run' else 'invalid' end as kind,
    case when regexp_matches(upper(trim(t)), '^[SED]RR[0-9]{6,9}$') then upper(trim(t)) end as run from t""")
def accession_kinds(spark, d):
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey")
    t = F.when(k == 0, F.concat(F.lit(" srr"), (n + 1000000).cast("string"))).when(k == 1, F.concat(F.lit("ERP"), (n + 100000).cast("string"))).when(k == 2, F.concat(F.lit("prjna"), n.cast("string"))).when(k == 3, F.lit("SRR12")).otherwise(F.concat(F.lit("drr"), (n + 100000).cast("string"), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", sq.accession_kind(t).alias("kind"), sq.run_accession(t).alias("run"))


@query(f"""with {RUNS_SQL} select accession, layout, case when layout = 'PAIRED' then [average // 2, average - average // 2] else [average] end as lengths, format('{{:,}}', size) as shown,
    spots * (case when layout = 'PAIRED' then 84 + 2 * average else 42 + 2 * average end) as fastq from runs""".replace("case when layout = 'PAIRED' then [average // 2, average - average // 2] else [average] end as lengths", "case when layout = 'PAIRED' then (average // 2) || ';' || (average - average // 2) else cast(average as varchar) end as lengths"))
def run_estimates(spark, d):
    r = derived.runs(spark, d)
    lengths = catalog.run_lengths(F.col("average"), F.when(F.col("layout") == "PAIRED", 2).otherwise(1))
    return r.select("accession", "layout", F.array_join(lengths.cast("array<string>"), ";").alias("lengths"), sq.thousands(F.col("size")).alias("shown"), sq.fastq_bytes(F.col("spots"), lengths).alias("fastq"))


@query(f"""with {RUNS_SQL}, f as (select accession, size * 3000 as size from runs), c as (select *, case when size < 268435456 then 8388608 when size < 2147483648 then 16777216 else 67108864 end as chunk from f where size > 0)
    select accession, size, unnest(range(0, size, chunk)) as start, least(unnest(range(0, size, chunk)) + chunk - 1, size - 1) as "end" from c""")
def download_chunks(spark, d):
    files = derived.runs(spark, d).select("accession", (F.col("size") * 3000).alias("size"))
    return catalog.chunks(files, catalog.chunk_bytes(F.col("size")))


@query(f"""with {RUNS_SQL}, req as (select accession from runs where spots % 2 = 0), d as (select accession, size, md5(accession) as md5 from runs where spots % 3 = 0), l as (select accession, size + 1 as size, cast(null as varchar) as md5 from runs where spots % 5 <> 0)
    select accession, coalesce(d.size, l.size) as size, coalesce(d.md5, l.md5) as md5, case when d.size is not null then 'direct' when l.size is not null then 'located' end as source, layout
    from req left join d using (accession) left join l using (accession) left join (select accession, layout from runs) i using (accession)""")
def resolved_runs(spark, d):
    r = derived.runs(spark, d)
    direct = r.where("spots % 3 = 0").select("accession", "size", F.md5("accession").alias("md5"))
    located = r.where("spots % 5 <> 0").select("accession", (F.col("size") + 1).alias("size"), F.lit(None).cast("string").alias("md5"))
    return catalog.resolved(r.where("spots % 2 = 0").select("accession"), direct, located, r.select("accession", "layout"))


@query(f"""with {RUNS_SQL} select accession from runs where spots % 4 = 1 and accession not in (select accession from runs where customer % 2 = 0)""")
def missing_accessions(spark, d):
    r = derived.runs(spark, d)
    return catalog.missing(r.where("spots % 4 = 1").select("accession"), r.where("customer % 2 = 0").select("accession"))


@query("select o_custkey as key, min(o_orderkey) as pos from orders group by 1")
def ordered_dedup(spark, d):
    return catalog.first_occurrences(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos")), "key", "pos")


@query(f"""with {RUNS_SQL}, f as (select accession, 'ftp://f/' || accession as base, spots % 4 as k, size from runs where spots % 9 <> 0)
    select accession, unnest(case k when 0 then ['single'] when 1 then ['read1', 'read2'] when 2 then ['unpaired', 'read1', 'read2'] else ['read1'] end) as slot,
    unnest(case k when 0 then [''] when 1 then ['_1', '_2'] when 2 then ['', '_1', '_2'] else ['_1'] end) as s, size from f""".replace("as s, size from f", "as s, size, base from f").replace("with ", "with ", 1))
def file_reports(spark, d):
    r, k = derived.runs(spark, d), F.col("spots") % 4
    ends = F.when(k == 0, F.array(F.lit(""))).when(k == 1, F.array(F.lit("_1"), F.lit("_2"))).when(k == 2, F.array(F.lit(""), F.lit("_1"), F.lit("_2"))).otherwise(F.array(F.lit("_1")))
    base = F.concat(F.lit("f/"), F.col("accession"))
    report = r.withColumn("ends", ends).select(
        F.col("accession").alias("run_accession"), F.array_join(F.transform("ends", lambda e: F.concat(base, e, F.lit(".fastq.gz"))), ";").alias("fastq_ftp"),
        F.array_join(F.transform("ends", lambda e: F.lit("m")), ";").alias("fastq_md5"),
        F.when(F.col("spots") % 9 == 0, F.lit("0")).otherwise(F.array_join(F.transform("ends", lambda e: F.col("size").cast("string")), ";")).alias("fastq_bytes"),
    )
    return catalog.report_files(report).select("accession", "slot", F.regexp_extract("url", r"(_\d)?\.fastq\.gz$", 1).alias("s"), "size", F.concat(F.lit("ftp://"), F.regexp_extract("url", r"^https://(f/[A-Z0-9]+)", 1)).alias("base"))


@query(f"""with {RUNS_SQL}, s as (select accession, size * size as n from runs) select accession, case when n >= 1099511627776 then printf('%.2f TiB', n / 1099511627776.0::double) when n >= 1073741824 then printf('%.2f GiB', n / 1073741824.0::double)
    when n >= 1048576 then printf('%.2f MiB', n / 1048576.0::double) when n >= 1024 then printf('%.2f KiB', n / 1024.0::double) else n || ' B' end as bytes,
    case when n >= 1000000000 then printf('%.2f Gbp', n / 1e9::double) when n >= 1000000 then printf('%.2f Mbp', n / 1e6::double) when n >= 1000 then printf('%.1f Kbp', n / 1e3::double) else n || ' bp' end as bases from s""")
def shown_sizes(spark, d):
    n = F.col("size") * F.col("size")
    return derived.runs(spark, d).select("accession", sq.format_size(n).alias("bytes"), sq.format_bases(n).alias("bases"))


@query("""select event_id, strftime(make_timestamp((event_id * 86413 + 946684800) * 1000000), '%Y-%m-%d %H:%M:%S') as iso, strftime(make_timestamp((event_id * 86413 + 946684800) * 1000000), '%m/%d/%Y %H:%M') as c from events""")
def shown_times(spark, d):
    t = F.col("event_id") * 86413 + 946684800
    return table(spark, d, "events").select("event_id", sq.iso_time(t).alias("iso"), sq.c_time(t).alias("c"))


@query("""select k as attempt, least(500 * pow(2, k - 1), 30000)::bigint as ms from range(1, 13) t(k)""")
def backoff_schedule(spark, d):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), catalog.backoff_ms(F.col("id")).alias("ms"))


@query("""select c_custkey, case when regexp_matches(v, '["\\r\\n,]') then '"' || replace(v, '"', '""') || '"' else v end || ',' || c_nationkey as value from (select c_custkey, c_nationkey, case c_custkey % 3 when 0 then c_name || ',x' when 1 then 'say "' || c_mktsegment || '"' else c_name end as v from customer)""")
def delimited_rows(spark, d):
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, F.concat("c_name", F.lit(",x"))).when(k == 1, F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('"'))).otherwise(F.col("c_name"))
    rows = table(spark, d, "customer").select("c_custkey", v.alias("v"), "c_nationkey")
    text = render.delimited(rows)
    return text.select(F.split_part("value", F.lit(","), F.lit(1)).cast("bigint").alias("c_custkey"), F.regexp_replace("value", "^\\d+,", "").alias("value"))


@query("""with recursive n as (select 'region' as path, 0 as depth), r as (select r_name as path, 1 as depth from region), t as (select r_name || '/' || n_name as path, 2 as depth from region join nation on n_regionkey = r_regionkey)
    select path, depth from t where path like 'ASIA/%' union all select path, depth from r where path = 'ASIA'""")
def metadata_subtree(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    top = region.select(F.col("r_name").alias("path"), F.lit(1).alias("depth"))
    below = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.lit(2).alias("depth"))
    return metadata.subtree(top.unionByName(below).withColumn("pos", F.col("path")), "ASIA", 1).select("path", "depth")


@query("""select p_partkey, ['LS454','ILLUMINA','ABI_SOLID','COMPLETE_GENOMICS','HELICOS','PACBIO_SMRT','ION_TORRENT','CAPILLARY','OXFORD_NANOPORE','DNBSEQ','ELEMENT'][p_size % 13] as platform,
    case ['LS454','ILLUMINA','ABI_SOLID','COMPLETE_GENOMICS','HELICOS','PACBIO_SMRT','ION_TORRENT','CAPILLARY','OXFORD_NANOPORE','DNBSEQ','ELEMENT'][p_size % 13] when 'ILLUMINA' then 2 when 'PACBIO_SMRT' then 1 when 'OXFORD_NANOPORE' then 1 end as nreads,
    coalesce(p_size % 13 in (1, 3, 5, 7, 8), false) as unsupported from part""")
def platform_names(spark, d):
    name = catalog.platform_name(F.col("p_size") % 13)
    return table(spark, d, "part").select("p_partkey", name.alias("platform"), catalog.default_reads(name).alias("nreads"), catalog.is_unsupported(name).alias("unsupported"))


@query(f"""with {READS_SQL} select case when sum(read_len) <> 5 then 'bases' end as counter, 5::bigint as expected, sum(read_len)::bigint as seen from reads""")
def reconciliation(spark, d):
    r = derived.reads(spark, d).agg(F.sum("read_len").alias("bases"), F.countDistinct("spot_id").alias("spots"))
    return quality.reconciled(r, {"bases": 5, "spots": derived.reads(spark, d).select("spot_id").distinct().count()})


@query(f"""with {READS_SQL}, c as (select spot_id // 100 as run, sum((length(quality) <> read_len)::int)::bigint as quality_length, sum((bases_b like '%N%')::int)::bigint as quality_absent from reads group by 1)
    select run, quality_length + quality_absent > 0 as any, quality_length > 0 as any_fatal, 'quality_length=' || quality_length || ' quality_absent=' || quality_absent as summary from c""")
def integrity_summary(spark, d):
    r = derived.reads(spark, d).groupBy(F.floor(F.col("spot_id") / 100).alias("run"))
    c = r.agg(F.sum((F.length("quality") != F.col("read_len")).cast("int")).alias("quality_length"), F.sum(F.col("bases_b").contains("N").cast("int")).alias("quality_absent"))
    out = quality.diagnosis({"quality_length": F.col("quality_length"), "quality_absent": F.col("quality_absent")})
    return c.select("run", *(v.alias(k) for k, v in out.items()))


from spotweave.plans import archives  # noqa: E402, F401  registers its queries
