"""Unit vectors of operators, and the shape of plans."""

import pytest
from pyspark.sql import functions as F

from spotweave.functions import defline
from spotweave.functions import sequence as sq
from spotweave.operators import catalog, intervals, metadata, pagemap, render, restore, routing


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_bases(spark):
    got = one(spark, sq.unpack_2na(F.unhex(F.lit("1B")), F.lit(4)), sq.unpack_4na(F.unhex(F.lit("1248F0")), 5), sq.reverse_complement(F.lit("ACGTN")))
    assert got == ("ACGT", "ACGTN", "NACGT")


def test_merge_ambiguity(spark):
    assert one(spark, sq.merge_ambiguity(F.lit("ACGT"), F.array(*(F.lit(x) for x in (0, 1, 15, 4))))) == ("AMNK",)


def test_phred(spark):
    assert one(spark, *(sq.log_odds_to_phred(F.lit(x)) for x in (-9, -6, 0, 10, 40, 99))) == (0, 0, 3, 10, 40, 40)


@pytest.mark.parametrize(("q", "n", "want"), [("II", 4, "II??"), ("IIIII", 3, "III"), ("I I", 3, "I?I"), ("I I", 4, "I I?")])
def test_repair_quality(spark, q, n, want):
    assert one(spark, sq.repair_quality(F.lit(q), F.lit(n))) == (want,)


def test_years_of_any_length(spark, duck):
    epochs = [-99999999999, -62200000000, -62135596801, -61135596801, -1, 0, 253402300799, 253402300800, 600000000000, 9000000000000]
    for e in epochs:
        want = duck.execute("select strftime(make_timestamp(? * 1000000), '%Y-%m-%d %H:%M:%S'), strftime(make_timestamp(? * 1000000), '%m/%d/%Y %H:%M')", [e, e]).fetchone()
        assert one(spark, sq.iso_time(F.lit(e)), sq.c_time(F.lit(e))) == want


def test_templates(spark):
    columns = {"run": F.lit("R"), "spot_id": F.lit(7), "read_id": F.lit(2), "spot_name": F.lit(None).cast("string"), "read_len": F.lit(5)}
    assert one(spark, defline.compile_template("@$ac.$si/$ri $sn len=$rl $$", columns)) == ("R.7/2  len=5 $",)
    for bad in ("$sg", "$a", "x$"):
        with pytest.raises(defline.TemplateError):
            defline.parse(bad)


def test_row_ranges():
    assert intervals.parse_row_ranges("5,7-9, 100-,-50") == [(5, 5), (7, 9), (100, None), (None, 50)]
    assert intervals.spans([(9, 3), (None, 2), (40, None)], 1, 20) == [(3, 9), (1, 2)]
    with pytest.raises(ValueError):
        intervals.parse_row_ranges("a-b")


def test_page_map_repeats_and_offsets(spark):
    rows = [(1, b"abcdef", ([2], [4], "repeats", [1, 3])), (2, b"abcdef", ([3], [3], "offsets", [3, 0, 3]))]
    schema = "start_id bigint, data binary, page_map struct<lengths:array<int>,leng_runs:array<int>,kind:string,map:array<int>>"
    got = pagemap.expanded(spark.createDataFrame(rows, schema)).collect()
    assert [bytes(r.value) for r in got] == [b"ab", b"cd", b"cd", b"cd", b"def", b"abc", b"def"]


def test_restored_moves_the_reference(spark):
    f = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, restore.restored(F.lit("ACGTAC"), f(0, 1, 0, 0), F.lit("T"), f(0, 0, 1, 0), f(2))) == ("ATAC",)


def test_overrun_truncates(spark):
    rows = spark.createDataFrame([(1, "ACGTAC", "IIIIII", [2, 3, 4], [1, 0, 1])], "row_id bigint, read string, quality string, read_len array<int>, read_type array<int>")
    assert [r.bases for r in routing.exploded(rows).orderBy("mate_idx").collect()] == ["AC", "GTA"]


def test_catalog(spark):
    assert one(spark, catalog.etag_md5(F.lit('"0123456789abcdef0123456789ABCDEF"')), catalog.etag_md5(F.lit('"a-2"'))) == ("0123456789abcdef0123456789abcdef", None)
    assert one(spark, catalog.platform_of_schema(F.lit("NCBI:SRA:Illumina:tbl:q")), catalog.lenient_size(F.lit("x"))) == ("ILLUMINA", None)
    lines = spark.createDataFrame([(" SRR1 ",), ("# no",), ("",)], "value string")
    assert [r.accession for r in catalog.listed_accessions(lines).collect()] == ["SRR1"]


def test_metadata(spark):
    nodes = spark.createDataFrame([("STATS/TABLE/SPOTS", 3, 1, bytes([1, 2]), {}), ("STATS/QUALITY/PHRED_7", 3, 2, bytes([9]), {}), ("schema", 1, 3, b"", {"name": "NCBI:SRA:PacBio:x"})], "path string, depth int, pos int, value binary, attrs map<string,string>")
    assert metadata.statistic(nodes, "SPOTS").first()[0] == 513
    assert tuple(metadata.expected_histogram(nodes).first()) == (7, 9)
    assert tuple(metadata.platform(nodes).first()) == ("PACBIO_SMRT", 1)


def test_render(spark):
    df = spark.createDataFrame([(1, 'a"b', [1, 2], bytes([255]))], "row_id bigint, NAME string, READ_LEN array<int>, OTHER binary")
    assert render.delimited(df).first().value == '1,"a""b",1;2,ff'
    assert render.plain(df).first().value == 'row 1: NAME="a"b", READ_LEN=[1, 2], OTHER=ff'
    assert render.json_lines(df).first().value == '{"row_id":1,"NAME":"a\\"b","READ_LEN":[1,2],"OTHER":"ff"}'
    assert render.column_type("READ_LEN") == "array<bigint>" and render.column_type("ODD") == "binary"


def test_routing_stays_in_generated_code(spark):
    from spotweave.plans.queries import QUERIES
    from tests.conftest import SF

    plan = QUERIES["split3_routing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<l_orderkey" in plan and "l_shipdate" in plan and "l_tax" not in plan


def test_many_restored_at_once(spark):
    """Against a plain step through every read; among many rows, cursors begin anew in each."""
    import random

    rng, rows = random.Random(1), []
    for k in range(500):
        n = k % 9
        flags, moves = [rng.randrange(2) for _ in range(n)], [int(rng.random() < 0.3) for _ in range(n)]
        rows.append((k, "ACGTÄC"[: rng.randrange(7)], flags, "TGN"[: rng.randrange(4)], moves, [rng.randrange(3) for _ in range(sum(moves))]))
    rows.append((500, "ACGT", None, "", None, None))

    def plain(reference, flags, letters, moves, offsets):
        out, at, m, o = "", 0, 0, 0
        for other, moved in zip(flags, moves, strict=True):
            if moved:
                at, o = at + offsets[o], o + 1
            out, m, at = out + (letters[m : m + 1] if other else reference[at : at + 1]), m + other, at + 1
        return out

    df = spark.createDataFrame(rows, "k int, reference string, flags array<int>, letters string, moves array<int>, offsets array<int>").coalesce(1)
    got = dict(df.select("k", restore.restored(*(F.col(c) for c in ("reference", "flags", "letters", "moves", "offsets")))).collect())
    assert got == {k: plain(*r) if r[1] is not None else None for k, *r in rows}
    assert "ArrowEvalPython" in df.select(restore.restored(*(F.col(c) for c in ("reference", "flags", "letters", "moves", "offsets"))))._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_are_not_taken_apart(spark):
    from spotweave.operators import compare

    rows = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "ACG"), ("ACGT", "NCGA"), (None, "A")], "bases string, bases_b string")
    assert sorted(map(tuple, compare.confusion(rows).collect())) == [("A", "N", 1), ("T", "A", 1)]
    assert [r.n for r in compare.position_histogram(rows, 4).orderBy("bucket").collect()] == [1, 0, 0, 1]
    # no filter on the texts, below which they would be made a second time
    for out in (compare.confusion(rows), compare.position_histogram(rows, 4)):
        assert "length(" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)


def test_repeated_ranges_count_once(spark):
    rows = [(0, 5), (0, 5), (3, 9), (100, 50), (100, 50), (None, None), (None, None)]
    ranges = spark.createDataFrame(rows, "start bigint, end bigint")
    got = intervals.merged_ranges(ranges, 20)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, intervals.merged_ranges(ranges.distinct(), 20).collect()), key=str)
    from spotweave.plans.queries import QUERIES
    from tests.conftest import SF

    # ranges are not gathered in a hash table before they are sorted
    plan = QUERIES["coalesced_ranges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_merged_masks_of_other_lengths(spark):
    rows = [("ACGTN", [8, 0]), ("ÄC", [0, 0, 7]), ("", []), (None, [1]), ("A", None)]
    got = spark.createDataFrame(rows, "b string, m array<int>").coalesce(1).select(sq.merge_ambiguity(F.col("b"), F.col("m")).alias("x"))
    assert [r.x for r in got.collect()] == ["WCGTN", "NC", "", None, None]
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
