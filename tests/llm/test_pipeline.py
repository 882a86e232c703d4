"""The pipeline's stages: odd rows, decisions by row, and brute force on small tables."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from spotweave.llm import families

LONG = " ".join(f"word{k}" for k in range(30_000))
BASE = " ".join(f"base{k}" for k in range(60))
NEAR = BASE.replace("base7 ", "other ")
ROWS = [
    (5, "a a", "s1"), (5, "unique b", "s1"), (9, "a a", "s1"), (None, "n n", "s2"), (None, "n n", "s2"), (None, "alone", None), (7, None, "s2"), (8, "", None),
    (10, BASE, "s1"), (11, NEAR, "s1"), (10, "other text under ten", "s2"), (12, LONG, "s3"), (13, LONG, "s3"), (14, "tie tie", "s1"), (14, "tie tie", "s1"),
]
CLASH = ["score", "text_digest", "copy", "copies_taken", "removed", "gone_id", "row_key", "keep_id", "text_sha", "sha", "rows", "id", "n", "p", "level", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(3)
    return table.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASH})


def run(name, spark, docs, sf_dir="/root/testdata/sf0.001"):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(name, spark, odd):
    out = run(name, spark, odd)
    if name != "bpe":
        assert out.columns == odd.columns
        for r in out.collect():
            assert r["score"] == f"score:{'?' if r.doc_id is None else r.doc_id}" and r["size"] == f"size:{'?' if r.doc_id is None else r.doc_id}"
    assert run(name, spark, odd.limit(0)).count() == 0


def test_toxicity_keeps_ordinary_rows(spark, odd):
    assert rows_of(run("toxicity", spark, odd)) == rows_of(odd)


def test_exact_dedup_by_row(spark, odd):
    want = [(5, "unique b"), (9, "a a"), (None, "n n"), (None, "alone"), (10, BASE), (11, NEAR), (10, "other text under ten"), (13, LONG), (14, "tie tie")]
    got = run("exact_dedup", spark, odd).collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.text), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got if not r.text] == [8]


def test_near_dedup_by_row(spark, odd):
    got = Counter(rows_of(run("near_dedup", spark, odd)))
    assert (10, BASE) in got and (11, NEAR) not in got and (10, "other text under ten") in got and got[(7, None)] == got[(8, "")] == 1
    assert got[(12, LONG)] == 1 and (13, LONG) not in got and got[(5, "a a")] == 1 and (9, "a a") not in got and got[(14, "tie tie")] == 2


def test_near_dedup_of_a_large_group(spark):
    """Brute force on one large group of near copies around the threshold, with a passage that others share."""
    rng = random.Random(9)
    base, passage = [str(rng.randrange(10**6)) for _ in range(80)], [str(rng.randrange(10**6)) for _ in range(60)]
    texts = {}
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
        texts[i] = words
    for i in range(500, 700):
        texts[i] = passage + [str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 30))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    root = dict.fromkeys(sets)
    for i in sets:
        root[i] = i
        for j in range(i):
            a, b = sets[i], sets[j]
            if 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    table = spark.createDataFrame([(i, " ".join(w), "s") for i, w in texts.items()], "doc_id bigint, text string, source string").repartition(4)
    got = {r.doc_id for r in run("near_dedup", spark, table).collect()}
    assert got == set(root.values()) and 100 < len(got) < 600


def test_mixing_loses_no_row(spark, odd):
    rows = run("mixing", spark, odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter((r.doc_id, r.text, r.source) for r in rows)
    repeats = Counter(ROWS)
    assert set(taken) <= set(repeats) and all(n <= 3 * repeats[k] for k, n in taken.items())
    assert any(k[0] is None for k in taken)
    again = run("mixing", spark, odd.repartition(5)).collect()
    assert Counter((r.doc_id, r.text) for r in again) == Counter((r.doc_id, r.text) for r in rows)
    assert sum(size(r.text) for r in rows) > 0


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows) and {r.doc_id for r in rows} <= set(docs)


def test_near_dedup_holds_one_python_step_a_task(spark, monkeypatch):
    """Links found in Python are written before the next Python step unites them: workers of both would stay side by side."""
    rng = random.Random(3)
    passage = [str(rng.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(passage + [str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 30))]) for _ in range(150)]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    plans, unite = [], families.components

    def united(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return unite(edges)

    monkeypatch.setattr(families, "components", united)
    run("near_dedup", spark, table).collect()
    assert len(plans) > 1 and not any("InArrow" in p for p in plans)
