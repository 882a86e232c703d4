"""The language-model data operators against brute force, exact round trips and held-out labels, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm import bpe, components, exact_dedup, jaccard_join, line_dedup, mixing, secrets, token_counts, topk, toxicity, warc
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None, "a"), (2, "", None), (3, "One two three four five six", "b"), (4, "One two three four five six", "b"), (4, "One two three four five six", "b"), (None, "x <|endoftext|> Σ é 漢字 😀́", "c"), (7, "w " * 30000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, source string").withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_matches_the_library(odd, docs):
    library = Tokenizer.from_file(PATH)
    for table in (odd, docs):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in bpe.bpe_digests(table, PATH).collect():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_of_a_batch_match_the_library(docs):
    library, texts = Tokenizer.from_file(PATH), [r.text or "" for r in docs.select("text").collect()]
    texts += ["J\u030c İ ſ ŉ a\u0301", "''s 'S'LL <|endoftext|>x <|", "b" * 70 + " " + "c" * 64, "\x1c\x85\u2003 é"]
    assert bpe.count_batch(texts, PATH) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_use_the_cache(spark, odd, tmp_path):
    library, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text or "" for r in odd.collect()}
    for _ in range(2):
        rows = token_counts.token_counts(odd, PATH, str(tmp_path)).collect()
        assert len(rows) == len(ODD)
        assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(texts[r.doc_id].encode()) for r in rows)
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == stored.select("digest").distinct().count()


def test_exact_duplicates(odd, spark):
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(odd).collect()}
    assert (rows[1].keep_id, rows[2].keep_id, rows[2].kept, rows[3].kept, rows[4].group_size) == (2, 2, True, False, 3)
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, 500, 3000, np.uint64) << np.uint64(50) for _ in range(2))
    both = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter(12).add(v) for v in (x, y)])
    values, counts = np.unique(np.concatenate([x, y]), return_counts=True)
    assert [both.count(int(v)) for v in values] == counts.tolist() and both.count(3) == 0


def brute_components(texts, percent, width):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(spark):
    rng = random.Random(5)
    texts, base = {0: None, 1: "", 2: "a b", 3: "A B"}, [str(rng.randrange(10**6)) for _ in range(120)]
    for i in range(10, 160):  # one large group of near copies, so that long lists and their rounds run
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
        texts[i] = " ".join(words)
    for i in range(200, 240):
        texts[i] = " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 60)))
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect()}
    assert got == brute_components(texts, 85, 4)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)] + [(k, k + 1) for k in range(20, 60)], "a bigint, b bigint")
    got = dict(tuple(r) for r in components.components(edges).collect())
    assert got == {2: 1, 3: 1, 9: 8} | {k: 20 for k in range(21, 61)}


def test_mixing_meets_targets_and_repeats(spark, docs, odd):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert abs(sum(own[0].target for own in by.values()) - sum(r.size for r in rows)) < 1e-3
    assert len(mixing.mix_sources(odd).collect()) == len(ODD) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_flight_keeps_balance():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 900, 500).astype(float)
    p = np.full(500, 0.37)
    out = mixing.flight(p, np.vstack([size, np.ones(500)]), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out @ size - p @ size) < 1e-6 and abs(out.sum() - p.sum()) < 1e-9


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [0.5])]
    rows += [(304 + i, rows[0][1]) for i in range(30)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (i for i in whole if i % 20 == 0):
        want = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_secrets_match_plain_expressions(spark):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "apikey", "=", " ", ":", "'", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "\n", "é", "ghp_", "x" * 10, "eyJ.eyJ", "-----BEGIN RSA", " PRIVATE KEY-----"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(14))) for i in range(3000)} | {-1: None, -2: ""}
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in secrets.secret_spans(table).collect():
        want = []
        for n, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.exact, texts[r.doc_id] or "", (re.I if rule.either_case else 0) | re.A):
                if len(m[rule.group]) >= rule.least:
                    want.append((m.start(), n, m.end(), rule.kind))
        assert [(s.kind, s.start, s.end) for s in r.spans] == [(k, a, e) for a, _, e, k in sorted(want)]


def test_toxicity_of_rows_not_learnt_from(spark):
    rng = random.Random(4)
    syllables = ["ba", "ne", "ti", "ro", "su", "la", "mek", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(600):
        words, bad = [word() for _ in range(60)], i % 4 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(60)] = "grizl" + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, model).collect()}
    unseen = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in unseen) >= 0.95 * len(unseen) and got[900] == got[901]
    assert toxicity.fit(table, spark.createDataFrame([], "doc_id bigint, toxic int")).score("x") < 0.5


def test_toxicity_keeps_every_gram(spark, monkeypatch):
    """Scores are those of all counts, whatever travels to the texts, and a rare expression is not forgotten."""
    rng = random.Random(4)
    plain = [" ".join(rng.choices(["river", "stone", "garden", "letter", "window", "market"], k=12)) for _ in range(60)]
    texts = [f"{t} qzxv{'abcdefghij'[k % 10]}" if k % 2 else t for k, t in enumerate(plain)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    scores = lambda: {r.doc_id: r.score for r in toxicity.toxicity_scores(table, toxicity.fit(table, labels)).collect()}
    whole = scores()
    monkeypatch.setattr(toxicity, "MODEL_GRAMS", 20, raising=False)
    monkeypatch.setattr(toxicity, "COMMON_WORDS", 3, raising=False)
    monkeypatch.setattr(toxicity, "COMMON_GRAMS", 3)
    assert scores() == pytest.approx(whole)
    assert min(whole[k] for k in range(1, 60, 2)) > max(whole[k] for k in range(0, 60, 2))


def test_toxicity_learns_whole_words(spark):
    """What lies beyond a word's first characters counts."""
    texts = ["ab" * 32 + ("qzxvj" if k % 2 else "mnoph") for k in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int").coalesce(1)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(table, toxicity.fit(table, labels)).collect()}
    assert min(got[k] for k in range(1, 40, 2)) > 0.5 > max(got[k] for k in range(0, 40, 2))


def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away into the dark forest at night"
    rows = [(1, f"{a}\nunique line number one of the first text\n\n{a}"), (2, f"{a}!\nsomething else entirely is written here"), (3, None), (4, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(table).collect()}
    assert got == {1: (4, [3]), 2: (2, [0]), 3: (1, []), 4: (1, [])}
    assert {r.doc_id: r.text for r in line_dedup.without_lines(table).collect()}[2] == "something else entirely is written here"


def test_lines_of_long_bands(spark):
    """Pairs planted among lines of one template: many share none but long bands."""
    rng = random.Random(7)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    common, texts = " ".join(word(8) for _ in range(28)), []
    for _ in range(300):
        own = word(40)
        texts += [f"{common} {own}", f"{common} {own[:-24]}{word(24)}"]
    keyed = line_dedup.bands(texts)
    assert all(set(keyed[k]) & set(keyed[k + 1]) for k in range(0, 600, 2))
    sets = [line_dedup.shingles(t) for t in texts]
    similar = {(i, j) for i in range(600) for j in range(i) if len(sets[i] & sets[j]) >= line_dedup.SIMILARITY * len(sets[i] | sets[j])}
    assert similar == {(k + 1, k) for k in range(0, 600, 2)}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    gone = {r.doc_id for r in line_dedup.removed_lines(table).where("not kept").collect()}
    assert gone == set(range(1, 600, 2))


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    big = "é" * 900
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(pages).collect()}
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    assert got == {1: (1800, "revisit", 2, sha(big)), 2: (1800, "response", None, sha(big)), 3: (5, "response", None, sha("small")), 4: (5, "response", None, sha("small")), 5: (0, "response", None, sha(None))}
    warc.archive_pages(pages, str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    assert [bytes(r.payload).decode() for r in read.where("record_type = 'response' and target_uri = 'http://d'").collect()] == ["small"]
    assert read.where("record_type = 'revisit'").count() == 1
