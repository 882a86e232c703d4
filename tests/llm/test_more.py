"""What operators do with odd tables, foreign files and clashing names, and brute force where SQL cannot tell."""

import gzip
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotweave.llm import exact_dedup, families, jaccard_join, line_dedup, mixing, secrets, token_counts, topk, toxicity, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


def record(k, body, kind="response"):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/{k}\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["one", "each", "pairs", "plain"])
def test_warc_of_others(spark, tmp_path, packed):
    """Several records in a gzip member, as other tools write them: none is lost, whatever is wanted of them."""
    bodies = [b"", b"small", b"x" * 200_000, b"a\r\n\r\nb", b"last"]
    parts = [record(k, b, "response" if k % 2 else "metadata") for k, b in enumerate(bodies)]
    groups = {"one": [parts], "each": [[p] for p in parts], "pairs": [parts[:2], parts[2:4], parts[4:]], "plain": [parts]}[packed]
    name = "w.warc" if packed == "plain" else "w.warc.gz"
    (tmp_path / name).write_bytes(b"".join(b"".join(g) if packed == "plain" else gzip.compress(b"".join(g)) for g in groups))
    read = warc.read_warc(spark, str(tmp_path / name))
    assert {r.target_uri: bytes(r.payload) for r in read.collect()} == {f"http://x/{k}": b for k, b in enumerate(bodies)}
    assert sorted(r.target_uri[-1] for r in read.where("record_type = 'response'").select("target_uri").collect()) == ["1", "3"]


def test_warc_of_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).count() == 0
    twice = spark.createDataFrame([(1, "u", "z" * 2_000_000), (1, "u", "z" * 2_000_000), (2, "u", "é")], "page_id bigint, url string, html string")
    assert warc.round_trip(twice).count() == 3


def test_mixing_keeps_large_ids(spark):
    """Ids beyond 2^53 beside a null one stay what they were."""
    rows = [(2**60 + 1, "a b c", "s"), (2**60 + 3, "d e", "s"), (None, "f", "s"), (-(2**63), "g h", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    assert sorted((r.doc_id for r in mixing.mix_sources(table).collect()), key=str) == sorted((i for i, _, _ in rows), key=str)


def brute_ratio(words: Counter, word: str) -> float:
    """log P(toxic) - log P(ordinary) of a word by interpolated Kneser-Ney over pooled continuation counts."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    counts = {0: Counter(), 1: Counter()}
    for (w, c), k in words.items():
        for g in toxicity.grams(w):
            counts[c][g] += k
    levels = [set(counts[0]) | set(counts[1])]
    continuation = []
    for _ in range(n - 1):
        continuation.append(Counter(g[1:] for g in levels[-1]))
        levels.append(set(continuation[-1]))
    shared: dict[str, float] = {}
    for depth, level in enumerate(reversed(continuation), 1):
        now = {}
        for piece, c in level.items():
            own = {q: k for q, k in level.items() if q[: depth - 1] == piece[: depth - 1]}
            below = 1 / (1 + len(level)) if depth == 1 else shared[piece[1:]]
            now[piece] = (max(c - d, 0) + d * len(own) * below) / sum(own.values())
        shared = now
    out = 0.0
    for g in toxicity.grams(word):
        p = []
        for c in (0, 1):
            own = {q: k for q, k in counts[c].items() if q[: n - 1] == g[: n - 1]}
            total, base = sum(own.values()), shared.get(g[1:])
            if base is None:  # never seen in any class: what both share cancels
                p.append(d * len(own) / total if total else 1.0)
            else:
                p.append((max(own.get(g, 0) - d, 0) + d * len(own) * base) / total if total else base)
        seen = g in levels[0]
        if not seen:
            p = [d * len([q for q in counts[c] if q[: n - 1] == g[: n - 1]]) / t if (t := sum(k for q, k in counts[c].items() if q[: n - 1] == g[: n - 1])) else 1.0 for c in (0, 1)]
        out += math.log(p[1] / p[0])
    return out


def test_kneser_ney_by_brute_force(spark):
    words = Counter({("stone", 0): 5, ("stones", 0): 2, ("stoned", 1): 3, ("river", 0): 4, ("drivel", 1): 2, ("é漢", 1): 1, ("river", 1): 1})
    rows = [(w, c, n) for (w, c), n in words.items()]
    grams = Counter()
    for w, c, n in rows:
        for g in toxicity.grams(w):
            grams[g, c] += n
    cells = [(g, grams[g, 0], 0, grams[g, 1], 0) for g in {g for g, _ in grams}]
    tables = toxicity.ratio_tables(spark.createDataFrame(cells, "gram string, c0 bigint, c1 bigint, c2 bigint, c3 bigint"))
    asked = ["stone", "stoner", "driver", "zzz", "é", "river"]
    got = {r.word: r.r for r in toxicity.word_ratios(spark.createDataFrame([(w,) for w in asked], "word string"), tables, "r").collect()}
    shipped = toxicity.Shipped(tables).ratios(asked, ("r",))[:, 0]
    for w, told in zip(asked, shipped.tolist(), strict=True):
        assert got[w] == pytest.approx(brute_ratio(words, w)) and told == pytest.approx(got[w])


def test_shipped_ratios_come_as_numbers(spark):
    """The driver's Python holds little besides the hashes and ratios, and they are those of the texts' n-grams."""
    n = 100_000
    rows = spark.range(n).select(F.concat(F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(toxicity.END)).alias("gram"), *(F.col("id").cast("double").alias(c) for c in toxicity.CELLS), F.col("id").alias("times"))
    contexts = rows.select(F.substring("gram", 1, 5).alias("context"), *toxicity.CELLS, "times")
    tracemalloc.start()
    try:
        shipped = toxicity.Shipped((rows, contexts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6  # 106 MB when the texts of the n-grams came
    assert shipped.ratios(["00042", "99999"], ("r",))[:, 0].tolist() == [42.0, 99999.0]


def test_known_hashes_by_brute_force():
    rng = np.random.default_rng(5)
    near = (np.uint64(7) << np.uint64(60)) + np.arange(40, dtype=np.uint64)  # all in one bucket
    h = np.unique(np.concatenate([near[::2], rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    h = h[rng.permutation(len(h))]
    known = toxicity.Known(h, np.arange(len(h), dtype=float)[:, None])
    asked = np.concatenate([h, near, h ^ np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)])
    at, row = known.find(asked)
    want = {int(x): k for k, x in enumerate(h.tolist())}
    assert dict(zip(at.tolist(), known.values[row, 0].tolist(), strict=True)) == {k: want[int(x)] for k, x in enumerate(asked.tolist()) if int(x) in want}
    assert not len(toxicity.Known(h[:0], np.zeros((0, 1))).find(asked)[0])


def test_line_groups_by_brute_force(spark):
    """Random near lines in crowded bands: components are those of the similar pairs that share a band."""
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefghijklmnop"), 90))
    lines = []
    for _ in range(250):
        s = list(base)
        for _ in range(int(rng.integers(0, 4))):
            s[int(rng.integers(0, 90))] = str(rng.integers(0, 10))
        lines.append("".join(s))
    lines = list(dict.fromkeys(lines))
    keyed = [set(k) for k in line_dedup.bands(lines)]
    sets = [line_dedup.shingles(s) for s in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and keyed[i] & keyed[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in line_dedup.removed_lines(table).where("kept").collect()}
    assert kept == set(root) and 1 < len(kept) < len(lines)


def test_between_in_parts():
    """Links found part by part and across parts unite what all pairs would."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        s[rng.integers(0, 60, int(rng.integers(0, 7)))] = rng.integers(0, 2**63, 1, np.uint64)
        sets.append(np.unique(s))
    n = len(sets)
    ids, home = np.arange(n), np.ones(n, bool)

    def joined(pairs):
        root = list(range(n))
        for x, y in pairs:
            lo, hi = sorted((root[x], root[y]))
            root = [lo if r == hi else r for r in root]
        return root

    every = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j]))]
    zero = np.zeros(n, np.int64)
    whole = families.between(ids, ids, zero, home, zero, sets, False, 85)
    assert joined(whole) == joined(every) and len(whole) < n
    part = ids % 2
    inside = families.between(ids[::2], ids[::2], zero[::2], home[::2], part[::2], sets[::2], False, 85) + families.between(ids[1::2], ids[1::2], zero[1::2], home[1::2], part[1::2], sets[1::2], False, 85)
    across = families.between(ids, ids, zero, home, part, sets, True, 85)
    assert joined(inside + across) == joined(every)


def test_token_cache_with_doubles(spark, tmp_path):
    """A digest stored twice counts once; rows that share an id do not share counts."""
    rows = [(1, "one two"), (1, "three"), (2, "one two"), (None, None), (3, "x " * 50_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    library = Tokenizer.from_file(PATH)
    first = token_counts.token_counts(table, PATH, str(tmp_path)).collect()
    place = f"{tmp_path}/tokenizer={token_counts.tokenizer_version(PATH)}"
    spark.read.parquet(place).write.mode("append").parquet(place)
    for got in (first, token_counts.token_counts(table, PATH, str(tmp_path)).collect()):
        assert sorted(r.n_tokens for r in got) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert token_counts.token_counts(table.limit(0), PATH).count() == 0


CONTRACT = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", re.A, 0, 20), "hex": (r"[0-9a-f]+", re.A, 0, 24),
}


def test_secrets_by_the_contract(spark):
    """The base rules written out here, on repeated rows and one very long line with many matches."""
    long = "é" * 5000 + " ".join(f"token=abcdef{k} AKIA{'Z' * 16} {'0123456789abcdef' * 2}" for k in range(500))
    rows = [(1, long), (1, long), (2, "a\npassword: 'hunter22'\nb"), (3, None)]
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in CONTRACT]) for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    for i, spans in got:
        text = dict(rows)[i] or ""
        want = [(k, m.start(), m.end()) for k, (p, flags, group, least) in CONTRACT.items() for m in re.finditer(p, text, flags) if len(m[group]) >= least]
        assert sorted(spans) == sorted(want)
    assert len(got) == 4 and secrets.secret_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_odd_tables(spark):
    """Empty tables, repeated rows, null ids and clashing names."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e g h"), (2, None)]
    names = ["id", "n", "sid", "set", "root", "line", "key", "score", "size", "fp", "sha", "removed", "copy"]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in names}).withColumn("source", F.lit("s"))
    empty = table.limit(0)
    for f in (jaccard_join.jaccard_components, exact_dedup.exact_duplicates, line_dedup.line_report, line_dedup.without_lines, mixing.mix_sources):
        assert f(table).count() == len(rows) and f(empty).count() == 0
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect())
    assert got == {(1, 3, 1): 2, (None, 4, None): 1, (2, 0, 2): 1}
    vectors = topk.integer_vectors(spark.createDataFrame([(20, [1.0]), (20, [1.0]), (1, [0.5])], "vec_id bigint, embedding array<double>"))
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0
    assert [(r.query_id, r.vec_id) for r in topk.top_k(vectors, vectors.where("id = 20"), 20).collect()] == [(20, 1)]
