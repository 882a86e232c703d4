"""The queries op1 to op10 and the pipeline: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import bpe, exact_dedup, jaccard_join, line_dedup, mixing, secrets, token_counts, topk, toxicity, warc
from spotweave.llm.common import narrow_batches
from spotweave.session import prepare, table

WORD_BPE = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record, read back from the archives."""
    return warc.round_trip(table(prepare(spark), sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    narrow_batches(prepare(spark))
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: 4-word shingles, 85 percent."""
    return jaccard_join.jaccard_components(table(prepare(spark), sf_dir, "documents"), 85, 4)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mix_sources(table(prepare(spark), sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 largest integer inner products of every vector whose id 20 divides."""
    vectors = topk.integer_vectors(table(prepare(spark), sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, through a fresh cache."""
    counts = token_counts.token_counts(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined) of every document."""
    report = line_dedup.line_report(table(prepare(spark), sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_dedup.exact_duplicates(table(prepare(spark), sf_dir, "documents"))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    found = secrets.secret_spans(table(prepare(spark), sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", _is(k))).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_jaccard, op4_mixing, op5_topk, op6_token_counts, op7_line_dedup, op8_toxicity, op9_exact_dedup, op10_secrets)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        h as (select *, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest,
                     case when strlen(html) >= 1000 then max(page_id) over (partition by html) end as head from p)
        select page_id, payload_bytes, payload_digest,
               case when head > page_id then 'revisit' else 'response' end as record_type,
               case when head > page_id then head end as refers_to from h""",
    "op3_jaccard": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                     else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d),
        n as (select doc_id, len(g)::bigint as n_shingles from s),
        t as (select doc_id, len(g) as c, unnest(g) as g from s),
        k as (select x.doc_id as a, y.doc_id as b, any_value(x.c + y.c) as both_sizes, count(*) as shared from t x join t y on x.g = y.g and x.doc_id < y.doc_id
              and 100 * x.c >= 85 * y.c and 100 * y.c >= 85 * x.c group by x.doc_id, y.doc_id),
        u as (select a, b from k where 100 * shared >= 85 * (both_sizes - shared)),
        l as (select a, b from u union all select b, a from u),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
        select n.doc_id, any_value(n_shingles) as n_shingles, min(r.b) as component_id from n join r on n.doc_id = r.a group by n.doc_id""",
    "op5_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op9_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as text from documents),
        g as (select doc_id, sha256(text) as text_sha256, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
}
