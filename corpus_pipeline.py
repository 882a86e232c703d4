"""A pipeline from raw documents to training tokens: STAGES, each written as Parquet and reread as the next one's input.

toxicity, exact dedup, near dedup by n-gram Jaccard, mixing sources to target weights, BPE encoding.  All stages but the
last return the columns of `documents`, whatever further columns there are and whatever their names; decisions, which
are narrow rows, travel to the texts and not the reverse while a count shows them small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spotweave.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from spotweave.llm.common import narrow_batches, release, written
from spotweave.session import prepare, table

WORD_BPE = "word_bpe_49k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject.

    Decided by the text: equal texts stay or go together; null and empty texts count as texts without words, which tell
    nothing; ids play no part but to find labels; an empty table, or one without labels of both kinds, loses nothing.
    """
    model = toxicity.fit(docs, table(prepare(spark), sf_dir, "labels"))
    return toxicity.tolerated(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null counts as empty, and all empty texts are equal; other texts under the same id are not touched; a null id stays
    only where no other id has its text; of rows repeated with id and text one stays; an empty table stays empty.
    """
    prepare(spark)
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id, null last.

    Null and empty texts are in no group and stay; a text of fewer than five words has all its words as one shingle;
    other texts under the same id are not touched; rows repeated with id and text stay or go together.
    """
    prepare(spark)
    return jaccard_join.deduplicated(docs, 80, 5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are a source of their own; texts without words have size 0 and count by the number of documents only;
    null and repeated ids draw like others, repeated rows each for themselves; an empty table stays empty.
    """
    prepare(spark)
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256) of every document of the mix; null and empty texts have no ids."""
    narrow_batches(prepare(spark))
    path = public_tokenizers.path(WORD_BPE)

    def run(batches):
        for b in batches:
            codec, _, _ = bpe.loaded(path)
            ids = [codec.encode(t.as_py() or "") for t in b.column(2)]
            decoded = [hashlib.sha256(codec.decode(i).encode()).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)], names=["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, ids array<int>, decoded_sha256 string")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# Fitted models, balanced draws and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            release(before)
    return docs
