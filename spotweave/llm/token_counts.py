"""Operator 6: token counts through a digest cache.

Normalised content and tokenizer version give a digest; stored counts are joined by it, only distinct misses are
encoded, and their counts are appended to the cache.  Digests are taken where texts are read and texts never travel: of
each missing digest one row is chosen, a bitmap of bounded size tells the tasks which rows those are, and they are encoded
where they lie (a row that the bitmap takes for a chosen one is encoded for nothing).  A digest that very many rows share
is one row after the partial aggregation, and its join back is split by adaptive execution.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows and equal texts get equal counts; an empty
table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import bpe
from spotweave.llm.common import narrow_batches, release, shared_dir, written
from spotweave.llm.jaccard_join import Bits

SCHEMA = "digest binary, n_tokens bigint"
#: Texts whose new words are encoded together.
COUNTED = 64
#: Most bits of the bitmap of chosen rows.
ROW_BITS = 27


@lru_cache(8)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count(texts: list[str], path: str) -> list[int]:
    """Numbers of ids, without begin, end or added special tokens."""
    return [len(_sentencepiece(path).encode(t)) for t in texts] if path.endswith(".model") else bpe.count_batch(texts, path)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether runs of white space count as one: then they are normalised before the digest."""
    return path.endswith(".json") and (b := bpe.loaded(path)[0]).latin is not None and "Replace" in b.normalizers


def digest(text: str, drop: bool) -> bytes:
    """SHA-256 of the normalised content."""
    raw = text.encode("utf-8", "surrogatepass")
    return hashlib.sha256(b" ".join(raw.split()) if drop else raw).digest()


def row_hash(text_digest: bytes, row_id) -> int:
    """64 bits of a row, by its content and id."""
    return int.from_bytes(hashlib.blake2b(text_digest + repr(row_id).encode(), digest_size=8).digest(), "little", signed=True)


def _stored(spark: SparkSession, place: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    # calls that ran at the same time may have stored a digest twice
    return spark.read.schema(SCHEMA).parquet(place).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")) if there else spark.createDataFrame([], SCHEMA)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.  cache: a folder kept between calls; without it, a fresh one in the shared folder."""
    spark = docs.sparkSession
    narrow_batches(spark)
    place = f"{cache or shared_dir(spark)}/tokenizer={tokenizer_version(path)}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, drop = rows.schema["id"].dataType.simpleString(), drops_white_space(path)

    def describe(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            found = [digest(t, drop) for t in texts]
            row = pa.array([row_hash(d, i) for d, i in zip(found, b.column(0).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), sizes, row], names=["id", "digest", "n_bytes", "row"])

    told = written(rows.mapInArrow(describe, f"id {kind}, digest binary, n_bytes bigint, row bigint"))
    missing = written(told.groupBy("digest").agg(F.min("row").alias("row")).join(_stored(spark, place), "digest", "left_anti").select("row"))
    bits = max(16, min(ROW_BITS, math.ceil(math.log2(64 * max(1, missing.count())))))
    chosen = spark.sparkContext.broadcast(Bits.of(missing, bits).words)
    release(missing)

    def encode(batches):
        bitmap, done = Bits(bits, chosen.value), set()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [digest(t, drop) for t in texts]
            row = np.array([row_hash(d, i) for d, i in zip(found, b.column(0).to_pylist(), strict=True)], np.int64)
            at = list({found[k]: k for k in np.flatnonzero(bitmap.has(row.view(np.uint64))).tolist() if found[k] not in done}.values())
            done.update(found[k] for k in at)
            counts = []
            for k in range(0, len(at), COUNTED):
                counts += count([texts[i] for i in at[k : k + COUNTED]], path)
            yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in at], pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    # rows repeated with one id, or taken for chosen ones, are encoded alike: the cache keeps one of them
    new = rows.mapInArrow(encode, SCHEMA).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.join(_stored(spark, place), "digest", "left_anti").write.mode("append").parquet(place)
    return told.join(_stored(spark, place), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
