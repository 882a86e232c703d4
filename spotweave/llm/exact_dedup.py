"""Operator 9: exact duplicates through counting quotient filters.

Every partition builds a counting quotient filter of its texts' 64-bit fingerprints.  A filter is kept as its runs:
for each quotient the sorted remainders with their counts.  Sorted remainders merge losslessly, so the filters of all
partitions are merged range by range of quotients, one bounded range a group.  Only rows whose merged fingerprint
counts more than one go on to byte verification: grouped by the text itself, partially aggregated before the shuffle,
so a text that a third of all rows hold leaves each task as one row.

Defined results: null counts as empty, and all empty texts are equal; of equal texts the largest doc_id stays (a null
id only where all are null); rows repeated with one doc_id and text share one decision; empty tables give no rows;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import fresh, release, small, written

#: Fingerprints that one merged range of quotients holds, about; and those that a task gathers before it emits a filter.
RANGE_FINGERPRINTS, TASK_FINGERPRINTS = 50_000, 2_000_000


class CountingQuotientFilter:
    """Fingerprints split into quotient and remainder; each quotient's run of sorted remainders carries counts.

    `ends[q]` is the end of quotient q's run (the place of its last occupied slot), so a lookup is one slice and one
    binary search.  Nothing is approximate about counts: two filters of the same widths merge losslessly.
    """

    def __init__(self, quotient_bits: int, fingerprint_bits: int = 64):
        self.quotient_bits, self.remainder_bits = quotient_bits, fingerprint_bits - quotient_bits
        self.ends = np.zeros(1 << quotient_bits, np.int64)
        self.remainders, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _fill(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From entries in any order: sorted into runs, equal ones summed."""
        order = np.lexsort((remainders, quotients))
        q, r, c = quotients[order], remainders[order], counts[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        self.counts = np.add.reduceat(c, np.flatnonzero(first)) if len(c) else c
        self.remainders = r[first]
        self.ends = np.cumsum(np.bincount(q[first].astype(np.int64), minlength=len(self.ends)))
        return self

    def add(self, fingerprints: np.ndarray) -> CountingQuotientFilter:
        q = fingerprints >> np.uint64(self.remainder_bits)
        r = fingerprints & np.uint64((1 << self.remainder_bits) - 1)
        return self._fill(*(np.concatenate(x) for x in zip(self.entries(), (q, r, np.ones(len(q), np.int64)), strict=True)))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        quotients = np.repeat(np.arange(len(self.ends), dtype=np.uint64), np.diff(self.ends, prepend=0))
        return quotients, self.remainders, self.counts

    @classmethod
    def merged(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        filters = list(filters)
        out = cls(filters[0].quotient_bits, filters[0].quotient_bits + filters[0].remainder_bits)
        return out._fill(*(np.concatenate(x) for x in zip(*(f.entries() for f in filters), strict=True)))

    def count(self, fingerprint: int) -> int:
        q, r = fingerprint >> self.remainder_bits, np.uint64(fingerprint & ((1 << self.remainder_bits) - 1))
        a, b = int(self.ends[q - 1]) if q else 0, int(self.ends[q])
        i = a + int(np.searchsorted(self.remainders[a:b], r))
        return int(self.counts[i]) if i < b and self.remainders[i] == r else 0

    def ranges(self, range_bits: int) -> Iterable[tuple[int, bytes, bytes, bytes]]:
        """Cut at quotient ranges: (range, run lengths, remainders, counts), empty ranges left out."""
        step = len(self.ends) >> range_bits
        edges = np.concatenate([[0], self.ends[step - 1 :: step]])
        lengths = np.diff(self.ends, prepend=0).astype(np.int32)
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                yield k, lengths[k * step : (k + 1) * step].tobytes(), self.remainders[a:b].tobytes(), self.counts[a:b].tobytes()

    @classmethod
    def from_range(cls, quotient_bits: int, remainder_bits: int, lengths: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        out = cls(quotient_bits, quotient_bits + remainder_bits)
        out.ends = np.cumsum(np.frombuffer(lengths, np.int32).astype(np.int64))
        out.remainders, out.counts = np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64)
        return out


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp) that occur more than once in a one-column table of 64-bit fingerprints, by merged filters."""
    range_bits = max(4, int(np.ceil(np.log2(max(1, rows / RANGE_FINGERPRINTS)))))
    run_bits = 8  # quotients in one range
    quotient_bits = range_bits + run_bits
    remainder_bits = 64 - quotient_bits

    def build(batches):
        held: list[np.ndarray] = []

        def emit():
            cqf = CountingQuotientFilter(quotient_bits).add(np.concatenate(held))
            parts = list(cqf.ranges(range_bits))
            held.clear()
            return pa.RecordBatch.from_pydict({"part": [p[0] for p in parts], "lengths": [p[1] for p in parts], "remainders": [p[2] for p in parts], "counts": [p[3] for p in parts]}, schema=pa.schema([("part", pa.int32()), ("lengths", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())]))

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= TASK_FINGERPRINTS:
                yield emit()
        if held:
            yield emit()

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        columns = (table.column(c).to_pylist() for c in ("lengths", "remainders", "counts"))
        whole = CountingQuotientFilter.merged(CountingQuotientFilter.from_range(run_bits, remainder_bits, *x) for x in zip(*columns, strict=True))
        q, r, c = whole.entries()
        fp = (((np.uint64(part << run_bits) + q) << np.uint64(remainder_bits)) | r)[c > 1]
        return pa.table({"fp": fp.view(np.int64)})

    filters = fingerprints.mapInArrow(build, "part int, lengths binary, remainders binary, counts binary")
    return filters.groupBy("part").applyInArrow(merge, "fp bigint")


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, sha, keep_id, group_size) of every text that occurs more than once."""
    told = _told(docs, id_col, text_col)
    repeated = written(repeated_fingerprints(told.select("fp"), docs.count()))
    suspects = told.join(small(repeated), "fp", "left_semi")
    # byte verification: the text itself is a grouping key
    groups = written(suspects.groupBy("fp", "sha", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select("fp", "sha", "keep_id", "group_size"))
    release(repeated)
    # two different texts under one 64-bit fingerprint and one SHA-256 would make a group ambiguous: that stops the job
    alike = groups.groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("texts"))
    if not alike.where("texts > 1").isEmpty():
        raise ValueError("two texts share a SHA-256")
    return groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    groups = duplicate_groups(docs, id_col, text_col)
    found = _told(docs, id_col, text_col).drop("text").join(small(groups), ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of equal texts one row: of those with the largest id any one.  Decided by text and id together,
    so a row is not touched by another text under its id; a null id stays only where all ids of its text are null."""
    sha, keep = fresh(docs, "text_sha"), fresh(docs, "keep_id")
    groups = duplicate_groups(docs, id_col, text_col)
    side = small(groups.select("sha", "keep_id").toDF(sha, keep))
    keyed = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    alone = keyed.join(side.select(sha), sha, "left_anti")
    chosen = keyed.join(side, sha).where(F.col(id_col).eqNullSafe(F.col(keep))).dropDuplicates([sha])
    return alone.select(*docs.columns).unionByName(chosen.select(*docs.columns))
