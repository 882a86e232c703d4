"""Operator 7: fuzzy line dedup by MinHash.

Lines are compared by their distinct character shingles (eight characters; lines lower-cased, white space collapsed;
a shorter line is its own only shingle) and are near copies at Jaccard similarity 0.8.  A line's signature has one
minimum in each of BANDS * ROWS bins of one hash (empty bins borrow from the next); lines that share all ROWS values
of a band are candidates (at 0.8 a pair is missed with probability 0.6 percent); candidates are verified exactly;
verified pairs and equal lines form components by distributed union-find, and of a component the first line, by
(doc_id, line number), stays.  Lines that are empty or blank are never removed.

A task emits the bands of each distinct line once, however often it holds it.  A band that at most ALL_PAIRS lines share
gives all their pairs; a longer one gives its lines to groups under leaders (`families`), which find all links among them
that connect anything, by 64-bit shingle hashes, without listing pairs.  No candidate is left out.

Defined results: null and empty texts have no lines to remove; rows repeated with one doc_id count their lines under the
same numbers and stay or go together; a null doc_id comes first; an empty table gives no rows; other columns may have
any names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import families
from spotweave.llm.common import batches_of, fresh, keys, mix, narrow_batches, release, small, written
from spotweave.llm.components import components
from spotweave.llm.jaccard_join import Bits

CHARS, SIMILARITY, BANDS, ROWS = 8, 0.8, 10, 4
#: Lines of a band that gives all its pairs.
ALL_PAIRS = 16
#: Places that mark a line's shingles by the low bits of their hashes; rows of narrow batches.
MARKS, NARROW_ROWS = 1 << 18, 16384
#: Characters whose shingles are hashed at once: the arrays stay in the processor's cache.
SLICE_CHARS = 1 << 16


def normal(line: str) -> str:
    # printable lines hold no white space but the space
    if line and line.isprintable() and "  " not in line and line[0] != " " and line[-1] != " ":
        return line
    return " ".join(line.split())


def line_id(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingles(line: str) -> set[str]:
    return {line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def similar(a: list[str], b: list[str]) -> list[bool]:
    """Whether the lines of every pair have the similarity, exactly, by 64-bit hashes of their shingles."""
    place = {line: k for k, line in enumerate(dict.fromkeys(a + b))}
    sets = shingle_sets(list(place)) if place else []
    low = [(x & np.uint64(MARKS - 1)).astype(np.int64) for x in sets]
    mark, held, out = np.zeros(MARKS, bool), -1, []
    for x, y in zip((place[s] for s in a), (place[s] for s in b), strict=True):
        least = SIMILARITY * (len(sets[x]) + len(sets[y])) / (1 + SIMILARITY) - 1e-9  # shingles that a similar pair shares
        if min(len(sets[x]), len(sets[y])) < least:
            out.append(False)
            continue
        if y != held:  # the join brings a line's pairs together
            if held >= 0:
                mark[low[held]] = False
            mark[low[y]] = True
            held = y
        # marks shared by chance only add: a pair below the bound is not similar
        out.append(np.count_nonzero(mark[low[x]]) >= least and common_hashes(sets[x], sets[y]) >= least)
    return out


def common_hashes(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two ascending arrays without repetitions share."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every place's shingle."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(s) for s in lines], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.maximum(1, lengths - CHARS + 1)
    row = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    k = keys(4)
    with np.errstate(over="ignore"):
        rolled = np.concatenate([text + np.uint64(1), np.zeros(CHARS, np.uint64)])
        for j, width in enumerate((1, 2, 4)):  # polynomial hashes of two, four, eight characters
            rolled = rolled[:-width] * k[j] + rolled[width:]
        value = rolled[at]
        for r in np.flatnonzero(lengths < CHARS).tolist():  # one shingle: the line
            value[int(np.searchsorted(row, r))] = np.uint64(line_id(lines[r]) & 0x7FFFFFFFFFFFFFFF)
        return row, mix(value)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of every line, as ascending hashes."""
    row, value = hashed(lines)
    ends = np.searchsorted(row, np.arange(1, len(lines) + 1)).tolist()
    out, start = [], 0
    for end in ends:
        v = np.sort(value[start:end])
        new = v[1:] != v[:-1]
        out.append(v if new.all() else np.concatenate([v[:1], v[1:][new]]))
        start = end
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """(line, bin) minima of one-permutation MinHash over character shingles, empty bins filled from the next ones."""
    bins = BANDS * ROWS
    row, value = hashed(lines)
    with np.errstate(over="ignore"):
        out = np.full(len(lines) * bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(out, row * bins + ((value >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), value)
        out = out.reshape(len(lines), bins)
        empty = out == np.iinfo(np.uint64).max
        rows = np.flatnonzero(empty.any(axis=1))
        if len(rows):  # an empty bin takes the next one's minimum, mixed with its distance
            held, places = out[rows], np.arange(bins)
            full = np.where(np.tile(empty[rows], 2), 2 * bins, np.arange(2 * bins))
            ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :bins]
            lent = mix(np.take_along_axis(held, ahead % bins, axis=1) + (ahead - places).astype(np.uint64) * keys(1)[0])
            out[rows] = np.where(ahead > places, lent, held)
    return out


def bands(lines: list[str]) -> np.ndarray:
    """(line, band) keys, one band's keys never another's."""
    s = signatures(lines).reshape(len(lines), BANDS, ROWS)
    k = keys(ROWS + BANDS)
    with np.errstate(over="ignore"):
        return mix((s * k[:ROWS]).sum(axis=2) + k[None, ROWS:])


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line, bands) of every line that is not blank; bands at the first of a task's equal lines."""
    narrow_batches(docs.sparkSession)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, numbers, hashes, new, texts = [], [], [], [], []
            size = 0

            def emit():
                at = [k for k, s in enumerate(texts) if s is not None]
                flat = bands([texts[k] for k in at]).view(np.int64).ravel() if at else np.zeros(0, np.int64)
                counts = np.zeros(len(ids), np.int64)
                counts[at] = BANDS
                none = np.ones(len(ids), bool)
                none[at] = False
                offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32(), mask=np.append(none, False))
                listed = pa.ListArray.from_arrays(offsets, pa.array(flat))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), listed], names=["id", "line_no", "line", "bands"])

            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, raw in enumerate((text or "").lower().split("\n")):
                    if line := normal(raw):
                        h = line_id(line)
                        ids.append(i)
                        numbers.append(n)
                        hashes.append(h)
                        texts.append(None if h in seen else line)
                        size += len(line) if h not in seen else 0
                        seen.add(h)
                if size > SLICE_CHARS:
                    yield emit()
                    ids, numbers, hashes, texts, size = [], [], [], [], 0
            if ids:
                yield emit()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, line_no int, line bigint, bands array<bigint>")


def candidates(occurrences: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a short band, band null; and the lines a of every long band, b null."""
    postings = occurrences.where("bands is not null").select(F.explode("bands").alias("band"), "line").repartition("band").sortWithinPartitions("band")

    def pairs(band: np.ndarray, line: np.ndarray):
        if not len(band):
            return
        new = np.concatenate([[True], band[1:] != band[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # each entry's run begins there
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        rank = np.arange(len(band)) - first
        out = []
        for back in range(1, min(ALL_PAIRS, int(size.max()))):
            k = np.flatnonzero((rank >= back) & (size <= ALL_PAIRS))
            out.append(np.column_stack([line[k - back], line[k]]))
        if out and len(got := np.unique(np.concatenate(out), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy()), pa.nulls(len(got), pa.int64())], names=names)
        if len(k := np.flatnonzero(size > ALL_PAIRS)):
            yield entries(band[k], line[k])

    def entries(band: np.ndarray, line: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(line), pa.nulls(len(line), pa.int64()), pa.array(band)], names=names)

    names = ["a", "b", "band"]

    def run(batches):
        band, line, open_band = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                band, line = np.append(band, b.column(0).to_numpy()), np.append(line, b.column(1).to_numpy())
            if not len(band):
                continue
            order = np.lexsort((line, band))  # Spark sorts by band alone, a radix sort
            band, line = band[order], line[order]
            keep = np.ones(len(band), bool)
            keep[1:] = (band[1:] != band[:-1]) | (line[1:] != line[:-1])
            band, line = band[keep], line[keep]
            more = 0 if open_band is None else int(np.searchsorted(band, open_band, "right"))  # a band known to be long goes through
            if more:
                yield entries(band[:more], line[:more])
            band, line = band[more:], line[more:]
            end = len(band) if b is None or not len(band) else int(np.searchsorted(band, band[-1], "left"))
            yield from pairs(band[:end], line[:end])
            band, line = band[end:], line[end:]
            if len(band) > ALL_PAIRS:
                open_band = band[0]
                yield entries(band, line)
                band, line = band[:0], line[:0]

    with batches_of(occurrences.sparkSession, NARROW_ROWS):
        return written(postings.mapInArrow(run, "a bigint, b bigint, band bigint").distinct())


def line_texts(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(line, text) of the wanted lines, and a few more: a bitmap of bounded size chooses them where texts are read."""
    wanted = written(wanted.distinct())
    bits = max(16, min(27, int(np.ceil(np.log2(16 * max(1, wanted.count()))))))
    chosen = docs.sparkSession.sparkContext.broadcast(Bits.of(wanted, bits).words)
    release(wanted)

    def run(batches):
        bitmap, seen = Bits(bits, chosen.value), set()
        for b in batches:
            found = {}
            for text in b.column(0).to_pylist():
                for raw in (text or "").lower().split("\n"):
                    if line := normal(raw):
                        found[line_id(line)] = line
            ids = np.fromiter(found, np.int64, len(found))
            take = [i for i in ids[bitmap.has(ids.view(np.uint64))].tolist() if i not in seen]
            seen.update(take)
            yield pa.RecordBatch.from_arrays([pa.array(take, pa.int64()), pa.array([found[i] for i in take], pa.string())], names=["line", "text"])

    lines = docs.select(F.col(text_col)).mapInArrow(run, "line bigint, text string")
    return written(lines.groupBy("line").agg(F.min("text").alias("text")))


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar, exactly."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def check(batches):
        for t in batches:
            keep = similar(t.column(2).to_pylist(), t.column(3).to_pylist())
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def connected(docs: DataFrame, occurrences: DataFrame, text_col: str) -> DataFrame:
    """(line, root) of all lines that similar pairs sharing a band connect to a smaller one."""
    found = candidates(occurrences)
    pairs, long = found.where("b is not null").select("a", "b"), found.where("b is null").select("band", F.col("a").alias("line"))
    texts = line_texts(docs, found.select(F.col("a").alias("line")).union(pairs.select("b")), text_col)
    roots = components(linked(pairs, texts))
    if not long.isEmpty():

        def describe(batches):
            for t in batches:
                each = shingle_sets(t.column(1).to_pylist()) if t.num_rows else []
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], names=["sid", "n", "set"])

        sets = written(texts.join(long.select("line").distinct(), "line", "left_semi").mapInArrow(describe, "sid bigint, n bigint, set binary"))
        entries = long.toDF("token", "sid").join(sets.select("sid", "n"), "sid")
        percent = round(100 * SIMILARITY)
        roots, done = families.connected(entries, sets.select("sid", "set"), roots, percent), roots
        release(done, sets)
    release(found, texts)
    return roots


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kept) of every line that is not blank."""
    occurrences = written(line_occurrences(docs, id_col, text_col))
    roots = connected(docs, occurrences, text_col)
    lines = occurrences.select("id", "line_no", "line").join(small(roots.toDF("line", "root")), "line", "left").select("id", "line_no", F.coalesce("root", "line").alias("root"))
    lines = written(lines)
    release(occurrences, roots)
    firsts = lines.groupBy("root").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first")
    told = lines.join(firsts, "root", "left")
    kept = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
    return told.select(F.col("id").alias(id_col), "line_no", kept.alias("kept"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, removed) of every document: numbers of all lines, and of those to remove, from 0."""
    gone = removed_lines(docs.select(id_col, text_col), id_col, text_col).where("not kept").groupBy(F.col(id_col).alias("gone_id")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    sizes = docs.select(F.col(id_col), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("bigint").alias("n_lines"))
    out = sizes.join(gone, sizes[id_col].eqNullSafe(gone["gone_id"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(id_col, "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, their texts without the removed lines."""
    gone_id, removed = fresh(docs, "gone_id"), fresh(docs, "removed")
    report = line_report(docs, id_col, text_col).where("n_removed > 0").select(F.col(id_col).alias(gone_id), F.col("removed").alias(removed)).distinct()
    joined = docs.join(report, docs[id_col].eqNullSafe(report[gone_id]), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda s, n: ~F.array_contains(removed, n)), "\n")
    return joined.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
