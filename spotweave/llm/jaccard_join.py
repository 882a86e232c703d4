"""Operator 3: exact n-gram Jaccard join with set-relation skipping, and its components.

Sets of word shingles link at Jaccard similarity `percent` or more.  An inverted index holds, for every shingle of a
set's prefix (so few shingles that two linked sets must share one), a list of (size, position, set).

* Order.  Frequent shingles come last, so prefixes hold rare ones.  Which are frequent is counted over all texts and
  kept as a bitmap of bounded size; the order (bit, hash) is the same for all sets, so prefixes stay lossless whatever
  the bitmap says.
* Index level.  Lists are sorted by size and cut into blocks; sizes and positions bound the overlap of any two entries
  and skip whole blocks, then single pairs.  A list of at most LIST entries gives all pairs left.
* Answer level.  A longer list (a large group of similar texts) gives no pairs: its sets go to groups under leaders
  (`families`), whose exact distances |x ^ p| give a member its leader's answers, skip most others by
  |d(x,p) - d(y,p)| <= |x ^ y|, and leave the rest to comparisons inside tasks that end where components are one.

Sets are verified exactly; they travel only for pairs that pass all bounds.  Equal sets are one node.  A set is known
by its size and 64 bits of its digest, a shingle by 64 bits.

Defined results: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a
shingle has its whole sequence as one; rows repeated with one id share a component; ids that are null stay null and
their sets still link; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm import families
from spotweave.llm.common import fresh, narrow_batches, release, slices, small, text_bytes, written
from spotweave.llm.components import components
from spotweave.llm.shingles import shingle_sets

#: Entries of a list that gives all its pairs; entries of a block.
LIST, BLOCK = 64, 64
#: A shingle in so many sets (doubled until at most HEAVY are) comes last in the order.
FREQUENT, HEAVY = 24, 1_000_000
HEAVY_BITS, TEXT_BYTES = 26, 1 << 20


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def needed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of these sizes need to link."""
    return -(-(percent * (x + y)) // (100 + percent))


class Bits:
    """A bitmap of bounded size over hashes."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(max(1, (1 << bits) >> 6), np.uint64) if words is None else words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64((1 << self.bits) - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    @classmethod
    def of(cls, column: DataFrame, bits: int) -> Bits:
        """Of a one-column table of longs: or-ed in the cluster, at most 2^bits / 64 words come to the driver."""
        name = column.columns[0]
        slot = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
        words = column.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out = cls(bits)
        out.words[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return out


def ordered(s: np.ndarray, heavy: Bits) -> np.ndarray:
    """A set in the join's order: by hash, frequent shingles last."""
    late = heavy.has(s >> np.uint64(24))
    return np.concatenate([s[~late], s[late]])


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8, salt=len(s).to_bytes(8, "little")).digest(), "little", signed=True)


def parity_sketch(s: np.ndarray) -> bytes:
    """Bit k is the parity of the shingles that fall on k; sketches of two sets differ in at most |x ^ y| bits.
    Twice as many bits as shingles, a power of two: a longer sketch folds onto a shorter one."""
    bits = max(64, min(1 << 16, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of |x ^ y| from two sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def pairs_of_list(n: np.ndarray, position: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a list sorted by size that sizes and positions allow; blocks of entries are skipped whole."""
    out_i, out_j = [], []
    edges = [*range(0, len(n), BLOCK), len(n)]
    rest = n - position
    for a, b in zip(edges, edges[1:], strict=False):
        for c, d in zip(edges, edges[1:], strict=False):
            if c < a:
                continue
            if n[b - 1] * 100 < percent * n[c]:  # the block's largest set is too small for this and all later blocks
                break
            most = min(position[a:b].max(), position[c:d].max()) + min(rest[a:b].max(), rest[c:d].max())
            if most < needed(n[a], n[c], percent):
                continue
            i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
            i, j = i[i < j], j[i < j]
            overlap = np.minimum(position[i], position[j]) + np.minimum(rest[i], rest[j])
            fine = overlap >= needed(n[i], n[j], percent)
            out_i.append(i[fine])
            out_j.append(j[fine])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2


def batch_sets(batches, width: int):
    """(batch, its rows' sets); the text is a batch's last column."""
    for b in batches:
        raw, offsets = text_bytes(b.column(b.num_columns - 1))
        out: list[np.ndarray] = []
        for lo, hi in slices(offsets, TEXT_BYTES):
            out += shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
        yield b, out


class Join:
    """One run of the operator; each step is a table in the shared folder."""

    def __init__(self, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        narrow_batches(self.spark)
        self.percent, self.width = percent, width
        struct = docs.schema[id_col].dataType.typeName() == "struct"
        self.kind = docs.schema[id_col].dataType.simpleString() if struct else "bigint"
        self.docs = docs.select(F.col(id_col).cast(self.kind).alias("id"), F.col(text_col).alias("text"))
        self.held: list[DataFrame] = []

    def frequent(self) -> Bits:
        """Shingles in many distinct sets, counted over all texts, by 40 bits of their hash.

        Counted are the first shingles by hash, half as many again as a prefix holds: those beyond can only enter a
        prefix in place of such.
        """

        percent, width = self.percent, self.width

        def count(batches):
            seen: set[int] = set()
            held: list[np.ndarray] = []

            def emit():
                slot, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n)], names=["slot", "n"])

            for _, sets in batch_sets(batches, width):
                for s in sets:
                    if len(s) and (sid := set_id(s)) not in seen:
                        seen.add(sid)
                        held.append(s[: prefix_length(len(s), percent) * 3 // 2] >> np.uint64(24))
                if sum(map(len, held)) > 1_000_000:
                    yield emit()
            if held:
                yield emit()

        counts = self.docs.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
        least, found = FREQUENT, written(counts.where(F.col("n") >= FREQUENT))
        while found.where(F.col("n") >= least).count() > HEAVY:
            least *= 2
        bits = Bits.of(found.where(F.col("n") >= least).select("slot"), HEAVY_BITS)
        release(found)
        return bits

    def described(self) -> DataFrame:
        """(id, sid, n, sketch, prefix) of every row; sketch and prefix only at the first of a task's equal sets."""
        heavy = self.spark.sparkContext.broadcast(self.frequent().words)
        percent, width = self.percent, self.width

        def run(batches):
            bits, seen = Bits(HEAVY_BITS, heavy.value), set()
            for b, sets in batch_sets(batches, width):
                sid, sketch, prefix = [], [], []
                for s in sets:
                    sid.append(set_id(s) if len(s) else None)
                    new = len(s) > 0 and sid[-1] not in seen
                    seen.add(sid[-1])
                    sketch.append(parity_sketch(s) if new else None)
                    prefix.append(ordered(s, bits)[: prefix_length(len(s), percent)].view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sid, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "sid", "n", "sketch", "prefix"])

        return written(self.docs.mapInArrow(run, f"id {self.kind}, sid bigint, n bigint, sketch binary, prefix array<bigint>"))

    def listed(self, described: DataFrame) -> DataFrame:
        """Rows (token, n, sid, other): candidate pairs (sid, other), and the entries of long lists (other null)."""
        postings = described.where("prefix is not null").select("n", "sid", F.posexplode("prefix").alias("position", "token"))
        postings = postings.select("token", F.col("n").cast("int").alias("n"), "position", "sid").repartition("token").sortWithinPartitions("token", "n", "sid")
        percent = self.percent

        def run(batches):
            rest, open_list = None, None
            for b in itertools.chain(batches, [None]):
                new = None if b is None else [c.to_numpy(zero_copy_only=False) for c in b.columns]
                cols = new if rest is None else rest if new is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
                if cols is None or not len(cols[0]):
                    continue
                if open_list is not None:  # a list known to be long goes through as it comes
                    more = int(np.searchsorted(cols[0], open_list, "right"))
                    yield entries(*(c[:more] for c in cols))
                    cols = [c[more:] for c in cols]
                token = cols[0]
                end = len(token) if b is None or not len(token) else int(np.searchsorted(token, token[-1], "left"))  # the last list may go on
                yield from lists(*(c[:end] for c in cols))
                rest = [c[end:] for c in cols]
                if len(np.unique(rest[3])) > LIST:
                    open_list = rest[0][0]
                    yield entries(*rest)
                    rest = None

        def entries(token, n, position, sid):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64)), pa.array(sid), pa.nulls(len(token), pa.int64())], names=names)

        def lists(token, n, position, sid):
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (n[1:] != n[:-1])  # one set, seen by several tasks
            token, n, position, sid = token[keep], n[keep].astype(np.int64), position[keep].astype(np.int64), sid[keep]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(token)))
            left, right = [], []
            for a, k in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
                part = slice(a, a + k)
                if k > LIST:
                    yield entries(token[part], n[part], position[part], sid[part])
                    continue
                i, j = pairs_of_list(n[part], position[part], percent)
                left.append(sid[a + i])
                right.append(sid[a + j])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
                if len(pairs):
                    none = pa.nulls(len(pairs), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=names)

        names = ["token", "n", "sid", "other"]
        return written(postings.mapInArrow(run, "token bigint, n bigint, sid bigint, other bigint"))

    def near(self, pairs: DataFrame, described: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parity sketches allow."""
        sketches = described.where("sketch is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        sketches = written(sketches)
        percent = self.percent
        both = pairs.join(sketches.toDF("a", "na", "ka"), "a").join(sketches.toDF("b", "nb", "kb"), "b").select("a", "b", "na", "nb", "ka", "kb")

        def run(batches):
            for t in batches:
                na, nb = t.column(2).to_numpy(), t.column(3).to_numpy()
                room = na + nb - 2 * needed(na, nb, percent)
                keep = [apart(x.as_py(), y.as_py()) <= r for x, y, r in zip(t.column(4), t.column(5), room.tolist(), strict=True)]
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        out = written(both.mapInArrow(run, "a bigint, b bigint"))
        release(sketches)
        return out

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(sid, set) of all wanted sets (and a few more: a bitmap of bounded size chooses them where texts are read)."""
        wanted = written(wanted.distinct())
        bits = max(16, min(27, int(np.ceil(np.log2(16 * max(1, wanted.count()))))))
        chosen = self.spark.sparkContext.broadcast(Bits.of(wanted, bits).words)
        release(wanted)
        width = self.width

        def run(batches):
            bitmap, seen = Bits(bits, chosen.value), set()
            for _, sets in batch_sets(batches, width):
                sid = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
                take = [k for k in np.flatnonzero(bitmap.has(sid.view(np.uint64))).tolist() if len(sets[k]) and sid[k] not in seen]
                take = list({sid[k]: k for k in take}.values())
                seen.update(sid[take].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(sid[take]), pa.array([sets[k].tobytes() for k in take], pa.binary())], names=["sid", "set"])

        return written(self.docs.select("text").mapInArrow(run, "sid bigint, set binary").groupBy("sid").agg(F.first("set").alias("set")))

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, exactly."""
        percent = self.percent
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

        def run(batches):
            for t in batches:
                keep = []
                for x, y in zip(t.column(2), t.column(3), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return written(both.mapInArrow(run, "a bigint, b bigint"))

    @staticmethod
    def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose sets are not connected yet."""
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(node, root) that the similar ones of the pairs connect: first one pair a set, then those still between components."""
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        done = self.linked(first, sets)
        roots = components(done)
        more = self.linked(self.between(pairs.join(first, ["a", "b"], "left_anti"), roots), sets)
        out = components(roots.toDF("a", "b").unionByName(more))
        release(done, more, roots)
        return out

    def run(self) -> DataFrame:
        """(id, n_shingles, component_id) of every row."""
        described = self.described()
        listed = self.listed(described)
        pairs = self.near(listed.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct(), described)
        nodes = written(described.select("id", "sid", "n"))
        release(described)
        long = listed.where("other is null").select("token", "sid", "n")
        sets = self.sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(long.select("sid")))
        roots = self.verified(pairs, sets)
        release(pairs)
        if not long.isEmpty():
            roots, done = families.connected(long, sets, roots, self.percent), roots
            release(done)
        release(listed, sets)
        self.held = [nodes, roots]
        rooted = nodes.where("n > 0").join(roots.toDF("sid", "root"), "sid", "left").select("id", "n", F.coalesce("root", "sid").alias("root"))
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        inside = rooted.join(least, "root").select("id", F.col("n").alias("n_shingles"), "component_id")
        return inside.unionByName(nodes.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each component the row with the smallest id (null last, ties by a digest of the text).
    Rows are told apart by id and text together; rows repeated with both stay or go together."""
    key = fresh(docs, "row_key")
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)
    number = F.col(id_col).cast("bigint")
    keyed = docs.withColumn(key, F.struct(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), digest.alias("digest")))
    join = Join(keyed, percent, width, key, text_col)
    dropped = written(join.run().where("id <> component_id").select(F.col("id").alias(key)).distinct())
    release(*join.held)
    return keyed.join(small(dropped), key, "left_anti").select(*docs.columns)


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: component_id is the smallest id reachable by links."""
    return Join(docs, percent, width, id_col, text_col).run().withColumnRenamed("id", id_col)
