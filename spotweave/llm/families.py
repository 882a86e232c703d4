"""Links inside long inverted lists, for operators 3 and 7: groups under leaders instead of pairs of entries.

A list that many sets share is not paired.  Its entries are dealt to cells by size (sets that may link are in one cell or
in neighbours), and each cell of a list is led by the entry whose id has the smallest hash; lists that hold much the same
sets get the same leader, so their entries meet once, as rows (leader, cell, set), however many lists they share.

* Every member's distance |x ^ leader| is computed exactly: one row a member, no pairs of members.
* A member similar to its leader takes over the leader's component; groups within one component are done.
* What is left is compared inside tasks, group by group: members of one component are never compared, sizes, the bound
  |d(x,p) - d(y,p)| <= |x ^ y| and parity sketches skip most others, and a link found unites two components at once, so
  that a task returns at most one link for each component it meets.  No pair leaves a task unless it links two components.
* Members outside the group's largest component are its outsiders.  Groups too large for one task are cut into parts:
  first each part by itself, then outsiders' parts against all parts.  The largest component is never paired with itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import release, written
from spotweave.llm.components import components

#: Members of a part, and shingles of all its members: two parts meet in one task.
PART, PART_SHINGLES = 4096, 1 << 20
#: Bits of a sketch; shingles that are looked up at once.
SKETCH_BITS, LOOKUPS = 1024, 1 << 20


def room(x, y, percent: int):
    """The largest |x ^ y| with which sets of these sizes link."""
    return (100 - percent) * (x + y) // (100 + percent)


def grouped(entries: DataFrame, percent: int) -> DataFrame:
    """(leader, cell, sid, n, home): the groups of list entries (token, sid, n); of two members one at least is at home."""
    own = F.floor(F.log("n") / math.log(1.01 * 100 / percent))
    cells = F.array(F.struct(own.alias("cell"), F.lit(True).alias("home")), F.struct((own - 1).alias("cell"), F.lit(False).alias("home")))
    rows = entries.select("token", "sid", "n", F.explode(cells).alias("c")).select("token", "sid", "n", "c.cell", "c.home")
    led = rows.groupBy("token", "cell").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid")).alias("first"), F.max("home").alias("any_home"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    led = led.where("any_home and lo <> hi").select("token", "cell", F.col("first.sid").alias("leader"))
    return rows.join(led, ["token", "cell"]).select("leader", "cell", "sid", "n", "home").distinct()


def from_leaders(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(leader, sid, distance, linked) of every member that is not the leader."""
    pairs = members.where("leader <> sid").select("leader", "sid").distinct()
    both = pairs.join(sets.toDF("leader", "led"), "leader").join(sets, "sid").select("leader", "sid", "led", "set")

    def run(batches):
        for t in batches:
            distance, linked = [], []
            held, lead = None, None
            for who, x, y in zip(t.column(0).to_pylist(), t.column(2), t.column(3), strict=True):
                if who != held:
                    held, lead = who, np.frombuffer(x.as_py(), np.uint64)
                other = np.frombuffer(y.as_py(), np.uint64)
                distance.append(len(lead) + len(other) - 2 * len(np.intersect1d(lead, other, assume_unique=True)))
                linked.append(distance[-1] <= room(len(lead), len(other), percent))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(distance, pa.int64()), pa.array(linked, pa.bool_())], names=["leader", "sid", "distance", "linked"])

    return written(both.mapInArrow(run, "leader bigint, sid bigint, distance bigint, linked boolean"))


def sketches(flat: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Parity sketches (rows x words): those of two sets differ in at most |x ^ y| bits."""
    odd = np.bincount(owner * SKETCH_BITS + (flat & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def between(sid: np.ndarray, root: np.ndarray, distance: np.ndarray, home: np.ndarray, part: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links between components: each unites two, and together they unite all that links among these sets unite."""
    order = np.lexsort((sid, [len(s) for s in sets]))
    sid, distance, home, part, sets = sid[order], distance[order], home[order], part[order], [sets[k] for k in order.tolist()]
    root = np.unique(root[order], return_inverse=True)[1]
    n = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(n)
    flat = np.concatenate(sets)
    sketch = sketches(flat, np.repeat(np.arange(len(n)), n), len(n))
    code = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    tops = np.searchsorted(n * percent, 100 * n, "right")  # later sets are too large
    out: list[tuple[int, int]] = []
    for i in range(len(n)):
        j = np.arange(i + 1, int(tops[i]))
        j = j[root[j] != root[i]]
        j = j[(home[j] | home[i]) & ((part[j] != part[i]) == across)]
        most = room(n[i], n[j], percent)
        far = np.abs(distance[j] - distance[i]) > most
        j, most = j[~far], most[~far]
        far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64) > most
        j, most = j[~far], most[~far]
        if not len(j):
            continue
        mine = code[ends[i] - n[i] : ends[i]]
        mark[mine] = True
        step = max(1, LOOKUPS // int(n[j].max()))
        for a in range(0, len(j), step):
            k, r = j[a : a + step], most[a : a + step]
            fresh = root[k] != root[i]  # links of this set may have united some
            k, r = k[fresh], r[fresh]
            if not len(k):
                continue
            starts = np.cumsum(n[k]) - n[k]
            at = np.arange(int(n[k].sum())) + np.repeat(ends[k] - n[k] - starts, n[k])
            shared = np.add.reduceat(mark[code[at]].astype(np.int64), starts)
            hit = k[n[i] + n[k] - 2 * shared <= r]
            roots, first = np.unique(root[hit], return_index=True)
            out += [(int(sid[i]), int(sid[x])) for x in hit[first].tolist()]
            if len(roots):
                root[np.isin(root, roots)] = root[i]
        mark[mine] = False
    return out


def mixed(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(leader, cell, main, parts, outer, inner) of the groups of several components, and the most parts of one (0: no
    group): the root of the largest component, and the numbers of parts of all, of the outsiders, of that component."""
    rows = rooted(members, roots)
    by_root = rows.groupBy("leader", "cell", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"))
    parts = lambda k, size: F.ceil(F.greatest(k / F.lit(PART), size / F.lit(PART_SHINGLES)))
    main = F.max(F.struct("k", "size", "root"))
    group = by_root.groupBy("leader", "cell").agg(main.alias("main"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    outer, inner = parts(F.col("k") - F.col("main.k"), F.col("size") - F.col("main.size")), parts(F.col("main.k"), F.col("main.size"))
    group = written(group.select("leader", "cell", F.col("main.root").alias("main"), parts(F.col("k"), F.col("size")).alias("parts"), outer.alias("outer"), inner.alias("inner")))
    return group, group.agg(F.max("parts")).first()[0] or 0


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def dealt(members: DataFrame, roots: DataFrame, group: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
    """The groups' members in cells (leader, cell, low, high) of one or two parts.  whole: all pairs that are left; else
    each part by itself."""
    rows = rooted(members, roots).join(group, ["leader", "cell"])
    place = F.xxhash64("sid", F.lit(int(whole)))
    if not whole:
        rows = rows.withColumn("part", F.pmod(place, F.col("parts"))).withColumn("low", F.col("part")).withColumn("high", F.col("part"))
    else:
        inside, one = F.col("root") == F.col("main"), F.col("parts") <= 1
        rows = rows.withColumn("part", F.when(one, 0).when(inside, F.col("outer") + F.pmod(place, F.col("inner"))).otherwise(F.pmod(place, F.col("outer"))))
        others = F.when(one, 1).when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), others.cast("bigint") - 1)))
        rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    rows = rows.join(known.select("leader", "sid", "distance"), ["leader", "sid"], "left")
    return rows.select("leader", "cell", "low", "high", "sid", "root", F.coalesce("distance", F.lit(0)).alias("distance"), "home", F.col("part").cast("bigint").alias("part"))


def compared(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, found within the cells."""

    def run(key, t):
        sid, root, distance, home, part = (t.column(c).to_numpy() for c in ("sid", "root", "distance", "home", "part"))
        each = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("set")]
        found = between(sid, root, distance, home.astype(bool), part, each, key[2].as_py() != key[3].as_py(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.join(sets, "sid").groupBy("leader", "cell", "low", "high").applyInArrow(run, "a bigint, b bigint")


def connected(entries: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(node, root) of what the given components (node, root) and all links among entries (token, sid, n) of one list
    connect; sets has (sid, set: sorted 64-bit shingles)."""
    members = written(grouped(entries, percent))
    known = from_leaders(members, sets, percent)
    edges = known.where("linked").select(F.col("leader").alias("a"), F.col("sid").alias("b"))
    now = components(roots.toDF("a", "b").unionByName(edges))
    whole = started = False
    while not whole:
        group, most = mixed(members, now)
        whole = started or most <= 1  # groups of several parts: first each part by itself
        if most:
            rows = written(dealt(members, now, group, known, whole))
            links = written(compared(rows, sets, percent))  # else a task holds two Python workers, this step's and the next one's
            new = components(now.toDF("a", "b").unionByName(links))
            release(rows, links, now)
            now = new
        release(group)
        started = True
    release(members, known)
    return now
