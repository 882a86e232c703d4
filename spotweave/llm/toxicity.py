"""Operator 8: toxicity by class-conditional Kneser-Ney models.

Two models of words by their characters, one of toxic and one of ordinary texts, share one backoff: lower orders count
in how many distinct settings a piece of a word occurs, over both classes together, so that a rare expression, or an
inflected form never seen, is judged by the stem it shares with others.  A toxic text is mostly
ordinary words, so its likelihood is that of a mixture: a share of its words (chosen on labelled texts among SHARES)
comes from the toxic model, the rest from the ordinary one.  A text's score is the difference of the two
log-likelihoods divided by its number of words, put through a logistic curve that is fitted on labelled texts scored
by models which have not seen them (two halves, crossed).

All labelled training rows are counted, by word and then by character n-gram, and every n-gram and continuation count
is kept, in distributed tables.  Ratios of the COMMON_GRAMS commonest n-grams and contexts travel to the texts, with a
bitmap of bounded size that tells which others exist; a word all of whose n-grams are shipped or were never seen is told
where its text is read, any other word meets its n-grams' ratios in a join.  What is shipped changes no score.  The
curve is fitted on at most about CURVE_ROWS labelled rows.

Defined results: null and empty texts have no words and get the curve's value at zero, the score of a text that tells
nothing; a label that is null is no label; several labels of one document count as toxic if one is; without training
rows of both classes every score is 0.5 less than half by one part in a thousand (nothing is rejected); repeated rows
get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import batches_of, fresh, mix, narrow_batches, release, slices, small, written
from spotweave.llm.jaccard_join import Bits

ORDER, DISCOUNT = 6, 0.75
SHARES = (0.05, 0.02, 0.01, 0.005, 0.002)
CURVE_ROWS, COMMON_GRAMS, GRAM_BITS, HEAD_BITS = 20_000, 300_000, 27, 18
#: A worker holds about so many words; their n-grams are hashed, and texts taken apart, in runs of so many words and characters.
TASK_WORDS, HASHED_WORDS, SPLIT_CHARACTERS = 120_000, 8_192, 1 << 20
PAD, END = "\x02", "\x03"
WORD = re.compile(r"\w+")


def grams(word: str) -> list[str]:
    """Every character of a word with the ORDER - 1 before it, and the word's end."""
    padded = PAD * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def backoff(inventory: DataFrame) -> DataFrame:
    """(piece, p): Kneser-Ney probabilities of the last character of every piece below the highest order, from pooled
    continuation counts; `inventory` has each n-gram of the highest order once."""
    levels, level = [], inventory.select(F.col("gram").alias("piece"))
    for _ in range(ORDER - 1):
        level = written(level.groupBy(F.expr("substring(piece, 2)").alias("piece")).agg(F.count(F.lit(1)).alias("c")))
        levels.append(level)
    out = None
    for n, level in enumerate(reversed(levels), 1):
        rows = level.withColumn("context", F.substring("piece", 1, n - 1))
        of = rows.groupBy("context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(of, "context")
        if out is None:
            rows = rows.withColumn("shared", F.lit(1 / (1 + level.count())))
        else:
            rows = rows.withColumn("part", F.expr("substring(piece, 2)")).join(out.toDF("part", "shared"), "part")
        before, out = out, rows.select("piece", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("shared")) / F.col("total")).alias("p"))
        out = written(out)
        release(level, *([] if before is None else [before]))
    return out


#: Counts of a class and n-gram by column of ratios: of all rows, and of those outside either half.
CELLS = {"r": ("c0 + c1", "c2 + c3"), "r0": ("c1", "c3"), "r1": ("c0", "c2")}


def ratio_tables(by_gram: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log P(toxic) - log P(ordinary) of every character in its context: (gram, r, r0, r1) of all n-grams that were
    seen, and (context, r, r0, r1) for n-grams that were not."""
    sides = [(f"{r}_{k}", F.expr(both[k])) for r, both in CELLS.items() for k in (0, 1)]
    rows = by_gram.select("gram", F.substring("gram", 1, ORDER - 1).alias("context"), F.expr("substring(gram, 2)").alias("piece"), *(v.alias(c) for c, v in sides))
    of = rows.groupBy("context").agg(*(F.sum(c).alias(f"total_{c}") for c, _ in sides), *(F.sum((F.col(c) > 0).cast("bigint")).alias(f"kinds_{c}") for c, _ in sides))
    of = written(of)

    def seen(c: str) -> Column:
        p = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * F.col("p")) / F.col(f"total_{c}")
        return F.when(F.col(f"total_{c}") > 0, p).otherwise(F.col("p"))

    def left(c: str) -> Column:
        return F.when(F.col(f"total_{c}") > 0, DISCOUNT * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0)

    shared, times = backoff(by_gram), lambda r: F.expr(f"{r}_0 + {r}_1").alias("times")
    grams_of = rows.join(of, "context").join(shared, "piece").select("gram", *(F.log(seen(f"{r}_1") / seen(f"{r}_0")).alias(r) for r in CELLS), times("r"))
    out = written(grams_of), written(of.select("context", *(F.log(left(f"{r}_1") / left(f"{r}_0")).alias(r) for r in CELLS), times("total_r")))
    release(of, shared)
    return out


def word_ratios(words: DataFrame, tables: tuple[DataFrame, DataFrame], *names: str) -> DataFrame:
    """(word, ratios) of distinct words."""

    def run(batches):
        for b in batches:
            pairs = [(w, g, n) for w in b.column(0).to_pylist() for g, n in Counter(grams(w)).items()]
            word, gram, n = zip(*pairs, strict=True) if pairs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

    seen, unseen = tables
    rows = words.select("word").mapInArrow(run, "word string, gram string, n bigint").withColumn("context", F.substring("gram", 1, ORDER - 1))
    rows = rows.join(seen.select("gram", *(F.col(r).alias(f"g_{r}") for r in names)), "gram", "left")
    rows = rows.join(unseen.select("context", *(F.col(r).alias(f"h_{r}") for r in names)), "context", "left")
    return rows.groupBy("word").agg(*(F.sum(F.coalesce(f"g_{r}", f"h_{r}", F.lit(0.0)) * F.col("n")).alias(r) for r in names))


def mixture(ratio: Column, share: float) -> Column:
    """A word's log-likelihood ratio, toxic mixture to ordinary."""
    return F.log1p(F.lit(share) * F.expm1(F.least(ratio, F.lit(100.0))))


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every n-gram, hash of its context, its word's place)."""
    text = np.frombuffer("".join([PAD * (ORDER - 1) + w + END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.array([len(w) + 1 for w in words], np.int64)
    at = np.arange(int(counts.sum())) + np.repeat((ORDER - 1) * np.arange(len(words)), counts)
    shift = np.uint64(21)
    pair = (text[:-1] << shift) | text[1:]
    three = (pair[:-1] << shift) | text[2:]  # three code points of 21 bits each
    head, tail = three[at], three[at + 3]
    return joint(head, tail), joint(head, tail >> shift | np.uint64(1 << 63)), np.repeat(np.arange(len(words)), counts)


def joint(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(head) * np.uint64(0x9E3779B97F4A7C15) + tail)


def piece_hashes(pieces: list[str], width: int) -> np.ndarray:
    """Of n-grams (width ORDER) or contexts (one less) the hash that gram_hashes gives them."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width).astype(np.uint64)
    shift = np.uint64(21)
    head, tail = (points[:, 0] << shift | points[:, 1]) << shift | points[:, 2], points[:, 3] << shift | points[:, 4]
    return joint(head, tail << shift | points[:, 5] if width == ORDER else tail | np.uint64(1 << 63))


def hashed(rows: DataFrame, width: int) -> DataFrame:
    """The rows with their first column, n-grams or contexts, replaced by its hash."""
    rest = rows.columns[1:]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(piece_hashes(b.column(0).to_pylist(), width).view(np.int64)), *b.columns[1:]], names=["h", *rest])

    return rows.mapInArrow(run, ", ".join(["h bigint", *(f"{c} double" for c in rest)]))


class Known:
    """Rows of values by 64-bit hash, found by the first HEAD_BITS of it."""

    def __init__(self, h: np.ndarray, values: np.ndarray):
        order = np.argsort(h)
        self.h, self.values = h[order], values[order]
        self.starts = np.searchsorted(self.h >> np.uint64(64 - HEAD_BITS), np.arange((1 << HEAD_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are known, the rows of these)."""
        head = (h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
        place, end, hit = self.starts[head], self.starts[head + 1], np.zeros(len(h), bool)
        left = np.flatnonzero(place < end)
        while len(left):
            same = self.h[place[left]] == h[left]
            hit[left[same]] = True
            left = left[~same]
            place[left] += 1
            left = left[place[left] < end[left]]
        at = np.flatnonzero(hit)
        return at, place[at]


class Shipped:
    """Ratios of the commonest n-grams and contexts by 64-bit hash, and a bitmap of the others; hashed in the cluster, so
    that only numbers come to the driver."""

    def __init__(self, tables: tuple[DataFrame, DataFrame]):
        self.known, rest, spent = [], [], []
        with batches_of(tables[0].sparkSession, HASHED_WORDS):
            for kind, df in enumerate(tables):
                name = df.columns[0]
                usual = written(df.orderBy(F.desc("times"), name).limit(COMMON_GRAMS))
                got = hashed(usual.select(name, *CELLS), ORDER - kind).toArrow()
                self.known.append(Known(got.column("h").to_numpy().view(np.uint64), np.column_stack([got.column(r).to_numpy() for r in CELLS])))
                if got.num_rows == COMMON_GRAMS:
                    rest.append(hashed(df.select(name).join(usual.select(name), name, "left_anti"), ORDER - kind))
                del got
                spent.append(usual)
            self.others = None
            if rest:
                others = written(rest[0] if len(rest) == 1 else rest[0].union(rest[1]))
                self.others = Bits.of(others, max(16, min(GRAM_BITS, math.ceil(math.log2(16 * max(1, others.count()))))))
                spent.append(others)
        release(*spent)

    def ratios(self, words: list[str], cells: tuple[str, ...]) -> np.ndarray:
        """(words x cells) sums of the n-grams' ratios, nan where a join must tell them."""
        gram, context, word = gram_hashes(words)
        columns = [list(CELLS).index(c) for c in cells]
        value, left = np.zeros((len(gram), len(cells))), np.arange(len(gram))
        for h, known in zip((gram, context), self.known, strict=True):
            at, row = known.find(h[left])
            value[left[at]] = known.values[row][:, columns]
            left = np.delete(left, at)
            if self.others is not None and len(left):  # as an n-gram, or else as a context
                elsewhere = self.others.has(h[left])
                value[left[elsewhere]] = np.nan
                left = left[~elsewhere]
        return np.add.reduceat(value, np.searchsorted(word, np.arange(len(words)))) if len(words) else value

    def places(self, cells: tuple[str, ...], shares: tuple[float, ...]) -> Places:
        """What this worker process knows of words so far; kept with the broadcast value from task to task."""
        kept = self.__dict__.setdefault("kept", {})
        if (cells, shares) not in kept:
            kept[cells, shares] = Places(self, cells, shares)
        return kept[cells, shares]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}


class Places(dict):
    """word -> its row of `values`: for each cell and share the mixture's log-likelihood ratio, nan if not told here.
    A word gets its row when it is first looked up, the row its values when `of` ends."""

    def __init__(self, shipped: Shipped, cells: tuple[str, ...], shares: tuple[float, ...]):
        self.shipped, self.cells, self.shares = shipped, cells, np.array(shares)
        self.values, self.new = np.zeros((0, len(cells) * len(shares))), []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def of(self, words: Iterable[str], n: int) -> np.ndarray:
        """The rows of n words."""
        if len(self) > TASK_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, n)
        new, self.new = self.new, []
        held = len(self) - len(new)
        if len(self) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(len(self) - len(self.values), len(self.values) // 2), self.values.shape[1]))])
        for k in range(0, len(new), HASHED_WORDS):
            part = new[k : k + HASHED_WORDS]
            ratio = np.minimum(self.shipped.ratios(part, self.cells), 100.0)
            self.values[held + k : held + k + len(part)] = np.log1p(self.shares * np.expm1(ratio)[:, :, None]).reshape(len(part), -1)
        return at


def told_words(rows: DataFrame, shipped: Shipped, cells: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """(key, cell, n, base, rest) of rows (key, cell, text): the number of words, for every share the sum of the mixture's
    log-likelihood ratios over the words told here, by the cell's counts; and the other words."""
    sent = rows.sparkSession.sparkContext.broadcast(shipped)

    def run(batches):
        places, m = sent.value.places(cells, shares), len(shares)
        for b in batches:
            n, base, rest = [], [], []
            cells_of, texts = b.column(1).to_pylist(), [t or "" for t in b.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            for lo, hi in slices(offsets, SPLIT_CHARACTERS):
                split = [WORD.findall(t.lower()) for t in texts[lo:hi]]
                ends = np.cumsum([len(words) for words in split])
                rows = places.of(itertools.chain.from_iterable(split), int(ends[-1]))
                for cell, words, end in zip(cells_of[lo:hi], split, ends.tolist(), strict=True):
                    values, left = places.values[rows[end - len(words) : end], cell * m : (cell + 1) * m], {}
                    unknown = np.isnan(values[:, 0])
                    if unknown.any():
                        left = Counter(words[k] for k in np.flatnonzero(unknown).tolist())
                        values = values[~unknown]
                    n.append(len(words))
                    base.append(values.sum(0).tolist())
                    rest.append([{"word": w, "times": k} for w, k in left.items()])
            kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(base, pa.list_(pa.float64())), pa.array(rest, kind)], names=["key", "cell", "n", "base", "rest"])

    key = rows.schema["key"].dataType.simpleString()
    out = written(rows.select("key", "cell", "text").mapInArrow(run, f"key {key}, cell int, n bigint, base array<double>, rest array<struct<word:string,times:bigint>>"))
    sent.destroy()
    return out


def whole(told: DataFrame, tables: tuple[DataFrame, DataFrame], cells: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """(key, mean) of told rows, one a key: for every share the mean log-likelihood ratio over all words, 0 without words."""
    tokens = told.select("key", "cell", F.explode("rest").alias("w")).select("key", "cell", "w.word", "w.times")
    ratio = F.element_at(F.array(*cells), F.col("cell") + 1)
    found = tokens.join(word_ratios(tokens.select("word").distinct(), tables, *cells), "word")
    more = found.groupBy("key").agg(F.array(*(F.sum(F.col("times") * mixture(ratio, s)) for s in shares)).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.zip_with("base", "more", lambda x, y: x + y))
    return told.join(more, "key", "left").select("key", F.transform(sums, lambda v: F.when(F.col("n") > 0, v / F.col("n")).otherwise(0.0)).alias("mean"))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's method, with a slight pull to slope 0."""
    scale = float(np.abs(x).mean()) or 1.0
    a, b, z = 0.0, 0.0, x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1e-2 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return a / scale, b


def held_out(id_col: Column) -> Column:
    """Whether a row's labels may not be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class ToxicityModel:
    """The fitted ratios, as tables and as what is shipped of them, and the curve."""

    def __init__(self, tables: tuple[DataFrame, DataFrame] | None, share: float, slope: float, intercept: float, shipped: Shipped | None = None):
        self.tables, self.share, self.slope, self.intercept, self.shipped = tables, share, slope, intercept, shipped

    def score(self, text: str | None) -> float:
        if self.tables is None:
            return 0.499
        one = self.tables[0].sparkSession.createDataFrame([(text,)], "text string")
        return toxicity_scores(one, self).first().score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """From the rows whose labels may be learnt; `labels` has the id and `toxic` (0 or 1)."""
    spark = docs.sparkSession
    narrow_batches(spark)
    told = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)).cast("int")
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(told), "id").withColumn("half", half)

    def words(batches):
        held = [Counter() for _ in range(4)]

        def emit():
            for c, of in enumerate(held):
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.string(), size=len(of)), pa.array(np.full(len(of), c, np.int32)), pa.array(of.values(), pa.int64(), size=len(of))], names=["word", "cell", "n"])
                    of.clear()

        for b in batches:
            for toxic, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[2 * toxic + h].update(WORD.findall((text or "").lower()))
                if sum(map(len, held)) > TASK_WORDS:
                    yield from emit()
        yield from emit()

    def pieces(batches):
        for b in batches:
            out: dict[str, list[int]] = {}
            for word, *n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for g in grams(word):
                    got = out.setdefault(g, [0, 0, 0, 0])
                    for k in range(4):
                        got[k] += n[k]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *(pa.array([v[k] for v in out.values()], pa.int64()) for k in range(4))], names=["gram", "c0", "c1", "c2", "c3"])

    sums = lambda: [F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]
    by_word = train.select("toxic", "half", "text").mapInArrow(words, "word string, cell int, n bigint")
    by_word = written(by_word.groupBy("word").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(4)]))
    by_gram = by_word.mapInArrow(pieces, "gram string, c0 bigint, c1 bigint, c2 bigint, c3 bigint").groupBy("gram").agg(*sums())
    by_gram = written(by_gram)
    release(by_word)
    total = by_gram.agg(F.sum(F.expr("c0 + c1")), F.sum(F.expr("c2 + c3"))).first()
    if not total[0] or not total[1]:
        return ToxicityModel(None, 0.0, 0.0, 0.0)
    tables = ratio_tables(by_gram)
    release(by_gram)
    shipped = Shipped(tables)

    rows = told.count()
    part = train.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(max(1, -(-rows // CURVE_ROWS)))) == 0)
    # a half's texts are scored by the other half's counts
    part = part.select(F.struct(F.monotonically_increasing_id().alias("row"), "toxic").alias("key"), F.col("half").alias("cell"), "text")
    sample = told_words(part, shipped, ("r0", "r1"), SHARES)
    points = whole(sample, tables, ("r0", "r1"), SHARES).select("key.toxic", F.col("mean").alias("x")).toArrow()
    release(sample)
    y = points.column("toxic").to_numpy().astype(float)
    x = np.array(points.column("x").to_pylist(), float).reshape(len(y), len(SHARES))
    curves = [fit_curve(x[:, k], y) for k in range(len(SHARES))]
    loss = [float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a * x[:, k] + b)).sum()) for k, (a, b) in enumerate(curves)]
    best = int(np.argmin(loss))
    return ToxicityModel(tables, SHARES[best], *curves[best], shipped)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with `score`, by the text alone (a column `score` of theirs is replaced)."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"))
    if model.tables is None:
        return rows.withColumn("score", F.lit(model.score(None)))
    key = fresh(rows, "text_digest")
    scores = text_scores(rows.select(F.col(text_col).alias("text")), model).toDF(key, "score")
    return rows.withColumn(key, text_digest(F.col(text_col))).join(small(scores), key).drop(key)


def tolerated(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""
    if model.tables is None:
        return docs
    narrow_batches(docs.sparkSession)
    key = fresh(docs, "text_digest")
    scores = text_scores(docs.select(F.col(text_col).alias("text")), model)
    rejected = written(scores.where("score >= 0.5").select(F.col("key").alias(key)))
    release(scores)
    return docs.withColumn(key, text_digest(F.col(text_col))).join(small(rejected), key, "left_anti").select(*docs.columns)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def text_scores(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """(key, score) of every distinct text, by its digest; `texts` has one column, and the model was fitted."""
    told = told_words(texts.select(text_digest(F.col("text")).alias("key"), F.lit(0).alias("cell"), "text"), model.shipped, ("r",), (model.share,))
    mean = whole(told.dropDuplicates(["key"]), model.tables, ("r",), (model.share,))
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), model.slope * F.col("mean")[0] + model.intercept))
    out = written(mean.select("key", (1 / (1 + F.exp(-power))).alias("score")))
    release(told)
    return out
