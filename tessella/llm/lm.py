"""Language-model scoring with a hashed maximum-entropy model.

The probability of a token is that of its class after its context times that of the token in its class.
The most frequent words have classes of their own, and the others share classes by the hash of their last
two bytes; the number of classes grows with the root of the number of distinct words, from ``LEAST_CLASSES``
to ``CLASSES``.  Class probabilities are a softmax over weights of hashed features: the class of the previous
word, that of the word before it (a skip), and both together.  In a class a token has its smoothed relative
frequency.  All training text is counted: tokens, and classes by context, a sparse table that grows with the
text towards all triples of classes.  It is what the gradient depends on, so every update is a distributed
pass over it.  The logarithm of each context's sum is computed once, so that a token's score is a few look-ups.

Counts of the ``HOT`` most frequent words are broadcast; other words are resolved by a join.

A null text is an empty one and has only its end.  A null key counts as an empty string in the split.
Equal rows are scored alike.  Without training rows every token has probability 1 in the base and the
model's classes are uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import slim, staged

#: Words in the broadcast table (17 bytes each).
HOT = 1_000_000
LEAST_CLASSES, CLASSES, SUFFIXES = 64, 512, 256
#: Contexts are classes; rows of hashed pairs of them are so many for each class.
BUCKETS, PAIRS_EACH = CLASSES, 4
PAIRS = PAIRS_EACH * CLASSES
STEPS, RATE, PRIOR = 16, 0.2, 1e-6
#: Partitions of the context table at least, rows of one, and contexts whose probabilities are held at a time.
PARTS, PART_ROWS, BLOCK = 12, 2_000_000, 4096


def split_of(key: Column, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the last two bytes of words."""
    last = data[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (_text.mix(last * np.uint64(257) + before) % np.uint64(SUFFIXES)).astype(np.int16)


def classes_for(distinct: int) -> int:
    """The power of two next to the root of the number of distinct words, within bounds."""
    return int(min(CLASSES, max(LEAST_CLASSES, 1 << round(math.log2(max(distinct, 1)) / 2))))


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in _text.slices(batch, "t"):
        data, hashes, starts, ends, bounds = _text.words(part.column("t"))
        yield part, hashes, suffixes(data, starts, ends) if len(hashes) else np.zeros(0, np.int16), bounds


def token_counts(docs: DataFrame) -> DataFrame:
    """w, c, suffix of every distinct word hash.  Each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, c, s = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, back = np.unique(w, return_index=True, return_inverse=True)
            return u, np.bincount(back, weights=c).astype(np.int64), s[at]

        def out(u, c, s) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(s)], ["w", "c", "s"])

        for batch in batches:
            for _, hashes, suffix, _ in _words_of(batch):
                u, at, c = np.unique(hashes, return_index=True, return_counts=True)
                held.append((u, c, suffix[at]))
                size += len(u)
                if size > 3_000_000:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())

    return docs.mapInArrow(run, "w long, c long, s smallint").groupBy("w").agg(F.sum("c").alias("c"), F.first("s").alias("s"))


class Vocabulary:
    """Counts of the hot words and the classes of words: 0 is the end, then come own words, then suffixes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, suffix: np.ndarray, by_suffix: np.ndarray, ends: int, total: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.classes = classes_for(distinct)
        self.shared = self.classes // 2
        self.own = self.classes - self.shared - 1
        top = np.lexsort((words, -counts))[: self.own]
        by_hash = np.argsort(words[top])
        self.frequent = words[top][by_hash]
        self.rank = np.arange(len(top))[by_hash]
        self.ends, self.total, self.distinct = ends, total, distinct
        #: tokens and types of each class
        tokens, types = np.zeros(self.classes), np.zeros(self.classes)
        tokens[0], types[0] = ends, ends > 0
        shared = 1 + self.own + np.arange(SUFFIXES) % self.shared
        np.add.at(tokens, shared, by_suffix[:, 0])
        np.add.at(types, shared, by_suffix[:, 1])
        for r, i in enumerate(top):
            tokens[1 + r], types[1 + r] = counts[i], 1
            tokens[shared[suffix[i]]] -= counts[i]
            types[shared[suffix[i]]] -= 1
        self.log_class_size = np.log10(tokens + types + 1)
        self.log_base = math.log10(total + distinct + 1)

    def place(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Classes of words."""
        cls = 1 + self.own + suffix.astype(np.int32) % self.shared
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            hit = self.frequent[at] == hashes
            cls[hit] = 1 + self.rank[at][hit]
        return cls

    def tokens(self, hashes: np.ndarray, suffix: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, class, document, word number or -1) of every token, ends included; 0 stands before a text."""
        docs = len(bounds) - 1
        n = len(hashes) + docs
        word = np.full(n, -1)
        where = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(bounds))
        word[where] = np.arange(len(hashes))
        k = np.zeros(n, np.int32)
        k[where] = self.place(hashes, suffix)
        first = bounds[:-1] + np.arange(docs)
        one, two = np.zeros(n, np.int32), np.zeros(n, np.int32)
        one[1:], two[2:] = k[:-1], k[:-2]
        one[first] = 0
        two[first] = 0
        two[np.minimum(first + 1, n - 1)] = 0
        return two * self.classes + one, k, np.repeat(np.arange(docs), np.diff(bounds) + 1), word

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words; -1 where a word is not hot."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        u, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
        return np.where(self.words[at] == u, self.counts[at], -1)[back]


def vocabulary(counts: DataFrame, ends: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of its hot words."""
    sums = counts.groupBy("s").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * 0).alias("z")).collect()
    classes = np.zeros((SUFFIXES, 2))
    for r in sums:
        classes[r.s] = r.c, r.n
    levels = {r.b: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, n = max(levels, default=0) + 1, 0
    while least > 0 and n + levels.get(least - 1, 0) <= HOT:
        least -= 1
        n += levels.get(least, 0)
    hot = counts.where(F.col("c") >= (1 << least)).toArrow()
    arrays = [hot.column(c).to_numpy() for c in ("w", "c", "s")]
    total, distinct = int(classes[:, 0].sum()) + ends, int(classes[:, 1].sum()) + (ends > 0)
    return Vocabulary(arrays[0].view(np.uint64), arrays[1], arrays[2], classes, ends, total, distinct), 1 << least


def contexts(docs: DataFrame, shared) -> DataFrame:
    """ctx, cls, n: for each pair of classes the counts of the classes that follow.  Each task sums before the shuffle.

    Rows are dealt by the hashed pair, so that a partition has all of what changes that pair's weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cells, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(cells, kind="stable")
            cells, n = cells[order], n[order]
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            return cells[first], np.add.reduceat(n, first)

        def out(cells: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(cells), 250_000):
                c = cells[i : i + 250_000]
                ctx = c // v.classes
                both = rows_of(ctx, v.classes, PAIRS_EACH * v.classes)[2].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(ctx), pa.array(c % v.classes), pa.array(n[i : i + 250_000])], ["both", "ctx", "cls", "n"])

        for batch in batches:
            for _, hashes, suffix, bounds in _words_of(batch):
                ctx, cls, _, _ = v.tokens(hashes, suffix, bounds)
                cells, n = np.unique(ctx * np.int32(v.classes) + cls, return_counts=True)
                held.append((cells, n))
                size += len(cells)
                if size > 4_000_000:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield from out(*held.pop())
                        size = 0
        if held:
            yield from out(*merged())

    cells = docs.mapInArrow(run, "both int, ctx int, cls int, n long")
    return cells.repartition("both").groupBy("both", "ctx", "cls").agg(F.sum("n").alias("n")).drop("both")  # one shuffle


def rows_of(ctx: np.ndarray, classes: int, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight rows of the features of contexts: previous class, skip, both hashed; row 0 is common."""
    ctx = ctx.astype(np.int64)
    both = (_text.mix(ctx.astype(np.uint64) + np.uint64(1)) % np.uint64(pairs)).astype(np.int64)
    return 1 + ctx % classes, 1 + classes + ctx // classes, 1 + 2 * classes + both


def _logits(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    classes = weights.shape[1]
    return weights[0] + sum(weights[r] for r in rows_of(ctx, classes, len(weights) - 1 - 2 * classes))


def log_sums(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Of each context the logarithm of the sum that makes its probabilities add up to 1."""
    z = _logits(weights, ctx)
    most = z.max(1)
    return most + np.log(np.exp(z - most[:, None]).sum(1))


def log_softmax(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    z = _logits(weights, ctx)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def log_probability(weights: np.ndarray, sums: np.ndarray, ctx: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Of one class in each context, from the sums of all contexts."""
    classes = weights.shape[1]
    z = weights[0][cls] + sum(weights[r, cls] for r in rows_of(ctx, classes, len(weights) - 1 - 2 * classes))
    return z - sums[ctx]


def gradient(weights: np.ndarray, ctx: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """Of the log-likelihood of some cells, with the tokens they hold; cells may be split among calls."""
    classes = weights.shape[1]
    order = np.argsort(ctx, kind="stable")
    ctx, cls, n = ctx[order], cls[order], n[order]
    first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
    ends = np.append(first, len(ctx))
    grad = np.zeros(weights.shape, np.float32)
    for low in range(0, len(first), BLOCK):
        high = min(low + BLOCK, len(first))
        a, b = ends[low], ends[high]
        cells = ctx[first[low:high]]
        part = np.zeros((high - low, classes), np.float32)
        part[np.repeat(np.arange(high - low), np.diff(ends[low : high + 1])), cls[a:b]] = n[a:b]
        part -= part.sum(1, keepdims=True) * np.exp(log_softmax(weights, cells))
        grad[0] += part.sum(0)
        for rows in rows_of(cells, classes, len(weights) - 1 - 2 * classes):
            by = np.argsort(rows, kind="stable")
            of, at = np.unique(rows[by], return_index=True)
            grad[of] += np.add.reduceat(part[by], at, axis=0)
    return grad, int(n.sum())


def train(table: DataFrame, prior: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights by gradient updates over the context table; each update is one distributed pass.

    They begin at the classes' own log sizes.
    """
    spark, classes = table.sparkSession, len(prior)
    table = table.coalesce(max(PARTS, -(-table.count() // PART_ROWS)))
    shape = (1 + (2 + PAIRS_EACH) * classes, classes)
    weights, first, second = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    weights[0] = prior

    def pass_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]  # about PART_ROWS rows of 16 bytes
            if held:
                t = pa.Table.from_batches(held)
                grad, n = gradient(shared.value, *(t.column(c).to_numpy() for c in ("ctx", "cls", "n")))
                rows = np.flatnonzero(grad.any(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([grad[rows].tobytes()], pa.binary()), pa.array([n], pa.int64())], ["rows", "g", "n"])

        return run

    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(weights)
        grad, n = np.zeros(shape, np.float32), 0
        for row in table.mapInArrow(pass_with(shared), "rows binary, g binary, n long").collect():  # one for each partition
            grad[np.frombuffer(row.rows, np.int32)] += np.frombuffer(row.g, np.float32).reshape(-1, classes)
            n += row.n
        shared.destroy()
        if not n:
            break
        grad = grad / n - PRIOR * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        weights = (weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return weights


def sums_of(spark, shared, classes: int) -> np.ndarray:
    """``log_sums`` of every context, computed by parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i in range(0, len(ids), BLOCK):
                some = ids[i : i + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(log_sums(shared.value, some).astype(np.float32))], ["ctx", "z"])

    found = spark.range(classes * classes, numPartitions=PARTS).mapInArrow(run, "ctx long, z float").toArrow()  # CLASSES squared numbers at most
    out = np.zeros(classes * classes, np.float32)
    out[found.column("ctx").to_numpy()] = found.column("z").to_numpy()
    return out


def fit(learn: DataFrame) -> tuple:
    """Of training texts (t), broadcast: the vocabulary, and weights with every context's sum; and all counts, and the least of the hot words."""
    spark = learn.sparkSession
    counts = staged(token_counts(learn), "counts")
    vocab, least = vocabulary(counts, learn.count())
    shared = spark.sparkContext.broadcast(vocab)
    classes, prior = vocab.classes, vocab.log_class_size * math.log(10)
    del vocab
    weights = train(staged(contexts(learn, shared), "contexts"), prior)
    sent = spark.sparkContext.broadcast(weights)
    sums = sums_of(spark, sent, classes)
    sent.destroy()
    return shared, spark.sparkContext.broadcast((weights, sums)), counts, least


def score(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t"), (split_of(F.col(key), folds) == held).alias("held_out"))
    shared, model, counts, least = fit(docs.where("NOT held_out").select("t"))
    total, log_base = shared.value.total, shared.value.log_base
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "held_out", "n_tokens", "n_known", "log_counts", "log_rest", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (weights, sums) = shared.value, model.value
        for batch in batches:
            for part, hashes, suffix, bounds in _words_of(batch):
                ctx, cls, doc, word = v.tokens(hashes, suffix, bounds)
                c = np.full(len(word), v.ends)
                c[word >= 0] = v.find(hashes)
                n = part.num_rows
                hot = c > 0
                rest = np.bincount(doc, weights=log_probability(weights, sums, ctx, cls) / math.log(10) - v.log_class_size[cls], minlength=n)
                logs = np.bincount(doc[hot], weights=np.log10(c[hot] + 1.0), minlength=n)
                unknown = c < 0
                rare = hashes[word[unknown]].view(np.int64) if least > 1 else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[unknown], minlength=n))]) if least > 1 else np.zeros(n + 1)
                arrays = [pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[hot], minlength=n)), pa.array(logs), pa.array(rest), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rare))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("held_out"), *arrays], names)

    rows = docs.mapInArrow(run, f"k {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, log_rest double, rare array<long>")
    if least > 1:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
        seen = rows.select("row", F.explode("rare").alias("w")).groupBy("row", "w").count()
        found = seen.join(counts.where(F.col("c") < least).select("w", "c"), "w")
        found = found.groupBy("row").agg(F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("count").alias("more_known"))
        rows = rows.drop("rare").join(found, "row", "left")
        rows = rows.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("log_counts", F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0)))
    return rows.select(
        F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * log_base).alias("base_score"), (F.col("log_counts") + F.col("log_rest")).alias("score"),
    )
