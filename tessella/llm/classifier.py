"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text gives ``STATISTICS``, shares and sizes that no label, language, source or key is part of.  They are centred
and scaled by the training rows, and ``FEATURES`` random cosines of them approximate a Gaussian kernel.  The normal
equations of a ridge regression are sums over partitions, kept by fold; the equations of all folds but one give
scores for that fold, which choose the penalty and fit the isotonic curve on rows their weights have not seen.
The curve, over a histogram of these scores, makes the probabilities; all folds give the final weights.

Training takes at most ``LABELLED_ROWS`` labelled rows, those of least hash, whose key has another checksum
remainder than the held-out one.  Every document is scored, in one pass without a shuffle.

A null text is an empty one and is scored like it.  Labels that are null do not count; of several labels of a
key the least holds.  Repeated documents train once each and score alike.  A null key is not held out.  With
labels of one value only, all scores are that value; without any, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import slim

#: Bound of the labelled rows that train.
LABELLED_ROWS = 100_000
FEATURES, FOLDS, BINS = 256, 5, 2000
#: Width of the kernel as a share of the root of the number of statistics.
WIDTH = 1.0
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
#: Rows that give one partition's sums.
PART_ROWS = 10_000
HELD_OUT, REMAINDERS, LIMIT = 2, 4, 0.7
#: Words of the stretches whose largest shares are statistics as well, so that a bad part of a good text shows.
STRETCH = 16
STATISTICS = (
    "words", "word_chars", "word_spread", "upper", "symbols", "marks", "digits", "other_bytes", "symbol_words", "capital_words", "single_marks", "same_as_last", "repeated_words",
    "new_words", "lines", "repeated_lines", "most_symbols", "most_capitals", "most_same", "most_marks",
)
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "#*$%&|<>", "!\"'()+,-./:;=?@[\\]^_`{}~", "0123456789"), 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_CLASS[128:192], _CLASS[192:] = 6, 7


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of every text of a column, a row each."""
    n = len(column)
    data, hashes, starts, ends, bounds = _text.words(column, lower=False)
    kinds = _CLASS[data]
    per_word = np.zeros((len(starts), 8), np.int64)  # bytes of each class
    sums = np.zeros(len(data) + 1, np.int64)
    for c in range(1, 8):
        np.cumsum(kinds == c, out=sums[1:])
        per_word[:, c] = sums[ends] - sums[starts]
    chars = (ends - starts) - per_word[:, 6]
    doc = np.repeat(np.arange(n), np.diff(bounds))
    first = np.zeros(len(starts), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    symbol = per_word[:, 3] > 0
    capital = (per_word[:, 1] >= 2) & (per_word[:, 2] == 0)
    alone = (per_word[:, 1] + per_word[:, 2] + per_word[:, 5] + per_word[:, 7] == 0)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~first[1:]
    marks = per_word[:, 4]

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n)

    words = np.diff(bounds).astype(float)
    w = np.maximum(words, 1)
    mean = total(chars) / w
    letters = np.maximum(total(chars), 1)
    new, again = np.zeros(n), np.zeros(n)
    lines, repeated = np.zeros(n), np.zeros(n)
    new_line = data == 10
    breaks = np.concatenate([[0], np.cumsum(new_line)])
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            continue
        own = hashes[a:b]
        new[i] = len(np.unique(own)) / (b - a)
        if b - a > 2:
            with np.errstate(over="ignore"):
                grams = _text.mix(own[:-2] * np.uint64(3) + _text.mix(own[1:-1] * np.uint64(5) + _text.mix(own[2:])))
            _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(counts[back] > 1)
            if len(twice):
                covered = np.zeros(b - a, bool)
                for k in range(3):
                    covered[twice + k] = True
                again[i] = covered.sum() / (b - a)
        line = breaks[starts[a:b]]
        at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(_text.mix(own + np.arange(b - a).astype(np.uint64) - np.repeat(at, np.diff(np.append(at, b - a))).astype(np.uint64)), at)
        lines[i], repeated[i] = len(at), len(at) - len(np.unique(whole))
    stretch = (np.arange(len(starts)) - bounds[doc]) // STRETCH if len(starts) else np.zeros(0, np.int64)
    begins = np.flatnonzero(first | np.concatenate([[True], stretch[1:] != stretch[:-1]])) if len(starts) else np.zeros(0, np.int64)

    def most(x: np.ndarray) -> np.ndarray:
        """The largest share of a stretch, of each text."""
        out = np.zeros(n)
        if len(begins):
            np.maximum.at(out, doc[begins], np.add.reduceat(x.astype(float), begins) / STRETCH)
        return out

    stats = (
        np.log1p(words), np.minimum(mean, 40), np.minimum(np.sqrt(np.maximum(total(chars.astype(float) ** 2) / w - mean**2, 0)), 40), total(per_word[:, 1]) / letters, np.minimum(total(per_word[:, 3]) / w, 4), np.minimum(total(marks) / w, 4),
        total(per_word[:, 5]) / letters, total(per_word[:, 7]) / letters, total(symbol) / w, total(capital) / w, total(alone) / w, total(same) / w, again,
        new, np.log1p(lines), repeated / np.maximum(lines, 1), most(symbol), most(capital), most(same), np.minimum(most(marks), 4),
    )
    return np.column_stack(stats)


@dataclass
class Classifier:
    """Centre and scale of statistics, random cosines, ridge weights, and the calibration curve."""

    centre: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.turns + self.shifts)])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.x, self.y)


def constant(value: float) -> Classifier:
    d = len(STATISTICS)
    return Classifier(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([value]))


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % REMAINDERS


def isotonic(values: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: rising means of ``targets`` and the weighted middle of ``values`` of each pool."""
    pools: list[list[float]] = []
    for v, w, t in zip(values, weights, targets, strict=True):
        pools.append([w, w * v, w * t])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


def ridge(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of the normal equations, the intercept without a penalty."""
    extra = np.eye(len(b)) * penalty * a[0, 0] / len(b)
    extra[0, 0] = 1e-9
    return np.linalg.solve(a + extra, b)


def measured(df: DataFrame, text: str, carried: list[Column], kinds: str) -> DataFrame:
    """``carried`` columns and ``s``, the statistics of every text."""
    names = [f"c{i}" for i in range(len(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in _text.slices(batch, "t")):
            found = statistics(part.column("t"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(STATISTICS)), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "s"])

    return slim(df).select(*(c.alias(n) for c, n in zip(carried, names, strict=True)), F.col(text).alias("t")).mapInArrow(run, f"{kinds}, s array<double>")


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", rows: int = LABELLED_ROWS, seed: int = 23) -> Classifier:
    """The classifier of a bounded sample of labelled rows.  What comes to the driver are sums by fold and a histogram."""
    own = labels.select(F.col(label_key).alias("k"), F.col(label).cast("double").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.min("y").alias("y"))
    own = own.where(remainder(F.col("k")) != HELD_OUT).orderBy(F.xxhash64("k"), "k").limit(rows)
    drawn = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(own), "k")  # bounded by rows
    fold = F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(FOLDS)).cast("int")
    stats = measured(drawn, "t", [fold, F.col("y")], "c0 int, c1 double").persist()
    try:
        return _fitted(stats, seed)
    finally:
        stats.unpersist()


def _fitted(stats: DataFrame, seed: int) -> Classifier:
    d = len(STATISTICS)
    sums = stats.agg(F.count(F.lit(1)), F.avg("c1"), F.min("c1"), F.max("c1"), *(f(F.col("s")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    n, mean, least, most = sums[:4]
    if not n:
        return constant(0.5)
    if least == most:
        return constant(min(max(mean, 0.0), 1.0))
    centre, scale = np.array(sums[4::2]), np.array(sums[5::2])
    rng = np.random.default_rng(seed)
    model = Classifier(centre, np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return batch.column("c0").to_numpy(), batch.column("c1").to_numpy(), model.features(s)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        squares = np.zeros(FOLDS)
        for batch in batches:
            fold, y, x = columns(batch)
            for f in np.unique(fold):
                at = fold == f
                total[f, :, :size] += x[at].T @ x[at]
                total[f, :, size] += x[at].T @ y[at]
                squares[f] += (y[at] ** 2).sum()
        for f in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([squares[f]]), pa.array([total[f].ravel()], pa.list_(pa.float64()))], ["fold", "q", "m"])

    def added(table: pa.Table) -> pa.Table:
        m = np.sum([x.as_py() for x in table.column("m")], axis=0)
        return pa.table({"fold": table.column("fold").slice(0, 1), "q": [sum(table.column("q").to_pylist())], "m": pa.array([m], pa.list_(pa.float64()))})

    parts = max(1, min(-(-LABELLED_ROWS // PART_ROWS), -(-n // PART_ROWS)))
    dealt = stats.coalesce(parts)  # each gives the equations of all folds, so that few are to be added
    by_fold = dealt.select("c0", "c1", "s").mapInArrow(equations, "fold int, q double, m array<double>").groupBy("fold").applyInArrow(added, "fold int, q double, m array<double>").collect()  # FOLDS rows
    a, b, q = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS)
    for r in by_fold:
        m = np.array(r.m).reshape(size, size + 1)
        a[r.fold], b[r.fold], q[r.fold] = m[:, :size], m[:, size], r.q
    used = [f for f in range(FOLDS) if a[f, 0, 0] > 0]

    def others(penalty: float) -> np.ndarray:
        return np.array([ridge(a.sum(0) - a[f], b.sum(0) - b[f], penalty) if len(used) > 1 else ridge(a.sum(0), b.sum(0), penalty) for f in range(FOLDS)])

    def loss(w: np.ndarray) -> float:
        return sum(q[f] - 2 * w[f] @ b[f] + w[f] @ a[f] @ w[f] for f in used)

    unseen, penalty = min(((others(p), p) for p in PENALTIES), key=lambda x: loss(x[0]))
    model.weights = ridge(a.sum(0), b.sum(0), penalty)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y, x = columns(batch)
            found = (x * unseen[fold]).sum(1)
            at = np.clip(np.floor((found + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found), pa.array(y)], ["bin", "v", "y"])

    bins = stats.select("c0", "c1", "s").mapInArrow(histogram, "bin long, v double, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.avg("y").alias("y")).orderBy("bin").collect()  # BINS rows
    model.x, model.y = isotonic(np.array([r.v for r in bins]), np.array([r.n for r in bins], float), np.array([r.y for r in bins]))
    model.y = np.clip(model.y, 0, 1)
    return model


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: float = LIMIT) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    model = train(df, labels, key, text, label=label)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in _text.slices(batch, "t")):
            score = np.clip(model.score(statistics(part.column("t"))), 0, 1)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(score)], ["k", "score"])

    scored = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double")
    return scored.select(F.col("k").alias(key), (remainder(F.col("k")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
