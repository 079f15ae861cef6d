"""Quality rules: counts of whole texts, and an isolation forest on statistics made of them.

The forest's trees are random splits of small bounded draws from labelled good rows, so a document that
few splits set apart from the rest (a short path) is unlike them.  The score above which a document
goes is calibrated on labelled rows as well: the lowest score that rejects at most ``FALSE_REJECTS`` of
the good ones.  The labelled rows used are at most ``LABELLED_ROWS``, those with the smallest hash.

A null text has no words.  Equal rows are judged alike.  Without labelled rows only the base decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import slim

#: Bound of the labelled rows that fit the forest and its threshold.
LABELLED_ROWS = 6000
TREES, DRAW = 150, 256
#: Share of good labelled rows that the threshold may reject.
FALSE_REJECTS = 0.002
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SPACES = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("symbols", "upper", "marks", "repeats", "word_length")
#: Least distance by which a split may lie outside the rows it divides, for each of STATISTICS: a rule
#: that no good row breaks still gets splits, and rows beyond them are set apart.
TOLERANCE = (0.1, 0.2, 0.1, 0.3, 4.0)


def counts_of(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and STATISTICS of a text."""
    raw = text.encode()
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = _WORD.findall(text)
    n = len(words)
    word_chars = len(text) - int(bins[_SPACES].sum())
    symbols = int(bins[_SYMBOLS].sum())
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    w, c = max(n, 1), max(word_chars, 1)
    statistics = (
        min(symbols / w, 2.0), int(bins[65:91].sum()) / c, int(bins[33:48].sum() - bins[_SYMBOLS].sum() + bins[[60, 62, 124]].sum()) / c,
        repeats / w, min(word_chars / w, 40.0),
    )
    return (n, word_chars, symbols, dup_lines, repeats), statistics


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    again = np.fromiter((seen[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(grams)] |= again
    return int(covered.sum())


@dataclass
class Forest:
    """Random trees as arrays: split feature (-1 at a leaf), split value, first child, path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    usual: float
    threshold: float = 1.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus (mean path length / usual path length): near 1 is anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, child, path in zip(self.feature, self.value, self.child, self.path, strict=True):
            at = np.zeros(len(rows), np.int64)
            live = every
            while len(live):
                here = at[live]
                split = feature[here] >= 0
                live, here = live[split], here[split]
                at[live] = child[here] + (rows[live, feature[here]] >= value[here])
            total += path[at]
        return np.exp2(-total / len(self.feature) / self.usual)


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int = 7, trees: int = TREES, draw: int = DRAW, tolerance: tuple[float, ...] = TOLERANCE) -> Forest:
    """A forest on a sample of rows.

    Splits are drawn from the range of the rows widened on both sides by a tenth or the tolerance, so that
    values beyond all that was seen are set apart too.
    """
    rng = np.random.default_rng(seed)
    draw = min(draw, len(rows))
    limit = int(np.ceil(np.log2(max(draw, 2)))) + 4
    size = 4 * draw * limit + 1
    out = [np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size))]
    max_used = 1
    for t in range(trees):
        feature, value, child, path = (x[t] for x in out)
        todo, used = [(0, rows[rng.choice(len(rows), draw, replace=False)], 0)], 1
        while todo:
            at, part, depth = todo.pop()
            if depth >= limit or len(part) < 2:
                path[at] = depth + _usual(len(part))
                continue
            f = rng.integers(part.shape[1])
            low, high = part[:, f].min(), part[:, f].max()
            edge = max(0.1 * (high - low), tolerance[f])
            v = rng.uniform(low - edge, high + edge)
            right = part[:, f] >= v
            feature[at], value[at], child[at] = f, v, used
            for k, side in enumerate((part[~right], part[right])):
                if len(side):
                    todo.append((used + k, side, depth + 1))
                else:
                    path[used + k] = depth + 1
            used += 2
        max_used = max(max_used, used)
    size = max_used
    return Forest(out[0][:, :size].astype(np.int8), out[1][:, :size].copy(), out[2][:, :size].astype(np.int32), out[3][:, :size].astype(np.float32), usual=_usual(draw))


def calibrate(forest: Forest, rows: np.ndarray, good: np.ndarray, false_rejects: float = FALSE_REJECTS) -> Forest:
    """Set the threshold between the good rows and, where they lie apart, the bad ones."""
    scores = forest.score(rows)
    fine, bad = np.sort(scores[good]), np.sort(scores[~good])
    if not len(fine):
        return forest
    least = fine[min(len(fine) - 1, int(np.ceil((1 - false_rejects) * len(fine))))]
    above = bad[bad > least]
    forest.threshold = float((least + above[0]) / 2) if len(above) else float(least)
    return forest


def _measured(df: DataFrame, key: str, text: str, forest: Forest | None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    names = [*COUNTS, *(STATISTICS if forest is None else ("score",))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _text.slices(whole, "t")):
            found = [counts_of(t or "") for t in batch.column("t").to_pylist()]
            if not found:
                continue
            counts = np.array([c for c, _ in found], np.int64)
            stats = np.array([s for _, s in found], float)
            columns = [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            columns += [pa.array(stats[:, i]) for i in range(len(STATISTICS))] if forest is None else [pa.array(forest.score(stats))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], ["k", *names])

    schema = f"k {kind}, " + ", ".join(f"{n} {'long' if n in COUNTS else 'double'}" for n in names)
    return slim(df).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = LABELLED_ROWS) -> Forest | None:
    """The forest of a bounded sample of labelled rows; None without good ones."""
    drawn = labels.select(F.col(key).alias("k"), F.col(label).alias("q")).where("k IS NOT NULL AND q IS NOT NULL").groupBy("k").agg(F.min("q").alias("q"))
    drawn = drawn.orderBy(F.xxhash64("k"), "k").limit(rows)
    some = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn), "k")  # bounded by rows
    found = _measured(some.select("k", "t"), "k", "t", None).dropDuplicates(["k"]).join(F.broadcast(drawn), "k").where(base_ok()).orderBy("k").toPandas()
    good = found["q"].to_numpy(bool)
    stats = found[list(STATISTICS)].to_numpy(float)
    if good.sum() < 2:
        return None
    return calibrate(grow(stats[good]), stats, good)


def base_ok():
    return (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))


def judge_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, COUNTS, base_failed, kept, score of every row.  No shuffle of texts."""
    forest = fit(df, labels, key, text, label)
    judged = _measured(df, key, text, forest or Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), np.int64), np.ones((1, 1)), 1.0))
    limit = forest.threshold if forest else 1.0
    return judged.select(F.col("k").alias(key), *COUNTS, (~base_ok()).alias("base_failed"), (base_ok() & (F.col("score") <= limit)).alias("kept"), "score")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``df`` that the base and the forest keep.  No shuffle."""
    forest, at = fit(df, labels, key, text, label), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _text.slices(whole, text)):
            found = [counts_of(t or "") for t in batch.column(at).to_pylist()]
            good = np.array([c[0] >= 50 and 100 * c[4] <= 50 * c[0] for c, _ in found], bool)
            if forest and len(found):
                good &= forest.score(np.array([s for _, s in found])) <= forest.threshold
            yield batch.filter(pa.array(good))

    return slim(df).mapInArrow(run, df.schema)
