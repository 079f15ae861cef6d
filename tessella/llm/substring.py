"""Substring dedup by hashing lines and parts of long lines.

A unit is a line, or in a line of more than ``LONG`` words a stretch between words that have the least
hash of some ``WINDOW`` words in a row.  Such borders move with the text, and windows within a passage choose
the same in every line that holds it, so of L words at least L - 4 WINDOW + 3 are in shared whole units: a
passage of over 50 words inside long lines always has ``LEAST``.  Units are normalised (A-Z lowered, white space ignored) and digested.  Digests are grouped over
all documents; the occurrence with the lowest rank is kept, and every run of consecutive later
occurrences is a repeat, given by its offsets in the original text, if it has ``LEAST`` words from long
lines or twice as many in all, so that a few short lines that many texts share don't make one.

The rank is the key, then the place in the text; null keys come first.  Among rows of equal keys the
order is that of the rows read.  A null or empty text has no units.  Digests have 64 bits; a repeat has
several of them in a row or a whole line of ``LEAST`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import fresh, slim, staged

LONG, WINDOW, LEAST = 16, 8, 20
#: Digests whose units are spread at most (some tens of bytes each), units of one in a slice of text that
#: make it one of them, and parts over which their units are dealt.
HOT, OFTEN, SPREAD = 20_000, 8, 1024


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end, words, document, is of a long line) of every unit; starts and ends are code points."""
    data, hashes, starts, ends, bounds = _text.words(column)
    n = len(hashes)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none.astype(bool)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    line = np.cumsum(data == 10)[starts]
    border = np.ones(n, bool)
    border[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    of_line = np.cumsum(border) - 1
    long = np.bincount(of_line)[of_line] > LONG
    if n >= WINDOW:
        inside = np.flatnonzero(long[: n - WINDOW + 1] & (of_line[: n - WINDOW + 1] == of_line[WINDOW - 1 :]))
        least = np.lib.stride_tricks.sliding_window_view(_text.mix(hashes), WINDOW)
        for i in range(0, len(inside), 100_000):
            some = inside[i : i + 100_000]
            border[some + least[some].argmin(1)] = True
    first = np.flatnonzero(border)
    sizes = np.diff(np.append(first, n))
    place = (np.arange(n) - np.repeat(first, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        digest = _text.mix(np.add.reduceat(_text.mix(hashes + _text.mix(place)), first) + sizes.astype(np.uint64))
    later = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that begin no code point
    _, offsets = _text.flat(column)
    base = offsets[doc[first]]
    points = lambda at: at - base - (later[at] - later[base])
    return digest, points(starts[first]), points(ends[first + sizes - 1]), sizes, doc[first], long[first]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...], np.ndarray]]:
    """Slices of a batch with their units, and each unit's number in its text."""
    for part in _text.slices(batch, "t"):
        found = units(part.column("t"))
        if len(found[0]):
            doc = found[4]
            yield part, found, (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32)


def _is_in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def _hot_firsts(docs: DataFrame, kind: str) -> pa.Table:
    """d, k, row, i of the first occurrence of digests that many units share, by d.

    These are at most ``HOT`` digests, those with most units in slices where at least ``OFTEN`` share one.
    All texts are read for them, but only how the work is dealt depends on their choice, and no result.
    """

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found, _ in _rows_of(batch):
                d, n = np.unique(found[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(d[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["d", "n"])

    most = docs.select("t").mapInArrow(often, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(HOT)
    hot = np.sort(most.select("d").toPandas()["d"].to_numpy(np.int64).view(np.uint64))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found, number in _rows_of(batch):
                at = np.flatnonzero(_is_in(hot, found[0]))
                doc = pa.array(found[4][at])
                yield pa.RecordBatch.from_arrays([pa.array(found[0][at].view(np.int64)), part.column("k").take(doc), part.column("row").take(doc), pa.array(number[at])], ["d", "k", "row", "i"])

    rows = docs if len(hot) else docs.limit(0)
    least = rows.mapInArrow(firsts, f"d long, k {kind}, row long, i int").groupBy("d").agg(F.min(F.struct("k", "row", "i")).alias("f"))
    table = least.select("d", "f.k", "f.row", "f.i").toArrow()  # at most HOT rows
    return table.take(pa.array(np.argsort(table.column("d").to_numpy().view(np.uint64)))).combine_chunks()


def _later(batches: Iterator[pa.RecordBatch], first: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest and rank all but the first of each digest, with the first's key.

    The rows of the digests in ``first`` are spread and have their first there.
    """
    hot, hot_row, hot_i = (first.column(c).to_numpy() for c in ("d", "row", "i"))
    hot = hot.view(np.uint64)
    last_d, last_k = None, None  # digest of the row before a batch, and the key of its first
    for batch in batches:
        d, k = batch.column("d").to_numpy(), batch.column("k")
        if not len(d):
            continue
        again = np.zeros(len(d), bool)
        again[1:] = d[1:] == d[:-1]
        source = np.maximum.accumulate(np.where(again, 0, np.arange(len(d))))
        if last_d is not None and d[0] == last_d:  # the digest goes on: its first key stands behind the batch's
            again[0] = True
            source[: np.argmin(d == d[0]) or len(d)] = len(d)
            k = pa.concat_arrays([k, last_k])
        last_d, last_k = d[-1], k.take(pa.array(source[-1:]))
        heavy = np.flatnonzero(_is_in(hot, d.view(np.uint64)))
        if len(heavy):
            at = np.searchsorted(hot, d[heavy].view(np.uint64))
            again[heavy] = (batch.column("row").to_numpy()[heavy] != hot_row[at]) | (batch.column("i").to_numpy()[heavy] != hot_i[at])
            source[heavy] = len(k) + at
            k = pa.concat_arrays([k, *first.column("k").chunks])
        keep = np.flatnonzero(again)
        arrays = [batch.column(c).take(pa.array(keep)) for c in ("k", "row", "i", "s", "e", "w")]
        yield pa.RecordBatch.from_arrays([*arrays, k.take(pa.array(source[keep]))], ["k", "row", "i", "s", "e", "w", "f"])


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, row: str | None = None) -> DataFrame:
    """key, start, end, n_words, first_key, row for every repeat; ``first_key`` has the earliest occurrence of its units.

    ``row`` names a column with a number for each row; without it rows are numbered here, as they are read, which
    asks that ``df`` gives them in the same order each time, as a table does.  Texts are read three times.  Units are shuffled
    once, by digest; those of digests that many share are dealt by their row into ``SPREAD`` parts, as their
    first occurrence is found beforehand by partial minima.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = slim(df).select(F.col(key).alias("k"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(text).alias("t"))
    shared = df.sparkSession.sparkContext.broadcast(_hot_firsts(docs, kind))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value.column("d").to_numpy().view(np.uint64)
        for batch in batches:
            for part, (digest, start, end, size, doc, long), number in _rows_of(batch):
                rows = part.column("row").take(pa.array(doc))
                deal = np.where(_is_in(hot, digest), rows.to_numpy() % SPREAD, 0)
                arrays = [pa.array(x.astype(np.int32)) for x in (deal, number, start, end, 2 * size + long)]
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(doc)), rows, pa.array(digest.view(np.int64)), *arrays], ["k", "row", "d", "deal", "i", "s", "e", "w"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _later(batches, shared.value)

    found = docs.mapInArrow(split, f"k {kind}, row long, d long, deal int, i int, s int, e int, w int")
    found = found.repartition("d", "deal").sortWithinPartitions("d", "deal", "k", "row", "i")
    again = found.mapInArrow(later, f"k {kind}, row long, i int, s int, e int, w int, f {kind}")
    island = F.col("i") - F.row_number().over(Window.partitionBy("row").orderBy("i"))
    runs = again.withColumn("island", island).groupBy("row", "island").agg(F.first("k").alias("k"), F.min("s").alias("start"), F.max("e").alias("end"), F.sum(F.expr("w div 2")).alias("n_words"), F.sum(F.expr("(w div 2) * (w % 2)")).alias("n_long"), F.min("f").alias("first_key"))
    runs = runs.where((F.col("n_long") >= least) | (F.col("n_words") >= 2 * least))
    return runs.select(F.col("k").alias(key), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words", "first_key", "row")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    out, at = [], 0
    for s, e in sorted(spans):
        out.append(text[at:s])
        at = max(at, e)
    return "".join([*out, text[at:]])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with the repeats cut out of ``text``, and ``removed``: their offsets in the original text.

    Other columns stay as they are, whatever their names, but for one named ``removed``, which is replaced.
    """
    df = df.drop("removed")
    row = fresh(df, "_row")
    kept = staged(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    spans = find_repeats(kept, key, text, least, row).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = kept.join(spans.select(F.col("row").alias(row), "removed"), row, "left").drop(row)
    pieces = F.expr(f"""aggregate(removed, struct(cast('' AS string) AS s, 0L AS at),
        (x, r) -> struct(concat(x.s, substring(`{text}`, cast(x.at AS int) + 1, cast(r.start - x.at AS int))) AS s, r.end AS at),
        x -> concat(x.s, substring(`{text}`, cast(x.at AS int) + 1)))""")
    return joined.withColumn(text, F.coalesce(pieces, F.col(text)))
