"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words over the benchmark's vocabulary, weighted by TF-IDF with document
frequencies of the whole corpus.  A randomised SVD, whose products are summed over the executors, gives
the latent space; it is fitted on the items and the passages of all documents, whose words of the benchmark
are written once as numbers.  Every
passage of every document is compared with every item by cosine, in blocks of items.  A long item is
cut into pieces that fit a passage wherever they begin; a hit on any is a candidate for the whole item.  No word is without
weight, and passages that hold enough of an item's runs of ``GRAM`` words are candidates too, so that a
literal copy is one however frequent its words are.  A candidate is verified by the longest common subsequence with the item, and by a check that the item's answer (its
rarest words, where the benchmark has no answers) occurs there, so that a paraphrase with dropped,
added or changed words still counts.  Two bounds that no such passage can miss, both vectorised, come first:
the answer's words that occur there, and the item's words that do, which no common subsequence exceeds.

A block of items is fitted, broadcast and searched at a time; where there are several, what a block has
found is written before the next begins, so the driver holds one at a time; workers hold those of earlier blocks
until Spark clears their broadcasts.

Words are runs of letters, digits and bytes above ASCII, lower-cased.  A null or empty text has no
passage; an item without words is contained nowhere.  Repeated items and rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import discard, slim, staged

#: Items of one pass; a larger benchmark takes several passes over the documents.
ITEM_BLOCK = 4096
#: Features of a passage, dimensions, extra columns.
FEATURES, RANK, OVER = 8192, 96, 16
#: Weight of an item's passages against those of so many documents in the fit; against more it grows with them.
ITEM_WEIGHT, AGAINST = 100.0, 1000
#: Matrices of a product that reach the driver; rows of a band of the passages' matrix, cells of it that a task sums at a time.
SUMS, BAND, CELLS = 4, 256, 12_000_000
#: Bytes of text whose words' vectors are held at a time, and candidates' words compared at a time.
SLICE, PAIRS = 1 << 19, 1 << 18
#: Words in a block; a passage is this many blocks.
BLOCK, SPAN = 16, 3
#: Words in a run of the literal path, and least part of an item's runs (of those of two blocks) in a passage.
GRAM, RUNS = 3, 0.3
#: Candidates: least cosine, and least part along the item, in its lengths (a short item within other
#: text has a low cosine but most of its own length).  Verified: common subsequence, answer words.
COSINE, HELD, COMMON, ANSWER = 0.2, 0.55, 0.6, 0.5
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the words of every text."""
    data, offsets = _text.flat(pa.compute.utf8_lower(column.fill_null("").cast(pa.large_string())))
    starts, ends = _text.runs(_WORD[data], offsets)
    return _text.hash_runs(data, starts, ends), np.searchsorted(starts, offsets)


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the bits of one integer for ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = where.get(x)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _runs(v: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of runs of ``size`` words of the vocabulary within a document."""
    n = max(len(v) - size + 1, 0)
    ok = doc[:n] == doc[size - 1 :][:n]
    for i in range(size):
        ok &= v[i : i + n] >= 0
    at = np.flatnonzero(ok)
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            key = _text.mix(key + v[at + i].astype(np.uint64))
    return at, key


@dataclass
class Benchmark:
    """A block of items and what is known of their words."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    vocabulary: np.ndarray
    weight: np.ndarray | None = None  # of each word: idf, above 0
    feature: np.ndarray | None = None
    latent: np.ndarray | None = None  # weighted latent vector of each word
    items: np.ndarray | None = None  # unit latent vectors of the items' pieces
    owner: np.ndarray | None = None  # item of each piece
    lengths: np.ndarray | None = None  # and their lengths before
    runs: dict | None = None  # by size: keys of the items' runs, bounds of each key's items, items
    least: np.ndarray | None = None  # runs that make a passage a candidate, by item
    sizes: np.ndarray | None = None  # words of each item
    word_lists: tuple | None = None  # numbers of all items' words, and where each item's begin
    answer_lists: tuple | None = None

    def fits(self, v: np.ndarray, bounds: np.ndarray, d: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of candidates (document, block, item), those whose region has words enough for both checks.

        ``v`` has the vocabulary's numbers of all words.  The share of the words of an item that occur in the
        region is at least that of the longest common subsequence.
        """
        n = len(v) + 1
        at = np.flatnonzero(v >= 0)
        places = np.sort(v[at].astype(np.int64) * n + at)  # by word, then place
        good = np.ones(len(d), bool)
        for lists, least in ((self.answer_lists, ANSWER), (self.word_lists, COMMON)):
            numbers, starts = lists
            live = np.flatnonzero(good)
            pairs = np.cumsum(np.diff(starts)[j[live]])
            low = 0
            while low < len(live):
                high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + PAIRS, "right")))
                some = live[low:high]
                low = high
                own, first = np.diff(starts)[j[some]], starts[j[some]]
                ends = np.cumsum(own)
                words_ = numbers[np.repeat(first - (ends - own), own) + np.arange(ends[-1])].astype(np.int64) * n
                begin, end = self.region(bounds, d[some], b[some], j[some])
                i = np.searchsorted(places, words_ + np.repeat(begin, own))
                there = places[np.minimum(i, len(places) - 1)] < words_ + np.repeat(end, own)
                there &= i < len(places)
                sums = np.concatenate([[0], np.cumsum(there)])
                good[some] = sums[ends] - sums[ends - own] >= least * own - 1e-9
        return good

    def region(self, bounds: np.ndarray, d, b, j) -> tuple:
        """First and last place of the words in which item ``j`` is looked for around a passage."""
        size = self.sizes[j]
        return bounds[d] + np.maximum(0, b * BLOCK - size), np.minimum(bounds[d + 1], bounds[d] + (b + SPAN) * BLOCK + size)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def index(self) -> None:
        """Set the items' words as numbers, and their runs; an item of fewer than GRAM words is one run."""
        self.sizes = np.array([len(w) for w in self.words])
        self.word_lists, self.answer_lists = ((self.place(np.concatenate(x)), np.concatenate([[0], np.cumsum([len(w) for w in x])])) for x in (self.words, self.answers))
        sizes = np.array([min(GRAM, len(w)) for w in self.words])
        self.least, self.runs = np.ones(len(sizes)), {}
        for size in np.unique(sizes).tolist():
            keys, owners = [], []
            for j in np.flatnonzero(sizes == size).tolist():
                v = self.place(self.words[j])
                key = _runs(v, np.zeros(len(v), np.int64), size)[1]
                self.least[j] = max(1, RUNS * min(len(key), 2 * BLOCK - 2))
                keys.append(np.unique(key))
                owners.append(np.full(len(keys[-1]), j))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            self.runs[size] = key, np.append(first, len(order)), owner[order]

    def copies(self, v: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, blocks and items of passages that hold enough runs of an item, the fullest first."""
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size, (keys, starts, owners) in self.runs.items():
            at, key = _runs(v, doc, size)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            at, i = at[hit], i[hit]
            pairs = np.cumsum(starts[i + 1] - starts[i])
            low = 0
            while low < len(at):  # whole documents of some million pairs
                done = pairs[low - 1] if low else 0
                high = min(np.searchsorted(pairs, done + 4_000_000, "right"), len(at) - 1)
                high = int(np.searchsorted(doc[at], doc[at[high]], "right"))
                p, q = at[low:high], i[low:high]
                low = high
                many = starts[q + 1] - starts[q]
                item = owners[np.repeat(starts[q], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                d = np.repeat(doc[p], many)
                block = (np.repeat(p, many) - bounds[d]) // BLOCK
                order = np.lexsort((block, item, d))
                d, item, block = d[order], item[order], block[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                own = np.diff(np.append(first, len(d)))
                d, item, block, n = d[first], item[first], block[first], own.copy()
                for k in range(1, SPAN):
                    j = np.flatnonzero((d[k:] == d[:-k]) & (item[k:] == item[:-k]) & (block[k:] - block[:-k] < SPAN))
                    n[j] += own[j + k]
                enough = np.flatnonzero(n >= self.least[item])
                enough = enough[np.argsort(-n[enough], kind="stable")]
                yield d[enough], block[enough], item[enough]

    def passages(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Words of the vocabulary by block: (numbers, first word of each block, document, block in it), and all words."""
        hashes, bounds = words(column)
        v = self.place(hashes)
        at = np.flatnonzero(v >= 0)
        doc = np.searchsorted(bounds, at, "right") - 1
        block = (at - bounds[doc]) // BLOCK
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        return v[at], first, doc[first], block[first], hashes, bounds, v

    def vectors(self, v: np.ndarray, first: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of the passages that begin at each block, and their counts of words."""
        own = np.add.reduceat(self.latent[v], first, axis=0)
        count = np.diff(np.append(first, len(v)))
        out, n = own.copy(), count.copy()
        for k in range(1, SPAN):  # blocks that follow within the span; blocks without words are absent
            same = np.zeros(len(first), bool)
            same[:-k] = (doc[k:] == doc[:-k]) & (block[k:] - block[:-k] < SPAN)
            i = np.flatnonzero(same)
            out[i] += own[i + k]
            n[i] += count[i + k]
        return out, n

    def find(self, column: pa.Array) -> list[tuple[int, int, float, float, float, int, int]]:
        """(row, item, cosine, common share, answer share, first word, last word) of verified passages."""
        v, first, doc, block, hashes, bounds, every = self.passages(column)
        if not len(v):
            return []
        z, n = self.vectors(v, first, doc, block)
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()

        def verify(d: int, b: int, j: int, cosine: float | None) -> None:
            if (d, b, j) in tried or ((d, j) in best and best[d, j][3] >= 0.999):
                return
            tried.add((d, b, j))
            item = self.words[j]
            start, end = (int(x) for x in self.region(bounds, d, b, j))
            region = hashes[start:end]
            share = common_length(item, region) / len(item)
            if share < COMMON or ((d, j) in best and best[d, j][3] >= share):
                return
            answer = self.answers[j]
            held = float(np.isin(answer, region).mean()) if len(answer) else 1.0
            if held >= ANSWER:
                if cosine is None:
                    own = every[bounds[d] + b * BLOCK : min(bounds[d + 1], bounds[d] + (b + SPAN) * BLOCK)]
                    at = self.latent[own[own >= 0]].sum(0)
                    cosine = float((self.items[self.owner == j] @ at).max()) / max(float(np.linalg.norm(at)), 1e-9)
                start -= int(bounds[d])
                best[d, j] = (d, j, cosine, share, held, start, start + len(region))

        for low in range(0, len(z), 4096):
            part = z[low : low + 4096]
            norm = np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
            for left in range(0, len(self.items), ITEM_BLOCK):
                along = part @ self.items[left : left + ITEM_BLOCK].T
                rows, pieces = np.nonzero((along >= HELD * self.lengths[left : left + ITEM_BLOCK]) & (along >= COSINE * norm))
                cosine = along[rows, pieces] / norm[rows, 0]
                d, b, j = doc[low + rows], block[low + rows], self.owner[left + pieces]
                fit = np.flatnonzero(self.fits(every, bounds, d, b, j))
                fit = fit[np.argsort(-cosine[fit], kind="stable")]
                for x in zip(d[fit].tolist(), b[fit].tolist(), j[fit].tolist(), cosine[fit].tolist(), strict=True):
                    verify(*x)
        for d, b, j in self.copies(every, bounds):
            fit = self.fits(every, bounds, d, b, j)
            for x in zip(d[fit].tolist(), b[fit].tolist(), j[fit].tolist(), strict=True):
                verify(*x, None)
        return sorted(best.values())


def _load(items: list, key: str, text: str, answer: str | None) -> Benchmark:
    hashes, bounds = words(pa.array([r[text] for r in items], pa.string()))
    each = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    answers: list = [None] * len(items)
    if answer:
        h, b = words(pa.array([r[answer] for r in items], pa.string()))
        answers = [h[x:y] for x, y in zip(b[:-1], b[1:], strict=True)]
    filled = [i for i, w in enumerate(each) if len(w)]
    vocabulary = np.unique(np.concatenate([hashes, *(answers[i] for i in filled if answers[i] is not None)]))
    return Benchmark([items[i][key] for i in filled], [each[i] for i in filled], [answers[i] for i in filled], vocabulary)


def _encoded(docs: DataFrame, b: Benchmark) -> DataFrame:
    """v, first, bounds, n: of each slice of texts the numbers of the vocabulary's words, the first of each block and of
    each text, as bytes, and the texts that are not null."""
    shared = docs.sparkSession.sparkContext.broadcast(b)
    kind = _number(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t", SLICE):
                v, first, doc, *_ = shared.value.passages(part.column("t"))
                bounds = first[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))] if len(v) else first
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (v.astype(kind), first.astype(np.int32), bounds.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([part.num_rows - part.column("t").null_count]), pa.array([part.num_rows])], ["v", "first", "bounds", "n", "every"])

    return docs.select("t").mapInArrow(run, "v binary, first binary, bounds binary, n long, every long")


def _number(b: Benchmark) -> type:
    return np.uint16 if len(b.vocabulary) < 1 << 16 else np.uint32


def _slices(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict]]:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["v"], kind), np.frombuffer(r["first"], np.int32), np.frombuffer(r["bounds"], np.int32), r


def _weigh(encoded: DataFrame, b: Benchmark) -> int:
    """Set idf weights from the documents that each word occurs in; the number of texts."""
    size, kind = len(b.vocabulary), _number(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, texts = np.zeros(size, np.int64), 0, 0
        for v, _, bounds, r in _slices(batches, kind):
            pairs = np.unique(np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(v)))) * size + v)
            seen += np.bincount(pairs % max(size, 1), minlength=size)
            n += r["every"]
            texts += r["n"]
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [-1, -2])), pa.array(np.append(seen[hit], [n, texts]))], ["v", "n"])

    # at most a row for each word of the block of items
    found = {r.v: r.n for r in encoded.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toLocalIterator()}
    total, texts = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(len(b.vocabulary))
    df[list(found)] = list(found.values())
    b.weight = np.log((2 + total) / (1 + df)).astype(np.float32)
    n = min(FEATURES, max(len(b.vocabulary), 1))
    b.feature = (b.vocabulary % np.uint64(n)).astype(np.int64) if len(b.vocabulary) > n else np.arange(len(b.vocabulary))
    return texts


def _pairs(v: np.ndarray, first: np.ndarray, weight: np.ndarray, feature: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i * (n + 1) + j, product) of all pairs i <= j of a passage's features, of passages as unit vectors; n stands for none."""
    sizes = np.diff(np.append(first, len(v)))
    row = np.repeat(np.arange(len(first)), sizes)
    column = np.arange(len(v)) - first[row]
    w = weight[v].astype(np.float64)
    f, u = np.full((len(first), BLOCK), n), np.zeros((len(first), BLOCK))
    f[row, column] = feature[v]
    u[row, column] = w / np.sqrt(np.maximum(np.add.reduceat(w * w, first), 1e-12))[row]
    yield (f * (n + 2)).ravel(), (u * u).ravel()
    for k in range(1, int(sizes.max())):
        i, j, x = f[:, :-k], f[:, k:], u[:, :-k] * u[:, k:]
        x[i == j] *= 2  # a word that occurs again: both orders are the diagonal's
        yield (np.minimum(i, j) * (n + 1) + np.maximum(i, j)).ravel(), x.ravel()


def _gram(encoded: DataFrame, b: Benchmark) -> DataFrame:
    """low, m: X' X over all passages of documents, in bands of ``BAND`` rows from column ``low`` on.

    A task sums as many rows at a time as ``CELLS`` allow, so a large vocabulary takes several passes.  As each task hands
    on a matrix, there are no more tasks than cores.
    """
    n = int(b.feature.max()) + 1 if len(b.feature) else 1
    shared = encoded.sparkSession.sparkContext.broadcast((b.weight, b.feature))
    kind = _number(b)
    rows = max(BAND, CELLS // (n + 1) // BAND * BAND)

    def summed(start: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, feature = shared.value
            end = min(n, start + rows)
            out = np.zeros((end - start + 1) * (n + 1))  # the last row is for what lies outside
            for v, first, _, _ in _slices(batches, kind):
                for low in range(0, len(first), 4096):
                    part = first[low : low + 4096]
                    stop = first[low + 4096] if low + 4096 < len(first) else len(v)
                    for at, x in _pairs(v[part[0] : stop], part - part[0], weight, feature, n):
                        at -= start * (n + 1)
                        if rows < n:
                            own = (at >= 0) & (at < (end - start) * (n + 1))
                            at, x = at[own], x[own]
                        np.add.at(out, at, x)
            out = out.reshape(-1, n + 1)
            for low in range(start, end, BAND):
                band = out[low - start : min(low + BAND, end) - start, low:n].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([TaskContext.get().partitionId()]), pa.array([band.tobytes()], pa.binary())], ["low", "p", "m"])

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for low, m in zip(batch.column("low").to_pylist(), batch.column("m"), strict=True):
                if low != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["low", "m"])
                    now, total = low, 0.0
                total = total + np.frombuffer(m.as_buffer(), np.float32).astype(np.float64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["low", "m"])

    few = encoded.select("v", "first", "bounds").coalesce(encoded.sparkSession.sparkContext.defaultParallelism)
    parts = None
    for start in range(0, n, rows):
        now = few.mapInArrow(summed(start), "low long, p long, m binary")
        parts = now if parts is None else parts.unionByName(now)
    return staged(parts.repartition("low").sortWithinPartitions("low", "p").mapInArrow(add, "low long, m binary"), "gram")


def _product(gram: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """X' X M, by bands; a band's part has no more numbers than M."""
    n = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(matrix.shape)
        for batch in batches:
            for low, m in zip(batch.column("low").to_pylist(), batch.column("m"), strict=True):
                band = np.frombuffer(m.as_buffer(), np.float64).reshape(-1, n - low)
                high = low + len(band)
                square = np.triu(band[:, : high - low])
                out[low:high] += (square + np.triu(square, 1).T) @ matrix[low:high] + band[:, high - low :] @ matrix[high:]
                out[high:] += band[:, high - low :].T @ matrix[low:high]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["m"])

    return sum((np.frombuffer(bytes(r.m), np.float64).reshape(matrix.shape) for r in gram.coalesce(SUMS).mapInArrow(run, "m binary").toLocalIterator()), np.zeros(matrix.shape))


def _project(encoded: DataFrame, texts: int, items: list, b: Benchmark) -> None:
    """Set latent vectors by a randomised SVD with one power iteration."""
    n = int(b.feature.max()) + 1 if len(b.feature) else 1
    columns = min(RANK + OVER, n)
    own = np.zeros((n + 1) * (n + 1), np.float32)
    v, first, *_ = b.passages(pa.array(items, pa.string()))
    for at, x in _pairs(v, first, b.weight, b.feature, n):
        np.add.at(own, at, x.astype(np.float32))
    own = np.triu(own.reshape(n + 1, n + 1)[:n, :n])
    own += np.triu(own, 1).T
    gram = _gram(encoded, b)

    def product(m: np.ndarray) -> np.ndarray:
        return _product(gram, m.astype(np.float64)) + ITEM_WEIGHT * max(1.0, texts / AGAINST) * (own @ m)

    q = np.random.default_rng(5).standard_normal((n, columns)).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    small = q.T @ product(q)
    discard(gram)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    basis = (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)
    b.latent = b.weight[:, None] * basis[b.feature]
    pieces = [np.array_split(w, -(-len(w) // (BLOCK * (SPAN - 1)))) for w in b.words]
    b.owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    z = np.array([b.latent[b.place(w)].sum(0) for p in pieces for w in p], np.float32).reshape(len(b.owner), basis.shape[1])
    b.lengths = np.maximum(np.linalg.norm(z, axis=1), 1e-9)
    b.items = z / b.lengths[:, None]
    for j, w in enumerate(b.words):
        if b.answers[j] is None:
            rare = np.unique(w)
            rare = rare[np.argsort(-b.weight[b.place(rare)], kind="stable")]
            b.answers[j] = rare[: max(1, len(rare) // 4)]


def blocks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator[Benchmark]:
    """The fitted blocks of items, one at a time; ``docs`` has columns k and t."""
    held = []
    columns = [F.col(item).alias("i"), F.col(text).alias("t"), *([F.col(answer).alias("a")] if answer else [])]
    rows = benchmark.select(*columns).toLocalIterator()
    while True:
        row = next(rows, None)
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) >= ITEM_BLOCK):
            b = _load(held, "i", "t", "a" if answer else None)
            if b.ids:
                encoded = staged(_encoded(docs, b), "passages")
                _project(encoded, _weigh(encoded, b), [r["t"] for r in held], b)
                discard(encoded)
                b.index()
                yield b
            held = []
        if row is None:
            return


def prepare(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", answer: str | None = None) -> list[Benchmark]:
    """All fitted blocks at once; for benchmarks of a few blocks."""
    return list(blocks(docs, benchmark, item, text, answer))


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """key, item, cosine, common, answer, first_word, last_word for every item found in a row.  No shuffle of texts.

    Where ``key`` or ``item`` has the name of another of these columns, it gets an underscore after it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind, item_kind = df.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    arrow = to_arrow_type(item_kind)
    schema = f"k {kind}, i {item_kind.simpleString()}, cosine double, common double, answer double, first_word long, last_word long"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _text.slices(batch, "t", SLICE):
                    b = shared.value
                    found = b.find(part.column("t"))
                    if found:
                        cells = list(zip(*found, strict=True))
                        keys = part.column("k").take(pa.array(cells[0]))
                        yield pa.RecordBatch.from_arrays([keys, pa.array([b.ids[j] for j in cells[1]], arrow), *(pa.array(cells[i], pa.float64()) for i in (2, 3, 4)), *(pa.array(cells[i], pa.int64()) for i in (5, 6))], ["k", "i", "cosine", "common", "answer", "first_word", "last_word"])

        return run

    found = None
    for b in blocks(docs, benchmark, item, item_text, answer):
        if found is not None:  # of several blocks, each is searched before the next is fitted
            found = staged(found, "leaks")
        shared = df.sparkSession.sparkContext.broadcast(b)
        now = docs.mapInArrow(search(shared), schema)
        found = now if found is None else found.unionByName(now)
    if found is None:
        found = df.sparkSession.createDataFrame([], schema)
    out: list[str] = []
    for name in (key, item, *found.columns[2:]):
        if name in found.columns[2:] and len(out) < 2:
            name += "_"
        out.append(name + "_" if name in out else name)
    return found.toDF(*out)


def without_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that contain no item.  No shuffle."""
    at = df.columns.index(text)
    docs = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _text.slices(batch, text, SLICE):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in shared.value.find(part.column(at))]] = False
                    yield part.filter(pa.array(clean))

        return run

    first = True
    for b in blocks(docs, benchmark):
        if not first:
            df = staged(df, "clean")
        df, first = df.mapInArrow(search(df.sparkSession.sparkContext.broadcast(b)), df.schema), False
    return df
