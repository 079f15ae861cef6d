"""Word n-gram Jaccard join over count vectors.

A document is the set of its distinct word n-grams.  The n-grams are hashed into groups, and a document
becomes the point of its group counts; the overlap of two documents is at most the sum over groups of
the smaller count.

Candidates.  An R-tree over such points prunes little between the parts of a cluster beyond what their sizes do (the
README has figures), so as the only step it would compare most parts of like size with each other.  What brings documents together is therefore a signature: for sizes
up to ``hi`` two linked sets differ in at most ``D`` n-grams, so if the n-grams are dealt into more than ``D``
blocks, some blocks of both sets are equal.  The digest of a block is a row (it sums a hash of each n-gram in
the block, so it tells the n-grams themselves and not just how many there are); sets that share a digest meet.
This loses no link: ``m = D + 1 + z`` blocks leave ``z + 1`` equal ones, so a set with at most ``z`` blocks
without rare n-grams need not show those, and frequent n-grams, found in a bounded sample, can be left out of
digests altogether.

Verification.  Pairs of points that meet are left if their bound falls short.  Of a digest that many sets share, which is
crowded, each is joined with one of them unseen; but a set need not show the most crowded ones of its digests, as
linked sets share several (``_stars``).  What still meets, directly or over others, is a cluster.  A cluster is dealt into chunks
of bounded size, and every pair of chunks is a task with a packed R-tree over the points: a node stores
the largest counts below it, subtrees and points whose summed minima fall short are left, and the rest
is verified on the sets themselves.  Only a spanning forest of the links leaves a task, so the rows that
come out are at most the documents, however many links a group of copies has.

Documents with equal sets are one point from the start.  A document without words has an empty set and
is linked with nothing, and so is a null text.  A document of fewer words than ``n`` has its whole
sequence as its one n-gram.  Sets are told apart by 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._graph import components
from tessella.llm._util import discard, fresh, sampled, slim, staged

#: Size classes grow by this ratio.
RATIO = 1.3
#: Blocks beyond D + 1, as a share of D and at least: so many crowded digests a set may leave out.
SPARE, LEAST_SPARE = 0.2, 8
#: Documents whose frequent n-grams are left out of digests; fitting only, every list gives all links.
SAMPLE = 4000
FREQUENT = 50_000
#: Groups of the R-tree's points and its leaf size; n-grams and documents of one chunk, and those of chunks that a cluster
#: may have a few of.  Each document goes to as many tasks as its cluster has chunks.
GROUPS, LEAF = 64, 24
CHUNK_NGRAMS, CHUNK_DOCS = 2_000_000, 5000
FEW_CHUNKS, SMALL_NGRAMS, SMALL_DOCS = 4, 400_000, 1000
#: Sets of one digest up to which all their pairs are compared by point before clusters are formed.
FEW = 6
#: Documents up to which the list of those to verify is broadcast (16 bytes each).
BROADCAST_DOCS = 1_000_000
#: Bits of a digest that hold its size class; there are 105 classes.
_CLASS = np.uint64(127)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    _, hashes, _, _, bounds = _text.words(column)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for k in range(n):
            grams = _text.mix(grams * _A + hashes[k : k + len(grams)])
        for i in range(len(column)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                one = np.uint64(b - a)
                for h in hashes[a:b]:
                    one = _text.mix(np.array([one * _A + h], np.uint64))[0]
                yield np.array([one], np.uint64)
            else:
                yield hashes[:0]


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        total = _text.mix(s ^ _B).sum(dtype=np.uint64) * _A + np.uint64(len(s))
        return int(_text.mix(np.array([total], np.uint64)).view(np.int64)[0])


class Blocks:
    """Digests of the blocks of a set, for one similarity ``num / den``."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent = num, den, frequent
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * RATIO)))

    def classes(self, n: int) -> Iterator[int]:
        """Size classes of all sets of at least n elements that n can be linked with."""
        c = int(np.searchsorted(self.tops, n))
        last = int(np.searchsorted(self.tops, n * self.den // self.num))
        yield from range(c, last + 1)

    def digests(self, s: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The digests of all classes, each with its class in the lowest bits, and (class, t) for each class.

        A set that is linked with this one shows at least ``t`` of the class's digests too: of the ``m - D`` equal blocks
        at most those without rare n-grams are hidden, unless this set shows them and the other does not.
        """
        out, shared = [], []
        at = np.searchsorted(self.frequent, s)
        rare = np.ones(len(s), bool)
        if len(self.frequent):
            rare = self.frequent[np.minimum(at, len(self.frequent) - 1)] != s
        with np.errstate(over="ignore"):
            for c in self.classes(len(s)):
                differ = 2 * self.tops[c] * (self.den - self.num) // (self.den + self.num)
                if not differ:
                    continue  # only equal sets are linked
                m = differ + 1 + max(LEAST_SPARE, int(np.ceil(SPARE * differ)))
                h = _text.mix(s + np.uint64(c) * _B)
                block = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
                group = _text.mix((h & np.uint64(0xFFFFFFFF)) + _A)
                sums = np.zeros(m, np.uint64)
                np.add.at(sums, block[rare], group[rare])
                low = np.bincount(block[rare], minlength=m) == 0
                shown = ~low
                shared.append((c, max(1, m - differ - int(low.sum()))))
                if int(low.sum()) > m - 1 - differ:
                    shown[:] = True
                    np.add.at(sums, block[~rare], np.where(low[block[~rare]], group[~rare], np.uint64(0)))
                names = np.arange(m, dtype=np.uint64) + (np.uint64(c) << np.uint64(42))
                out.append(_text.mix(sums ^ _text.mix(names + _B))[shown] & ~_CLASS | np.uint64(c))
        return np.concatenate(out) if out else s[:0], shared


class RTree:
    """Points packed by sort and tile; every node holds the largest counts and the least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.sqrt(len(order) * LEAF)))
        axis = int(points.var(0).argmax())
        parts = [order[i : i + slab] for i in range(0, len(order), slab)]
        order = np.concatenate([p[np.argsort(points[p, axis], kind="stable")] for p in parts])
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.most = np.array([points[x].max(0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.fan = [np.arange(i, min(i + LEAF, len(self.leaves))) for i in range(0, len(self.leaves), LEAF)]
        self.top_most = np.array([self.most[x].max(0) for x in self.fan])
        self.top_least = np.array([self.least[x].min() for x in self.fan])

    def search(self, q: np.ndarray, size: int, need) -> np.ndarray:
        """Points whose overlap with q can reach ``need(size, its size)``, best bound first."""
        up = np.minimum(self.top_most, q).sum(1) >= need(size, self.top_least)
        leaves = np.concatenate([self.fan[i] for i in np.flatnonzero(up)] or [np.zeros(0, np.int64)])
        leaves = leaves[np.minimum(self.most[leaves], q).sum(1) >= need(size, self.least[leaves])]
        found = np.concatenate([self.leaves[i] for i in leaves] or [np.zeros(0, np.int64)])
        bound = np.minimum(self.points[found], q).sum(1)
        fits = bound >= need(size, self.sizes[found])
        return found[fits][np.argsort(-bound[fits], kind="stable")]


def forest(sets: list[np.ndarray], sides: list[int], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of the sets; with two sides, of links across only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], np.int32)
    tree, root = RTree(points, sizes), list(range(len(sets)))
    across = len(set(sides)) > 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def need(a, b):
        return -(-num * (a + b) // (num + den))

    for i in range(len(sets)):
        for j in map(int, tree.search(points[i], int(sizes[i]), need)):
            if j == i or (across and sides[i] == sides[j]) or (not across and j > i):
                continue
            if across and sides[i] > sides[j]:
                continue
            a, b = find(i), find(j)
            if a != b and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need(int(sizes[i]), int(sizes[j])):
                root[max(a, b)] = min(a, b)
                yield i, j


def point_of(s: np.ndarray) -> bytes | None:
    """Group counts as 16-bit numbers, in more groups for larger sets; None if a count is too large."""
    groups = 1 << min(13, max(5, int(len(s) / 8).bit_length()))
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return None if counts.max(initial=0) > 65535 else counts.astype(np.uint16).tobytes()


def may_link(a: bytes | None, b: bytes | None, num: int, den: int) -> bool:
    """Can sets with these points be linked?  The overlap is at most the sum of the smaller counts."""
    if a is None or b is None:
        return True
    p, q = sorted((np.frombuffer(x, np.uint16).astype(np.int64) for x in (a, b)), key=len)
    q = q.reshape(-1, len(p)).sum(0)  # the same hash in fewer groups
    return int(np.minimum(p, q).sum()) * (num + den) >= num * int(p.sum() + q.sum())


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest and set: pairs of sets (x, y), and sets with crowded digests (x, y), each once a batch.

    Of a digest with up to ``FEW`` sets all pairs; of one with more, which is crowded, each set with the digest.
    """

    def out(pairs: list[np.ndarray], stars: list[np.ndarray]) -> pa.RecordBatch:
        empty = np.zeros((0, 2), np.int64)
        p, q = (np.unique(np.concatenate([empty, *x]), axis=0) for x in (pairs, stars))
        both = np.concatenate([p, q])
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(p))], ["x", "y", "crowded"])

    def pairs_of(s: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        found = []
        for k in range(2, FEW + 1):
            rows = s[start[size == k][:, None] + np.arange(k)]
            found += [rows[:, [i, j]] for i in range(k) for j in range(i + 1, k)]
        return found

    left_d = left_s = np.zeros(0, np.int64)
    last: int | None = None  # digest of the last large group
    for batch in batches:
        d, s = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((left_d, "d"), (left_s, "s")))
        if not len(d):
            continue
        again = np.zeros(len(d), bool)
        again[1:] = (d[1:] == d[:-1]) & (s[1:] == s[:-1])
        d, s = d[~again], s[~again]
        start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        size = np.diff(np.append(start, len(d)))
        large = size > FEW
        if last is not None and d[0] == last:
            large[0] = True
        keep = len(d) if large[-1] else start[-1]
        last = int(d[-1]) if large[-1] else None
        left_d, left_s = d[keep:], s[keep:]
        whole = np.repeat(large, size)
        stars = np.stack([s[whole], d[whole]], 1)
        ends = slice(None) if large[-1] else slice(-1)
        yield out(pairs_of(s, start[ends][~large[ends]], size[ends][~large[ends]]), [stars])
    if len(left_d):
        yield out(pairs_of(left_s, np.array([0]), np.array([len(left_s)])), [])


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """N-grams of more than a few documents of a bounded sample."""
    sample = sampled(docs.select("t"), SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t"):
                sets = list(ngram_sets(part.column("t"), n))
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["g"])

    counts = sample.mapInArrow(run, "g long").groupBy("g").count().where("count >= 4")
    rows = counts.orderBy(F.desc("count"), "g").limit(FREQUENT).select("g").toArrow()
    return np.sort(rows.column("g").to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _listed(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_DOCS else df


def _stars(crowd: DataFrame, docs: DataFrame, first: DataFrame, shares) -> DataFrame:
    """Pairs (x, y) that join the sets of each crowded digest, but for the most crowded ones of a set that it need not show.

    ``crowd`` has s and d.  Sets that are linked share ``t`` digests of a class or more.  In one order of all digests, by
    the sets that show them, their first common one has ``t - 1`` common ones behind it, so a set that leaves out its last
    ``t - 1`` still shows it.  So what very many sets have in common by chance, as a line, does not make them one cluster.
    """
    some = crowd.select("s").distinct().join(first.select("s", "k"), "s")
    least = docs.where("t IS NOT NULL").join(_listed(staged(some, "crowded")), "k").select("s", "t").mapInArrow(shares, "s long, c long, t long")
    own = crowd.join(crowd.groupBy("d").agg(F.count(F.lit(1)).alias("sets")), "d").withColumn("c", F.col("d").bitwiseAND(F.lit(int(_CLASS))))
    place = F.row_number().over(Window.partitionBy("s", "c").orderBy(F.desc("sets"), F.desc("d")))
    kept = own.withColumn("place", place).join(least.distinct(), ["s", "c"], "left").where("place >= coalesce(t, 1)")
    kept = staged(kept.select("s", "d"), "stars")
    return kept.join(kept.groupBy("d").agg(F.min("s").alias("y")), "d").where("s <> y").select(F.col("s").alias("x"), "y").distinct()


def classes_of(df: DataFrame, n: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row; sets are linked from a similarity of ``num / den`` on."""
    kind = df.schema[key].dataType.simpleString()
    docs = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t"))
    blocks = Blocks(num, den, _frequent(docs, n))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t"):
                found = [(len(s), set_key(s), point_of(s)) for s in ngram_sets(part.column("t"), n)]
                yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array([x[i] for x in found], kind_) for i, kind_ in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["k", "n", "s", "p"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t"):
                found = [(x, c, t) for x, s in zip(part.column("s").to_pylist(), ngram_sets(part.column("t"), n), strict=True) if set_key(s) == x for c, t in blocks.digests(s)[1] if t > 1]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["s", "c", "t"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies met by this task give their rows once
        for batch in batches:
            for part in _text.slices(batch, "t"):
                if len(seen) > 200_000:
                    seen.clear()
                rows, keys = [], []
                for s in ngram_sets(part.column("t"), n):
                    x = set_key(s)
                    if len(s) and x not in seen:
                        seen.add(x)
                        rows.append(blocks.digests(s)[0])
                        keys.append(np.full(len(rows[-1]), x, np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate(keys))], ["d", "s"])

    sets = staged(docs.mapInArrow(light, f"k {kind}, n long, s long, p binary"), "sets")
    # equal digests lie next to each other in a partition, so one shuffle of the rows is enough
    rows = docs.select("t").mapInArrow(digests, "d long, s long").repartition("d").sortWithinPartitions("d", "s")
    met = staged(rows.mapInArrow(_meetings, "x long, y long, crowded boolean").distinct(), "met")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_link(x, y, num, den) for x, y in zip(a, b, strict=True)], dtype=bool)

    points = sets.where("n > 0").groupBy("s").agg(F.first("p").alias("p"))
    # one document of each set
    first = sets.where("n > 0 AND k IS NOT NULL").groupBy("s").agg(F.min("k").alias("k"), F.min("n").alias("n"))
    stars = _stars(met.where("crowded").select(F.col("x").alias("s"), F.col("y").alias("d")), docs, first, shares)
    pairs = met.where("NOT crowded").join(points.select(F.col("s").alias("x"), F.col("p").alias("px")), "x").join(points.select(F.col("s").alias("y"), F.col("p").alias("py")), "y")
    clusters = components(stars.unionByName(pairs.where(near("px", "py")).select("x", "y")))
    discard(met)
    # the document of each set to verify, with its cluster and the chunks of that
    chosen = staged(clusters.withColumnRenamed("u", "s").join(first, "s"), "chosen")
    parts = [F.greatest(F.ceil(F.sum("n") / grams), F.ceil(F.count(F.lit(1)) / docs_)) for grams, docs_ in ((CHUNK_NGRAMS, CHUNK_DOCS), (SMALL_NGRAMS, SMALL_DOCS))]
    chunks = chosen.groupBy("root").agg(F.greatest(parts[0], F.least(parts[1], F.lit(FEW_CHUNKS))).cast("int").alias("chunks"))
    chosen = _listed(chosen.join(chunks, "root").select("k", "s", "root", "chunks"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t"):
                found = [s.view(np.int64) if set_key(s) == x else None for s, x in zip(ngram_sets(part.column("t"), n), part.column("s").to_pylist(), strict=True)]
                part = part.append_column("grams", pa.array(found, pa.list_(pa.int64())))
                yield part.select(["s", "root", "chunks", "grams"]).filter(pa.compute.is_valid(part.column("grams")))

    sent = docs.where("t IS NOT NULL").join(chosen, "k").select("s", "root", "chunks", "t").mapInArrow(fetch, "s long, root long, chunks int, grams array<long>")
    own = F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int")
    sent = sent.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = sent.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "s", "grams")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            unique = {s: (g, side) for s, g, side in members}
            names, values = list(unique), list(unique.values())
            pairs = list(forest([g for g, _ in values], [side for _, side in values], num, den)) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()), pa.array([names[j] for _, j in pairs], pa.int64())], ["x", "y"])

        now, members = None, []
        for batch in batches:
            grams, keys = batch.column("grams"), zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b")), strict=True)
            flat, ends = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), grams.offsets.to_numpy()
            for i, (at, side, s) in enumerate(zip(keys, batch.column("own").to_pylist(), batch.column("s").to_pylist(), strict=True)):
                if at != now:
                    if members:
                        yield done()
                    now, members = at, []
                members.append((s, flat[ends[i] : ends[i + 1]].copy(), side))
        if members:
            yield done()

    links = sent.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(link, "x long, y long")
    linked = components(links).withColumnRenamed("u", "s")
    least = first.select("s", F.col("k").alias("least"))
    named = least.join(linked, "s", "left").withColumn("root", F.coalesce("root", "s"))
    whole = named.join(linked.select("s"), "s").groupBy("root").agg(F.min("least").alias("of_all"))
    named = named.join(whole, "root", "left").select("s", F.coalesce("of_all", "least").alias("component"))
    sets = sets.drop("p")
    out = sets.where("n > 0").join(named, "s", "left").unionByName(sets.where("n = 0").withColumn("component", F.col("k")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(df: DataFrame, n: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose key is the least of its class; of rows with equal keys and sets one.

    Documents without words and rows without a key belong to no class and stay.
    """
    name = fresh(df, "__key")
    keyed = df.where(F.col(key).isNotNull())
    if keyed.groupBy(key).count().where("count > 1").limit(1).count():  # rows need ids that hold
        row = fresh(df, "__row")
        rows = staged(df.withColumn(row, F.monotonically_increasing_id()), "rows")
        rows = rows.withColumn(name, F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.col(row).alias("r"))))
    else:
        rows = df.withColumn(name, F.col(key))
    found = staged(classes_of(rows, n, num, den, name, text), "classes")
    gone = found.where((F.col("n_shingles") > 0) & F.col(name).isNotNull() & (F.col("component_id") != F.col(name))).select(name)
    if gone.count() <= BROADCAST_DOCS:
        gone = F.broadcast(gone)
    return rows.join(gone, name, "left_anti").select(*df.columns)
