"""Approximate nearest neighbours: layered proximity graphs, one a part of the vectors, stored as a table.

``build`` deals distinct vectors out to parts of about ``PART_ROWS`` by their hash and makes a graph of each part in
a task; the index is a table with one row a part.  Keys of equal vectors share a node.  ``search`` walks every
part's graph from its top layer down with a beam of ``EF`` candidates, all queries of a block in step, and merges the
parts' best.  A part compares a query with a number of vectors that grows far slower than the part, so the share
of vectors met falls as parts fill up.

A graph's layers hold all vectors, then one in ``M``, one in ``M`` squared and so on.  A vector's links go to near
vectors that are nearer to it than to each other, then to the nearest left over, and back.  Within a part
candidates for links are exact: blocks of vectors are multiplied with all of the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tessella.operators.retrieval import QUERY_BLOCK, top

#: Links a vector chooses, candidates for them, width of the search beam, vectors of a part.
M, CANDIDATES, EF, PART_ROWS = 16, 64, 50, 50_000
#: Keys of equal vectors that a node keeps, the smallest; no list of as many neighbours needs another one.
COPIES = 100
#: Vectors multiplied with a part at a time, and queries that walk it in step.
BUILD_BLOCK, WALK_BLOCK = 512, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def levels_of(hashes: np.ndarray, m: int = M) -> np.ndarray:
    """The top layer of each vector: its share of the hashes' range gives a geometric number."""
    u = ((hashes.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) + 1) / (1 << 53)
    return np.minimum(-np.log(u) / np.log(m), 15).astype(np.int64)


def links_of(vectors: np.ndarray, m: int = M, most: int = CANDIDATES) -> np.ndarray:
    """Links of one layer, ``2 m`` a vector at most, -1 where there are fewer."""
    n = len(vectors)
    most = min(most, n - 1)
    if most < 1:
        return np.full((n, 1), -1, np.int32)
    chosen = np.full((n, min(m, most)), -1, np.int32)
    near = np.zeros(chosen.shape, np.float32)
    for at in range(0, n, BUILD_BLOCK):
        own = vectors[at : at + BUILD_BLOCK]
        rows = np.arange(len(own))
        sims = own @ vectors.T
        sims[rows, at + rows] = -2
        found = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        order = np.argsort(-np.take_along_axis(sims, found, 1), axis=1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        sims = np.take_along_axis(sims, found, 1)
        between = np.matmul(vectors[found], vectors[found].transpose(0, 2, 1))
        kept = np.zeros(found.shape, bool)
        shadow = np.full(found.shape, -2, np.float32)  # nearness to the nearest link chosen
        for c in range(most):
            kept[:, c] = (shadow[:, c] < sims[:, c]) & (kept.sum(1) < m)
            np.maximum(shadow, np.where(kept[:, c, None], between[:, c], -2), out=shadow)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, : chosen.shape[1]]  # those kept, then the nearest left over
        chosen[at : at + len(own)] = np.take_along_axis(found, rank, 1)
        near[at : at + len(own)] = np.take_along_axis(sims, rank, 1)
    # both directions, the nearest 2 m of each vector, its own choices first
    a = np.repeat(np.arange(n), chosen.shape[1])
    b, s = chosen.ravel(), near.ravel()
    rows, cols, sims, back = np.r_[a, b], np.r_[b, a], np.r_[s, s], np.r_[np.zeros(len(a)), np.ones(len(a))]
    _, first = np.unique(rows.astype(np.int64) * n + cols, return_index=True)
    rows, cols, sims, back = rows[first], cols[first], sims[first], back[first]
    order = np.lexsort((-sims, back, rows))
    rows, cols = rows[order], cols[order]
    begins = np.searchsorted(rows, np.arange(n))
    place = np.arange(len(rows)) - begins[rows]
    out = np.full((n, 2 * m), -1, np.int32)
    held = place < 2 * m
    out[rows[held], place[held]] = cols[held]
    return out


def walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, nearness, vectors met) of the ``ef`` best that each query reaches from its entry, best first."""
    count, width = len(queries), links.shape[1]
    rows = np.arange(count)
    seen = np.zeros((count, len(vectors)), bool)
    beam = np.full((count, ef), -1, np.int64)
    sims = np.full((count, ef), -np.inf)
    beam[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", vectors[entry], queries)
    seen[rows, entry] = True
    open_ = beam >= 0
    met = np.ones(count, np.int64)
    while len(live := np.flatnonzero(open_.any(1))):
        at = np.argmax(np.where(open_[live], sims[live], -np.inf), axis=1)
        open_[live, at] = False
        around = links[beam[live, at]]
        new = (around >= 0) & ~seen[live[:, None], around]
        seen[live[:, None], np.where(around >= 0, around, beam[live, at][:, None])] = True
        met[live] += new.sum(1)
        nearness = np.where(new, np.einsum("qwd,qd->qw", vectors[around], queries[live]), -np.inf)
        every, every_sims = np.hstack([beam[live], around]), np.hstack([sims[live], nearness])
        every_open = np.hstack([open_[live], new])
        keep = np.argpartition(-every_sims, ef - 1, axis=1)[:, :ef]
        beam[live], sims[live] = np.take_along_axis(every, keep, 1), np.take_along_axis(every_sims, keep, 1)
        open_[live] = np.take_along_axis(every_open, keep, 1) & (sims[live] > -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(np.where(sims > -np.inf, beam, -1), order, 1), np.take_along_axis(sims, order, 1), met


class Graph:
    """The layers of one part: members of each layer, and their links by position in the layer."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.members, self.links = vectors, members, links

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        vectors = np.ascontiguousarray(vectors, np.float32)
        members = [np.flatnonzero(levels >= level) for level in range(int(levels.max(initial=0)) + 1)]
        return cls(vectors, members, [links_of(vectors[some]) for some in members])

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = np.zeros(len(queries), np.int64)  # a position in the layer above
        met = np.zeros(len(queries), np.int64)
        for level in range(len(self.members) - 1, -1, -1):
            own = self.members[level]
            if level < len(self.members) - 1:
                entry = np.searchsorted(own, self.members[level + 1][entry])
            found, sims, some = walk(self.vectors[own], self.links[level], queries, entry, 1 if level else ef)
            met += some
            entry = found[:, 0]
        return found, sims, met

    def dumps(self) -> tuple[bytes, bytes, list[int], list[int]]:
        return self.vectors.tobytes(), b"".join(x.astype(np.int32).tobytes() for x in self.links), [len(x) for x in self.members], [x.shape[1] for x in self.links]

    @classmethod
    def loads(cls, vectors: bytes, links: bytes, sizes: list[int], widths: list[int], levels: np.ndarray) -> Graph:
        v = np.frombuffer(vectors, np.float32).reshape(sizes[0], -1)
        flat, at, parts = np.frombuffer(links, np.int32), 0, []
        for n, w in zip(sizes, widths, strict=True):
            parts.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(v, [np.flatnonzero(levels >= level) for level in range(len(sizes))], parts)


def build(corpus: DataFrame, key: str, vector: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The index: part, keys of each node, and the graph as bytes.  To be written once and searched often.

    Equal vectors are one node with their ``COPIES`` smallest keys, so a vector that very many rows share is one
    node as well; what is shuffled of it is cut in each task first.  Null vectors are left out.
    """
    keys_type = T.ArrayType(T.ArrayType(corpus.schema[key].dataType))
    parts_of = [("part", T.IntegerType()), ("keys", keys_type), ("levels", T.BinaryType()), ("vectors", T.BinaryType()), ("links", T.BinaryType()), ("sizes", T.ArrayType(T.IntegerType())), ("widths", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in parts_of])
    arrow = to_arrow_schema(schema)
    rows = corpus.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("k"))).where(F.col("r") <= COPIES)
    nodes = ranked.groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    parts = max(1, -(-rows.count() // part_rows))
    nodes = nodes.select(F.pmod(F.xxhash64(F.lit("part"), "v"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("v").alias("h"), "keys", "v")

    def graph(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hashes = table.column("h").to_numpy()
        order = np.argsort(hashes, kind="stable")
        vectors = np.array(table.column("v").to_pylist(), float)[order]
        levels = levels_of(hashes[order])
        one = Graph.build(unit(vectors), levels).dumps()
        keys = table.column("keys").take(pa.array(order)).to_pylist()
        row = [table.column("part")[0].as_py(), keys, levels.astype(np.int8).tobytes(), *one]
        return pa.table([[x] for x in row], schema=arrow)

    return nodes.groupBy("part").applyInArrow(graph, schema)


def hits(index: DataFrame, queries: DataFrame, query: str, k: int, ef: int = EF) -> DataFrame:
    """query, key, score of each part's ``k`` best, and ``met``, the vectors of the part the query was compared with.

    ``queries`` has ``query`` and ``q`` and at most ``QUERY_BLOCK`` rows.
    """
    own = queries.where("q IS NOT NULL").select(query, "q").toPandas()  # checked by the caller
    kind = index.schema["keys"].dataType.elementType.elementType.simpleString()
    name, names = queries.schema[query].dataType.simpleString(), own[query].tolist()
    types = [to_arrow_type(t) for t in (queries.schema[query].dataType, index.schema["keys"].dataType.elementType.elementType)]
    sent = index.sparkSession.sparkContext.broadcast(unit(np.array(own["q"].tolist() or np.zeros((0, 1)), float)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = np.frombuffer(r["levels"], np.int8)
                graph = Graph.loads(r["vectors"], r["links"], r["sizes"], r["widths"], levels)
                for at in range(0, len(names), WALK_BLOCK):
                    found, sims, met = graph.search(sent.value[at : at + WALK_BLOCK], max(ef, k))
                    rows, keys, scores, counts = [], [], [], []
                    for i in range(len(found)):
                        left = k
                        for node, s in zip(found[i], sims[i], strict=True):
                            if node < 0 or left <= 0:
                                break
                            for key in r["keys"][node][:k]:
                                rows.append(names[at + i])
                                keys.append(key)
                                scores.append(float(s))
                                counts.append(int(met[i]))
                            left -= len(r["keys"][node])
                    yield pa.RecordBatch.from_arrays([pa.array(rows, types[0]), pa.array(keys, types[1]), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], ["query", "key", "score", "met"])

    conf = index.sparkSession.conf  # a part a batch
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")
    return index.mapInArrow(run, f"query {name}, key {kind}, score double, met long").withColumnRenamed("query", query)


def search(index: DataFrame, queries: DataFrame, query: str, k: int = 10, ef: int = EF) -> DataFrame:
    """query, key, score, rank: the ``k`` nearest that the walks of all parts find; ties go to the smaller key.

    More than ``QUERY_BLOCK`` queries are taken in blocks by the hash of the query.
    """
    if k > COPIES:
        raise ValueError(f"k is at most {COPIES}, the keys that a node keeps of equal vectors")
    n = queries.count()
    blocks = 1 if n <= QUERY_BLOCK else -(-2 * n // QUERY_BLOCK)
    block = F.pmod(F.xxhash64(query), F.lit(blocks))
    every = [hits(index, queries if blocks == 1 else queries.where(block == i), query, k, ef) for i in range(blocks)]
    return top(reduce(DataFrame.unionByName, every).drop("met"), [query], "key", k)
