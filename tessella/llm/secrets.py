"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two models of character pairs, one of random strings and one of ordinary identifiers and words, are
trained from labelled samples: keys and identifiers made by rule, and, where labelled documents are given,
strings of all of them that are surely one or the other (``fit``).  Every run of at least
``MIN_RUN`` characters of a key alphabet is scored by the ratio of both; a run that the random model explains
better by a margin, in bits a character, becomes a span of kind ``random``, unless a pattern's span covers it.
The margin is ``MARGIN``, or with labelled documents a larger one that leaves few false spans on their prose and
still finds the keys it should.  Patterns' spans always stay.

A null text is an empty one; spans are code points of the whole text, end exclusive.  Repeated rows are
scanned each by itself.  Without labelled documents, or where all are empty, the samples made by rule serve.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _text
from tessella.llm._util import slim, staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX = _text.mask_of("0123456789abcdef")
_KEY = _text.mask_of(string.ascii_letters + string.digits + "+/_=-")
_LETTER, _UPPER, _LOWER_CASE = (_text.mask_of(x) for x in (string.ascii_letters, string.ascii_uppercase, string.ascii_lowercase))
MIN_RUN, MARGIN = 16, 1.0
#: Strings made by rule that train both models.
SAMPLES = 20_000
#: Labelled keys up to which their list is broadcast.
BROADCAST_LABELS = 1_000_000
#: Spans in a million words of labelled documents that the margin may leave.
FALSE_SPANS = 1.0
#: Share of unseen keys made by rule that the margin must leave.
KEY_RECALL = 0.97
#: Histogram of scores by which the margin is set: from MARGIN up, in steps of bits a character.
STEP, STEPS = 0.02, 400

#: Words of which ordinary identifiers are made.
WORDS = """account active address amount array async attribute author average base batch block body buffer build bytes cache
call category center chunk class client code color column command comment config connection content context copy count create
current data date default delete description device document domain element email enable encoding entry error event example
export factory field file filter first flag folder format frame function group handler header height hidden history image
import index input instance integer internal item iterator label language last layout length level library limit line link
list loader local location lock manager map mask master match matrix maximum memory merge message method minimum mode model
module month name network node number object offset option order output owner package page parameter parent parser partition
path pattern payload payment pixel plugin point policy position prefix price print process product profile project property
provider proxy public query queue random range reader record reference region register remote render report request resource
response result return role root route row rule sample scale schema scope score screen search section select sequence server
service session setting shape shared signal simple size slice snapshot socket sort source space stack standard start state
status storage stream string style subject suffix summary symbol system table target task template test text theme thread
time title total trace track transaction transform tree trigger type union unique unit update upload user utility valid value
variable vector version view visible weight width window worker wrapper writer zone""".split()


def labelled_samples(rows: int = SAMPLES, seed: int = 11) -> list[tuple[str, bool]]:
    """(string, is random): keys over usual alphabets, and identifiers, paths and numbers as people write them."""
    rng = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-")
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), True) for _ in range(rows // 2)]
    for _ in range(rows - len(out)):
        parts = rng.choices(WORDS, k=rng.randint(2, 5))
        style = rng.randrange(7)
        text = ("_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(map(str.title, parts[1:])), "_".join(parts).upper(), "".join(parts), rng.choice("=-_") * rng.randint(16, 40))[style]
        out.append((text + (str(rng.randint(0, 2030)) if rng.random() < 0.2 else ""), False))
    return out


def pair_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of neighbouring characters in runs of ASCII bytes, each run between border marks."""
    out = np.zeros(128 * 128, np.int64)
    if len(starts):
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside)[:-1] > 0
        first = np.zeros(len(data), bool)
        first[starts] = True
        codes = data.astype(np.int64) & 127
        both = np.flatnonzero(inside[1:] & ~first[1:]) + 1
        for pairs in (codes[both - 1] * 128 + codes[both], codes[starts], codes[ends - 1] * 128):
            out += np.bincount(pairs, minlength=128 * 128)
    return out.reshape(128, 128)


def counts_of(texts: Iterable[str]) -> np.ndarray:
    data, offsets = _text.flat(pa.array([t.encode("ascii", "ignore").decode() for t in texts], pa.string()))
    own = np.diff(offsets) > 0
    return pair_counts(data, offsets[:-1][own], offsets[1:][own])


class RatioScorer:
    """Bits a character by which the random model explains a run better: log2 P(next | character) of both."""

    def __init__(self, samples: Iterable[tuple[str, bool]], more: tuple[np.ndarray, np.ndarray] | None = None, margin: float = MARGIN):
        samples = list(samples)
        logs = []
        for k, kind in enumerate((True, False)):
            counts = counts_of(t for t, r in samples if r is kind) + 0.05
            if more is not None:
                counts = counts + more[k]
            logs.append(np.log2(counts / counts.sum(1, keepdims=True)))
        self.ratio, self.margin = logs[0] - logs[1], margin

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts))
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            codes = data[s:e] & 127
            out[i] = (self.ratio[codes[:-1], codes[1:]].sum() + self.ratio[0, codes[0]] + self.ratio[codes[-1], 0]) / (e - s)
        return out


def scan(column: pa.Array, scorer: RatioScorer) -> list[list[tuple[int, int, int]]]:
    """For every text its spans (start, kind number, end), sorted."""
    data, offsets = _text.flat(column)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    n = len(data)
    spans: list[tuple[int, int, int]] = []  # in bytes of the slice
    starts, ends = _text.runs(_HEX[data], offsets)
    long = ends - starts >= 16
    spans += [(int(s), 2, int(e)) for s, e in zip(starts[long], ends[long], strict=True)]
    raw = data.tobytes()
    lower = raw.lower()
    rows = set()
    for name in _NAMES:
        at = lower.find(name.encode())
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            rows.add(row)
            at = lower.find(name.encode(), int(offsets[row + 1]))
    at = raw.find(b"AKIA")
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        rows.add(row)
        at = raw.find(b"AKIA", int(offsets[row + 1]))
    for row in rows:
        text = raw[offsets[row] : offsets[row + 1]].decode()
        found[row] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        found[row] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    starts, ends = _text.runs(_KEY[data], offsets)
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    chosen = scorer.score(data, starts, ends) >= scorer.margin
    spans += [(int(s), 3, int(e)) for s, e in zip(starts[chosen], ends[chosen], strict=True)]
    # byte positions to code points of their text
    if spans:
        spans.sort()
        row, at, points = -1, 0, 0
        for s, kind, e in spans:
            new = int(np.searchsorted(offsets, s, "right")) - 1
            if new != row:
                row, at, points = new, int(offsets[new]), 0
            points += s - at - int(np.count_nonzero((data[at:s] & 0xC0) == 0x80))
            at = s
            found[row].append((points, kind, points + e - s))  # a run is ASCII
    for spans_ in found:
        spans_.sort()
        base = [(s, e) for s, k, e in spans_ if k < 3]
        if len(base) < len(spans_):
            spans_[:] = uncovered(spans_, base)
    return found if n else [[] for _ in found]


def uncovered(spans: list[tuple[int, int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans without the added ones that lie inside the furthest-reaching base span begun by then."""
    out, i, reach = [], 0, -1
    for s, k, e in spans:
        while i < len(base) and base[i][0] <= s:
            reach = max(reach, base[i][1])
            i += 1
        if k < 3 or e > reach:
            out.append((s, k, e))
    return out


def spelled(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: Iterable[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal union of spans replaced by the mark."""
    out, at, merged = [], 0, []
    for s, _, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def prose_shaped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for runs written like words: letters and dashes only, and capitals none, at first places or everywhere."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[data] | (data == ord("-")))])
    inner = _UPPER[data]
    inner[1:] &= _LETTER[data[:-1]]  # capitals behind a letter
    inner_sum, lower_sum = np.concatenate([[0], np.cumsum(inner)]), np.concatenate([[0], np.cumsum(_LOWER_CASE[data])])
    inner_n = inner_sum[ends] - inner_sum[np.minimum(starts + 1, ends)]
    return (letters[ends] - letters[starts] == ends - starts) & ((inner_n == 0) | (lower_sum[ends] == lower_sum[starts]))


def key_recall_margin(scorer: RatioScorer, recall: float = KEY_RECALL, seed: int = 29) -> float:
    """The largest margin at which the share ``recall`` of keys made by rule, that trained no model, is still found."""
    keys = [t for t, r in labelled_samples(4000, seed) if r]
    data, offsets = _text.flat(pa.array(keys))
    return float(np.quantile(scorer.score(data, offsets[:-1], offsets[1:]), 1 - recall))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id") -> RatioScorer:
    """Models of the samples made by rule and of all labelled documents, and the margin by all of them.

    A long run that no pattern holds may be a key or a word: nothing says which, so it trains no model.  The
    ordinary model learns from runs too short to be a key, the random one from long runs in patterns' spans.  False
    spans are counted among long runs shaped like prose, in each half of the documents by models that the other half
    trained, and the margin never goes beyond the one that still finds ``KEY_RECALL`` of unseen keys made by rule.
    So secrets in labelled documents, however many, cost no recall.

    What comes to the driver is a table of character pairs for each half and kind and a histogram, whatever the corpus.
    """
    if label_key not in labels.columns or key not in df.columns:
        raise ValueError(f"labels need the column {label_key}, documents {key}")
    own = staged(labels.select(F.col(label_key).alias("k")).where("k IS NOT NULL").distinct(), "labelled")
    if own.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    half = F.pmod(F.xxhash64("k"), F.lit(2)).alias("half")
    some = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t")).join(own, "k", "left_semi").select(half, "t")
    made = labelled_samples()
    plain = RatioScorer(made, margin=np.inf)  # patterns only

    def split(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Runs of the key alphabet in a slice: bytes, starts, ends, whether a pattern's span holds them, and their half."""
        data, offsets = _text.flat(part.column("t"))
        starts, ends = _text.runs(_KEY[data], offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        later = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        point = starts - offsets[row] - (later[starts] - later[offsets[row]])
        held = np.zeros(len(starts), bool)
        for i, spans in enumerate(scan(part.column("t"), plain)):
            first, last = np.searchsorted(row, [i, i + 1])
            for s, _, e in spans:
                held[first:last] |= (point[first:last] + (ends - starts)[first:last] > s) & (point[first:last] < e)
        return data, starts, ends, held, part.column("half").to_numpy(zero_copy_only=False)[row]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, 128, 128), np.int64)
        for part in (x for batch in batches for x in _text.slices(batch, "t")):
            data, starts, ends, held, halves = split(part)
            size = ends - starts
            for h in range(2):
                for k, own in enumerate((held & (size >= MIN_RUN), ~held & (size >= 4) & (size < MIN_RUN))):
                    of = own & (halves == h)
                    sums[h, k] += pair_counts(data, starts[of], ends[of])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["pair", "n"])

    more = np.zeros(2 * 2 * 128 * 128)
    for r in some.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 4 x 128 x 128 at most
        more[r.pair] = r.n
    more = more.reshape(2, 2, 128, 128)
    scorer, unseen = RatioScorer(made, tuple(more.sum(0))), [RatioScorer(made, tuple(more[1 - h])) for h in range(2)]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, n = np.zeros(STEPS + 1, np.int64), 0
        for part in (x for batch in batches for x in _text.slices(batch, "t")):
            data, starts, ends, held, halves = split(part)
            n += len(starts)
            long = ~held & (ends - starts >= MIN_RUN) & prose_shaped(data, starts, ends)
            for h in range(2):
                found = unseen[h].score(data, starts[long & (halves == h)], ends[long & (halves == h)])
                bins += np.bincount(np.clip((found[found >= MARGIN] - MARGIN) // STEP, 0, STEPS).astype(np.int64), minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, STEPS + 1)), pa.array(np.append(n, bins))], ["bin", "n"])

    bins = {r.bin: r.n for r in some.mapInArrow(scores, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    words, above, at = bins.pop(-1, 0), sum(bins.values()), 0
    while at <= STEPS and above > FALSE_SPANS * words / 1e6:
        above -= bins.get(at, 0)
        at += 1
    scorer.margin = min(MARGIN + at * STEP, max(MARGIN, key_recall_margin(scorer)))
    return scorer


def _scorer(df: DataFrame, key: str, text: str, samples: Iterable[tuple[str, bool]] | None, labels: DataFrame | None) -> RatioScorer:
    if labels is not None:
        return fit(df, labels, key, text)
    return RatioScorer(labelled_samples() if samples is None else samples)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", samples: Iterable[tuple[str, bool]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """key, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row.  No shuffle.

    ``labels`` names labelled documents of ``df`` by ``doc_id``; without them ``samples``, or those made by rule, train.
    """
    scorer = _scorer(df, key, text, samples, labels)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "t"):
                found = scan(part.column("t"), scorer)
                counts = [pa.array([sum(k == n for _, k, _ in spans) for spans in found], pa.int64()) for n in range(4)]
                base = pa.array([hashlib.sha256(spelled(x for x in spans if x[1] < 3).encode()).hexdigest() for spans in found])
                yield pa.RecordBatch.from_arrays([part.column("k"), *counts, base, pa.array(map(spelled, found), pa.string())], ["k", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    out = slim(df).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    return out.withColumnRenamed("k", key)


def redact_secrets(df: DataFrame, text: str = "text", samples: Iterable[tuple[str, bool]] | None = None, labels: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``df`` with each secret in ``text`` replaced by a mark; a null text stays null.  No shuffle."""
    scorer = _scorer(df, key, text, samples, labels)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, text):
                texts = part.column(at).to_pylist()
                clean = [redact(t, s) if s else t for t, s in zip(texts, scan(part.column(at), scorer), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return slim(df).mapInArrow(run, df.schema)
