"""Vectorised text primitives shared by the corpus operators.

All of them work on the UTF-8 bytes of an Arrow string column, a few megabytes at a time, so that
memory follows the slice and not the batch.  A word is a maximal run of bytes other than
``\\x20`` and ``\\x09``-``\\x0D``; as these are ASCII, the byte runs are the code point runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 2 << 20
_CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mask_of(chars: str) -> np.ndarray:
    """A byte table that is true for the ASCII characters given."""
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode("ascii"), np.uint8)] = True
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty; offsets start at 0."""
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``limit`` text bytes; a longer text is a part alone."""
    n = batch.num_rows
    sizes = np.zeros(n + 1, np.int64)
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0)
    np.cumsum(lengths.to_numpy(zero_copy_only=False), out=sizes[1:])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of ``mask``; runs don't cross document offsets."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", _P_INV)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte run: a polynomial by prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, low + _CHUNK)))
            part = data[low : int(ends[to - 1])]
            up, down = _pow(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
    return out


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hashes, starts, ends, bounds): words of document i are ``bounds[i]:bounds[i + 1]``."""
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    starts, ends = runs(IS_WORD[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    return data, hash_runs(data, starts, ends), starts, ends, bounds


def word_hash(word: str) -> int:
    """The hash that ``words`` gives for one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_runs(data, np.array([0]), np.array([len(data)]))[0])
