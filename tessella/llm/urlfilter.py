"""URL filter over a sorted digest array.

The rules' strings (host and path joined) are hashed to 64-bit xxhash keys, sorted and written to one
file that every executor fetches once and memory-maps, so all Python workers of a machine share its
pages.  A batch of URLs is turned into candidate strings (host suffixes at label borders, joined with
path prefixes of the lengths that rules have); one vectorised binary search finds the keys, and the
stored full string confirms each hit, so that a hash collision cannot decide a verdict.

A null or empty URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.  A very
long URL is judged whole: it has a candidate for each label of its host and length of a rule's path.  Repeated
rows give repeated results; of rules with the same string the last one holds.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._util import fresh

#: Rules in one index file; more rules make more files, each searched.
MAX_RULES = 50_000_000

Rule = tuple[str, str, str]  # host, path, allow or block
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def write_index(rules: Iterable[Rule], path: str) -> None:
    """The file: counts and the longest host, sorted keys, offsets of the strings, verdicts, lengths of rule paths, strings."""
    unique = {host + path_: verdict == "allow" for host, path_, verdict in (r for r in rules)}
    lengths, longest = sorted({len(r[1]) for r in rules}), max((len(r[0]) for r in rules), default=0)
    texts = [s.encode() for s in unique]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.argsort(keys, kind="stable")
    texts = [texts[i] for i in order]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    allow = np.array(list(unique.values()), np.uint8)[order] if texts else np.zeros(0, np.uint8)
    with open(path, "wb") as out:
        np.array([len(texts), len(lengths), longest], np.int64).tofile(out)
        keys[order].tofile(out)
        offsets.tofile(out)
        np.array(lengths, np.int64).tofile(out)
        allow.tofile(out)
        out.write(b"".join(texts))


class DigestIndex:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        n, m, self.longest = (int(x) for x in np.fromfile(path, np.int64, 3))
        at = 24
        raw = np.memmap(path, np.uint8, "r")
        self.keys, at = raw[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.offsets, at = raw[at : at + 8 * (n + 1)].view(np.int64), at + 8 * (n + 1)
        self.lengths, at = raw[at : at + 8 * m].view(np.int64).tolist(), at + 8 * m
        self.allow, self.strings = raw[at : at + n], raw[at + n :]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Row of each string in the index, or -1."""
        found = np.full(len(texts), -1, np.int64)
        if not len(self.keys) or not texts:
            return found
        probes = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        low = np.searchsorted(self.keys, probes, "left")
        high = np.searchsorted(self.keys, probes, "right")
        for i in np.flatnonzero(high > low):
            for row in range(low[i], high[i]):  # more than one only for colliding keys
                if self.text(row) == texts[i]:
                    found[i] = row
        return found

    def text(self, row: int) -> bytes:
        return self.strings[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def judge(self, hosts: Iterable[str], paths: Iterable[str]) -> Iterator[tuple[str | None, str]]:
        """(rule or None, verdict) of each host and path: of the rules that fit, the longest."""
        probes: list[bytes] = []
        ends: list[int] = []
        for host, path in zip(hosts, paths, strict=True):
            at = max(0, len(host) - self.longest)  # no longer suffix is a rule's host
            if at and host[at - 1] != ".":
                at = host.find(".", at) + 1 or -1
            while host and 0 <= at <= len(host):
                suffix = host[at:]
                probes += [(suffix + path[:n]).encode() for n in self.lengths if n <= len(path)]
                at = host.find(".", at) + 1 or -1
            ends.append(len(probes))
        found, begin = self.find(probes), 0
        for end in ends:
            hit = found[begin:end]
            hit = hit[hit >= 0]
            begin = end
            if not len(hit):
                yield None, "allow"
                continue
            best = max(hit, key=lambda row: (len(self.text(row).decode()), self.text(row)))
            yield self.text(best).decode(), "allow" if self.allow[best] else "block"


_open: dict[str, DigestIndex] = {}
_added: dict[tuple[str, str], list[str]] = {}


def judge_all(indexes: list[DigestIndex], hosts: list[str], paths: list[str]) -> Iterator[tuple[str | None, str]]:
    """(rule or None, verdict) of each host and path: of all indexes' rules that fit, the longest."""
    for found in zip(*(list(x.judge(hosts, paths)) for x in indexes), strict=True):
        yield max(found, key=lambda f: (-1, "") if f[0] is None else (len(f[0]), f[0]))


def _ship(spark: SparkSession, rules: list[Rule]) -> list[str]:
    """Names of the indexes among the files that Spark gives to every executor."""
    digest = hashlib.sha256(repr(rules).encode()).hexdigest()[:24]
    key = (spark.sparkContext.applicationId, digest)
    if key not in _added:
        unique = list({host + path: (host, path, verdict) for host, path, verdict in rules}.values())  # of equal strings the last
        folder = os.path.realpath(tempfile.mkdtemp())  # the driver serves the files from here while it runs
        atexit.register(shutil.rmtree, folder, True)
        names = []
        for i in range(0, max(len(unique), 1), MAX_RULES):
            names.append(f"digests-{digest}-{i // MAX_RULES}.idx")
            write_index(unique[i : i + MAX_RULES], os.path.join(folder, names[-1]))
            spark.sparkContext.addFile(os.path.join(folder, names[-1]))
        _added[key] = names
    return _added[key]


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` with host, path, rule and verdict of ``url``.  No shuffle.

    Where ``keep`` has a column of such a name, the new one gets an underscore after it.
    """
    names = _ship(df.sparkSession, list(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def probe(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        for name in names:
            if name not in _open:
                _open[name] = DigestIndex(SparkFiles.get(name))
        return pd.DataFrame(judge_all([_open[n] for n in names], list(hosts), list(paths)), columns=["rule", "verdict"])

    kept = df.select(*keep)
    host, path, rule, verdict, judged = (fresh(kept, c) for c in ("host", "path", "rule", "verdict", "_judged"))
    parts = df.select(*keep, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path))
    found = parts.withColumn(judged, probe(host, path))
    return found.select(*keep, host, path, F.col(f"{judged}.rule").alias(rule), F.col(f"{judged}.verdict").alias(verdict))
