"""Not-modified revisits in web archives, resolved to the response they stand for.

A revisit record says that a page had not changed.  It is joined, as of its time, to the latest earlier
full response of the same canonical URL; its validators are checked against that response, and the
headers that a 304 answer may update are merged into the response's.

The as-of join is by window within (URL, range of times).  The ranges are quantiles of all times, so the
rows of one URL, however many, are spread over up to ``RANGES`` groups; what a group needs from earlier
ones is the last response of each, carried over by a second window over at most ``RANGES`` rows a URL.

A null URL has no canonical form and its revisits find nothing.  Of records with equal times the one
with the smaller id is the earlier; null times come first.  Null headers are none; of header names that differ only in case the
last one holds.  Repeated records are resolved each by itself.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = 64
#: Headers that a 304 answer may carry and a cache then updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, leading ``www.``, default ports, fragment and last slash go; the host is lower-cased."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(rest, "^[^/?]*(.*)$", 1)), "/$", "")


def lower_headers(headers: Column) -> Column:
    """A map with lower-case names; null is empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with the permitted ones of the revisit over them."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def verdict_of(response: Column, revisit: Column, response_digest: Column, digest: Column) -> Column:
    """The first validator that both have decides: entity tag (weakly), time of change, digest."""
    both = lambda name: response[name].isNotNull() & revisit[name].isNotNull()
    say = lambda same: F.when(same, "resolved").otherwise("mismatch")
    return (
        F.when(both("etag"), say(_strong(response["etag"]) == _strong(revisit["etag"])))
        .when(both("last-modified"), say(response["last-modified"] == revisit["last-modified"]))
        .when(response_digest.isNotNull() & digest.isNotNull(), say(response_digest == digest))
        .otherwise("unchecked")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of records (id, url, ts, kind, status, headers, digest).

    Returns id, url_key, ts, response_id, response_ts, verdict and headers: merged where the verdict is
    not ``mismatch`` or ``no_response``, else the revisit's own.
    """
    rows = records.select("id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status", lower_headers(F.col("headers")).alias("headers"), "digest")
    rows = rows.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200)))
    cuts = rows.agg(F.percentile_approx("ts", [i / RANGES for i in range(1, RANGES)], 10000).alias("q")).first()["q"] or []
    place = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    full = F.when(F.col("kind") == "response", F.struct("id", "ts", "headers", "digest"))
    rows = rows.withColumn("place", place).withColumn("full", full)
    near = Window.partitionBy("url_key", "place").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("here", F.last("full", ignorenulls=True).over(near)).where("kind = 'revisit'").drop("full", "kind", "status")
    ends = rows.where("url_key IS NOT NULL").groupBy("url_key", "place").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    joined = seen.join(ends, ["url_key", "place"], "left").withColumn("found", F.when(F.col("url_key").isNotNull(), F.coalesce("here", "carried")))
    verdict = F.when(F.col("found").isNull(), "no_response").otherwise(verdict_of(F.col("found.headers"), F.col("headers"), F.col("found.digest"), F.col("digest")))
    joined = joined.withColumn("verdict", verdict)
    merged = F.when(F.col("verdict").isin("resolved", "unchecked"), merge_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return joined.select("id", "url_key", "ts", F.col("found.id").alias("response_id"), F.col("found.ts").alias("response_ts"), "verdict", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records of pages' URLs over time.

    Every page is a response, tagged by its content; every third has changed 2,000 later, and every fifth once more
    at 6,000.  A revisit at 4,005 names the tag of that time, or for every fourth page still the first one, which
    for changed pages no longer holds; every ninth page has one before its first response as well.
    """
    k, tag = F.col("page_id"), F.md5("html")
    changed = F.md5(F.concat("html", F.lit("2")))

    def response(rows: DataFrame, at: int, tag) -> DataFrame:
        typed = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), (k + at).cast("string"), F.lit("Server"), F.lit("origin"))
        return rows.select((k * 10 + F.lit(at % 7)).alias("id"), "url", (k * 10 + at).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), typed.alias("headers"), tag.alias("digest"))

    def revisit(rows: DataFrame, at: int, tag) -> DataFrame:
        again = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), (k + at).cast("string"), F.lit("server"), F.lit("edge"))
        return rows.select((k * 10 + F.lit(7 + (at < 0))).alias("id"), "url", (k * 10 + at).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"), tag.alias("digest"))

    now = F.when((k % 3 == 0) & (k % 4 != 0), changed).otherwise(tag)
    parts = [
        response(pages, 0, tag), response(pages.where(k % 3 == 0), 2000, changed), response(pages.where(k % 5 == 0), 6000, F.md5(F.concat("html", F.lit("3")))),
        revisit(pages, 4005, now), revisit(pages.where(k % 9 == 0), -5, tag),
    ]
    return reduce(DataFrame.unionByName, parts)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed WARC file: version, headers (lower-case names) and block.

    What is no record is skipped, up to the next line that begins one.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 and data.startswith(b"WARC/", at) else []
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = headers.get("content-length", "")
        if not head or not size.isdigit() or end + 4 + int(size) > len(data):
            at = data.find(b"\nWARC/", at) + 1
            if not at:
                return
            continue
        size = int(size)
        yield {"version": head[0], "headers": headers, "block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (id, url, ts, kind, status, headers, digest) of the WARC files of a path, gzipped or not.

    Each file is read whole by the task that parses it, so files should have the usual size of a gigabyte at
    most.  Records without a target, and other kinds than responses and revisits, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for r in parse_warc(data):
                    h = r["headers"]
                    if h.get("warc-type") in ("response", "revisit") and "warc-target-uri" in h:
                        first, *lines = r["block"].partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")
                        status = re.match(r"HTTP/\S+ (\d{3})", first)
                        pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
                        yield pa.RecordBatch.from_pylist(
                            [{"id": h.get("warc-record-id"), "url": h["warc-target-uri"], "at": h.get("warc-date"), "kind": h["warc-type"], "status": int(status[1]) if status else None, "names": [k for k, _ in pairs], "values": [v for _, v in pairs], "digest": h.get("warc-payload-digest")}],
                            pa.schema([("id", pa.string()), ("url", pa.string()), ("at", pa.string()), ("kind", pa.string()), ("status", pa.int32()), ("names", pa.list_(pa.string())), ("values", pa.list_(pa.string())), ("digest", pa.string())]),
                        )

    schema = "id string, url string, at string, kind string, status int, names array<string>, values array<string>, digest string"
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    names = F.transform("names", lambda x: F.lower(x))
    last = F.transform(F.array_distinct(names), lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), F.col("values").alias("v")), lambda p: p["n"] == n), -1)["v"])
    return found.select("id", "url", F.unix_micros(F.try_to_timestamp("at")).alias("ts"), "kind", "status", F.map_from_arrays(F.array_distinct(names), last).alias("headers"), "digest")


def format_warc(records: list[dict]) -> bytes:
    """The inverse of ``parse_warc``."""
    out = []
    for r in records:
        head = {**r["headers"], "content-length": str(len(r["block"]))}
        out.append("\r\n".join([r["version"], *(f"{k}: {v}" for k, v in head.items())]).encode() + b"\r\n\r\n" + r["block"] + b"\r\n\r\n")
    return b"".join(out)
