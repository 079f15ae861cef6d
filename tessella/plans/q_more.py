"""Queries of sources that arrive as files or documents of other services."""

from __future__ import annotations

import contextlib
import zlib

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators.tables import scratch
from tessella.plans import _samples as X
from tessella.plans import _sql as Q
from tessella.plans.registry import query
from tessella.sources import ledger, markup, readers, recorded, sinks
from tessella.sources.tables import table


@query("SELECT event_id, event_type FROM events")
def src_watch_dir(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive in a folder, as a stream that takes what is there; its rows go to the shared folder."""
    schema = table(spark, d, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event*.parquet")
    out = scratch(spark)
    stream = files.select("event_id", "event_type")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def src_txn(spark: SparkSession, d: str) -> DataFrame:
    """Orders in three transactions, one a status; the last breaks on a row, so that none of its rows is seen."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store = ledger.Ledger(spark, scratch(spark))
    bad = F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(7)) == 0, F.raise_error(F.lit("a broken row")).cast("string")).otherwise(F.col("o_orderstatus"))
    for number, (status, value) in enumerate((("F", F.col("o_orderstatus")), ("O", F.col("o_orderstatus")), ("P", bad))):
        with contextlib.suppress(PySparkException):  # what breaks a transaction rolls it back
            store.write(o.where(F.col("o_orderstatus") == status).withColumn("o_orderstatus", value), number)
    return store.rows("o_orderkey long, o_orderstatus string").drop("batch")


@query("SELECT s_name AS company, 'Remote' AS location, coalesce(s_acctbal, 0) > 0 AS paid FROM supplier UNION ALL SELECT c_name, 'Remote', true FROM customer")
def src_free_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Two job APIs of unlike shapes, recorded page by page, mapped to one schema."""
    a = _pages(table(spark, d, "supplier"), "s_suppkey", F.struct(F.struct(F.col("s_name").alias("name")).alias("company"), F.col("s_acctbal").alias("pay")), _JOBS_A)
    b = _pages(table(spark, d, "customer"), "c_custkey", F.struct(F.col("c_name").alias("employer")), _JOBS_B)
    rows = _recorded(spark, a.unionByName(b), _JOBS_A, _JOBS_B)
    x = recorded.typed(rows, _JOBS_A).select("company", (F.coalesce(F.col("pay").cast("double"), F.lit(0.0)) > 0).alias("paid"))
    y = recorded.typed(rows, _JOBS_B).select("company", F.lit(True).alias("paid"))
    return x.unionByName(y).select("company", F.lit("Remote").alias("location"), "paid")


_JOBS_A = recorded.Api("jobs-a", "jobs", "next", (("company", "$.company.name"), ("pay", "$.pay")))
_JOBS_B = recorded.Api("jobs-b", "results", "cursor", (("company", "$.employer"),))
_REPOS = recorded.Api("repos", "items", "next", (("title", "$.full_name"), ("stars", "$.stargazers_count"), ("url", "$.html_url")))


def _pages(rows: DataFrame, key: str, item: Column, api: recorded.Api, size: int = 500) -> DataFrame:
    """Answers of an API: (api, page, body), pages of at most ``size`` neighbouring keys; each but the last names the next."""
    number = F.floor(F.col(key) / size)
    last = rows.agg(F.max(number).alias("last"))
    pages = rows.groupBy(number.alias("n")).agg(F.collect_list(item).alias("found")).crossJoin(F.broadcast(last))  # one row
    following = F.when(F.col("n") < F.col("last"), (F.col("n") + 1).cast("string"))
    return pages.select(F.lit(api.name).alias("api"), F.col("n").cast("string").alias("page"), F.to_json(F.struct(F.col("found").alias(api.items), following.alias(api.token))).alias("body"))


def _recorded(spark: SparkSession, answers: DataFrame, *apis: recorded.Api) -> DataFrame:
    folder = scratch(spark)
    recorded.record(answers, folder)
    return recorded.read(spark, folder, apis)


@query("SELECT c_nationkey, c_name AS company, c_mktsegment AS role, CASE WHEN c_custkey % 5 = 0 THEN 'Remote' ELSE 'City ' || c_custkey END AS location, CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE 'https://jobs.example/' || c_custkey END AS link FROM customer WHERE c_custkey % 7 <> 0")
def src_html_table(spark: SparkSession, d: str) -> DataFrame:
    """Job lists as HTML tables, of a nation's hundred customers at most: rows of company, role, place and link; missing cells get a default, rows without a company go."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    name = F.when(k % 7 == 0, "Unknown").otherwise(F.col("c_name"))
    link = F.when(k % 3 == 0, F.lit("closed")).otherwise(F.concat(F.lit('<a class="b" href="https://jobs.example/'), k, F.lit('"> Apply </a>')))
    place = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" City <b>"), k, F.lit("</b> ")))
    row = F.concat(F.lit("<tr>"), cell(F.lit("<strong>"), name, F.lit("</strong>")), cell("c_mktsegment"), cell(place), cell(link), F.lit("</tr>\n"))
    pages = c.groupBy("c_nationkey", F.floor(k / 100)).agg(F.concat(F.lit("<p>jobs</p><table><thead><tr><th>company</th></tr></thead><tbody>"), F.array_join(F.collect_list(row), ""), F.lit("</tbody></table>")).alias("html"))
    first = lambda row, i, j, default: (row[i][j] if len(row) > i else "") or default
    jobs = lambda text: [(first(r, 0, 0, "Unknown"), first(r, 1, 0, "Unknown"), first(r, 2, 0, "Remote"), next((x for _, x in r if x), "#")) for t in markup.tables(text) for r in t]
    return markup.parsed(pages, "html", ["c_nationkey"], jobs, "company string, role string, location string, link string").where("company <> 'Unknown'")


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query(f"SELECT page_id, 0 AS pos, {_TITLE} AS title, url AS link FROM pages WHERE {_TITLE} <> '' UNION ALL SELECT page_id, 1, 'again ' || page_id, url || '?again' FROM pages")
def src_rss(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of three items; an item without title or link is left out.  Texts are kept as the feed spells them."""
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    item = lambda a, b: F.concat(F.lit("<item>\n<title type='text'> "), a, F.lit("\n</title><link> "), b, F.lit(" </link></item>"))
    feed = F.concat(F.lit("<rss>"), item(title, F.col("url")), item(F.concat(F.lit("again "), "page_id"), F.concat("url", F.lit("?again"))), item(F.lit("no link"), F.lit("")), F.lit("</rss>"))
    one = lambda x, f: x.get(f, [""])[0].strip()
    read = lambda text: [(pos, one(x, "title"), one(x, "link")) for pos, x in enumerate(markup.items(text, "item", ("title", "link"), resolve=False))]
    found = markup.parsed(table(spark, d, "pages").select("page_id", feed.alias("x")), "x", ["page_id"], read, "pos int, title string, link string")
    return found.where("title <> '' AND link <> ''")


#: Subjects that a feed of papers leaves out.
IRRELEVANT = [
    "cosmic ray", "cloud chamber", "cern", "particle physics", "hadron", "neutrino", "quantum chromodynamics", "aerosol", "meteorolog", "climatolog", "atmospheric physics", "geophysic", "astrophysic",
]
_PAPER = ["On sorting", "A cosmic ray survey", "Deep  nets\n again", "Aerosol and code"]


@query(f"""SELECT doc_id, 'http://papers.example/' || doc_id AS id, regexp_replace(trim(t), '\\s+', ' ', 'g') AS title, 'of ' || lang || ' text' AS summary, '2024-01-0' || (doc_id % 9 + 1) AS published, coalesce(source, 'none') || ',B. Author' AS authors, CASE WHEN doc_id % 2 = 0 THEN 'http://papers.example/' || doc_id || '.pdf' END AS pdf_url
 FROM (SELECT *, {X.pick_sql(_PAPER, 'doc_id')} AS t FROM documents) WHERE NOT {Q.any_of("lower(regexp_replace(t, '\\s+', ' ', 'g') || ' of ' || lang || ' text')", IRRELEVANT)}""")
def src_atom(spark: SparkSession, d: str) -> DataFrame:
    """Papers of a feed: id, title, summary, date, authors and file; those of other subjects are left out."""
    k = F.col("doc_id").cast("string")
    pdf = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<link title="pdf" rel="related" href="http://papers.example/'), k, F.lit('.pdf"/>'))).otherwise("")
    xml = F.concat(
        F.lit("<feed><entry><id>http://papers.example/"), k, F.lit("</id><title>\n "), X.pick(_PAPER, F.col("doc_id")), F.lit(" </title><summary> of\n"), "lang", F.lit("  text </summary><published>2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"),
        F.lit("</published><author><name>"), F.coalesce("source", F.lit("none")), F.lit("</name></author><author><name> B. Author</name></author>"), pdf, F.lit("</entry></feed>"),
    )
    flat = lambda x, f: " ".join(x.get(f, [""])[0].split())
    file = lambda x: next((h for h, t in zip(x.get("link@href", []), x.get("link@title", []), strict=False) if t == "pdf"), None)
    papers = lambda text: [(*(flat(x, f) for f in ("id", "title", "summary", "published")), ",".join(n.strip() for n in x.get("name", [])), file(x)) for x in markup.items(text, "entry", ("id", "title", "summary", "published", "name", "link"))]
    found = markup.parsed(table(spark, d, "documents").select("doc_id", xml.alias("x")), "x", ["doc_id"], papers, "id string, title string, summary string, published string, authors string, pdf_url string")
    return found.where(~S.any_of(F.lower(F.concat_ws(" ", "title", "summary")), IRRELEVANT))


_MARKED = X.pick_sql(X.PAGES, "page_id") + " || html"


def _markdown_sql() -> str:
    x = _MARKED
    for pattern, by in readers.MARKDOWN:
        x = f"regexp_replace({x}, {Q.text(pattern)}, {Q.text(by.replace('$', chr(92)))}, 'g')"
    for entity, char in readers.ENTITIES:
        x = f"replace({x}, {Q.text(entity)}, {Q.text(char)})"
    for pattern, by in readers.BLANKS:
        x = f"regexp_replace({x}, {Q.text(pattern)}, {Q.text(by)}, 'g')"
    title = f"coalesce(nullif(trim(regexp_extract({_MARKED}, '<title>([^<]*)</title>', 1)), ''), 'Untitled')"
    return f"SELECT page_id, '# ' || {title} || chr(10) || chr(10) || '> Source: ' || url || chr(10) || chr(10) || {x} AS text FROM pages"


@query(_markdown_sql())
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown under their title and source: headings, links, lists, emphasis and code stay."""
    html = F.concat(X.pick(X.PAGES, F.col("page_id")), F.col("html"))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), F.lit("")), F.lit("Untitled"))
    text = markup.parsed(table(spark, d, "pages").select("page_id", "url", title.alias("title"), html.alias("html")), "html", ["page_id", "url", "title"], lambda t: [(markup.markdown(t),)], "body string")
    return text.select("page_id", F.concat(F.lit("# "), "title", F.lit("\n\n> Source: "), "url", F.lit("\n\n"), "body").alias("text"))


@query()
def html_readable(spark: SparkSession, d: str) -> DataFrame:
    """The main text of every page, and how many blocks are part of it or not; navigation, advertisements and footers go."""
    return markup.parsed(table(spark, d, "pages"), "html", ["page_id"], lambda t: [markup.readable(t)], "text string, kept int, dropped int")


def _repositories(spark: SparkSession, d: str) -> DataFrame:
    """Recorded pages of a repository API; of every tenth there is a second recording, cut off, and the last names one that is not there."""
    item = F.struct(F.col("p_name").alias("full_name"), F.col("p_size").cast("long").alias("stargazers_count"), F.concat(F.lit("https://example.com/"), "p_partkey").alias("html_url"))
    pages = _pages(table(spark, d, "part"), "p_partkey", item, _REPOS, 100)
    cut = pages.where("page % 10 = 0").select("api", F.concat("page", F.lit("-again")).alias("page"), F.substring("body", 1, 50).alias("body"))
    end = pages.where("page = 0").select("api", F.lit("end").alias("page"), F.lit('{"items": [], "next": "lost"}').alias("body"))
    return _recorded(spark, pages.unionByName(cut).unionByName(end), _REPOS)


@query("SELECT p_name AS title, p_size::BIGINT AS stars, 'https://example.com/' || p_partkey AS url FROM part")
def src_http(spark: SparkSession, d: str) -> DataFrame:
    """Items of all pages that can be read."""
    return recorded.typed(_repositories(spark, d), _REPOS).select("title", F.col("stars").cast("long").alias("stars"), "url")


@query("SELECT 'repos' AS api, p || '-again' AS page, false AS absent FROM (SELECT DISTINCT p_partkey // 100 AS p FROM part) WHERE p % 10 = 0 UNION ALL SELECT 'repos', 'lost', true")
def src_http_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages that could not be read, and the one that was never recorded."""
    return recorded.errors(_repositories(spark, d)).select("api", "page", (F.col("error") == "not recorded").alias("absent"))


@query("SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id ORDER BY k LIMIT 100")
def st_skiplist(spark: SparkSession, d: str) -> DataFrame:
    """The smallest keys of a sorted map."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").limit(100)


def _answers(body: str, attempt: int) -> bool:
    """A service that is busy at the first call for some bodies, and always for a few."""
    busy = zlib.crc32(body.encode()) % 8
    return busy > 1 or busy == 1 and attempt > 1


@query("SELECT vec_id, count(*) AS n, round(sum(x), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def sink_vec_remote(spark: SparkSession, d: str) -> DataFrame:
    """Points of a vector service in request bodies of at most 100: written with their states, and read back; those that fail are sent in a second batch."""
    bodies = ledger.bodies(table(spark, d, "embeddings"), "vec_id", "embedding")
    store, schema = ledger.Ledger(spark, scratch(spark)), "body string, n long, tries int, state string"
    store.write(ledger.delivered(bodies, "body", _answers), 0)
    again = store.rows(schema).where("batch = 0 AND state = 'failed'").select("body", "n")
    store.write(ledger.delivered(again, "body", lambda body, attempt: True), 1)
    back = store.rows(schema).where("state = 'sent'").select(F.explode(F.from_json("body", "points array<struct<id: long, vector: array<float>>>")["points"]).alias("p"))
    values = back.select(F.col("p.id").alias("vec_id"), F.explode("p.vector").alias("x"))
    return values.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))
