"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from tessella.plans import registry
from tools_oracle import TABLES, plain

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
    QUERIES[name](spark, sf).toPandas()


#: Columns of results that must not have one value only, as the rules they come from have several outcomes.
DECIDING = {
    "filt_audit": "risk", "filt_log": "healthy", "sc_persona": "persona", "sc_category": "category", "sc_antipattern": "grade", "sc_complexity": "rating", "sc_cmd_match": "score", "sc_codeblocks": "language",
    "sc_query_quality": "domain", "x_url_type": "kind", "x_url_bloom": "fresh", "x_domain_rules": "domain", "x_backfill": "changed", "ret_sem_cache": "tier", "ret_federated": "src", "dl_verify": "status",
    "g_schedule": "hours", "g_mastery": "status", "agg_usage": "unused", "sq_quiz_update": "best_streak", "x_traffic_sim": "event", "x_metric_summary": "part", "sink_outbox": "state", "sq_patterns": "confidence", "x_topic_ttl": "accepted",
    "src_json_nested": "url", "sm_ratelimit": "accepted", "sm_alert": "state", "st_coalesce": "event_id", "src_http_errors": "absent", "sink_graph_json": "part",
}


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_has_rows_and_outcomes(larger, name):
    rows = larger.execute(SQL[name]).fetchdf()
    assert len(rows)
    if name in DECIDING:
        assert rows[DECIDING[name]].map(str).nunique() > 1


def test_a_mean_on_a_half_is_rounded_like_the_sql(spark, larger):
    """on these tables the mean is 84.71 / 172 = 0.4925."""
    got = QUERIES["x_notify_rank"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.loc[got["part"] == "mean", "value"].tolist() == [0.493]
    assert plain(got) == plain(larger.execute(SQL["x_notify_rank"]).fetchdf())


#: Texts that Java's regular expressions and case rules read otherwise than the SQL.
READ_OTHERWISE = [
    "raqueó ñllm las", "ll\u1e3f", "x á llmé", "treé and étree", "a\u0130 MODEL", "A\u0130 MODEL", "doc\u212aer", "tree\u0301", "# one\r\n# two\rthree\n", "# a\u2028b\n# c\u0085d", "# a\xa0\n#  \u3000b\u2003\n",
    "#\vno topic", "\u017fubject: a", "V\u1ec0: b", "top\u0130c: c", "top\u0131c: d", "\v\vabcdefghi. abcdefgh\v\v. abcdefghij \u2028. abcdefghij \n", "e\u0301" * 1100, None, "",
]


@pytest.mark.parametrize("at", range(len(READ_OTHERWISE)))
def test_categories_of_texts_that_java_reads_otherwise(spark, tmp_path, at):
    """a word bound beside a letter beyond ASCII, other ends of lines, spaces and capitals; behind each head."""
    spark.createDataFrame([(i, READ_OTHERWISE[at]) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["sc_category"](spark, str(tmp_path)).toPandas(), con.execute(SQL["sc_category"]).fetchdf()
    assert len(got) == 6 and plain(got) == plain(want)
