"""Markup in one pass: nested and broken pages, tables, feeds, and the readable part."""

import re

import pytest

from tessella.plans import q_more
from tessella.sources import markup as M


def shape(text):
    return [(k, v) for k, v, _, _ in M.nested(text)]


def test_tokens_of_all_kinds():
    got = list(M.tokens("""<!DOCTYPE html><a href='x?a=1&amp;b' data-n=3 open>T&eacute;&#65;&#x42;<!-- no <b> --> <![CDATA[<raw>&amp;]]></A><br/><script>if (a < b) "</p>"</script>1 < 2<img src=q>"""))
    assert got == [
        ("open", "a", {"href": "x?a=1&b", "data-n": "3", "open": ""}), ("text", "TéAB", {}), ("text", " ", {}), ("text", "<raw>&amp;", {}), ("close", "a", {}), ("open", "br", {}), ("close", "br", {}),
        ("open", "script", {}), ("close", "script", {}), ("text", "1 ", {}), ("text", "<", {}), ("text", " 2", {}), ("open", "img", {"src": "q"}), ("close", "img", {}),
    ]


@pytest.mark.parametrize("text", ["", "<", "<p", "</p></b>", "<p><b>x", "<!-- open", "<![CDATA[x", "a<b>c</i></b>", "<li><li></ul><td>", "<script>never closed <p>", "<p title='a>b'>x</p>", "&#xZZ; &bogus; &#99999999;"])
def test_broken_markup_nests_and_loses_no_text(text):
    depth = 0
    for kind, _ in shape(text):
        depth += {"open": 1, "close": -1}.get(kind, 0)
        assert depth >= 0
    assert depth == 0
    for f in (M.markdown, M.readable, M.tables):
        f(text)


def test_missing_ends_are_put_in():
    assert M.markdown("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>").split() == ["a", "b", "c", "d"]
    assert shape("<p>a<p>b<div>c</div>") == [("open", "p"), ("text", "a"), ("close", "p"), ("open", "p"), ("text", "b"), ("open", "div"), ("text", "c"), ("close", "div"), ("close", "p")]
    assert M.tables("<table><tr><td>1<td>2<tr><td>3</table>") == [[[("1", ""), ("2", "")], [("3", "")]]]


def test_markdown_of_nested_elements():
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav><h2>A <em>b</em></h2><p>See <a href='u'>this <b>one</b></a>.</p><ul><li>x<ul><li>y</li></ul></li></ul><pre><code>a = 1\nb</code></pre><p>open <b>end"
    got = M.markdown(page)
    assert "## A _b_" in got and "[this **one**](u)" in got and "- y" in got and "```\na = 1\nb\n```" in got
    assert "menu" not in got and got.endswith("open end")


def test_nested_tables_are_tables_of_their_own():
    text = "<table><tbody><tr><td>a <b>1</b></td><td><table><tr><td>in<a href='/x'>side</a></td></tr></table>after</td></tr><tr></tr></tbody></table><table><tr><th>only heads</th></tr></table>"
    assert M.tables(text) == [[[("inside", "/x")]], [[("a 1", ""), ("after", "")]]]


def test_items_of_feeds():
    xml = "<rss><item><title><![CDATA[ A <b>&amp; ]]>c &#233;</title><link>u</link><author><name>N</name></author><author><name>M</name></author></item><item/><item><title>two</title><link rel='x' href='h'/></item></rss>"
    got = M.items(xml, "item", ("title", "link", "name"))
    assert got == [{"title": [" A <b>&amp; c é"], "link": ["u"], "name": ["N", "M"]}, {}, {"title": ["two"], "link": [""], "link@rel": ["x"], "link@href": ["h"]}]
    assert M.items("<item><title>a &amp; b</title></item>", "item", ("title",), resolve=False) == [{"title": ["a &amp; b"]}]


def test_readable_part_of_a_page():
    long = "A sentence, with commas, that is long enough to count as text of the page, and more. " * 2
    page = f"""<body><div class="menu"><a href=1>one</a> <a href=2>two</a></div><div class="ad">Buy, this, now, and, much, more, of, it, all.</div>
    <div id="content"><h1>Title</h1><p>{long}</p><p>Short.</p><ul><li><a href=3>related link text that is long enough to count</a></li></ul><p>{long}</p></div><div class="sidebar"><p>{long[:40]}</p></div><footer>foot</footer>"""
    text, kept, dropped = M.readable(page)
    assert text.split("\n") == ["Title", " ".join(long.split()), "Short.", " ".join(long.split())] and kept == 4 and dropped == 5


def test_readable_parts_of_the_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r for r in q_more.html_readable(spark, sf).collect()}
    assert found.keys() == pages.keys()
    strip = lambda s: " ".join(M.entities.unescape(re.sub("<[^>]+>", " ", s)).split())
    for k, page in pages.items():
        article = re.search("<article>(.*?)</article>", page, re.S)
        if not article or len(strip(article[1])) < 200:
            continue
        assert found[k].text.replace("\n", " ").split() == strip(article[1]).split()
        advert = re.search('<div class="ad">(.*?)</div>', page, re.S)
        assert found[k].dropped > 0 and (not advert or strip(advert[1]) not in found[k].text)


def test_parsed_keeps_columns_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "<table><tr><td>x</td></tr></table>", None)], "k long, html string, s string").withColumn("_text_", M.F.lit(1))
    rows = M.parsed(df, "html", ["k", "s"], lambda t: [(c,) for table in M.tables(t) for row in table for c, _ in row], "cell string")
    assert [tuple(r) for r in rows.collect()] == [(2, None, "x")]
