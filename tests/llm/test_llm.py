"""Corpus operators: hard inputs, and results against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import _text, decontam, lm, mixing, ngram_join, quality, queries, secrets, substring, tokens, urlfilter, warc
from tessella.llm._graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BODY = " ".join(f"word{i}x" for i in range(120))
NEAR = BODY.replace("word60x", "other")
#: Nulls, empties, blanks, ties, repeated rows, odd characters and a long text; with columns of clashing names.
ROWS = [
    (1, BODY, "a"), (1, BODY, "a"), (2, NEAR, "a"), (3, None, None), (4, "", "b"), (5, " \t\n ", "b"), (6, "one two", "b"), (7, "One two", "b"),
    (None, "a key of none\x00 é 😀 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", None), (8, "ab " * 60_000, "c"), (9, "x" * 200_000, "c"), (10, BODY, "c"),
]
CLASH = ["k", "t", "n", "s", "kept", "n_words", "size", "target", "component", "row", "d", "__key", "__row", "_row", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# Text


def test_words_equal_the_pattern():
    texts = [r[1] for r in ROWS]
    _, hashes, _, _, bounds = _text.words(pa.array(texts))
    for i, t in enumerate(texts):
        want = [_text.word_hash(w) for w in WORD.findall((t or "").translate(LOW))[:50]]
        assert hashes[bounds[i] : bounds[i + 1]][:50].tolist() == want
        assert bounds[i + 1] - bounds[i] == len(WORD.findall(t or ""))


def test_slices_cover_a_batch():
    batch = pa.record_batch({"t": pa.array(["x" * n for n in (10, 5000, 1, 0, 70)] + [None])})
    parts = list(_text.slices(batch, "t", 64))
    assert sum(p.num_rows for p in parts) == 6 and pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()


# 1


def test_url_filter(spark):
    urls = ["http://A.Net/x", "https://example.net/en/1", "http://x.example.com/de/#q", "http://fr.org/fr/2", "http://net", None, "no scheme", "http://sub.example.net/de/?a", "http://notnet/", "", "x://"]
    got = rows(urlfilter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), queries.RULES, keep=("page_id",)))
    assert [(r["host"], r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])] == [
        ("a.net", "net/", "block"), ("example.net", "example.net/en/", "allow"), ("x.example.com", "example.com/de/", "block"), ("fr.org", "org/fr/", "allow"), ("net", None, "allow"),
        ("", None, "allow"), ("", None, "allow"), ("sub.example.net", "net/", "block"), ("notnet", None, "allow"), ("", None, "allow"), ("", None, "allow"),
    ]


def test_url_index_confirms_strings(tmp_path):
    urlfilter.write_index([("a", "/", "block"), ("b", "/", "allow")], str(tmp_path / "i"))
    index = urlfilter.DigestIndex(str(tmp_path / "i"))
    index.keys = np.sort(np.full(2, int(index.keys[0]), np.uint64))  # all keys collide now
    import xxhash

    probe = next(t for t in (b"a/", b"b/") if xxhash.xxh64_intdigest(t) == int(index.keys[0]))
    assert index.text(index.find([probe])[0]) == probe and index.find([b"c/"])[0] == -1
    urlfilter.write_index([], str(tmp_path / "e"))
    assert list(urlfilter.DigestIndex(str(tmp_path / "e")).judge(["a"], ["/"])) == [(None, "allow")]


# 2


def plain_counts(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    at = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(at)


def test_quality(spark, docs, none, sf_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (None, 1), (10, None), (99, 1)], "doc_id long, quality int")
    got = rows(quality.judge_quality(docs, labels))
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for k, t, _ in ROWS if k == r["doc_id"]) or ""
        want = plain_counts(text)
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    assert rows(quality.judge_quality(none, labels)) == [] and all(r["kept"] != r["base_failed"] for r in rows(quality.judge_quality(docs, labels.limit(0))))
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge_quality(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("NOT kept").count() >= 0.9 * bad.count()


# 3


def test_secrets(docs, none):
    got = rows(secrets.find_secrets(docs))
    assert len(got) == len(ROWS)
    r = next(r for r in got if r["doc_id"] is None)
    text = ROWS[8][1]
    a, h = text.index("token"), text.index("04db")
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 1)
    assert r["spans"] == f"assign:{a}:{h + 40},hex:{h}:{h + 40}"
    assert rows(secrets.find_secrets(none)) == []
    assert "04db" not in next(r for r in rows(secrets.redact_secrets(docs)) if r["doc_id"] is None)["text"]


def test_secret_patterns_equal_plain_search():
    texts = ["AKIA" + "A" * 16 + " é AKIAB", "api-key: " + "z" * 20 + " PASSWORD='abc", "x" + "a1" * 9 + "é" + "0" * 15, "token=password=abcdefghijkl", "secret : \"0123456789ab\" apikey=0123456789abX"]
    scorer = secrets.RatioScorer(secrets.labelled_samples(2000))
    for text, found in zip(texts, secrets.scan(pa.array(texts), scorer), strict=True):
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [x for x in found if x[1] < 3] == sorted(want)


def test_secret_models_held_out():
    samples = secrets.labelled_samples(6000, 1)
    scorer = secrets.RatioScorer(samples[::2])
    right = 0
    for text, is_random in samples[1::2]:
        data = np.frombuffer(text.encode(), np.uint8)
        right += (scorer.score(data, np.array([0]), np.array([len(data)]))[0] >= 0) == is_random
    assert right >= 0.97 * len(samples[1::2])


# 4


def test_revisits(spark):
    schema = "id long, url string, ts long, kind string, status int, headers map<string,string>, digest string"
    r = lambda i, url, ts, kind, status=200, digest=None, **h: (i, url, ts, kind, status, {k.replace("_", "-"): v for k, v in h.items()}, digest)
    data = [
        r(1, "http://www.A.com/x/", 10, "response", ETag="e1", Server="s", Date="d1"), r(2, "https://a.com:443/x#f", 20, "revisit", 304, etag="W/e1", date="d2", server="t"),
        r(3, "http://a.com/x", 30, "response", 404), r(4, "http://a.com/x", 40, "revisit", 304, etag="e9"), r(5, "http://b.com/", 5, "revisit", 304), r(6, None, 50, "revisit", 304),
        (7, "http://a.com/x", 60, "revisit", 304, None, None), r(8, "http://a.com/x", 10, "revisit", 304), r(2, "https://a.com:443/x#f", 20, "revisit", 304, etag="W/e1", date="d2", server="t"),
    ]
    got = {x["id"]: x for x in rows(warc.resolve_revisits(spark.createDataFrame(data, schema)))}
    assert {k: (v["response_id"], v["verdict"]) for k, v in got.items()} == {2: (1, "resolved"), 4: (1, "mismatch"), 5: (None, "no_response"), 6: (None, "no_response"), 7: (1, "unchecked"), 8: (1, "unchecked")}
    assert got[2]["headers"] == {"etag": "W/e1", "server": "s", "date": "d2"}
    assert rows(warc.resolve_revisits(spark.createDataFrame([], schema))) == []


def test_revisits_of_one_hot_url(spark):
    n = 3000
    df = spark.range(n).select(F.col("id"), F.lit("http://h.com/").alias("url"), F.col("id").alias("ts"), F.when(F.col("id") % 7 == 0, "response").otherwise("revisit").alias("kind"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("digest"))
    assert all(r["response_id"] == r["id"] // 7 * 7 for r in rows(warc.resolve_revisits(df)))


def test_warc_round_trip():
    records = [{"version": "WARC/1.1", "headers": {"warc-type": "response"}, "block": b"a\r\n\r\nb"}, {"version": "WARC/1.1", "headers": {"warc-type": "revisit"}, "block": b""}]
    assert [r["block"] for r in warc.parse_warc(warc.format_warc(records))] == [r["block"] for r in records]


# 5


def test_repeats_equal_plain_search(spark, docs, none):
    passage = " ".join(f"passage{i}" for i in range(55))
    rng = np.random.default_rng(1)
    noise = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 10**9, n))
    texts = {i: f"{noise(40)}\n{noise(30)} {passage} {noise(30)}\n{noise(9)}" for i in (3, 5, 9)} | {i: noise(200) for i in (1, 2, 4)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = rows(substring.find_repeats(df))
    assert {r["doc_id"] for r in got} == {5, 9} and all(r["first_key"] == 3 for r in got)
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert part in passage and len(part.split()) == r["n_words"] >= 20
    clean = {r["doc_id"]: r["text"] for r in rows(substring.remove_repeats(df))}
    assert clean[3] == texts[3] and all(clean[r["doc_id"]] == texts[r["doc_id"]][: r["start"]] + texts[r["doc_id"]][r["end"] :] for r in got)
    assert rows(substring.find_repeats(none)) == []
    hard = rows(substring.find_repeats(docs))
    assert {r["doc_id"] for r in hard if r["first_key"] == 1} >= {1, 2, 10}
    whole = rows(substring.remove_repeats(docs))
    assert len(whole) == len(ROWS) and all(r[c] == 1 for r in whole for c in CLASH)
    assert sorted(len(r["removed"] or []) > 0 for r in whole if r["doc_id"] == 1) == [False, True]


# 6


def test_mix(docs, none, sf_docs):
    for df in (docs, sf_docs):
        got = rows(mixing.mix(df))
        assert len(got) == df.count() and got and sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(df))))
        total, by = sum(r["size"] for r in got), {}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
            by.setdefault(r["source"], []).append(r)
        assert math.isclose(sum(v[0]["target"] for v in by.values()), total, rel_tol=1e-9)
        for v in by.values():
            assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1
            assert v[0]["source_size"] == sum(r["size"] for r in v)
    assert rows(mixing.mix(none)) == []


def test_targets_equal_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 400}
    order = sorted(s for s in sizes if s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, total, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        left = total - sum(goal.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        goal |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    got = {r["source"]: r["target"] for r in rows(mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")))}
    assert got == pytest.approx(goal)


def test_shared_passages_of_51_words(spark):
    """A passage of 51 words inside long lines is found whatever its words are."""
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**9, n))
    shared = [text(51) for _ in range(1000)]
    texts = [(2 * i + j, f"{text(30)} {s} {text(30)}") for i, s in enumerate(shared) for j in (0, 1)]
    got = {r["doc_id"] for r in rows(substring.find_repeats(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == {2 * i + 1 for i in range(1000)}


# 7


def test_leaks(spark, docs, none):
    items = [(1, " ".join(f"Item{i}" for i in range(30))), (2, BODY[:300]), (3, None), (4, ""), (5, "plain words that no text has at all in any place")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    para = items[0][1].lower().replace("item5 ", "").replace("item9 ", "changed ")
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20, f"{'some other words ' * 30} {para} {'and more of them ' * 30}"), (21, "some other words " * 50)], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(df, bench))}
    assert got == {(1, 2), (2, 2), (10, 2), (20, 1)}
    assert {r["doc_id"] for r in rows(decontam.without_leaks(df, bench))} == {3, 4, 5, 6, 7, None, 8, 9, 21}
    assert rows(decontam.find_leaks(none, bench)) == [] and rows(decontam.find_leaks(df, bench.limit(0))) == []


def test_leaks_equal_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(x.doc_id, i.item_id) for i in b.collect() for x in d.where(F.contains(F.lower("text"), F.lower(F.lit(i.text)))).collect()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(d, b))}
    assert len(want & got) >= 0.95 * len(want) and len(got) <= 1.2 * len(want)


def test_leaks_in_many_documents(spark):
    """An item that a third of the documents hold, and one of words that every document has, are found in each."""
    rng = np.random.default_rng(8)
    lexicon = [f"w{i}" for i in range(3000)]
    common = [f"c{i}" for i in range(40)]
    text = lambda n: " ".join(common[i] if u < 0.5 else lexicon[j] for u, i, j in zip(rng.random(n), rng.integers(0, 40, n), rng.integers(0, 3000, n), strict=True))
    hot, plain = " ".join(f"hot{i}" for i in range(36)), " ".join(rng.permutation(common)[:30])
    items = [(0, hot), (1, plain), *((i, text(40)) for i in range(2, 60))]
    put = lambda i: hot if i % 3 == 0 else plain if i % 30 == 1 else items[2 + i % 58][1] if i % 3 == 1 else ""
    d = spark.createDataFrame([(i, f"{text(150)} {put(i)} {text(130)}") for i in range(300)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")))}
    want = {(i, 0) for i in range(0, 300, 3)} | {(i, 1) for i in range(1, 300, 30)} | {(i, 2 + i % 58) for i in range(1, 300, 3) if i % 30 != 1}
    assert want <= got and len(got) <= 1.1 * len(want)


def plain_leaks(docs, benchmark, texts, items):
    """Pairs that pass the checks of the common subsequence and the answer anywhere in the text, without candidates."""
    b = decontam.prepare(docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), benchmark)[0]
    found = set()
    for k, t in texts:
        h = decontam.words(pa.array([t]))[0]
        for (i, _), w, answer in zip(items, b.words, b.answers, strict=True):
            if k % 1000 == i and decontam.common_length(w, h) >= decontam.COMMON * len(w) and np.isin(answer, h).mean() >= decontam.ANSWER:
                found.add((k, i))
    return found


def test_long_items(spark):
    """Copies and paraphrases (every third word changed, so that no run of three stays) of items of 100 to 500 words."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{int(3000 * u * u)}" for u in rng.random(n))
    items = [(i, text(n)) for i, n in enumerate((30, 59, 100, 100, 150, 200, 300, 400, 500, 500))]
    para = lambda t: " ".join("other" if k % 3 == 2 else w for k, w in enumerate(t.split()))
    parts = [(i, t) for i, t in items] + [(1000 + i, para(t)) for i, t in items] + [(200 + i, "") for i in range(80)]
    texts = [(k, f"{text(137)} {t} {text(150)}") for k, t in parts]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(d, b, texts, items)
    assert {(i, i) for i in range(10)} <= want and len(want) > 15
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(d, b))} == want


def test_paraphrases_equal_brute_force(spark):
    """Planted paraphrases of a benchmark larger than the rank, against the checks without candidates."""
    rng = np.random.default_rng(10)
    text = lambda n: " ".join(f"w{int(4000 * u * u)}" for u in rng.random(n))
    items = [(i, text(int(rng.integers(20, 60)))) for i in range(300)]
    para = lambda t: " ".join("other" if u < 0.15 else w for w, u in zip(t.split(), rng.random(len(t.split())), strict=True) if u < 0.85)
    texts = [(i, f"{text(int(rng.integers(20, 200)))} {para(t)} {text(100)}") for i, t in items]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(d, b, texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(d, b))}
    assert len(want) > 200 and len(want & got) >= 0.9 * len(want)


def test_common_length():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 20)
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_length(a, b) == t[-1, -1]


# 8

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(docs, none, sf_docs, name):
    path = P.path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    for df in (docs, sf_docs.limit(60)):
        texts = Counter((r.doc_id, count(r.text or ""), len((r.text or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in rows(tokens.count_tokens(df, path))) == texts
    assert rows(tokens.count_tokens(none, path)) == []


def test_token_cuts_are_safe():
    c = tokens.counter(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["a", " ", "  ", "\n", "<s>", "é", "\t", "▁", "the", "\u3000", ".\n\n", "😀", "\x00"], rng.integers(0, 9))) for _ in range(5000)]
    assert c.counts(texts) == [len(x) for x in c.sp.encode(texts)]


# 9


def plain_classes(data, n, num, den):
    sets = {}
    for k, t in data:
        w = WORD.findall((t or "").translate(LOW))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * i >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, sf_docs, docs, none, n, num, den):
    want = plain_classes([(r.doc_id, r.text) for r in sf_docs.collect()], n, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.classes_of(sf_docs, n, num, den))} == want
    got = rows(ngram_join.classes_of(docs, n, num, den))
    assert len(got) == len(ROWS)
    classes = {r["doc_id"]: r["component_id"] for r in got}
    assert [classes[k] for k in (1, 10, 3, 4, 5, 6, 7)] == [1, 1, 3, 4, 5, 6, 6]
    assert rows(ngram_join.classes_of(none, n, num, den)) == []
    kept = rows(ngram_join.keep_first(docs, n, num, den))
    assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] not in (2,)) == sorted(["1", "3", "4", "5", "6", "8", "9", "None"])
    assert all(r[c] == 1 for r in kept for c in CLASH)


def test_ngram_join_in_chunks(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(60):  # a chain of small edits and unlike texts between
        base = base[:]
        base[i] = f"edit{i}"
        data.append((i, " ".join(base if i % 5 else [f"q{i}-{j}" for j in range(50)])))
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 7)
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.classes_of(spark.createDataFrame(data, "doc_id long, text string"), 3, 8, 10))}
    assert got == {k: c for k, (_, c) in plain_classes(data, 3, 8, 10).items()}


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("x"), (F.col("id") - 1).alias("y"))
    assert {(r.u, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(200)}
    assert components(edges.limit(0)).count() == 0


# 10


@pytest.mark.parametrize("hot", [1_000_000, 50])
def test_language_model(spark, sf_docs, docs, none, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    df = sf_docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    data = [(r.doc_id, r.text) for r in df.collect()]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    words = lambda t: [*WORD.findall((t or "").translate(LOW)), None]
    c = Counter(w for k, t in data if not held(k) for w in words(t))
    total, distinct = sum(c.values()), len(c)
    got = rows(lm.score(df))
    want = sorted((str(k), held(k), len(words(t)), sum(c[w] > 0 for w in words(t)), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words(t))) for k, t in data)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want] and np.allclose([x[5] for x in have], [x[5] for x in want])
    assert all(r["score"] < 0 for r in got)
    assert rows(lm.score(none)) == []


def test_language_model_beats_its_base_on_held_out_text(spark):
    got = rows(lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out"))
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_class_probabilities_sum_to_one():
    w = np.random.default_rng(0).standard_normal((1 + 2 * lm.BUCKETS + lm.PAIRS, lm.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(lm.log_softmax(w, np.arange(500))).sum(1), 1, atol=1e-4)


# Pipeline


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert pipeline.run(spark, sf).count() == seen[-1]
