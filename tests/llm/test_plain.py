"""Whole results of corpus operators and of the pipeline against plain Python."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import _text, decontam, lm, mixing, ngram_join, quality, queries, secrets, spelling, substring, urlfilter, warc
from tessella.llm._util import staged

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# 2


def plain_score(forest, row):
    total = 0.0
    for feature, value, child, path in zip(forest.feature, forest.value, forest.child, forest.path, strict=True):
        at = 0
        while feature[at] >= 0:
            at = int(child[at]) + int(row[feature[at]] >= value[at])
        total += float(path[at])
    return 2 ** (-total / len(forest.feature) / forest.usual)


def test_quality_verdicts_equal_plain_walks(spark, sf_docs):
    labels = table(spark, "labels")
    forest = quality.fit(sf_docs, labels)
    texts = {r.doc_id: r.text for r in sf_docs.collect()}
    for r in rows(quality.judge_quality(sf_docs, labels)):
        counts, statistics = quality.counts_of(texts[r["doc_id"]] or "")
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and r["score"] == pytest.approx(plain_score(forest, statistics), rel=2e-3)
        assert r["kept"] == (not failed and r["score"] <= forest.threshold)


def test_forest_paths_equal_plain_walks():
    rng = np.random.default_rng(3)
    seen = rng.random((400, len(quality.STATISTICS)))
    forest = quality.grow(seen, trees=40)
    odd = np.vstack([rng.random((60, seen.shape[1])), np.full((3, seen.shape[1]), 30.0)])
    got = forest.score(odd)
    n = quality.DRAW
    assert forest.usual == pytest.approx(2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n, rel=1e-2)
    assert np.allclose(got, [plain_score(forest, x) for x in odd], rtol=2e-3)
    assert got[-3:].min() > got[:60].max()  # what lies far out has the shortest paths


# 3


def plain_spans(text, scorer):
    base = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    added = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= secrets.MIN_RUN and not any(s <= m.start() and m.end() <= e for s, _, e in base):
            codes = [0, *m[0].encode(), 0]
            if sum(scorer.ratio[a, b] for a, b in zip(codes, codes[1:])) / len(m[0]) >= scorer.margin:
                added.append((m.start(), 3, m.end()))
    return sorted(base), sorted(base + added)


def test_secret_spans_equal_plain_search(spark, sf_docs):
    labels = table(spark, "labels")
    more = spark.createDataFrame([(90001, "the key Zk3xQ9vTtR7bLw2PfYh8 stays é x"), (90002, None), (90003, ""), (90004, "é" * 10 + " token: aB3dE5gH7jK9mN1p " + "0f" * 20)], "doc_id long, text string")
    df = sf_docs.select("doc_id", "text").unionByName(more)
    scorer = secrets.fit(df, labels)
    got = {r["doc_id"]: r for r in rows(secrets.find_secrets(df, labels=labels))}
    said = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    for r in df.collect():
        base, every = plain_spans(r.text or "", scorer)
        assert got[r.doc_id]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert got[r.doc_id]["spans"] == said(every)
    assert got[90001]["n_random"] == 1


def test_secret_models_of_labelled_documents(spark):
    """Keys without a pattern are found, and of prose in four languages next to nothing."""
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = secrets.fit(d, labels)
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(letters, 24)) for _ in range(500)]
    data, offsets = _text.flat(pa.array(keys))
    assert (scorer.score(data, offsets[:-1], offsets[1:]) >= scorer.margin).mean() >= 0.98
    found = sum(r["n_random"] for r in rows(secrets.find_secrets(d, labels=labels)))
    words = sum(len(WORD.findall(r.text or "")) for r in d.collect())
    assert found <= 5 * words / 1e6 + 1


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5, -0.1])
def test_secrets_in_labelled_documents_cost_no_recall(spark, share):
    """Keys without a pattern planted in a share of labelled documents, or of the others, are found all the same."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    own = {r.doc_id for r in labels.collect()}
    held = sorted(r.doc_id for r in docs.select("doc_id").collect() if (r.doc_id in own) == (share > 0))
    rng = np.random.default_rng(6)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = [(int(i), "".join(rng.choice(letters, 32))) for i in rng.choice(held, max(4, int(abs(share) * len(held))), replace=False)]
    planted = docs.join(spark.createDataFrame(keys, "doc_id long, planted string"), "doc_id", "left").withColumn("text", F.concat_ws(" ", "text", "planted"))
    found = secrets.find_secrets(planted.drop("planted"), labels=labels).where("n_random > 0").join(planted.select("doc_id", "text"), "doc_id").collect()
    texts = [(r.doc_id, r.text[int(s) : int(e)]) for r in found for k, s, e in (x.split(":") for x in r.spans.split(",")) if k == "random"]
    hit = set(texts) & set(keys)
    words = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert len(hit) >= 0.95 * len(keys) and len(texts) - len(hit) <= 5 * words / 1e6 + 1


def test_every_labelled_document_trains_the_secret_models(spark):
    """more labelled documents than the 6,000 that once were the most; none is left out."""
    words = [f"{a}{b}{c}word" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    texts = [f"{words[i % 600]} {words[i * 7 % 600]}" for i in range(7000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    scorer = secrets.fit(df, df.select("doc_id"))
    want = secrets.RatioScorer(secrets.labelled_samples(), (np.zeros((128, 128)), secrets.counts_of(w for t in texts for w in t.split())))
    assert np.allclose(scorer.ratio, want.ratio, atol=1e-12)


def test_secret_labels_without_their_column_are_refused(spark, sf_docs):
    with pytest.raises(ValueError, match="label"):
        secrets.find_secrets(sf_docs, labels=table(spark, "labels").withColumnRenamed("doc_id", "other"))


# 5


def plain_units(text):
    """(words, start, end) of every unit, and whether its line is long."""
    out = []
    for line in re.finditer("[^\n]*", text):
        words = [(m[0].translate(LOW), line.start() + m.start(), line.start() + m.end()) for m in WORD.finditer(line[0])]
        border = {0}
        if len(words) > substring.LONG:
            hashes = [int(_text.mix(np.array([_text.word_hash(w)], np.uint64))[0]) for w, _, _ in words]
            for i in range(len(words) - substring.WINDOW + 1):
                part = hashes[i : i + substring.WINDOW]
                border.add(i + part.index(min(part)))
        cuts = [*sorted(border), len(words)]
        out += [(tuple(w for w, _, _ in words[a:b]), words[a][1], words[b - 1][2], len(words) > substring.LONG) for a, b in zip(cuts, cuts[1:]) if a < b]
    return out


def plain_repeats(data):
    first, units = {}, {}
    for k, text in sorted(data):
        units[k] = plain_units(text or "")
        for i, u in enumerate(units[k]):
            first.setdefault(u[0], (k, i))
    found = set()
    for k, us in units.items():
        run = []
        for i, u in enumerate([*us, None]):
            if u is not None and first[u[0]] != (k, i):
                run.append(u)
                continue
            if run and (sum(len(x[0]) for x in run if x[3]) >= substring.LEAST or sum(len(x[0]) for x in run) >= 2 * substring.LEAST):
                found.add((k, run[0][1], run[-1][2], sum(len(x[0]) for x in run), min(first[x[0]][0] for x in run)))
            run = []
    return found


@pytest.mark.parametrize("often", [8, 2])
def test_repeats_equal_plain_grouping(spark, sf_docs, monkeypatch, often):
    """Also where nearly all digests count as ones that many share."""
    monkeypatch.setattr(substring, "OFTEN", often)
    want = plain_repeats([(r.doc_id, r.text) for r in sf_docs.collect()])
    got = {(r["doc_id"], r["start"], r["end"], r["n_words"], r["first_key"]) for r in rows(substring.find_repeats(sf_docs))}
    assert got == want and want


# 7


def test_leaks_equal_exhaustive_subsequences(spark, sf_docs):
    bench = table(spark, "benchmark")
    docs = sf_docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    (b,) = decontam.prepare(docs, bench)
    want = set()
    for k, t in ((r.k, r.t) for r in docs.collect()):
        hashes, _ = decontam.words(pa.array([t]))
        for at in range(0, max(len(hashes), 1), decontam.BLOCK):
            for j, item in enumerate(b.words):
                region = hashes[max(0, at - len(item)) : at + decontam.BLOCK * decontam.SPAN + len(item)]
                if np.isin(item, region).mean() < decontam.COMMON or np.isin(b.answers[j], region).mean() < decontam.ANSWER:
                    continue
                if decontam.common_length(item, region) >= decontam.COMMON * len(item):
                    want.add((k, b.ids[j]))
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(sf_docs, bench))}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_leaks_in_blocks_of_items(spark, sf_docs, monkeypatch):
    bench = table(spark, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(sf_docs, bench))}
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 15)
    parts = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find_leaks(sf_docs, bench))}
    assert len(whole & parts) >= 0.95 * len(whole | parts)
    left = {r["doc_id"] for r in rows(decontam.without_leaks(sf_docs, bench))}
    assert left == {r.doc_id for r in sf_docs.collect()} - {k for k, _ in parts}


def test_words_are_never_broadcast(spark, sf_docs, monkeypatch):
    """the driver holds no table of words, however small its files."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(spelling, "staged", kept)
    df = spelling.group_variants(sf_docs)
    assert df.count()
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_a_common_line_makes_no_cluster(spark, monkeypatch):
    """sets that share a line only, too rare for a sample to show, stay apart; and no link is lost."""
    found = {}

    def kept(df, label):
        found[label] = staged(df, label)
        return found[label]

    monkeypatch.setattr(ngram_join, "staged", kept)
    monkeypatch.setattr(ngram_join, "discard", lambda *_: None)
    monkeypatch.setattr(ngram_join, "_frequent", lambda *_: np.zeros(0, np.uint64))
    rng = np.random.default_rng(4)
    line = " ".join(f"line{i}" for i in range(8))
    texts = [f"{line} {' '.join(f'w{x}' for x in rng.integers(0, 10**9, 30))}" for _ in range(400)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in rows(ngram_join.classes_of(df, 5, 4, 5))}
    assert got == {i: i - 400 if i >= 400 else i for i in range(440)}
    assert max([r["count"] for r in rows(found["chosen"].groupBy("root").count())]) < 60


@pytest.mark.parametrize("cells", [decontam.CELLS, 1])
def test_all_documents_fit_the_latent_space(spark, monkeypatch, cells):
    """the matrix of passages holds those of every document, where once about 1,000 documents were drawn."""
    monkeypatch.setattr(decontam, "CELLS", cells)
    monkeypatch.setattr(decontam, "BAND", 16)
    rng = np.random.default_rng(3)
    letters = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(letters, 40)) for _ in range(1500)] + [None, "", "none of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)
    b = decontam._load([{"i": i, "t": " ".join(letters[i * 10 : i * 10 + 20])} for i in range(5)], "i", "t", None)
    encoded = decontam._encoded(docs, b).persist()
    assert decontam._weigh(encoded, b) == 1502
    m = rng.standard_normal((len(b.vocabulary), 7))
    want, place = np.zeros(m.shape), {h: i for i, h in enumerate(b.vocabulary.tolist())}
    seen = np.zeros(len(place))
    for t in texts:
        own = np.array([place.get(h, -1) for h in decontam.words(pa.array([t or ""]))[0].tolist()], int)
        seen[np.unique(own[own >= 0])] += 1
    assert np.allclose(b.weight, np.log((2 + len(texts)) / (1 + seen)), rtol=1e-6)
    for t in texts:
        hashes = decontam.words(pa.array([t or ""]))[0].tolist()
        for i in range(0, len(hashes), decontam.BLOCK):
            x = np.zeros(len(place))
            for h in hashes[i : i + decontam.BLOCK]:
                if h in place:
                    x[place[h]] += b.weight[place[h]]
            counts = sum(b.weight[place[h]] ** 2 for h in hashes[i : i + decontam.BLOCK] if h in place)
            want += np.outer(x, x @ m) / max(counts, 1e-12)
    assert np.allclose(decontam._product(decontam._gram(encoded, b), m), want, rtol=1e-5, atol=1e-5)


def test_leaks_with_clashing_names(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, text, 7)], "cosine long, text string, k long")
    found = decontam.find_leaks(df, spark.createDataFrame([(1, text)], "cosine long, text string"), "cosine", item="cosine")
    assert len(set(found.columns)) == 7 and found.count() == 1


# 10


def test_scores_equal_plain_forward_pass(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}{'abc'[i % 3]}{'xy'[i % 2]}" for i in range(120)]
    data = [(i, None if i == 5 else " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", F.lit(1)).withColumn("k", F.lit(2)).withColumn("score", F.lit(3))
    docs = df.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), (lm.split_of(F.col("doc_id")) == 2).alias("h"))
    shared, model, counts, _ = lm.fit(docs.where("NOT h").select("t"))
    v, weights = shared.value, model.value[0]
    by_word = {np.uint64(np.int64(r.w)): (r.c, r.s) for r in counts.collect()}
    c = v.classes

    def class_of(word):
        h = np.uint64(_text.word_hash(word))
        at = np.searchsorted(v.frequent, h)
        if at < len(v.frequent) and v.frequent[at] == h:
            return 1 + int(v.rank[at])
        raw = word.encode()
        number = lm.suffixes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
        return 1 + v.own + int(number) % v.shared

    def probabilities(two, one):
        both = int(_text.mix(np.array([two * c + one + 1], np.uint64))[0] % np.uint64(len(weights) - 1 - 2 * c))
        z = weights[0] + weights[1 + one] + weights[1 + c + two] + weights[1 + 2 * c + both]
        e = np.exp(z - z.max())
        return e / e.sum()

    got = {r["doc_id"]: r for r in rows(lm.score(df))}
    for k, text in data:
        two = one = 0
        total = 0.0
        for word in [*WORD.findall(text or ""), None]:
            cls = 0 if word is None else class_of(word)
            n = v.ends if word is None else by_word.get(np.uint64(_text.word_hash(word)), (0, 0))[0]
            total += math.log10(probabilities(two, one)[cls]) + math.log10(n + 1) - v.log_class_size[cls]
            two, one = one, cls
        assert got[k]["score"] == pytest.approx(total, rel=1e-4)
    # all known tokens and one unknown token of each class add up to 1
    inside = np.zeros(c)
    inside[0] += v.ends + 1
    for w, (n, s) in by_word.items():
        at = np.searchsorted(v.frequent, w)
        own = at < len(v.frequent) and v.frequent[at] == w
        inside[1 + int(v.rank[at]) if own else 1 + v.own + s % v.shared] += n + 1
    full = (inside + 1) / 10**v.log_class_size
    assert np.allclose(full[inside > 0], 1)


# Hard inputs of the other operators


def test_url_filter_on_hard_inputs(spark):
    urls = [(1, "https://A.net/x", 0), (1, "https://A.net/x", 0), (2, "", 0), (3, None, 0), (4, "https://" + "a." * 3000 + "net/" + "y" * 50_000, 0), (5, "://", 0), (6, "ftp://example.net/en/?q", 0)]
    df = spark.createDataFrame(urls, "page_id long, url string, host int")
    got = rows(urlfilter.judge_urls(df, queries.RULES, keep=("page_id", "host")))
    assert len(got) == len(urls) and all(r["host"] == 0 for r in got)
    assert [r["verdict"] for r in sorted(got, key=lambda r: r["page_id"])] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    assert rows(urlfilter.judge_urls(df.limit(0), queries.RULES, keep=("page_id",))) == []


def test_revisits_on_hard_inputs(spark):
    schema = "id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, url_key int, full int"
    data = [(1, "", 1, "response", 200, {}, "", 0, 0), (2, "", 2, "revisit", 304, None, "", 0, 0), (3, "h://" + "z" * 100_000, None, "revisit", 304, {"ETag": "e" * 100_000}, None, 0, 0), (None, None, None, None, None, None, None, 0, 0)]
    got = {r["id"]: r for r in rows(warc.resolve_revisits(spark.createDataFrame(data, schema)))}
    assert set(got) == {2, 3} and got[2]["response_id"] == 1 and got[3]["verdict"] == "no_response"


def test_warc_reader(spark, tmp_path):
    head = {"warc-type": "response", "warc-target-uri": "http://a.com/x", "warc-date": "2024-01-01T00:00:00Z", "warc-record-id": "<a>"}
    good = {"version": "WARC/1.1", "headers": head, "block": b"HTTP/1.1 200 OK\r\nETag: e1\r\n\r\nbody"}
    again = {"version": "WARC/1.1", "headers": {**head, "warc-type": "revisit", "warc-date": "2024-01-02T00:00:00Z", "warc-record-id": "<b>"}, "block": b"HTTP/1.1 304 Not Modified\r\nETag: W/e1\r\n\r\n"}
    data = warc.format_warc([good]) + b"junk without a header\r\n\r\n" + warc.format_warc([again])
    (tmp_path / "one.warc").write_bytes(data)
    records = warc.read_warc(spark, f"file://{tmp_path}/*.warc")
    assert records.count() == 2
    (r,) = rows(warc.resolve_revisits(records))
    assert r["verdict"] == "resolved" and r["headers"]["etag"] == "W/e1"


# Pipeline


def test_pipeline_stages_equal_plain_ones(spark, sf_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_llm import plain_classes

    stages = dict(pipeline.STAGES)
    kept = {r["doc_id"] for r in rows(quality.judge_quality(sf_docs, table(spark, "labels"))) if r["kept"]}
    one = spark.createDataFrame(stages["quality rules"](spark, sf_docs, SF).toPandas(), sf_docs.schema)
    assert {r.doc_id for r in one.collect()} == kept
    classes = plain_classes([(r.doc_id, r.text) for r in one.collect()], 5, 4, 5)
    two = spark.createDataFrame(stages["near duplicates"](spark, one, SF).toPandas(), sf_docs.schema)
    assert sorted(r.doc_id for r in two.collect()) == sorted(k for k, (n, c) in classes.items() if not n or c == k)
    leaks = {r["doc_id"] for r in rows(decontam.find_leaks(two, table(spark, "benchmark")))}
    three = spark.createDataFrame(stages["benchmark decontamination"](spark, two, SF).toPandas(), sf_docs.schema)
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaks
    scorer = secrets.fit(three, table(spark, "labels"))
    four = spark.createDataFrame(stages["secret scan"](spark, three, SF).toPandas(), sf_docs.schema)
    clean = {r.doc_id: secrets.redact(r.text, plain_spans(r.text, scorer)[1]) for r in three.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in four.collect()} == {k: (t, len(t)) for k, t in clean.items()}
    assert sorted(map(str, rows(stages["source mix"](spark, four, SF)))) == sorted(map(str, rows(mixing.mix(four))))


def test_pipeline_on_hard_inputs(spark, sf_docs, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"long{i}" for i in range(40_000))
    hard = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, long, None, "a", None), (3, long, None, "a", None), (4, long, "de", "b", 5), (5, " \n\t ", "fr", "b", 1)]
    extra = spark.createDataFrame(hard, sf_docs.schema)
    for name, docs in (("some", extra.unionByName(sf_docs.limit(40))), ("none", sf_docs.limit(0))):
        docs = docs.select("*", *(F.lit(1).alias(c) for c in ("k", "t", "size", "taken", "row", "component", "kept", "__key", "removed")))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            table(spark, t).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got = rows(pipeline.run(spark, f"{tmp_path}/{name}"))
        assert len(got) == len({(r["doc_id"], r["size"]) for r in got})
        assert (name == "none") == (not got)
        if got:
            assert sum(r["doc_id"] in (3, 4) for r in got) == 1  # copies of a long text: one stays


def test_url_rules_in_several_files(spark, monkeypatch):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["https://a.example.net/en/x", "http://b.net/q", "http://c.org/fr/", "http://example.com/de/1", "http://d.io/"])], "page_id long, url string")
    whole = sorted(map(str, rows(urlfilter.judge_urls(urls, queries.RULES, keep=("page_id",)))))
    monkeypatch.setattr(urlfilter, "MAX_RULES", 1)
    monkeypatch.setattr(urlfilter, "_added", {})
    parts = [*queries.RULES, ("example.net", "/", "block")]
    assert len(urlfilter._ship(spark, parts)) == 5
    assert sorted(map(str, rows(urlfilter.judge_urls(urls, parts, keep=("page_id",))))) == whole
