"""Quality classifier, spelling variants and whitening: whole results against plain forms, and hard inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import classifier, queries, spelling, whitening

SF = "/root/testdata/sf0.001"
CLASH = ["k", "t", "s", "y", "v", "x", "n", "c0", "word", "held_out", "score", "component", "h"]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 11


def plain_statistics(text):
    """Some of the statistics, by patterns."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    w = max(len(words), 1)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for k in range(3)}
    rows = [tuple(re.findall("[^\x20\x09-\x0d]+", line)) for line in text.split("\n")]
    rows = [r for r in rows if r]
    stretches = [words[i : i + 16] for i in range(0, len(words), 16)]
    return {
        "words": math.log1p(len(words)),
        "word_chars": min(sum(map(len, words)) / w, 40),
        "symbol_words": sum(bool(re.search(r"[#*$%&|<>]", x)) for x in words) / w,
        "capital_words": sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in words) / w,
        "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / w,
        "repeated_words": len(covered) / w,
        "new_words": len(set(words)) / w if words else 0,
        "lines": math.log1p(len(rows)),
        "repeated_lines": (len(rows) - len(set(rows))) / max(len(rows), 1),
        "most_symbols": max([sum(bool(re.search(r"[#*$%&|<>]", x)) for x in s) / 16 for s in stretches], default=0),
    }


def test_statistics_equal_patterns(spark):
    texts = ["", " \n\t", "a", "a b a b a b\na b a b a b\n\nX", "É é| ## !!\nÉ é| ## !!", "one " * 40, *(r.text for r in table(spark, "documents").limit(60).collect())]
    found = classifier.statistics(pa.array([*texts, None]))
    assert np.isfinite(found).all()
    assert (found[-1] == found[0]).all()
    for t, row in zip(texts, found, strict=False):
        got = dict(zip(classifier.STATISTICS, row, strict=True))
        for name, value in plain_statistics(t).items():
            assert got[name] == pytest.approx(value), (name, t[:50])


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        y, w = rng.random(30).round(1), rng.integers(1, 5, 30).astype(float)
        x = np.arange(30.0)
        _, means = classifier.isotonic(x, w, y)
        assert (np.diff(means) > 0).all()
        # by the max-min formula
        best = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert sorted(set(np.round(best, 9))) == sorted(set(np.round(means, 9)))


def test_classifier_equals_one_dense_solve(spark):
    """The equations summed by partition and fold give the weights of one solve over all rows."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = classifier.train(docs, labels)
    own = docs.join(labels, "doc_id").toPandas()
    own = own[[zlib.crc32(str(k).encode()) % 4 != 2 for k in own.doc_id]]
    x = model.features(classifier.statistics(pa.array(own.text)))
    answers = [classifier.ridge(x.T @ x, x.T @ own.quality.to_numpy(float), p) for p in classifier.PENALTIES]
    assert min(np.abs(x @ w - x @ model.weights).max() for w in answers) < 1e-6


def test_classifier_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    assert (found.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in found.doc_id]).all()
    both = found.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() >= 0.97
    assert both[both.quality == 1].predicted.mean() >= 0.98


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert (a.score - b.score).abs().max() < 1e-9


def test_classifier_takes_hard_rows(spark):
    rows = [(1, "good words of a text " * 20), (1, "good words of a text " * 20), (2, None), (3, ""), (None, "x"), (4, "a" * 300_000), (5, "&& | ## " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in CLASH))
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1), (4, 0), (5, 0), (9, 1)], "doc_id long, quality int")
    found = classifier.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1 and len({r.score for r in found if r.doc_id == 1}) == 1
    for some, want in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5), (labels.where("doc_id = 9"), 0.5)):
        assert {r.score for r in classifier.classify(docs, some).collect()} == {want}
    assert classifier.classify(docs.limit(0), labels).count() == 0


# 12


def plain_variants(rows):
    counts = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = {c for w in words for c in w}

    def near(w):
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        one |= {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1)}
        return (one & words.keys()) - {w}

    nears = {w: near(w) for w in words}
    form = {}
    for w, around in nears.items():
        if around and words[best := min(around, key=lambda x: (-words[x], x))] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(nears[w]), words[form[w]] if w in form else None))
    return out


def got_variants(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    docs = table(spark, "documents")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert got_variants(queries.op12_spelling_variants(spark, SF)) == want
    assert any(x[1] for x in want) and any(x[1] != x[2] for x in want if x[1])


def test_variants_of_equal_and_repeated_bigrams(spark):
    """Words whose bigrams repeat, edits at every place, and a chain of forms."""
    base = ["ananas", "banana", "aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abcdefgh", "ÀÉÎÕü"]
    words = {b for w in base for b in [w, *(w[:i] + w[i + 1 :] for i in range(len(w))), *(w[:i] + "z" + w[i + d :] for i in range(len(w) + 1) for d in (0, 1))]}
    rows = [(i, " ".join([w] * (3 + (7 * i) % 40))) for i, w in enumerate(sorted(words))]
    rows += [(900 + i, " ".join([w] * 4 * 3**i)) for i, w in enumerate(["chainaaaa", "chainaaa", "chainaa", "chaina", "chain"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(rows)
    assert got_variants(spelling.group_variants(docs)) == want
    assert {x[2] for x in want if x[0] == "chainaaaa"} == {"chain"}


def test_variants_take_hard_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "×÷ Ωmega word"), (None, "house Houses HOUSE"), (None, "house Houses HOUSE"), (4, "house " * 400_000), (5, "houses houses houses"), (6, "ÀB" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in CLASH))
    monkeypatch.setattr(spelling, "FLUSH", 1)
    want = plain_variants(rows)
    assert got_variants(spelling.group_variants(docs)) == want and len(want) >= 2
    assert spelling.group_variants(docs.limit(0)).count() == 0


# 13


def plain_whitening(vectors):
    x = np.unique(np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64), axis=0)
    n = len(x)
    c = (n * x - x.sum(0)) / n
    values, turns = np.linalg.eigh(c.T @ c / n)
    return n, x.sum(0), values[::-1], turns[:, ::-1], np.trace(c.T @ c / n)


def test_whitening_equals_dense_eigenvectors(spark):
    df = table(spark, "embeddings")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    n, sums, values, turns, trace = plain_whitening(vectors.values())
    found = queries.op13_whitening(spark, SF).toPandas()
    assert len(found) == 16 * len(vectors) and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10
    signs = {}
    for r in found.itertuples():
        x = np.array([math.floor(64 * float(c)) + 1_000_000 for c in vectors[r.vec_id]])
        m = n * x - sums
        i = r.component - 1
        want = m / n @ turns[:, i] / math.sqrt(values[i])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            assert signs.setdefault(i, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
        assert r.deviation == sum(int(v) ** 2 for v in m)
        assert r.explained == pytest.approx(values[i] / trace, rel=1e-9)


def spectrum(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.geomspace(1, 1e-6, 200), np.ones(40), np.r_[np.full(30, 5.0), np.ones(100)], np.r_[np.arange(1, 4.0), np.zeros(60)], np.array([2.0]), np.r_[1, 1 - 1e-9, np.linspace(0.5, 0, 90)], np.zeros(20)],
)
@pytest.mark.parametrize("block", [3, 16])
def test_lanczos_finds_the_largest(values, block):
    """Equal eigenvalues, few that are not zero (breakdown), and close ones."""
    values = np.sort(values)[::-1]
    v = spectrum(values, 5)
    passes = []
    got, found = whitening.lanczos(lambda b: passes.append(b.shape[1]) or v @ b, len(v), min(block, len(v)), 1)
    assert len(got) == min(block, len(v))
    assert np.abs(got - values[: len(got)]).max() < 1e-12
    assert np.abs(v @ found - found * got).max() < 1e-12
    assert np.abs(found.T @ found - np.eye(len(got))).max() < 1e-10
    assert sum(passes) <= len(v)


def test_lanczos_ends_before_the_whole_space():
    v = np.diag(np.geomspace(1, 1e-12, 600))
    passes = []
    whitening.lanczos(lambda b: passes.append(b.shape[1]) or v @ b, 600)
    assert sum(passes) < 300


def test_whitening_takes_hard_rows(spark):
    rng = np.random.default_rng(3)
    good = [rng.standard_normal(5).tolist() for _ in range(40)]
    nan, inf = math.nan, math.inf
    rows = [(i, v) for i, v in enumerate(good)] + [(100, good[0]), (0, good[1]), (None, good[2]), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [nan] * 5), (104, [inf, 0.0, 0.0, 0.0, 0.0]), (105, [0.5, 0.25]), (106, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in CLASH))
    kept = [(k, v + [0.0] * (5 - len(v))) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums, values, _, _ = plain_whitening([v for _, v in kept])
    found = whitening.whiten(df).collect()
    assert n == 42 and len(found) == 5 * len(kept) and {r.n for r in found} == {n}
    assert found[0].identity_error < 1e-10
    assert sum(r.explained for r in found if r.vec_id == 105) == pytest.approx(1)
    whitened = {(k, c): [r.whitened for r in found if r.vec_id == k and r.component == c][0] for k in (100, 0) for c in range(1, 6)}
    assert all(math.isfinite(v) for v in whitened.values())
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id in (101, 103)")).count() == 0


def test_whitening_without_variance_and_with_huge_entries(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.component, r.whitened, r.deviation, r.explained) for r in whitening.whiten(one).collect()} == {(1, None, 0, 0.0), (2, None, 0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), float(i), 3.0]) for i in range(9)], "vec_id long, embedding array<double>")
    found = whitening.whiten(line).collect()
    assert {r.component for r in found if r.whitened is not None} == {1} and found[0].identity_error < 1e-10
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert len(found) == 6 and {r.deviation for r in found if r.vec_id == 1} == {None}
    x = [[math.floor(64 * max(min(a, 2.0**46), -(2.0**46))) + 1_000_000, math.floor(64 * b) + 1_000_000] for a, b in [(1e30, 0.0), (-1e300, 1.0), (5.0, 2.0)]]
    exact = sum((3 * a - sum(r[i] for r in x)) ** 2 for i, a in enumerate(x[2]))
    assert {r.deviation for r in found if r.vec_id == 3} == {exact if exact < 2**63 else None}


def test_sums_of_partitions_are_exact_integers(spark):
    df = spark.range(1000).repartition(7)
    got = whitening.summed(df, lambda batches: np.array([sum(b.num_rows for b in batches), 2**70], object))
    assert got[0] == 1000 and got[1] == 7 * 2**70


# 1


def test_hosts_of_very_many_labels_cost_little(tmp_path):
    """Only suffixes as long as a rule's host are looked up."""
    import tracemalloc

    from tessella.llm import urlfilter

    rules = [("x.b.example", "/", "block"), ("example", "/a", "allow"), ("ample", "/", "block")]
    urlfilter.write_index(rules, str(tmp_path / "i"))
    index = urlfilter.DigestIndex(str(tmp_path / "i"))
    long = "l." * 50_000
    hosts = ["b.example", "x.b.example", "y.x.b.example", "yx.b.example", "example", long + "example", long + "x.b.example", long + "other", "example.", "", "." * 50_000]
    tracemalloc.start()
    found = list(index.judge(hosts, ["/a"] * len(hosts)))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()

    def plain(host):
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and "/a".startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    assert found == [plain(h) for h in hosts]
