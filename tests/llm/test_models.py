"""Language identification, toxicity and quality: decoding by brute force, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import language_id, quality, toxicity
from pixelframe.llm.crf import forward_backward

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        score = np.exp(s[path[0]] + sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        for i, k in enumerate(path):
            total[i, k] += score
    assert np.allclose(forward_backward(e, np.array([0, 5, 0]), t, s), total / total.sum(axis=1, keepdims=True))


def test_long_sequences_equal_a_single_pass():
    rng = np.random.default_rng(1)
    lengths = np.array([700, 3, 250])
    e, t, s = rng.normal(size=(953, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = forward_backward(e, lengths, t, s)
    p, a = np.exp(e), np.exp(t)
    at = 0
    for n in lengths:
        x = p[at : at + n]
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        alpha[0] = np.exp(s) * x[0]
        for i in range(1, n):
            alpha[i] = alpha[i - 1] @ a * x[i]
            alpha[i] /= alpha[i].sum()
        for i in range(n - 2, -1, -1):
            beta[i] = a @ (x[i + 1] * beta[i + 1])
            beta[i] /= beta[i].sum()
        want = alpha * beta
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 -- 3 — …", "en"), (None, "the and of", None), (-4, "the and of " * 4000, "en"), (-4, "the and of", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    out = language_id.identify(both)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert len(rows[-4]) == 2 and rows[-4][0]["lang_pred"] == "en" and rows[None][0]["lang_pred"] == "en"
    assert all(rows[i][0]["lang_pred"] == "und" and rows[i][0]["score"] == 0 for i in (-1, -2, -3))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i][0]["held_out"] for i in held)
    assert np.mean([rows[i][0]["lang_pred"] == truth[i] for i in held]) > 0.97


def test_language_switches_within_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = language_id.fit(docs)
    mixed = spark.createDataFrame([(1, "the and of that with for was are is to in " * 5 + "der die und nicht mit dem den ein ist auf von " * 5)], "doc_id long, text string")
    assert language_id.predict(mixed, crf).first()["switches"] >= 1


def test_language_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(none).first()["lang_pred"] == "und"
    assert language_id.identify(none.where("doc_id = 9")).count() == 0


def test_toxicity_held_out_and_spans(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "!!! 123"), (None, "you idiot"), (-4, "of and " * 5000)], "doc_id long, text string")
    out = toxicity.classify(docs.select("doc_id", "text").union(odd), labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 1005 and all(rows[i]["spans"] == [] and rows[i]["predicted"] == 0 for i in (-1, -2, -3))
    held = [(r["toxic"], rows[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == t for t, r in held]) > 0.93
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    word = next((i, s) for i, r in rows.items() if i in texts for s in r["spans"])
    assert texts[word[0]][word[1]["start"] : word[1]["stop"]].strip()


def test_toxicity_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, one, fold=1000, held=999).agg(F.min("score")).first()[0] > 0.99
    assert toxicity.classify(docs, one.where("toxic = 9")).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.classify(docs.where("doc_id = 9"), one).count() == 0


def test_quality_statistics_of_small_texts():
    import pyarrow as pa

    from pixelframe.llm.textscan import string_buffers

    x = quality.statistics(*string_buffers(pa.array(["", None, "a a a b", "One\nOne\ntwo"], pa.string())))
    named = dict(zip(quality.FEATURES, x.T, strict=True))
    assert np.isfinite(x).all()
    assert np.allclose(x[0], x[1])
    assert np.isclose(named["log_words"][2], np.log1p(4)) and np.isclose(named["top_word"][2], np.arcsin(np.sqrt(0.75)))
    assert np.isclose(named["distinct_lines"][3], np.arcsin(np.sqrt(2 / 3)))


def test_quality_log_density():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (400, 2)), rng.normal(1, 2, (200, 2))
    cov = lambda v: np.cov(v.T, bias=True)
    m = quality.Discriminant({0: 400, 1: 200}, {0: a.mean(0), 1: b.mean(0)}, {0: cov(a), 1: cov(b)}, 0.0, 0.0)
    x = np.array([[0.3, -0.2], [2.0, 2.5]])

    def log_density(v, mean, c, n):
        d = v - mean
        return np.log(n / 600) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)

    z = log_density(x, b.mean(0), cov(b), 200) - log_density(x, a.mean(0), cov(a), 400)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)))


def test_quality_held_out_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (-4, "y " * 20000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.classify(docs.select("doc_id", "text").union(odd), labels).collect()}
    assert len(rows) == 1004 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == q for q, r in held]) > 0.93
    assert quality.classify(docs.where("doc_id = -9"), labels).count() == 0


@pytest.mark.parametrize("share", [0, 1])
def test_quality_one_class(spark, share):
    docs = spark.createDataFrame([(i, "abc def") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, share) for i in range(4)], "doc_id long, quality int")
    assert quality.classify(docs, labels, fold=1000, held=999).select("score").distinct().collect()[0][0] == share


def test_every_label_is_learned_from_bounded_rows(spark):
    """Seventy labels, one of which holds many equal rows of one id."""
    rows = [(i, f"w{chr(97 + i % 70 // 26)}{chr(97 + i % 70 % 26)} common", f"l{i % 70}") for i in range(700)] + [(None, "same text", "l0")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample_labelled(docs, "doc_id", "text", "lang", 5)
    assert {lang for _, lang in got} == {f"l{i}" for i in range(70)}
    assert all(sum(lang == x for _, lang in got) == 5 for x in ("l0", "l7"))
    assert len(language_id.sample_labelled(docs, "doc_id", "text", "lang", 5, language_bytes=1)) == 70
    assert sorted(got) == sorted(language_id.sample_labelled(docs.repartition(7), "doc_id", "text", "lang", 5))
    assert language_id.sample_labelled(docs.where("lang = 'x'"), "doc_id", "text", "lang", 5) == []


def test_toxic_sample_is_bounded_with_a_hot_id(spark, monkeypatch):
    """An id with most rows, and texts longer than the bound, do not make the sample larger."""
    rows = [(1, f"word{i} other text of the hot id") for i in range(500)] + [(1, "same again")] * 300 + [(i, f"plain words {i} " * 20) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 1)) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(rows) or toxicity.ToxicModel(None, np.zeros(4)))
    toxicity.fit(docs, labels, per_class=5)
    assert 2 <= len(seen[0]) <= 10 and {y for _, y in seen[0]} == {0, 1} and len(set(seen[0])) == len(seen[0])
    toxicity.fit(docs, labels, per_class=50, class_bytes=700)
    for y in (0, 1):
        sizes = [len(t) for t, v in seen[1] if v == y]
        assert sizes and sum(sizes) - max(sizes) < 700


def test_documents_with_two_labels_take_the_larger(spark):
    docs = spark.createDataFrame([(i, "good words here " * 3 if i % 2 else "vile vile slur") for i in range(40)], "doc_id long, text string")
    once = [(i, 1 - i % 2, i % 2) for i in range(40)]
    twice = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (3, None, None), (2, 7, 7)]
    schema = "doc_id long, toxic int, quality int"
    a, b = spark.createDataFrame(once, schema), spark.createDataFrame(once + twice, schema)
    for labels in (a, b):
        model = toxicity.fit(docs, labels)
        want = toxicity.fit(docs, a)
        assert np.allclose(model.coefficients, want.coefficients)
    even = [(i, None, 1 - i % 2) for i in range(0, 40, 2)]
    low, high = quality.fit(docs, spark.createDataFrame(even, schema).union(a)), quality.fit(docs, spark.createDataFrame([(i, None, 1) for i in range(40)], schema))
    assert low.counts == high.counts == {1: 40}
