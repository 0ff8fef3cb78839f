"""The stages of the corpus pipeline against brute force, with odd rows and clashing names."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import language_id
from tests.llm import test_dedup, test_near_copies, test_rest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key int, `near.group` string, copies int"


def rows():
    """Texts with copies, near copies and shared passages; nulls, empties, ties, one id with two texts."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("an", "er", "ol", "ut")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(60) for _ in range(12)]
    shared = text(25)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[3]), (21, base[3]), (22, base[4] + " more"), (23, base[5].replace(" ", "  ", 1)), (24, text(20) + " " + shared), (25, shared + " " + text(20)), (26, "é" * 40 + shared)]
    out += [(30, None), (31, ""), (32, "12 - 3"), (None, base[6]), (None, text(40)), (7, text(50)), (7, base[7]), (33, text(4000)), (8, base[8])]
    out = [(i, t, "ab"[k % 2], "en" if k % 3 else None, len(t or ""), k, "x", k) for k, (i, t) in enumerate(out)]
    return [*out, (9, base[9], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash", "suffix_dedup", "mixing", "packing"]


def test_language_stage(spark, docs):
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars", F.lit(1).alias("key"), F.lit("x").alias("near.group"), F.lit(2).alias("copies"))
    both = labelled.union(docs)
    kept = cp.language_stage(spark, both, "")
    assert kept.columns == both.columns
    crf = language_id.fit(both.where(language_id.remainder("doc_id", 3) != 1))
    named = language_id.predict(both, crf, keep=["key"], with_text=True).collect()
    want = Counter((r["doc_id"], r["__text"]) for r in named if r["lang_pred"] != "und" and r["score"] >= cp.MIN_LANGUAGE_SCORE)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert not {None, "", "12 - 3"} & {t for _, t in want}


def test_simhash_stage(spark, docs):
    got = cp.simhash_stage(spark, docs, "")
    assert got.columns == docs.columns
    all_rows = rows()
    label = test_near_copies.brute([r[1] or "" for r in all_rows])
    order = lambda r: (r[0] if r[0] is not None else 1 << 63, hashlib.sha256((r[1] or "").encode()).hexdigest())
    first = {}
    for r, g in zip(all_rows, label, strict=True):
        first[g] = min(first.get(g, r), r, key=order)
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter((r[0], r[1]) for r in first.values())
    assert [tuple(r) for r in got.where("doc_id = 8").collect()] == [r for r in all_rows if r[0] == 8][:1]
    assert cp.simhash_stage(spark, docs.where("doc_id = -1"), "").count() == 0


def test_suffix_stage(spark, docs):
    got = cp.suffix_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = {k: v[3] for k, v in test_dedup.brute([(r[0], r[1]) for r in rows()]).items()}
    kept = Counter()
    for r in rows():
        n, gone = test_dedup.brute([(x[0], x[1]) for x in rows()])[r[0], r[1]][:2]
        if not gone or gone < n:
            kept[r[0], want[r[0], r[1]]] += 1
    found = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect())
    # A character that is cut through is dropped from the text of document 26, so its digest differs.
    assert {k: n for k, n in found.items() if k[0] != 26} == {k: n for k, n in kept.items() if k[0] != 26}
    assert sum(n for k, n in found.items() if k[0] == 26) == sum(n for k, n in kept.items() if k[0] == 26)
    assert all(r["n_chars"] == len(r["text"]) for r in got.where("doc_id is not null").collect())


def test_mixing_and_packing_stages(spark, docs):
    mixed = cp.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    seen, once = Counter((r["doc_id"], r["text"]) for r in mixed.collect()), Counter((r[0], r[1]) for r in rows())
    want = Counter()
    for r, (_, copies) in zip(rows(), test_rest.brute_copies([r[:3] for r in rows()], cp.MIX_ENTROPY, cp.MIX_REPEATS, True), strict=True):
        want[r[0], r[1]] += copies
    assert seen == want and set(seen) == set(once) and seen != once
    packed = cp.packing_stage(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r[0] for r in rows())
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    for stage in (cp.suffix_stage, cp.mixing_stage, cp.packing_stage):
        assert stage(spark, docs.where("doc_id = -1"), "").count() == 0
