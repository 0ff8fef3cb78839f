"""Packing by minimum bin slack against brute force."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelframe.llm import bin_slack, queries

SF = "/root/testdata/sf0.001"


def _best_sum(target, pieces):
    return max(sum(c) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= target)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_combination(pieces, target):
    counts = Counter(pieces)
    taken = bin_slack.fullest(target, counts)
    assert all(n <= counts[length] for length, n in taken.items())
    assert sum(length * n for length, n in taken.items()) == _best_sum(target, pieces)


def _one_by_one(counts, capacity):
    """The plan bin by bin, by definition: the longest piece left and the fullest combination with it."""
    counts, bins = Counter(counts), []
    while +counts:
        seed = max(+counts)
        counts[seed] -= 1
        some = bin_slack.fullest(capacity - seed, counts)
        counts.subtract(some)
        bins.append(Counter(some) + Counter([seed]))
    return bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=12))
def test_plan_is_that_of_single_bins(counts):
    bins = bin_slack.plan(counts, 40)
    assert [Counter(some) for some, times in bins for _ in range(times)] == _one_by_one(counts, 40)
    total = Counter()
    for some, times in bins:
        assert sum(length * n for length, n in some.items()) <= 40 and times > 0
        total.update({length: n * times for length, n in some.items()})
    assert total == Counter(counts)


def _least_bins(counts, capacity):
    """A lower bound of any packing: pieces over half of a bin each have their own, and for every k those over
    capacity - k take nothing of length k or more."""
    least = 0
    for k in range(capacity // 2 + 1):
        own = sum(n for length, n in counts.items() if 2 * length > capacity)
        room = sum((capacity - length) * n for length, n in counts.items() if 2 * length > capacity and length <= capacity - k)
        rest = sum(length * n for length, n in counts.items() if k <= length and 2 * length <= capacity)
        least = max(least, own + max(0, -(-(rest - room) // capacity)))
    return least


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_of_many_lengths_is_near_the_bound(seed):
    """Half a million pieces of all lengths: within a two-thousandth of a lower bound, by few combinations."""
    counts = Counter(np.random.default_rng(seed).integers(1, 1024, 500_000).tolist())
    bins = bin_slack.plan(counts)
    least = _least_bins(counts, 1024)
    assert least <= sum(times for _, times in bins) <= 1.0005 * least and len(bins) < 2000


def _check(rows, ids_of, capacity=1024):
    """Every id lies in exactly one piece and the pieces fill their sequences without a gap."""
    docs, places = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert docs.keys() == ids_of.keys()
    for doc_id, some in docs.items():
        ids = ids_of[doc_id]
        some.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in some] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in some:
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            assert r["length"] == capacity or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    return len(places)


def _ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts.items()}


def test_odd_rows(spark):
    import public_tokenizers as P

    texts = {0: "", 1: None, 2: "one", 3: "word " * 5000, 4: "日本 ½ it's", 5: "a b c d e f g", 6: "x " * 1023, 7: "same", 8: "same"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as piece", "'x' as length", "'y' as part").repartition(3)
    args = (P.path("byte_bpe_50k.json"), P.PATTERN)
    got = bin_slack.pack(df, *args, with_ids=True).collect()
    ids = _ids(texts)
    _check(got, ids)
    assert [x for r in sorted((r for r in got if r["doc_id"] == 3), key=lambda r: r["piece"]) for x in r["ids"]] == ids[3]
    small = bin_slack.pack(df, *args, capacity=8).collect()
    assert _check(small, ids, 8) >= -(-sum(map(len, ids.values())) // 8)
    twice = bin_slack.pack(df.where("doc_id IN (2, 7)").withColumn("doc_id", F.lit(None).cast("long")).unionByName(df.where("doc_id = 7")), *args).collect()
    assert Counter(r["doc_id"] for r in twice) == {None: 2, 7: 1} and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert bin_slack.pack(df.where("doc_id > 100"), *args).collect() == []


@pytest.mark.parametrize("files", [1, 7])
def test_query_by_brute_force(spark, files, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_bin_slack(spark, str(tmp_path)).collect()
    ids = _ids({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    used = _check(got, ids)
    counts = Counter(r["length"] for r in got)
    assert used == len(_one_by_one(counts, 1024)) <= -(-sum(map(len, ids.values())) // 1024) + 3
