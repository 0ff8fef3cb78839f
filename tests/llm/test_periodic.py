"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelframe.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """All runs by definition: (start, length, period) by start, then period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(12, 2 * p):
                found.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def quick_brute_runs(words):
    """The same with NumPy: every period of every word, still by definition."""
    known, found = {}, {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    for p in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[p:] == ids[:-p], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + p - s >= max(12, 2 * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_collapsed(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def _runs(texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for s, e, p in periodic.runs_of(ids, bounds):
        t = int(np.searchsorted(bounds, s, side="right")) - 1
        out[t].append((int(s - bounds[t]), int(e - s), int(p)))
    return [sorted(t, key=lambda r: (r[0], r[2])) for t in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5))
def test_runs_of_few_letters(texts):
    assert _runs(texts) == [brute_runs(t) for t in texts]


def test_structured_words(monkeypatch):
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(512)]
    texts = [fib[-1], thue, [5] * 400, [0, 1, 2] * 40, [], [1], [7] * 11, [7] * 12, list(range(50)) * 2, list(range(50)) * 2 + [0], [1, 2] * 6 + [2, 1] * 6]
    expected = [brute_runs(t) for t in texts]
    assert _runs(texts) == expected
    monkeypatch.setattr(periodic, "PAIRS", 100)  # pairs in many parts
    assert _runs(texts) == expected


def test_lying_hashes_are_found_out(monkeypatch):
    """With hashes that call everything equal at the first attempt, the words decide and the slice is done again."""
    true = periodic.PrefixHashes.equal
    tries = []

    class Lying(periodic.PrefixHashes):
        def __init__(self, ids, attempt=0):
            super().__init__(ids, attempt)
            self.attempt = attempt
            tries.append(attempt)

        def equal(self, at, period, length):
            return true(self, at, period, length) if self.attempt else np.ones(len(at), bool)

    monkeypatch.setattr(periodic, "PrefixHashes", Lying)
    words = [1, 2, 3] * 5 + list(range(10, 60)) + [1, 2]
    assert _runs([words]) == [brute_runs(words)] and tries == [0, 1]


def test_odd_rows(spark):
    long = "a b c " * 30_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 12), (4, "x " * 12), (None, "y " * 13), (5, "é ß z " * 6), (6, long), (7, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as runs", "1 as n_words", "'z' as __text")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(df).collect())
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "x"), (4, 12, [(0, 12, 1)], "x"), (0, 13, [(0, 13, 1)], "y"),
        (5, 12, [(0, 12, 2)], "é ß z"), (6, 90_001, [(0, 90_000, 3)], "a b c end"), (7, 1, [], "one"),
    ])
    assert periodic.find_runs(df.where("doc_id > 100")).count() == 0
    assert periodic.plant(df.where("doc_id > 100")).count() == 0


def test_query_by_brute_force(spark):
    sf = SF
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op12_harmonic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for doc_id, text in docs.items():
        words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        r = got[doc_id]
        runs = brute_runs(words) if len(words) < 300 else quick_brute_runs(words)
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert some > 10
