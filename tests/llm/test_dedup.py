"""SimHash, suffix dedup and components against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelframe.llm import simhash, suffix_dedup
from pixelframe.operators.graph import components

rng = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(40)]


def sample(n):
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(1, 60))))
        if rows and i % 3 == 0:
            words = rows[int(rng.integers(len(rows)))][1].split(" ")
            if len(words) > 20 and i % 2:
                words[int(rng.integers(len(words)))] = "new"
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "One"), (n + 4, "one"), (n + 4, "one"), (n + 5, "x y"), (n + 6, "É x y z")]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("chunk", [1024, 4])
def test_simhash_links(spark, monkeypatch, chunk):
    rows = sample(120)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash.links, "__defaults__", (chunk,))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("node", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert all(r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_every_table_layout_finds_the_same_links(spark, monkeypatch, blocks):
    base = rng.integers(0, 1 << 63, 30)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(6)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = [(r["a"], r["b"]) for r in simhash.links(nodes, len(fps)).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert classes(range(len(fps)), got) == classes(range(len(fps)), want)


def test_bk_trees_find_all_pairs():
    fp = np.unique(rng.integers(0, 1 << 12, 300)).astype(np.uint64)
    shard = np.sort(rng.integers(0, 3, len(fp)))
    found = {(int(q), int(t)) for a, b in simhash.BkForest(fp, shard).within(fp, shard) for q, t in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert found == want


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(df.where("doc_id = 9")).count() == 0


def test_a_fingerprint_without_ids_connects_others(spark, monkeypatch):
    """00 and 3f differ in six bits; 07, which only rows without an id hold, is within three of both."""
    rows = [(1, 0x00), (None, 0x07), (None, 0x07), (2, 0x3F), (9, 1 << 40 | 0xFF00), (None, (1 << 64) - 1)]
    marked = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, id_col, text_col: marked)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(marked).collect())
    assert got == Counter([(1, f"{0:016x}", 1), (None, f"{7:016x}", 1), (None, f"{7:016x}", 1), (2, f"{0x3F:016x}", 1), (9, f"{1 << 40 | 0xFF00:016x}", 9), (None, "f" * 16, None)])


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (200, 200), (5, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200}
    assert components(edges.where("a = -1")).count() == 0


def test_suffix_array():
    for _ in range(200):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 80)))
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] if r[0] is not None else 1 << 63, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in order:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = set()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            if w in seen:
                gone[k : k + 50] = True
            own.add(w)
        seen |= own
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) and gone[0]))
        out[i, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(n):
    passage = " ".join(rng.choice(WORDS, 40))
    line = "the very same line that nearly all of the documents do hold."
    rows = []
    for i in range(n):
        own = " ".join(rng.choice(WORDS, int(rng.integers(1, 80))))
        kind = i % 6
        text = {0: own, 1: f"{own} {passage} {own[:20]}", 2: f"{own}\n{line}\n{own[::-1]}", 3: passage[int(rng.integers(20)) :], 4: "De " * int(rng.integers(10, 90)), 5: rows[int(rng.integers(len(rows)))][1] if rows else own}[kind]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("kinds", [1024, 3])
def test_repeats_against_brute_force(spark, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    rows = [*texts(150), (900, None), (901, ""), (902, "é" * 60), (903, "é" * 60), (904, "x" * 49), (905, "x" * 49), (906, "x" * 50), (907, "x" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("x")).withColumn("runs", F.lit(2))
    want = brute(rows)
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"], by_id[r["doc_id"]]], r["doc_id"]


def test_repeated_and_null_ids(spark):
    rows = [*texts(30), *texts(30)[:10], (None, "the very same line that nearly all of the documents do hold. ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = suffix_dedup.remove_repeats(df, with_text=True).collect()
    key = lambda values: sorted(map(repr, values))
    assert key((r["doc_id"], *tuple(r)[1:5]) for r in got) == key((i, *want[i, t]) for i, t in rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix_dedup.remove_repeats(df.where("doc_id = -5")).count() == 0


def test_strings_of_split_buckets_meet_as_digests():
    """Two buckets whose fragments share few strings: four bytes for each different string, and only shared ones are sent whole."""
    shared = rng.integers(97, 123, 50).astype(np.uint8).tobytes()
    rows = [(bucket, True, 100 * bucket + i, [7], shared + rng.integers(97, 123, 31).astype(np.uint8).tobytes()) for bucket in (1, 2) for i in range(100)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(suffix_dedup._PIECES.names, r, strict=True)) for r in rows if r[0] == b], suffix_dedup._PIECES) for b in (1, 2)]
    out = pa.Table.from_batches([o for i, b in enumerate(batches) for o in suffix_dedup._sort(16, iter([b]))]).to_pylist()
    strings = sum(len({r[4][k : k + 50] for r in rows if r[0] == b for k in range(32)}) for b in (1, 2))
    parts = [r for r in out if r["part"] is not None]
    assert sum(len(r["packed"]) for r in parts) == 4 * strings
    units = [r["packed"] for r in out if r["unit"] is not None and r["part"] is None]
    sent = [(i, r["part"], r["packed"]) for i, r in enumerate(parts)]
    found = [o for p in range(16) for o in suffix_dedup._repeated(iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[r for r in sent if r[1] == p], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["unit", "part", "packed"])]))]
    again = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for b in found for x in b.column(1).to_pylist()]))
    common = {r[4][k : k + 50] for r in rows if r[0] == 1 for k in range(32)} & {r[4][k : k + 50] for r in rows if r[0] == 2 for k in range(32)}
    assert shared in common and len(common) <= len(again) < strings / 50
    whole = list(suffix_dedup._strings(16, iter([pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array([[again.tobytes()]] * 2, pa.list_(pa.binary()))], names=["packed", "wanted"])])))
    met = np.concatenate([np.frombuffer(x, suffix_dedup._MEET) for b in whole for x in b.column(1).to_pylist()])
    assert [(int(r["doc"]), int(r["run"])) for r in met if r["string"] == shared] == [(100, suffix_dedup._code(7, 1)), (200, suffix_dedup._code(7, 1))]
    covered = {(d, r >> 6) for b in suffix_dedup._meet(iter(whole)) for d, r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert (200, 7) in covered and all(d >= 200 for d, _ in covered)
