"""Prefix tries against a plain construction and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from pixelframe.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"


def brute_nodes(turns, every=20, most=3):
    """Nodes of rows (conv_id, turn, role, text) by prefixes as keys of a dictionary."""
    def digest(r, t):
        return hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]

    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = convs.get(c - c % every, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, who in members.items():
        more = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in kids)
            saved[node[:d]] = saved.get(node[:d], 0) + more
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, who in members.items()
    )


def _got(df):
    return sorted(tuple(r[c] for c in prefix_trie.NODE_COLUMNS) for r in df.collect())


def _all(spark, turns, **limits):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as words", "1 as depth", "2 as n")
    return _got(prefix_trie.nodes(prefix_trie.rebuild(prefix_trie.sequences(df)), **limits))


def _hot(seed):
    """Many copies, a first turn that most share, long ways without branches, ends at inner nodes."""
    rng = random.Random(seed)
    turns = []
    for c in range(120):
        kind = rng.random()
        if kind < 0.3:
            texts = ["hello there"] + ["a b"] * 5
        elif kind < 0.7:
            texts = ["hello there", "one two three"] + ["same again"] * 9 + [rng.choice(["x", "y y"]) for _ in range(rng.randrange(5))]
        else:
            texts = [rng.choice("pqrs") for _ in range(rng.randrange(1, 6))]
        turns += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("limit, per_task", [(100_000, 20_000), (8, 4)])
def test_oversized_subtries_are_dealt_again(spark, limit, per_task):
    turns = _hot(limit)
    assert _all(spark, turns, limit=limit, per_task=per_task) == brute_nodes(turns)


def test_packets_of_a_hot_conversation(spark, monkeypatch):
    """The ids of one node come in many packets and are hashed in numeric order."""
    turns = [(c, 0, "user", "all the same") for c in range(400)]
    monkeypatch.setattr(prefix_trie, "PACKET", 20)
    assert _all(spark, turns) == brute_nodes(turns)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 400), pa.array(range(400), pa.int64())], names=["key", "conv_id"])
    packets = pa.Table.from_batches(prefix_trie._packed(iter([batch.slice(0, 150), batch.slice(150)])))
    assert packets.num_rows > 50 and sum(packets.column("n").to_pylist()) == 400
    (row,) = pa.Table.from_batches(prefix_trie._hashed(iter(packets.to_batches(max_chunksize=7)))).to_pylist()
    assert row == {"conv_id": 0, "n": 400, "ends": hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()}


def test_odd_rows(spark):
    turns = [
        (None, 0, "user", "nobody"), (1, None, "user", "first"), (1, 1, "assistant", None), (1, 1, "assistant", "tie"), (1, 2, None, None), (2, 5, "user", ""), (2, 5, "user", ""),
        (3, 0, "user", "long " * 50_000), (23, 0, "user", "a"), (40, 0, "user", "b c"), (41, 0, "x", "y"), (-5, 0, "user", "minus"), (45, 0, "user", "q"), (46, 0, "user", "q"),
    ]
    for limits in ({}, {"limit": 1, "per_task": 1}):
        assert _all(spark, turns, **limits) == brute_nodes(turns)
    assert _all(spark, []) == [] and _all(spark, [(None, 1, "user", "x")]) == []


def test_query_matches_sql_and_brute_force(spark):
    got = _got(queries.op13_prefix_trie(spark, SF))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = con.sql(f"SELECT {', '.join(prefix_trie.NODE_COLUMNS)} FROM ({queries.OP13_SQL})").fetchall()
    turns = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got == sorted(sql, key=lambda r: r[:2]) == brute_nodes(turns) and len(got) > 50
