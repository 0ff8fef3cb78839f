"""Packing, neighbours, archives, mixing, search and the pipeline."""

import gzip
import io
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import ann, mixing, packing, queries, topk, warc

SF = "/root/testdata/sf0.001"


def test_pieces_are_powers_of_two_and_complete(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = ["", None, "one", "a b  c\n\nd", "日本 ½ <|endoftext|> it's", "word " * 5000, "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (0, "again")], "doc_id long, text string").withColumn("start", F.lit("x"))
    got = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert len({r["sequence_id"] for r in got}) == len(got)
    for i, text in enumerate(texts[1:], 1):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in pieces for x in r["ids"]] == ids
        for r in pieces:
            assert r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["length"] <= 2048 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["offset"] == 0
    assert sum(r["length"] for r in got if r["doc_id"] == 0) == 1 + 2


def test_ids_are_those_of_the_plain_call():
    """On all documents of a small table, on odd spacing and on contents of added tokens."""
    import pyarrow.parquet as pq
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    texts += ["", " ", "  ", "a ", " a", "a  b", "a   b", "a \n b", "a\n b", "a\n\n  b ", "\t x", "it's 's '", "a\u00a0 b", "a \u3000b", "x" * 100_000, "end.\nNext 12,5%"]
    texts += [f"a {x.content} b{x.content}" for x in t.get_added_tokens_decoder().values()]
    encode = packing.encoder(path, P.PATTERN)
    for i in range(0, len(texts), 200):
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts[i : i + 200])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts[i : i + 200]]


def test_cut_and_splitter():
    import public_tokenizers as P
    import regex

    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        assert sum(packing.cut(n)) == n and all(x & (x - 1) == 0 for x in packing.cut(n))
    for text in ("Don't  stop\n\n 12 ²x½", "élève 3.5%  ", "a\x1cb　 c", "× ÷ Ðe\t\r\n end "):
        assert packing.splitter(P.PATTERN)(text) == regex.compile(P.PATTERN).findall(text)
    with pytest.raises(ValueError):
        packing.pack(None, "", "", max_length=100)


def test_chi_square_quantile():
    assert math.isclose(ann.chi_square_quantile(0.95, 2), -2 * math.log(0.05), rel_tol=1e-9)
    assert math.isclose(ann.chi_square_quantile(0.95, 8), 15.507313, rel_tol=1e-6)


def test_neighbour_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 16), (5004, [float("nan")] + [1.0] * 15), (5005, [None] + [1.0] * 15), (5006, [1.0, 2.0]), (None, [1.0] * 16), (5020, [0.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=400, round_bytes=2000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(best) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(math.isclose(sc, x[v] @ x[q], rel_tol=1e-9) for _, v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 4
    assert ann.nearest(df.where("vec_id = 5001"), F.col("vec_id") % 20 == 0).count() == 0


def _recall(x, q_at, k=20):
    """(recall, share of rows verified) of a search over one shard."""
    asked = ann.Asked(q_at, q_at, x[q_at], k)
    ann.search_shard(np.arange(len(x)), x, asked)
    hit = 0
    for row, q in enumerate(q_at):
        s = x @ x[q]
        s[q] = -np.inf
        assert (np.diff(asked.best[row]) <= 0).all() and q not in asked.best_id[row]
        hit += len(set(np.argpartition(-s, k)[:k]) & set(asked.best_id[row]))
    return hit / (k * len(q_at)), asked.verified / (len(x) * len(q_at))


def test_stop_leaves_rows_unverified():
    """Recall of 0.9 with a part of the rows verified, on the table and on 100000 vectors in clusters."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(table.column("embedding").to_pylist()).astype(float)
    recall, verified = _recall(x, np.arange(0, len(x), 100))
    assert recall >= 0.9 and verified < 0.65, (recall, verified)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))[rng.integers(0, 500, 100_000)] + 0.5 * rng.normal(size=(100_000, 64))
    recall, verified = _recall(x, np.arange(0, 100_000, 2000))
    assert recall >= 0.9 and verified < 0.3, (recall, verified)


def test_neighbours_of_repeated_query_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.1, 3.0]), (3, [2.0, 0.1]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 2).collect())
    assert got == [(20, 1, 1, 2.0), (20, 1, 2, 3.0), (20, 2, 1, 0.1), (20, 2, 3, 2.0)]


def test_arc_versions_are_parsed():
    one = b"filedesc://a 0.0.0.0 20240101000000 text/plain 76\n1 0 x\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 17
    body = b"HTTP/1.1 200 OK\r\n\r\nhi\nyou"
    data = one[: one.index(b"\n") + 1] + one[one.index(b"\n") + 1 :][:76] + b"\n"
    data += b"http://a 1.2.3.4 20240101000000 text/html %d\n" % len(body) + body + b"\n"
    (fields, got), *_ = list(warc.parse_arc(io.BytesIO(data)))
    assert got == body and fields["IP-address"] == "1.2.3.4"
    block = f"2 0 x\n{warc.ARC_FIELDS['2']}\n".encode()
    data = b"filedesc://a 0.0.0.0 20240101000000 text/plain %d\n" % len(block) + block + b"\n"
    data += b"http://b 1.2.3.4 20240101000000 text/html 404 - - 0 f.arc %d\n" % len(body) + body + b"\n"
    (fields, got), *_ = list(warc.parse_arc(io.BytesIO(data)))
    assert got == body and fields["Result-code"] == "404"
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"http://b 1.2.3.4 5\nhello\n")))


def test_archives_round_trip(spark):
    long, other = "x" * 120, "WARC/1.0\r\n\r\n" * 12
    rows = [(5, "http://a/ b", long), (2, None, long), (9, "u", long), (2, "u", long), (7, "u", "tiny"), (8, "u", "tiny"), (1, "u", None), (3, "u", ""), (None, "u", long), (-4, "é", other), (6, "v", other), (None, "w", "né" * 70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(df).collect())
    want = [("5", 120, "revisit", 2), ("2", 120, "response", None), ("9", 120, "revisit", 2), ("2", 120, "response", None), ("7", 4, "response", None), ("8", 4, "response", None), ("1", 0, "response", None), ("3", 0, "response", None), ("None", 120, "response", None), ("-4", 144, "response", None), ("6", 144, "revisit", -4), ("None", 210, "response", None)]
    assert got == sorted(want)


def test_revisits_refer_to_written_responses(spark):
    long = "x" * 120
    rows = [(5, "http://a/ b", long), (2, None, long), (9, "u", long), (2, "u", long), (2, "u", long), (None, "u", long), (None, "u", long), (None, "u", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc, out = warc.scratch.new_path(spark, "arc"), warc.scratch.new_path(spark, "warc")
    warc.write_arc(df, arc)
    warc.convert(spark, arc, out)
    records = [h for r in warc._files(spark, out).collect() for h, _ in warc.parse_warc(io.BytesIO(gzip.decompress(bytes(r["content"]))))]
    ids = [h["warc-record-id"] for h in records]
    assert len(set(ids)) == len(ids) == len(rows)
    responses = {h["warc-record-id"]: h["warc-payload-digest"] for h in records if h["warc-type"] == "response"}
    revisits = [h for h in records if h["warc-type"] == "revisit"]
    assert len(revisits) == 2
    assert all(responses[h["warc-refers-to"]] == h["warc-payload-digest"] for h in revisits)


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    for name, sql in queries.ORACLE_SQL.items():
        df, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        at = [list(want.columns).index(c) for c in df.columns]
        a = sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)
        assert a == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr), name


def test_mixing_meets_its_limits(spark):
    sizes = {"a": 60, "b": 25, "c": 10, "d": 5}
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, text string, source string")
    src = spark.createDataFrame([(s, 10 * n) for s, n in sizes.items()], "k string, tokens long")
    a = mixing.bisect_exponent(src, 1000, 1000, 0.9, 100.0)
    p = np.array(list(sizes.values())) / 100
    w = p**a / (p**a).sum()
    assert math.isclose(-(w * np.log(w)).sum() / math.log(4), 0.9, abs_tol=1e-6)
    b = mixing.bisect_exponent(src, 1000, 1000, 1.0, 2.0)
    w = p**b / (p**b).sum()
    assert math.isclose((w / p).max(), 2.0, rel_tol=1e-6)
    got = mixing.plan(docs, 0.9, 100.0, blocks=4).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.first("weight").alias("w")).collect()
    assert all(0 <= 1000 * r["w"] - r["t"] <= 10.01 for r in got)


def _entropy(shares, a):
    p = np.array(shares, float) / sum(shares)
    w = (p / p.max()) ** a
    w = w / w.sum()
    return -(w * np.log(w, where=w > 0, out=np.zeros_like(w))).sum() / math.log(len(p)), (w / p).max()


@pytest.mark.parametrize("target", [0.3, 0.5, 0.74, 0.75, 0.9, 0.99])
def test_mixing_meets_its_target_from_both_sides(spark, target):
    """Shares .60 .25 .10 .05 have an entropy of 0.745: exponents over one below it, under one above."""
    shares = [600, 250, 100, 50]
    src = spark.createDataFrame([(str(i), n) for i, n in enumerate(shares)], "k string, tokens long")
    a = mixing.bisect_exponent(src, 1000, 1000, target, 1e9)
    assert math.isclose(_entropy(shares, a)[0], target, abs_tol=1e-8) and (a > 1) == (target < 0.745)
    near = [1000, 999, 998]
    src = spark.createDataFrame([(str(i), n) for i, n in enumerate(near)], "k string, tokens long")
    a = mixing.bisect_exponent(src, sum(near), sum(near), target, 1e9)
    assert math.isclose(_entropy(near, a)[0], target, abs_tol=1e-6) and a > 100


def test_mixing_stops_at_the_limit_from_both_sides(spark):
    shares = [600, 250, 100, 50]
    src = spark.createDataFrame([(str(i), n) for i, n in enumerate(shares)], "k string, tokens long")
    for target, limit in ((0.01, 1.5), (0.999, 3.0)):
        a = mixing.bisect_exponent(src, 1000, 1000, target, limit)
        assert math.isclose(_entropy(shares, a)[1], limit, rel_tol=1e-8) and (a > 1) == (target < 0.5)
    with pytest.warns(UserWarning, match="as they are"):
        assert mixing.bisect_exponent(src, 1000, 5000, 0.5, 2.0) == 1.0  # every source is shown five times already


def brute_copies(rows, entropy, repeats, cover, blocks=mixing.BLOCKS):
    """(n_tokens, copies) of rows (id, text, source) by the definition of the mixture, quotas and permutations."""
    import hashlib
    import re

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = []
    for i, text, source in rows:
        order = md5(f"1:{'' if i is None else i}")
        docs.append(("null" if source is None else f"={source}", order, int(order[:8], 16) % blocks, len(re.findall(r"[^\x09-\x0D\x20]+", text or ""))))
    size = {}
    for k, _, _, n in docs:
        size[k] = size.get(k, 0) + n
    full = {k: n for k, n in size.items() if n}
    total = sum(full.values())
    shares = list(full.values())

    def shown(a):
        p = (np.array(shares, float) / max(shares)) ** a
        each = p / np.array(shares)
        return each.max() / each.min() if cover else each.max() / p.sum() * total

    low, high = 0.0, 1.0
    if (sharp := _entropy(shares, 1.0)[0] > entropy):
        low = 1.0
        high = next(2.0**k for k in range(1, 40) if _entropy(shares, 2.0**k)[0] < entropy or shown(2.0**k) > repeats)
    for _ in range(100):
        a = (low + high) / 2
        good = (_entropy(shares, a)[0] >= entropy if sharp else _entropy(shares, a)[0] <= entropy) and shown(a) <= repeats
        low, high = (a, high) if sharp == good else (low, a)
    p = {k: (n / max(shares)) ** low for k, n in full.items()}
    scale = max(full[k] / p[k] for k in full) if cover else total / sum(p.values())
    out = []
    for k, order, block, n in docs:
        if not size[k]:
            out.append((n, int(cover)))
            continue
        quota = max(size[k], int(round(scale * p[k], 3))) if cover else int(round(scale * p[k], 3))
        epochs, rest = divmod(quota, size[k])
        # Shown once more: documents before the quota's end in the order of permuted blocks.
        first = lambda b: (md5(f"1:{k}:group:{b // mixing.BLOCKS}"), b // mixing.BLOCKS, md5(f"1:{k}:{b}"), b)
        upto = sum(m for k2, o2, b2, m in docs if k2 == k and (first(b2) < first(block) or (b2 == block and o2 <= order)))
        whole = sum(m for k2, _, b2, m in docs if k2 == k and (first(b2) < first(block) or b2 == block))
        before = sum(m for k2, _, b2, m in docs if k2 == k and first(b2) < first(block))
        out.append((n, epochs + int(rest > before and (rest >= whole or upto <= rest))))
    return out


@pytest.mark.parametrize("entropy, repeats, cover", [(0.6, 4.0, False), (0.95, 4.0, False), (0.6, 1.4, True), (0.95, 2.5, True), (0.05, 3.0, True)])
def test_mixing_by_brute_force(spark, entropy, repeats, cover):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), "aaaabbc"[i % 7] if i % 11 else None) for i in range(230)] + [(500, None, "none"), (501, "", "none"), (None, "x y", "a"), (3, "x y z", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs, entropy, repeats, cover=cover, blocks=mixing.BLOCKS * 5).collect()
    want = brute_copies(rows, entropy, repeats, cover, mixing.BLOCKS * 5)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"], r["copies"]) for r in got), key=key) == sorted(((i, s, *c) for (i, _, s), c in zip(rows, want, strict=True)), key=key)
    assert len({c for _, c in want}) > 1


def test_mixing_changes_the_given_table(spark):
    """The sources of the table are flatter than the target: documents are left out and repeated, and the entropy is met."""
    got = queries.op8_temperature_mix(spark, "/root/testdata/sf0.01").collect()
    assert {0, 1, 2} <= {r["copies"] for r in got}
    weight = {r["source"]: r["weight"] for r in got}
    assert math.isclose(-sum(w * math.log(w) for w in weight.values()) / math.log(len(weight)), queries.MIX_ENTROPY, abs_tol=1e-6)
    shown = {k: sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == k) for k in weight}
    total = sum(r["n_tokens"] for r in got)
    longest = max(r["n_tokens"] for r in got)
    assert all(0 <= weight[k] * total - n <= longest + 1 for k, n in shown.items())


def test_mixing_cover_and_odd_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "c d e", None), (None, "f", "y"), (4, "", "z"), (1, "a b", "x"), *[(10 + i, "w " * 20, "big") for i in range(30)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x")).withColumn("weight", F.lit(0))
    out = mixing.mix(docs, 0.9, 3.0, cover=True)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"], r["source"]] = n.get((r["doc_id"], r["source"]), 0) + 1
    assert set(n) == {(r[0], r[2]) for r in rows} and max(n.values()) <= 8
    assert mixing.mix(docs.where("doc_id = -1"), 0.9, 3.0).count() == 0


def test_mixing_takes_any_column_name(spark):
    rows = [(i, "w " * (i % 5), "xyz"[i % 3], 1, 2, "t", "l", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, room int, epochs int, tokens string, last string, `a.b` int")
    plain = mixing.plan(docs.select("doc_id", "text", "source"), 0.9, 3.0).select("doc_id", "copies").collect()
    out = mixing.plan(docs, 0.9, 3.0)
    assert out.columns == [*docs.columns, "n_tokens", "weight", "copies"]
    assert sorted(map(tuple, plain)) == sorted((r["doc_id"], r["copies"]) for r in out.collect())
    assert mixing.mix(docs, 0.9, 3.0).columns == docs.columns
    even = spark.createDataFrame([(s, 10) for s in "abcd"], "k string, tokens long")
    with pytest.warns(UserWarning, match="as they are"):
        assert mixing.bisect_exponent(even, 40, 40, 0.9, 4.0) == pytest.approx(1.0)


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    """Pages of several MB, with small bounds: files hold few of them, rows leave a reader in small batches, nothing is lost."""
    monkeypatch.setattr(warc, "SIZES", ((1000, 50), (100_000, 4), (1 << 62, 2)))
    rows = [(i, f"http://h/{i}", "s" * i) for i in range(120)] + [(200 + i, "http://m", f"{i} " * 3000) for i in range(9)] + [(300 + i, "http://l", f"{i % 3}é" * 1_000_000) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    arc, out = warc.scratch.new_path(spark, "arc"), warc.scratch.new_path(spark, "warc")
    warc.write_arc(df, arc)
    warc.convert(spark, arc, out)
    for path, magic in ((arc, warc.parse_arc), (out, warc.parse_warc)):
        for r in warc._files(spark, path).collect():
            sizes = [len(body) for head, body in magic(io.BytesIO(gzip.decompress(bytes(r["content"])))) if "filedesc" not in str(head)]
            largest = max(sizes, default=0)
            assert len(sizes) <= 50 and (largest < 2000 or len(sizes) <= 4) and (largest < 200_000 or len(sizes) <= 2)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, out).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    again = {i: first[h] for i, _, h in rows if len(h) >= 100 and first[h] < i}
    assert got == {i: (len(h.encode()), "revisit" if i in again else "response", again.get(i)) for i, _, h in rows}
    content = gzip.compress(b"2 0 x\n") + gzip.compress(b"") + gzip.compress(b"next member")
    import pyarrow as pa

    assert warc._inflated(pa.scalar(content, pa.binary())).read() == b"2 0 x\nnext member"
    monkeypatch.setattr(warc, "BATCH_BYTES", 1000)
    batches = list(warc._batches(((900, (i, b"x")) for i in range(7)), [pa.int64(), pa.string()], ["a", "b"]))
    assert [b.num_rows for b in batches] == [1, 1, 1, 1, 1, 1, 1] and batches[0].column(1).to_pylist() == ["x"]


def test_cut_archives_are_errors():
    line = b"http://b 1.2.3.4 20240101000000 text/html 50\nhello\n"
    with pytest.raises(ValueError, match="declares 50 bytes"):
        list(warc.parse_arc(io.BytesIO(line)))
    with pytest.raises(ValueError, match="declares 9 bytes"):
        list(warc.parse_warc(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_warc(io.BytesIO(b"hello\r\n")))


def test_equal_payloads_match_sql(spark, tmp_path):
    """The tables hold no equal payloads of 100 bytes, so revisits meet their SQL here."""
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["x" * 120, "y" * 99, "x" * 120, None, "", "y" * 99, "é" * 50, "é" * 50, "x" * 120])] + [(-3, "u", "z" * 200), (12, None, "z" * 200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df, want = queries.op6_arc_to_warc(spark, str(tmp_path)), con.sql(queries.OP6_SQL)
    at = [list(want.columns).index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert sum(r[3] == "revisit" for r in got) == 4


def brute_bm25(rows, asks, k):
    import re

    docs = [(i, re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    n, mean = len(docs), sum(len(w) for _, w in docs) / max(len(docs), 1)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, words in docs:
        if q is None or not asks(q):
            continue
        scores = []
        for i, w in docs:
            if i is None or i == q:
                continue
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(words))
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard", [1000, 40])
def test_search_against_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    words = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)])
    weight = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=weight / weight.sum()))) for i in range(240)]
    rows += [(240, None), (241, ""), (242, "12 34"), (None, "wa wb waa"), (243, rows[20][1]), (244, rows[20][1]), (260, "Zebra ÉCLAIR " + rows[3][1]), (261, "zebra éclair ÉCLAIR")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.search(df, F.col("doc_id") % 20 == 0, 7, shard_docs=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_bm25(rows, lambda q: q % 20 == 0, 7)
    assert topk.search(df.where("doc_id = -1"), F.col("doc_id") % 20 == 0).count() == 0


def test_search_skips_blocks_and_takes_rounds(spark):
    """Four vocabularies: most blocks of documents stay closed, and several rounds find what one finds."""
    from pixelframe.llm.textscan import Words, string_buffers

    rng = np.random.default_rng(9)
    weight = 1 / np.arange(1, 401)
    texts = [" ".join(f"{'abcd'[i % 4]}{chr(97 + w % 26)}{chr(97 + w // 26)}" for w in rng.choice(400, 40, p=weight / weight.sum())) for i in range(4000)]
    import pyarrow as pa

    words = Words(*string_buffers(pa.array(texts)))
    doc, term, tf = topk.postings(words)
    known, number, df = np.unique(term, return_inverse=True, return_counts=True)
    asks = doc % 20 == 0
    queries = topk.Queries(np.arange(0, 4000, 20), np.bincount(doc[asks] // 20), known, np.log1p((4000 - df + 0.5) / (df + 0.5)), number[asks], 10)
    for part in np.array_split(np.arange(4000), 2):
        shard = topk.Shard(40.0, queries)
        shard.add(part, Words(*string_buffers(pa.array([texts[i] for i in part]))))
        shard.close().search_all()
    assert 0 < queries.opened < 0.5 * queries.blocks
    matrix = np.zeros((4000, len(known)))
    matrix[doc, number] = tf * 2.2 / (tf + 1.2)
    for row in range(0, 200, 17):
        q = 20 * row
        s = np.round((matrix * ((matrix[q] > 0) * np.log1p((4000 - df + 0.5) / (df + 0.5)))).sum(axis=1), 6)
        s[q] = -1
        assert queries.best_id[row].tolist() == np.lexsort((np.arange(4000), -s))[:10].tolist()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:600])], "doc_id long, text string")
    once = topk.search(frame, F.col("doc_id") % 20 == 0, 5)
    again = topk.search(frame.repartition(3), F.col("doc_id") % 20 == 0, 5, shard_docs=70, round_bytes=1, ahead_docs=100)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_search_in_very_long_texts(spark):
    rows = [(0, "ab cd " * 100_000), (1, "cd"), (20, "ab " * 5 + "zz"), (2, "zz " * 200_000 + "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in topk.search(df, F.col("doc_id") % 20 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_bm25(rows, lambda q: q % 20 == 0, 3)


def test_search_reads_each_text_once(spark):
    """Several rounds of queries and a part passed ahead share one index; many copies tie."""
    read = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{chr(97 + w % 26)}{chr(97 + w // 26)}" for w in rng.choice(90, 12)) for _ in range(240)]
    texts[100:160] = ["same old text"] * 60

    def text(i):
        read.add(1)
        return texts[i]

    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.udf(text, "string")("id").alias("text"))
    got = {}
    for r in topk.search(docs, F.col("doc_id") % 20 == 0, 7, shard_docs=50, round_bytes=1, ahead_docs=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_bm25(list(enumerate(texts)), lambda q: q % 20 == 0, 7)
    assert read.value == 240


def test_search_holds_little_at_a_time(spark, monkeypatch):
    """No step hands Python many rows of texts or of the index at once; a shard is arranged in a few times its postings."""
    import tracemalloc

    import pyarrow as pa
    from pixelframe.llm.textscan import Words, string_buffers

    limit, large = 20_000, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(topk, "ARROW_BYTES", limit, raising=False)

    def seen(batches):
        for batch in batches:
            large.add(int(batch.num_rows > 1 and batch.nbytes > 2 * limit))
            yield batch

    index, passed = topk.index, topk.pass_shards
    monkeypatch.setattr(topk, "index", lambda base, *a: index(base.mapInArrow(seen, base.schema), *a))
    monkeypatch.setattr(topk, "pass_shards", lambda shards, *a: passed(shards.mapInArrow(seen, shards.schema), *a))
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{chr(97 + w % 26)}{chr(97 + w // 26)}" for w in rng.choice(600, 300)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in topk.search(docs, F.col("doc_id") % 100 == 0, 5, shard_docs=50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == brute_bm25(list(enumerate(texts)), lambda q: q % 100 == 0, 5)
    assert large.value == 0

    words = Words(*string_buffers(pa.array(texts * 10)))
    doc, term, tf = topk.postings(words)
    known, number, df = np.unique(term, return_inverse=True, return_counts=True)
    queries = topk.Queries(np.array([0]), np.array([(doc == 0).sum()]), known, np.log1p(4000 / df), number[doc == 0], 5)
    shard = topk.Shard(300.0, queries)
    shard.add(np.arange(4000), words)
    tracemalloc.start()
    held = shard.documents.arrays()
    assert tracemalloc.get_traced_memory()[1] < 40 * len(doc)
    tracemalloc.stop()
    tracemalloc.start()
    shard.close(held)
    most = tracemalloc.get_traced_memory()[1] - shard.dense.nbytes
    tracemalloc.stop()
    assert most < 35 * len(doc)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs
    counts = {k: v.select("doc_id").distinct().count() for k, v in kept.items()}
    assert counts["language_id"] <= counts["input"] and counts["simhash"] < counts["language_id"]
    assert counts["mixing"] == counts["suffix_dedup"] == counts["packing"]
    for name in ("language_id", "simhash", "suffix_dedup", "mixing"):
        assert kept[name].columns == kept["input"].columns
    pieces = kept["packing"].agg(F.sum("length")).first()[0]
    whole = kept["packing"].where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces == whole
    for v in kept.values():
        v.unpersist()
