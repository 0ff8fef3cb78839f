"""Near copies by five-word shingles: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

1. Every document becomes its set of shingle hashes; equal sets are one node.
2. SimHash fingerprints of three-word shingles, linked within 3 bits through BK-trees (``simhash.links``), connect nodes.
   Fingerprints of short texts differ in more bits, so nodes that share one of 40 bands of 7 minima each are connected
   as well, whatever their similarity; both together are the coarse components.  A pair of exactly 0.8 shares a band with
   probability 1 - (1 - 0.8^7)^40 = 0.99992, one of 0.85 with 1 - 2e-7.
3. All pairs within a coarse component are compared exactly, by the sizes of their sets
   and of the intersection.  Large components are cut into chunks and every pair of
   chunks is a cell of its own, so no task gets an unbounded one and no pair is lost.

Each set moves once for every chunk of its own coarse component, and not at all where a
document has no company.  Results are the components of the exact links.

Defined results: documents of one to five words are one shingle; null texts and texts
without words share the empty set, so they are one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import scratch, simhash
from pixelframe.llm.textscan import mix64, slices, string_buffers
from pixelframe.operators.graph import components

WORDS = 5
#: Smallest Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 7
#: Sets and shingles of a chunk of a coarse component.
CHUNK_SETS, CHUNK_SHINGLES = 1024, 1 << 18
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(simhash.shingle_hashes(text, WORDS), np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) values of sets that are not empty; two sets share one where all its minima are equal."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    room = np.empty_like(flat)
    for band in range(BANDS):
        value = np.full(len(sets), band + 1, np.uint64)
        for t in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(flat, _FLIP[t], out=room)
            np.multiply(room, _ODD[t], out=room)
            value = mix64(value ^ np.minimum.reduceat(room, starts))
        out[:, band] = value
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, sketch: bool) -> DataFrame:
    """id, ``key`` of the set, and with ``sketch`` its ``size``, ``bands`` and SimHash ``fp``, else the ``set`` itself."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = string_buffers(batch.column(1))
            raw = data.tobytes()
            sets = [shingle_set(raw[s:e]) for s, e in pairwise(offsets.tolist())]
            packed = [s.tobytes() for s in sets]
            keys = pa.array(np.array([xxhash.xxh64_intdigest(p, 7) for p in packed], np.uint64).view(np.int64))
            if not sketch:
                yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(packed, pa.binary())], names=names)
                continue
            size = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            values = bands(full).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum((size > 0) * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            hashes = [simhash.shingle_hashes(raw[s:e]) for s, e in pairwise(offsets.tolist())]
            doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
            fp = simhash.majority(np.array(list(chain.from_iterable(hashes)), np.uint64), doc, len(hashes)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(size), lists, pa.array(fp)], names=names)

    rest = "size long, bands array<long>, fp long" if sketch else "set binary"
    names = [id_col, "key", *(x.split()[0] for x in rest.split(", "))]
    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, key long, {rest}")


def similar(members: list[np.ndarray], asks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of asks, index of members) of all pairs that are similar enough; no set is empty."""
    names, ids = np.unique(np.concatenate([*members, *asks]), return_inverse=True)
    size = np.array([len(s) for s in members])
    n_ids = int(size.sum())
    starts = np.cumsum(size) - size
    mark = np.zeros(len(names), np.int64)
    a, b, at = [], [], n_ids
    for k, s in enumerate(asks):
        own = ids[at : at + len(s)]
        at += len(s)
        mark[own] = 1
        both = np.add.reduceat(mark[ids[:n_ids]], starts)
        mark[own] = 0
        hit = np.flatnonzero(SIMILAR[1] * both >= SIMILAR[0] * (len(s) + size - both))
        a.append(np.full(len(hit), k))
        b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the cells (group, i, j), which come sorted; only one cell is held at a time."""

    def settle(i: int, j: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        member = [(key, np.frombuffer(s, np.uint64)) for chunk, key, s in rows if chunk == i]
        ask = member if i == j else [(key, np.frombuffer(s, np.uint64)) for chunk, key, s in rows if chunk == j]
        if not member or not ask:
            return
        q, t = similar([s for _, s in member], [s for _, s in ask])
        a, b = np.array([k for k, _ in ask], np.int64)[q], np.array([k for k, _ in member], np.int64)[t]
        a, b = a[a != b], b[a != b]
        if len(a):
            a, b = simhash._stars(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    cell, rows = None, []
    for batch in batches:
        for group, i, j, chunk, key, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, i, j) != cell:
                if rows:
                    yield from settle(cell[1], cell[2], rows)
                cell, rows = (group, i, j), []
            rows.append((chunk, key, s))
    if rows:
        yield from settle(cell[1], cell[2], rows)


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(a, b) that connect the nodes (key, fp) whose SimHash fingerprints are linked within 3 bits."""
    prints = scratch.table(nodes.select("fp").distinct(), "prints")
    linked = components(simhash.links(prints.select("fp", F.col("fp").alias("node")), prints.count()))
    named = nodes.select("key", "fp").join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("component", "fp").alias("print"))
    first = named.groupBy("print").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").select("print", "low")
    return named.join(first, "print").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """id and ``near_group`` (a number that near copies share) of every document; ids are not null."""
    spark = docs.sparkSession
    marked = scratch.table(_sets(docs, id_col, text_col, sketch=True), "sets")
    nodes = scratch.table(marked.groupBy("key").agg(F.min(id_col).alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "nodes")
    cells = nodes.select("key", F.explode("bands").alias("band"))
    shared = cells.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    met = cells.join(shared, "band").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    coarse = components(met.union(_fingerprint_links(nodes.where("size > 0")))).select(F.col("node").alias("key"), F.col("component").alias("group"))
    company = scratch.table(nodes.select("key", "rep", "size").join(coarse, "key"), "company")
    n_company = company.count()

    parts = F.ceil(F.greatest(F.count("*") / chunk_sets, F.sum("size") / chunk_shingles)).cast("int")
    groups = scratch.table(company.groupBy("group").agg(parts.alias("p")), "groups")
    dealt = scratch.join_counted(company, groups.where("p > 1"), ["group"], "left", groups.where("p > 1").count())
    dealt = dealt.withColumn("p", F.coalesce("p", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("p")).cast("int"))

    texts = scratch.join_counted(docs.select(id_col, text_col), company.select(F.col("rep").alias(id_col)).distinct(), [id_col], "left_semi", n_company)
    sets = _sets(texts, id_col, text_col, sketch=False).select("key", "set").dropDuplicates(["key"])
    rows = sets.join(dealt.select("key", "group", "p", "chunk"), "key")
    pairs = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    rows = rows.withColumn("c", F.explode(pairs)).select("group", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "chunk", "key", "set")
    rows = rows.repartition(scratch.partitions(spark, n_company, 20_000), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    found = components(rows.mapInArrow(_compare, "a long, b long")).select(F.col("node").alias("key"), "component")
    named = marked.select(id_col, "key").join(found, "key", "left")
    return named.select(id_col, F.coalesce("component", "key").alias("near_group"))
