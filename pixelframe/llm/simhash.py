"""SimHash near-duplicates linked through BK-trees.

Fingerprints are 64 bits wide.  Two that differ in at most 3 bits agree in full on at
least one set of b - 3 of b bit blocks, so distinct fingerprints are dealt to shards by
(block set, bits of it), and each shard gets a BK-tree: a root, children keyed by their
integer Hamming distance to the parent, all shards of a task built level by level at
once.  A query follows only edges within the radius of its distance to a node.

The trees are dealt out with the queries by the shard key.  Broadcasting them would put
the fingerprints of all documents on every executor and on the driver, without a bound.
A shard of many fingerprints is cut into chunks, a tree each, and every pair of chunks is
a cell of its own, so no task gets an unbounded shard and no link is lost.  The number of
blocks follows the number of distinct fingerprints so that random company in a shard stays
rare at any size; every choice finds the same links.

Defined results: null or empty texts have fingerprint zero and link like any other; fewer
than three words are one shingle; equal fingerprints are one node, so thousands of copies
cost one; repeated rows repeat in the result; a document with a null id links others like any, and gets the smallest id
reachable from it (null if there is none).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import scratch
from pixelframe.llm.textscan import slices, string_buffers
from pixelframe.operators.graph import components

RADIUS = 3
#: Fingerprints of a shard that share a tree; larger shards are cut into chunks of this size.
CHUNK = 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of ``words`` ASCII-lowered words, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(itertools.accumulate(map(len, tokens), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :])]


def majority(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Bit-wise majority of the hashes of each of n documents; zero without hashes."""
    count = np.bincount(doc, minlength=n)
    out = np.zeros(n, np.uint64)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for lane in range(8):
        ones = np.bincount(doc * 256 + lanes[:, lane], minlength=n * 256).reshape(n, 256) @ _BITS
        for bit in range(8):
            out |= (2 * ones[:, bit] > count).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and ``fp`` (the 64 bits as a signed long) of every document."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            data, offsets = string_buffers(batch.column(1))
            raw = data.tobytes()
            all_hashes, sizes = [], []
            for s, e in itertools.pairwise(offsets.tolist()):
                h = shingle_hashes(raw[s:e], words)
                all_hashes += h
                sizes.append(len(h))
            fp = majority(np.array(all_hashes, np.uint64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, fp long")


class BkForest:
    """BK-trees of many shards: ``shard`` (sorted) numbers the tree of each distinct fingerprint."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        self.roots = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(fp) else np.zeros(0, np.int64)
        self.tree = shard[self.roots]
        above = self.roots[np.searchsorted(self.tree, shard)]
        waiting = np.flatnonzero(above != np.arange(len(fp)))
        parents, edges, nodes = [], [], []
        while len(waiting):
            at = above[waiting]
            key = at * 128 + np.bitwise_count(fp[waiting] ^ fp[at])
            slot, first, where = np.unique(key, return_index=True, return_inverse=True)
            parents.append(slot // 128)
            edges.append(slot % 128)
            nodes.append(waiting[first])
            above[waiting] = waiting[first][where]
            stay = np.ones(len(waiting), bool)
            stay[first] = False
            waiting = waiting[stay]
        parent, edge, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, edges, nodes))
        key = parent * 128 + edge
        order = np.argsort(key)
        self.key, self.node = key[order], node[order]

    def within(self, query: np.ndarray, shard: np.ndarray, radius: int = RADIUS, block: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node index) of all pairs within ``radius``, block by block of queries."""
        for i in range(0, len(query), block):
            q = np.arange(i, min(i + block, len(query)))
            tree = np.searchsorted(self.tree, shard[q])
            found = (tree < len(self.tree)) & (self.tree[np.minimum(tree, len(self.tree) - 1)] == shard[q])
            q, at = q[found], self.roots[tree[found]]
            while len(q):
                d = np.bitwise_count(query[q] ^ self.fp[at]).astype(np.int64)
                near = d <= radius
                yield q[near], at[near]
                low = np.searchsorted(self.key, at * 128 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.key, at * 128 + np.minimum(d + radius, 127), side="right")
                size = high - low
                q = np.repeat(q, size)
                at = self.node[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the pairs: (node, smallest node), smallest left out."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            keep = label != np.arange(len(names))
            return names[keep], names[label[keep]]
        label = new


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the cells (set, bits, i, j) of one partition; rows carry their chunk."""
    got = [[b.column(j).to_numpy(zero_copy_only=False) for j in range(b.num_columns)] for b in batches if b.num_rows]
    if not got:
        return
    part, bits, i, j, chunk, fp, node = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((fp, chunk, j, i, bits, part))
    part, bits, i, j, chunk, fp, node = (x[order] for x in (part, bits, i, j, chunk, fp, node))
    cell = np.cumsum(np.append(False, (part[1:] != part[:-1]) | (bits[1:] != bits[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    alone = np.bincount(cell)[cell] < 2
    cell, i, chunk, fp, node = (x[~alone] for x in (cell, i, chunk, fp.view(np.uint64), node))
    j = j[~alone]
    member = chunk == i  # the tree of a cell holds its first chunk; its second chunk asks
    asks = chunk == j
    forest = BkForest(fp[member], cell[member])
    ids, asker = node[member], node[asks]
    a, b, n = [], [], 0
    for q, t in forest.within(fp[asks], cell[asks]):
        keep = asker[q] != ids[t]
        a.append(asker[q[keep]])
        b.append(ids[t[keep]])
        n += len(a[-1])
        if n > 500_000:
            a, b = ([x] for x in _stars(np.concatenate(a), np.concatenate(b)))
            n = 0
    if a and sum(map(len, a)):
        a, b = _stars(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def blocks_for(n: int) -> int:
    """Bit blocks for n distinct fingerprints: shards keep little random company."""
    return 4 if n < 1 << 21 else 5 if n < 1 << 30 else 6


def links(nodes: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b) that connect the same nodes as all pairs of ``nodes`` (fp long, node long) within 3 bits."""
    spark = nodes.sparkSession
    blocks = blocks_for(n)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for kept in itertools.combinations(range(blocks), blocks - RADIUS):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in kept)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    sets = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
    rows = nodes.select("fp", "node", F.explode(sets).alias("s")).select("s.part", "s.bits", "fp", "node")
    large = scratch.table(rows.groupBy("part", "bits").count().where(F.col("count") > chunk), "hot")
    n_large, copies = large.agg(F.count("*"), F.sum(F.col("count") * F.ceil(F.col("count") / chunk))).first()
    large = large.select("part", "bits", F.ceil(F.col("count") / chunk).cast("int").alias("p"))
    rows = scratch.join_counted(rows, large, ["part", "bits"], "left", n_large)
    p = F.coalesce("p", F.lit(1))
    rows = rows.withColumn("p", p).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("p")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    rows = rows.withColumn("c", F.explode(cells)).select("part", "bits", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "chunk", "fp", "node")
    dealt = rows.repartition(scratch.partitions(spark, n * len(masks) + (copies or 0), 150_000), "part", "bits", "i", "j")
    return dealt.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) of every document."""
    marked = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    # Fingerprints are the nodes, so one that only rows without an id hold still connects others.
    nodes = scratch.table(marked.groupBy("fp").agg(F.min(F.col(id_col)).cast("long").alias("first")), "nodes")
    joined = components(links(nodes.select("fp", F.col("fp").alias("node")), nodes.count()))
    named = scratch.table(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "classes")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.table(named.join(smallest, "component").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")
