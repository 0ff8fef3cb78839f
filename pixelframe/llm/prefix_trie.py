"""Prefix tries over the turns of conversations.

A turn is known by a digest of its role and text, so texts are read once and never
shuffled.  A conversation is the array of its turns' digests and word counts.

1. Equal conversations become one row with their number, their smallest id and the digest of all ids.  The ids
   of a hot conversation are packed by ranges of (conversation, id), and a task hashes the packets in order.
2. Conversations are dealt by a hash of their first turn; a task builds pointer tries (a dictionary of
   children for each node) inside ``applyInPandas`` and sums the subtrees up in an iterative postorder.
3. A first turn whose conversations have more than ``LIMIT`` turns is not given to one task: all turns that they have in common
   become nodes by themselves, and the conversations are dealt again by the turn after those, as often as needed.
   The subtrees' sums are then joined back, the deepest first.

Defined results: turns are ordered by turn number (null first; ties by digest); a null role or text is empty;
rows without a conversation id are in no conversation and make no node; repeated rows are turns of their own;
further columns are ignored; an empty table has no node.  A conversation's digests (about 100 bytes a turn) are in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import scratch

#: Turns of the conversations of one subtrie that a task takes; beyond it the subtrie is dealt again by its next turn.
LIMIT = 100_000
#: Turns that a task gets on the average.
PER_TASK = 20_000
#: Letters of a packet of ids.
PACKET = 8192

EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, words): one row for each conversation, its turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"))


def rebuild(found: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns come from the conversation at the start of their block of ``every`` ids.

    h = crc32(decimal id) % (most + 1); the conversation's own turns after its first h follow.
    """
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("digests", 1, most).alias("hd"), F.slice("words", 1, most).alias("hw"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = found.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").withColumn("h", h)

    def whole(head: str, own: str, kind: str):
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.size(own)))

    return both.select("conv_id", whole("hd", "digests", "array<string>").alias("digests"), whole("hw", "words", "array<int>").alias("words"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) to packets (key, first id, number, ids joined by commas)."""
    out: list[tuple] = []
    key, first, n, texts, letters = None, 0, 0, [], 0

    def close() -> None:
        if key is not None:
            out.append((key, first, n, ",".join(texts)))

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "n", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or letters > PACKET:
                close()
                key, first, n, texts, letters = k, i, 0, [], 0
            n += 1
            texts.append(str(i))
            letters += len(texts[-1]) + 1
        if out:
            yield emit()
    close()
    if out:
        yield emit()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted packets to (smallest id, number, SHA-256 of all ids joined by commas) of each key."""
    out: list[tuple] = []
    key, first, n, state = None, 0, 0, None

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "n", "ends"])
        out.clear()
        return batch

    for batch in batches:
        for k, i, more, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key:
                if key is not None:
                    out.append((first, n, state.hexdigest()))
                key, first, n, state = k, i, 0, hashlib.sha256()
            else:
                state.update(b",")
            n += more
            state.update(ids.encode())
        if out:
            yield emit()
    if key is not None:
        out.append((first, n, state.hexdigest()))
        yield emit()


def distinct(found: DataFrame) -> DataFrame:
    """One row for each different conversation: (conv_id, digests, words, n, ends); conv_id is the smallest of its n, ends the digest of all."""
    keyed = scratch.table(found.withColumn("key", F.sha2(F.array_join("digests", ""), 256)), "conversations")
    pairs = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packets = pairs.mapInArrow(_packed, "key string, first long, n long, ids string")
    ends = packets.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "conv_id long, n long, ends string")
    return scratch.table(ends.join(keyed.drop("key"), "conv_id"), "distinct")


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes below the spine nodes ``at`` of the conversations of a bucket.

    A row's first ``depth`` turns lead to ``at``, whose smallest member is ``at_conv``.
    """
    children: list[dict] = []
    parent, depth, words, n, first, ends, top = [], [], [], [], [], [], []
    roots: dict[str, dict] = {}
    for at, at_conv, skip, digests, counts, copies, conv, end in zip(*[pdf[c] for c in ("at", "at_conv", "depth", "digests", "words", "n", "conv_id", "ends")], strict=True):
        place, before = roots.setdefault(at, {}), ~at_conv
        for d in range(skip, len(digests)):
            node = place.get(digests[d])
            if node is None:
                node = place[digests[d]] = len(children)
                children.append({})
                parent.append(before)
                depth.append(d + 1)
                words.append(int(counts[d]))
                n.append(0)
                first.append(conv)
                ends.append(EMPTY)
                top.append(at if d == skip else None)
            n[node] += copies
            first[node] = min(first[node], conv)
            place, before = children[node], node
        ends[before] = end  # different conversations end at different nodes, below ``at``
    leaves, saved = [0] * len(children), [0] * len(children)
    # A node is numbered before its children: backwards is a postorder.
    for node in range(len(children) - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (n[node] - 1) * words[node]
        if top[node] is None:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    above = [~p if t is not None else first[p] for p, t in zip(parent, top, strict=True)]
    columns = [first, depth, above, n, [len(c) for c in children], leaves, saved, ends, top]
    return pd.DataFrame(dict(zip([*NODE_COLUMNS, "top"], columns, strict=True)))


def nodes(found: DataFrame, limit: int = LIMIT, per_task: int = PER_TASK) -> DataFrame:
    """One row for each node: smallest member, depth, parent's smallest member, members, children, leaves and saved
    words of the subtree (each node's members but one times the words of its last text), digest of the ids that end there."""
    spark = found.sparkSession
    whole = distinct(found)
    total = whole.agg(F.min("conv_id"), F.sum("n"), F.count("*")).first()
    if not total[2]:
        return spark.createDataFrame([], _NODE)
    # The root is the first node that is split; spine nodes are kept with the words of the turns on the way from their parent.
    spine = [spark.createDataFrame([("", None, 0, total[0], total[1], None, [])], "at string, above string, depth int, conv_id long, n long, above_conv long, way array<int>")]
    members = whole.withColumns({"at": F.lit(""), "at_conv": F.lit(total[0]), "depth": F.lit(0)})
    tries, ended = [], []
    while members is not None:
        ended.append(members.where(F.size("digests") == F.col("depth")).select("at", "ends"))
        below = members.where(F.size("digests") > F.col("depth")).withColumn("next", F.get("digests", F.col("depth")))
        left = F.size("digests") - F.col("depth")
        stats = below.groupBy("at", "next").agg(F.sum(left).alias("turns"), F.count("*").alias("kinds"), F.sum("n").alias("n_below"), F.min("conv_id").alias("first"))
        big = scratch.table(stats.where((F.col("turns") > limit) & (F.col("kinds") > 1)), "oversized")
        rows = big.count()
        small = scratch.join_counted(below, big.select("at", "next"), ["at", "next"], "left_anti", rows) if rows else below
        turns = int(small.agg(F.sum(left)).first()[0] or 0)
        dealt = small.withColumn("bucket", F.pmod(F.xxhash64("at", "next"), F.lit(turns // per_task + 1)))
        columns = ["bucket", "at", "at_conv", "depth", "digests", "words", "n", "conv_id", "ends"]
        tries.append(scratch.table(dealt.select(columns).groupBy("bucket").applyInPandas(build, _NODE + ", top string"), "tries"))
        members = None
        if rows:
            # What all conversations of an oversized subtrie share is a way without branches.
            inside = scratch.table(scratch.join_counted(below, big, ["at", "next"], "inner", rows).withColumn("new", F.sha2(F.concat("at", "next"), 256)), "oversized")
            example = inside.where(F.col("conv_id") == F.col("first")).select("new", F.col("digests").alias("like"))
            differs = F.array_position(F.zip_with("digests", "like", lambda a, b: a.eqNullSafe(b)), False)
            common = F.when(differs == 0, F.size("digests")).otherwise(differs - 1).cast("int")
            shared = scratch.table(inside.join(example, "new").groupBy("new").agg(F.min(common).alias("shared")), "shared")
            inside = scratch.join_counted(inside, shared, ["new"], "inner", rows)
            way = F.slice("words", F.col("depth") + 1, F.col("shared") - F.col("depth"))
            here = inside.where(F.col("conv_id") == F.col("first"))
            spine.append(scratch.table(here.select(F.col("new").alias("at"), F.col("at").alias("above"), F.col("shared").alias("depth"), "conv_id", F.col("n_below").alias("n"), F.col("at_conv").alias("above_conv"), way.alias("way")), "spine"))
            members = scratch.table(inside.select(F.col("new").alias("at"), F.col("first").alias("at_conv"), F.col("shared").alias("depth"), "digests", "words", "n", "conv_id", "ends"), "members")
    out = [t.select(NODE_COLUMNS) for t in tries]
    kids = None
    for level in range(len(spine) - 1, -1, -1):
        tops = tries[level].where("top IS NOT NULL").select(F.col("top").alias("at"), "n_leaves", "saved_tokens")
        tops = tops if kids is None else tops.unionByName(kids)
        sums = tops.groupBy("at").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below"))
        node = spine[level].join(ended[level], "at", "left").join(sums, "at", "left").select("*", F.posexplode_outer("way"))
        # Position 0 of the way is the turn after the parent; its last is the spine node.
        last = F.coalesce(F.col("pos") == F.size("way") - 1, F.lit(True))
        rest = F.aggregate(F.slice("way", F.col("pos") + 1, F.size("way")), F.lit(0).cast("long"), lambda a, w: a + w)
        row = node.select(
            "at", "above", F.coalesce("pos", F.lit(0)).alias("pos"), "conv_id", (F.col("depth") - F.when(last, 0).otherwise(F.size("way") - 1 - F.col("pos"))).cast("long").alias("depth"),
            F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved_below", F.lit(0)) + F.coalesce((F.col("n") - 1) * rest, F.lit(0))).cast("long").alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
        )
        row = scratch.table(row, "spine-nodes")
        out.append(row.select(NODE_COLUMNS))
        kids = row.where("above IS NOT NULL AND pos = 0").select(F.col("above").alias("at"), "n_leaves", "saved_tokens")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
