"""Best-fit packing by minimum bin slack.

A document's tokens (end mark included) stay together; only those of more than ``CAPACITY`` are cut, into full
pieces behind a first piece with the rest.  Pieces are packed into sequences of at most ``CAPACITY`` tokens.

For each bin the longest piece left is laid in, and a subset-sum over the lengths that are left (a bitset of
reachable sums, each length as often as it is there) gives the fullest feasible combination, long pieces first; it is
removed.  As lengths are all that matters, a corpus is its histogram of at most ``CAPACITY`` numbers: the same combination is the best
until one of its lengths runs short, so it is removed that many times at once.  The plan's size and time depend on the capacity and
not on the corpus.  Pieces of equal length are numbered through (within tasks, then by the sums of the tasks), and a number
tells the bin and the place.

Defined results: a null or empty text has the end mark only (a piece of length 1); repeated rows and rows with equal
or null ids are packed separately; very long texts are cut into full pieces; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm import packing, scratch
from pixelframe.llm.textscan import slices

END_ID = 2
CAPACITY = 1024


def fullest(target: int, counts: dict[int, int]) -> dict[int, int]:
    """The fullest combination of at most ``target`` from lengths that are there ``counts`` times; of equally full ones that with the longest pieces."""
    inside = (1 << (target + 1)) - 1
    sums, steps = 1, []
    for length in sorted(c for c in counts if c <= target and counts[c]):
        most = min(counts[length], target // length)
        steps.append((length, most, sums))
        some = 1
        while most:
            some = min(some, most)
            sums |= sums << some * length
            most -= some
            some *= 2
        sums &= inside
    left, taken = sums.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        for n in range(min(most, left // length), 0, -1):
            if before >> (left - n * length) & 1:
                taken[length] = n
                left -= n * length
                break
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins) until no piece is left."""
    counts, bins = dict(counts), []
    for seed in sorted(counts, reverse=True):
        while counts[seed]:
            counts[seed] -= 1
            some = fullest(capacity - seed, counts)
            counts[seed] += 1
            some[seed] = some.get(seed, 0) + 1
            times = min(counts[length] // n for length, n in some.items())
            for length, n in some.items():
                counts[length] -= n * times
            bins.append((some, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, first bin, pieces a bin, first offset), by length and number: where the pieces of a length go."""
    rows, used, begin = [], {}, 0
    for some, times in bins:
        offset = 0
        for length in sorted(some, reverse=True):
            n = some[length]
            rows.append((length, used.get(length, 0), begin, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        begin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, with ``with_ids`` the ``ids``; ``part`` and ``nth`` number those of a length within a task."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kind = small.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packing.encoder(tokenizer_path, pattern)
        end = np.array([END_ID], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, "__text"):
            rows, out = [], []
            for i, b in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                b += end
                n = len(b) // 4
                at = 0
                for piece in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if piece == 0 else capacity
                    some = b[4 * at : 4 * (at + size)]
                    rows.append(i)
                    out.append((piece, at, size, zlib.crc32(some), seen[size], np.frombuffer(some, "<u4").astype(np.int32) if with_ids else None))
                    seen[size] += 1
                    at += size
            piece, start, length, crc, nth, ids = zip(*out, strict=True)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc, nth)]]
            names = [id_col, "piece", "start", "length", "ids_crc32", "nth"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids
    return small.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and the ``offset`` there."""
    # Written once: the numbers of a task's pieces hold for every later read.
    cut = scratch.table(pieces(docs, tokenizer_path, pattern, id_col, text_col, capacity, with_ids), "pieces")
    of_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, capacity))
    # Lengths are below 2^20 and numbers below 2^43, so both are one ordered key.
    keys = (table[:, 0] << 43) + table[:, 1]
    parts = cut.select("part").distinct().count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = of_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = scratch.join_counted(cut, first, ["part", "length"], "inner", parts * capacity)
    wanted = [c for c in cut.columns if c not in ("part", "nth")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(wanted).schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, number = batch.columns
            length, number = batch.column(wanted.index("length")).to_numpy(), number.to_numpy()
            row = table[np.searchsorted(keys, (length << 43) + number, side="right") - 1]
            bin_, slot = np.divmod(number - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + slot * length)], names=[*wanted, "sequence_id", "offset"])

    return numbered.select(*wanted, (F.col("first") + F.col("nth")).alias("__number")).mapInArrow(run, schema)
