"""Pixels dealt to blocks: rows move once, with a halo around each block, and neighbours are looked up inside a task.

A block holds ``size`` by ``size`` cells.  Tasks get whole blocks, sorted, and work on runs of blocks of bounded size; a block's
pixels are found by binary search, so rasters may be sparse and no image is laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block's side, and rows of whole blocks that are worked on at once.
SIZE, ROWS = 64, 100_000


def dealt(df: DataFrame, halo: int = 0, size: int = SIZE) -> DataFrame:
    """Every row (px, py, ...) once for each block (``bx``, ``by``) whose window, grown by the halo, holds it."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    return df.withColumn("bx", F.explode(reach("px"))).withColumn("by", F.explode(reach("py")))


def over_blocks(rows: DataFrame, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = ("bx", "by")) -> DataFrame:
    """``run(rows, block)`` over runs of whole blocks of dealt rows; ``block`` numbers the rows' blocks from 0."""

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in keys:
            v = table.column(c).combine_chunks()
            v = v.dictionary_encode(null_encoding="encode").indices.to_numpy() if not pa.types.is_integer(v.type) or v.null_count else v.to_numpy()
            new |= v[1:] != v[:-1]
        return np.cumsum(np.append(False, new))[: table.num_rows]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held)
            block = numbered(table)
            whole = int(np.searchsorted(block, block[-1]))
            if whole:  # the last block may go on in the next batch
                yield from run(table.slice(0, whole), block[:whole])
            rest = table.slice(whole)
            held, n = rest.to_batches(), rest.num_rows
        if n:
            table = pa.Table.from_batches(held)
            yield from run(table, numbered(table))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


class Places:
    """Lookup of pixels by block and place in it."""

    def __init__(self, block: np.ndarray, px: np.ndarray, py: np.ndarray, halo: int, size: int = SIZE):
        self.side = size + 4 * halo + 2
        self.halo, self.size = halo, size
        key = self.key(block, px, py)
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]
        self.alone = not (self.sorted[1:] == self.sorted[:-1]).any()

    def key(self, block: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        # A window is narrower than ``side``, so places modulo ``side`` are different places.
        return (block * self.side + px % self.side) * self.side + py % self.side

    def find(self, block: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the pixels at each place, as positions in ``order``."""
        key = self.key(block, px, py)
        first = np.searchsorted(self.sorted, key)
        if not self.alone:
            return first, np.searchsorted(self.sorted, key, side="right")
        held = np.zeros(len(key), bool)
        inside = first < len(self.sorted)
        held[inside] = self.sorted[first[inside]] == key[inside]
        return first, first + held


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().cast(pa.int64()).to_numpy()


def in_own_block(size: int = SIZE) -> Column:
    return (F.floor(F.col("px") / size) == F.col("bx")) & (F.floor(F.col("py") / size) == F.col("by"))
