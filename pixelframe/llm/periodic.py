"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period p (words p apart are
identical) of at least ``max(MIN_WORDS, 2 p)`` words that no neighbouring word extends.

All texts of a slice are searched at once with NumPy.  For each period p the start
positions are a grid of step g = max(p, MIN_WORDS - p); a run has at least g positions
whose word equals the one p later, so one of them is on the grid, and the grids of all
periods have about n ln n points (a harmonic sum).  Points with equal words are probed
with prefix hashes over half of g in both directions; those left are extended by a binary
search for the longest common extension, for all (period, point) pairs together.
A run is found from several points and under multiples of its period: the smallest period
of each (start, end) stays.  The words of every run are then compared; should hashes have
lied, the slice is done again with other bases, so results are exact.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has no words, no run and
an empty collapsed text; repeated rows and rows with equal or null ids are judged separately; very long
texts are searched whole (their pairs are made ``PAIRS`` at a time); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.textscan import mix64, slices

#: Fewest words of a run.
MIN_WORDS = 12
#: (period, grid point) pairs that are held at once.
PAIRS = 1 << 20

_PRIME = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)
_RUN = "array<struct<start:long,length:long,period:long>>"


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1."""
    x = (x & _PRIME) + (x >> _SHIFT)
    x = (x & _PRIME) + (x >> _SHIFT)
    return np.where(x >= _PRIME, x - _PRIME, x)


class PrefixHashes:
    """Two polynomial hashes of every stretch of ``ids``."""

    def __init__(self, ids: np.ndarray, attempt: int = 0):
        self.tables = []
        for which in range(2):
            seed = np.uint64(2 * attempt + which + 1)
            base = mix64(np.array([seed]))[0] % (_PRIME - np.uint64(1000)) + np.uint64(500)
            power = np.ones(len(ids) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = _mod(power[:more] * step)
                done, step = done + more, _mod(np.array([step * step]))[0]
            letter = mix64(ids.astype(np.uint64) + (seed << np.uint64(40))) % _PRIME
            prefix = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(_mod(letter * power[:-1]), out=prefix[1:])
            self.tables.append((_mod(prefix), power))

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``at`` hash like those ``period`` later."""
        same = np.ones(len(at), bool)
        for prefix, power in self.tables:
            first = _mod(prefix[at + length] + _PRIME - prefix[at])
            second = _mod(prefix[at + period + length] + _PRIME - prefix[at + period])
            same &= _mod(first * power[period]) == second
        return same

    def extend(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """The most words, at most ``limit``, from ``at`` on (``back``: before it) that equal those ``period`` later."""
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            start = at[open_] - middle if back else at[open_]
            same = self.equal(start, period[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def _smallest(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) with the smallest period of each (start, end)."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def _candidates(ids: np.ndarray, bounds: np.ndarray, hashes: PrefixHashes) -> np.ndarray:
    """(start, end, period) of all runs; positions are those of ``ids``, texts lie between ``bounds``."""
    size = np.diff(bounds)
    halves = np.where(size >= MIN_WORDS, size // 2, 0)
    text = np.repeat(np.arange(len(size)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    step = np.maximum(period, MIN_WORDS - period)
    points = -(-(size[text] - period) // step)
    last = np.cumsum(points)
    found = [np.zeros((0, 3), np.int64)]
    begin = 0
    while begin < len(text):
        before = last[begin] - points[begin]
        end = max(int(np.searchsorted(last, before + PAIRS, side="right")), begin + 1)
        n = points[begin:end]
        at = np.arange(last[end - 1] - before) - np.repeat(last[begin:end] - n - before, n)
        at = at * np.repeat(step[begin:end], n) + np.repeat(bounds[text[begin:end]], n)
        p = np.repeat(period[begin:end], n)
        hit = np.flatnonzero(ids[at] == ids[at + p])
        grid = np.repeat(np.arange(begin, end), n)[hit]
        at, p = at[hit], p[hit]
        ahead, behind = bounds[text[grid] + 1] - at - p, at - bounds[text[grid]]
        # A run of g equal positions around the point has half of them on one side.
        need = step[grid]
        near, far = (need + 1) // 2, need // 2
        likely = np.zeros(len(at), bool)
        for room, some, back in ((ahead, near, False), (behind, far, True)):
            probe = np.flatnonzero(~likely & (room >= some))
            likely[probe] = hashes.equal(at[probe] - some[probe] if back else at[probe], p[probe], some[probe])
        at, p, ahead, behind, need = at[likely], p[likely], ahead[likely], behind[likely], need[likely]
        right = hashes.extend(at, p, ahead, False)
        left = hashes.extend(at, p, behind, True)
        long = left + right >= need
        found.append(_smallest(np.stack([at - left, at + p + right, p], axis=1)[long]))
        begin = end
    return _smallest(np.concatenate(found))


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of the texts between ``bounds``, by start and end."""
    attempt = 0
    while True:
        found = _candidates(ids, bounds, PrefixHashes(ids, attempt))
        if all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in found):
            return found
        attempt += 1


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id, ``n_words``, ``runs`` (start, length, period by start and period; words from 0), ``collapsed``
    (the text's words joined by one space, without those that any run holds after its first period)."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kind = small.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            # bytes.split() cuts at the same six characters as the pattern.
            texts = [t.split() if t else [] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, bounds[-1])
            found = runs_of(ids, bounds)
            start, end, period = found.T
            dropped = np.zeros(len(ids) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            dropped = np.cumsum(dropped[:-1]) > 0
            text = np.searchsorted(bounds, start, side="right") - 1
            # Two runs of a text with one start differ in period as they differ in end.
            order = np.lexsort((period, start))
            start, end, period, text = start[order], end[order], period[order], text[order]
            first = np.searchsorted(text, np.arange(len(texts) + 1))
            struct = pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            kept = [t if not dropped[b : b + len(t)].any() else [t[i] for i in np.flatnonzero(~dropped[b : b + len(t)])] for t, b in zip(texts, bounds[:-1].tolist(), strict=True)]
            collapsed = pa.array([b" ".join(t) for t in kept], pa.binary()).view(pa.string())
            columns = [batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(first, pa.int32()), struct), collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    return small.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {_RUN}, collapsed string")


def longest(runs: Column) -> Column:
    """(start, length, period) of the longest run; ties go to the smallest start, then period; null without a run."""
    first = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(first.isNotNull(), F.struct(first["start"].alias("start"), (-first["less"]).alias("length"), first["period"].alias("period")))


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which a tenth, chosen by h = crc32(id), is made periodic from a word on.

    With g = h // 10 and h % 10 = 0, each word i >= a of n becomes word a + (i - a) % p, where a = g % n
    and p = 1 + (n - a) // (3 + g % 8); such texts are their words joined by one space.  Others stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        repeated = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(repeated, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.array_join(whole, " "))

    # The lambda's variable holds the words once, however often they are named.
    words = F.array(F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    made = F.when(h % 10 == 0, F.transform(words, periodic)[0])
    return docs.withColumn(text_col, F.coalesce(made, F.col(text_col)))
