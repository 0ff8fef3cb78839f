"""Document quality by a regularised quadratic discriminant.

Each text becomes a few transformed statistics (logs of counts, arcsine roots of
shares).  Class means and covariances are aggregated over *all* labelled training
rows; a class covariance is shrunk towards the pooled one and towards its mean
variance, its Cholesky factor is computed once and cached, and the score is the
posterior from the difference of Mahalanobis log densities.

Defined results: null and empty texts have the statistics of an empty text and get a
score like any other; with one class only (or none) every score is that class's
share (0.5 without labels); a document with both labels counts as 1; repeated rows and null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import scratch
from pixelframe.llm.language_id import remainder
from pixelframe.llm.textscan import Words, slices, string_buffers

#: Share of the pooled covariance, and of the mean variance, in a class covariance.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "marks", "stops",
    "lines", "distinct_words", "distinct_lines", "top_word", "doubled", "mixed_marks",
)

_KIND = np.zeros((256, 6))  # letter, upper, digit, odd mark, sentence mark, line end
_KIND[97:123, 0] = _KIND[65:91, 0] = _KIND[128:, 0] = 1
_KIND[65:91, 1] = 1
_KIND[48:58, 2] = 1
for _c in b"#$%&*@|<>{}[]=_~^\\/!+`":
    _KIND[_c, 3] = 1
for _c in b".,;:?":
    _KIND[_c, 4] = 1
_KIND[10, 5] = 1


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) if len(values) else np.zeros(n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents x FEATURES) of UTF-8 texts that lie one after another."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc_of = np.repeat(np.arange(n), size)
    histogram = np.bincount(doc_of * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = histogram @ _KIND
    words = Words(data, offsets)
    nw = np.maximum(words.per_doc, 1)
    length = (words.end - words.start).astype(float)
    # distinct and most frequent words of each document
    key = np.stack([words.doc.astype(np.uint64), words.hashes()]) if len(words) else np.zeros((2, 0), np.uint64)
    order = np.lexsort((key[1], key[0]))
    key = key[:, order]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[0, 1:] != key[0, :-1]) | (key[1, 1:] != key[1, :-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, key.shape[1]))
    owner = key[0, first].astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    distinct = np.bincount(owner, minlength=n)
    # a word that follows itself
    h = words.hashes()
    same = np.append(False, (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])) if len(h) else np.zeros(0, bool)
    doubled = _per_doc(same.astype(float), words.doc, n)
    # lines by a hash of the words in them
    line_end = np.flatnonzero(data == 10)
    position = words.start - 1 - words.doc  # back to positions in data
    line = np.searchsorted(line_end, position) + words.doc  # a new document also starts a new line
    line_hash = np.bincount(line, (h >> np.uint64(20)).astype(float) % 1e9) if len(h) else np.zeros(0)
    used = np.unique(line) if len(h) else np.zeros(0, np.int64)
    at = np.zeros(len(line_hash), np.int64)
    at[line] = words.doc
    pair = np.unique(np.stack([at[used].astype(float), line_hash[used]], 1), axis=0) if len(used) else np.zeros((0, 2))
    n_lines = np.bincount(at[used], minlength=n) if len(used) else np.zeros(n)
    n_distinct = np.bincount(pair[:, 0].astype(np.int64), minlength=n) if len(pair) else np.zeros(n)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))
    mixed = np.count_nonzero(histogram[:, [33, 35, 36, 37, 38, 42, 64, 124]], axis=1)
    return np.stack(
        [
            np.log1p(size), np.log1p(words.per_doc), np.log1p(_per_doc(length, words.doc, n) / nw),
            share(kinds[:, 0], size), share(kinds[:, 1], kinds[:, 0]), share(kinds[:, 2], size), share(kinds[:, 3], size), share(kinds[:, 4], nw),
            np.log1p(kinds[:, 5]) - np.log1p(words.per_doc), share(distinct, nw), share(n_distinct, n_lines), share(top, nw), share(doubled, nw), np.log1p(mixed),
        ],
        axis=1,
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``x`` (array of FEATURES) of every document."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            x = statistics(*string_buffers(batch.column(1)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[id_col, "x"])

    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Class means, cached inverse Cholesky factors and log terms."""

    def __init__(self, counts: dict[int, int], means: dict[int, np.ndarray], covariances: dict[int, np.ndarray], pooled_share: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL):
        self.counts = counts
        total = sum(counts.values())
        self.classes = sorted(c for c in counts if counts[c] > 1)
        if len(self.classes) < 2:
            self.constant = (counts.get(1, 0) / total) if total else 0.5
            return
        self.constant = None
        pooled = sum(counts[c] * covariances[c] for c in self.classes) / total
        spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale = spread
        self.mean, self.whiten, self.log_term = {}, {}, {}
        d = len(spread)
        for c in self.classes:
            own = (1 - pooled_share) * covariances[c] + pooled_share * pooled
            own = own / np.outer(spread, spread)
            own = (1 - diagonal) * own + diagonal * max(np.trace(own) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.mean[c] = means[c]
            self.whiten[c] = np.linalg.inv(factor).T / spread[:, None]
            self.log_term[c] = np.log(counts[c] / total) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = {c: self.log_term[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c]) ** 2).sum(axis=1) for c in self.classes}
        low, high = self.classes[0], self.classes[-1]
        return 1 / (1 + np.exp(np.clip(logs[low] - logs[high], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Class moments of the features over all labelled rows; only sums reach the driver."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    # Few labels: only the labelled texts are looked at.  Many: the short features are joined, not the texts.
    if marked.count() <= scratch.BROADCAST_ROWS:
        docs = docs.join(F.broadcast(marked.select(F.col("__id").alias(id_col))), id_col, "left_semi")
    x = features(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "x").join(marked, "__id")
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            values = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(0))
            for c in np.unique(y):
                v = values[y == c]
                s = sums.setdefault(int(c), [0, np.zeros(d), np.zeros((d, d))])
                s[0] += len(v)
                s[1] += v.sum(axis=0)
                s[2] += v.T @ v
        keys, js, values = [], [], []
        for c, (n, s, q) in sums.items():
            flat = np.concatenate([[n], s, q.ravel()])
            keys += [c] * len(flat)
            js += range(len(flat))
            values.append(flat)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(js, pa.int32()), pa.array(np.concatenate(values))], names=["y", "j", "v"])

    sums = x.select("__y", "x").mapInArrow(partial, "y int, j int, v double").groupBy("y", "j").agg(F.sum("v").alias("v")).collect()
    flat = {y: np.zeros(1 + d + d * d) for y in {r["y"] for r in sums}}
    for r in sums:
        flat[r["y"]][r["j"]] = r["v"]
    counts = {y: int(v[0]) for y, v in flat.items()}
    means = {y: v[1 : 1 + d] / v[0] for y, v in flat.items()}
    return Discriminant(counts, means, {y: v[1 + d :].reshape(d, d) / v[0] - np.outer(means[y], means[y]) for y, v in flat.items()})


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, ``score``, ``predicted`` (1 from ``threshold`` on) of every document."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            value = shared.value.score(statistics(*string_buffers(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return small.mapInArrow(run, f"`{id_col}` {small.schema[0].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", fold: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows whose id's crc32 modulo ``fold`` is not ``held``; score every row."""
    model = fit(docs, labels.where(remainder(id_col, fold) != held), id_col)
    return score(docs, model, id_col, threshold=threshold).withColumn("held_out", remainder(id_col, fold) == held)
