"""Toxic spans and document scores from a linear-chain CRF.

Documents carry one label, so word labels are derived first: a word is toxic in a
document labelled 1 when the share of toxic among the training documents that hold
it is far above the base share.  The field is trained on those word labels and tags
every word with a marginal; marginals aggregate to document statistics (expected
number, largest, share) whose logistic model is fitted to the document labels.

The training sample is bounded: ``PER_CLASS`` distinct rows of each label and about ``CLASS_BYTES`` bytes (a text that
begins below the bound is taken whole).  Defined results: null or empty texts and texts without a letter have no span
and get the score of zero toxic words; with labels of one kind only (or none) every
score is that kind's share (0 without labels); a document with both labels counts as toxic; null ids, repeated rows and further
columns pass as in language identification.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import language_id
from pixelframe.llm.crf import Crf, Features, build_lexicon
from pixelframe.llm.language_id import remainder
from pixelframe.llm.textscan import Words, slices, string_buffers

#: Most training rows of each class, and bytes of their texts.
PER_CLASS, CLASS_BYTES = 900, 8_000_000
#: A training word counts as toxic from this smoothed log-odds ratio, number and share of toxic documents
#: (the share keeps out words that only the copies of one toxic document hold).
MIN_LOG_ODDS, MIN_DOCS, MIN_SHARE = 2.5, 4, 0.01
SPAN = 0.5


def _groups(texts: list[str], size: int = 400_000) -> Iterator[tuple[Words, int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < size):
            n += len(texts[j])
            j += 1
        yield Words(*string_buffers(pa.array(texts[i:j], pa.large_string()))), i, j
        i = j


def _statistics(marginal: np.ndarray, words: Words) -> np.ndarray:
    """Per document: log expected number of toxic words, largest marginal, share."""
    n = words.n_docs
    total = np.bincount(words.doc, marginal, n) if len(words) else np.zeros(n)
    top = np.zeros(n)
    if len(words):
        np.maximum.at(top, words.doc, marginal)
    return np.stack([np.ones(n), np.log1p(total), top, np.sqrt(total / np.maximum(words.per_doc, 1))], 1)


class ToxicModel:
    def __init__(self, crf: Crf | None, coefficients: np.ndarray):
        self.crf, self.coefficients = crf, coefficients

    def tag(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of toxic for every word, score of every document)."""
        marginal = self.crf.marginals(words)[:, 1] if self.crf is not None else np.zeros(len(words))
        return marginal, 1 / (1 + np.exp(-np.clip(_statistics(marginal, words) @ self.coefficients, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Newton steps of the ridge logistic model with classes weighted as they are."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * b), -5, 5)
    return b


def train(rows: list[tuple[str, int]], epochs: int = 3) -> ToxicModel:
    """Fit words, field and document model on (text, 0/1) pairs."""
    texts, y = [t or "" for t, _ in rows], np.array([v for _, v in rows])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicModel(None, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0]))
    held: list[dict[int, int]] = [{}, {}]
    scanned = list(_groups(texts))
    for words, i, _ in scanned:
        pairs = np.unique(np.stack([words.hashes(), words.doc.astype(np.uint64)], 1), axis=0)
        for h, d in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True):
            of = held[y[i + d]]
            of[h] = of.get(h, 0) + 1
    n = np.bincount(y, minlength=2)
    toxic = set()
    for h, c in held[1].items():
        odds = np.log((c + 0.5) / (n[1] - c + 1)) - np.log((held[0].get(h, 0) + 0.5) / (n[0] - held[0].get(h, 0) + 1))
        if c >= max(MIN_DOCS, MIN_SHARE * n[1]) and odds >= MIN_LOG_ODDS:
            toxic.add(h)
    f = Features()
    frequent = {**held[0]}
    for h, c in held[1].items():
        frequent[h] = frequent.get(h, 0) + c
    order = sorted((h for h, c in frequent.items() if c >= 3), key=lambda h: (h in toxic, frequent[h], h))
    crf = Crf([0, 1], build_lexicon(np.array(order, np.uint64), f.lexicon_bits), f)
    named = np.array(sorted(toxic), np.uint64)
    batches = [(words, (np.isin(words.hashes(), named) & (y[i:j][words.doc] == 1)).astype(np.int64)) for words, i, j in scanned if len(words)]
    crf.fit(batches, epochs)
    x = np.concatenate([_statistics(crf.marginals(words)[:, 1] if len(words) else np.zeros(0), words) for words, _, _ in scanned])
    return ToxicModel(crf, _logistic(x, y))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> ToxicModel:
    """Train on labelled rows of each class: the first ``per_class`` distinct ones in hash order and about ``class_bytes``.

    Twice as many ids are chosen by their hash and broadcast; the rows of an id, however many, are drawn by a hash of id and text.
    The class shares of the corpus are restored in the document model's intercept.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    counts = {r["__y"]: r["count"] for r in marked.groupBy("__y").count().collect()}
    chance = F.lit(0.0)
    for y, c in counts.items():
        chance = F.when(F.col("__y") == y, F.lit(min(1.0, 2 * per_class / c))).otherwise(chance)
    chosen = marked.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_003)) < chance * 1_000_003)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    drawn = language_id.sample_labelled(rows, "__id", "__text", "__y", per_class, class_bytes)
    # Classes take turns in training as their texts' checksums do.
    model = train(sorted(drawn, key=lambda r: (zlib.crc32(r[0].encode()), r)))
    if model.crf is not None and len(counts) == 2:
        used = np.bincount([y for _, y in drawn], minlength=2)
        model.coefficients[0] += np.log(counts[1] / counts[0]) - np.log(used[1] / used[0])
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score``, ``predicted``, ``spans``: (start, stop, marginal) of toxic runs, stop exclusive, in UTF-8 bytes."""
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "__text"):
            words = Words(*string_buffers(batch.column(1)))
            marginal, value = m.tag(words)
            hit = np.flatnonzero(marginal >= SPAN)
            joined = np.zeros(len(hit), bool)
            joined[1:] = (np.diff(hit) == 1) & (words.doc[hit[1:]] == words.doc[hit[:-1]])
            first = np.flatnonzero(~joined)
            last = np.append(first[1:], len(hit))[: len(first)] - 1
            at = words.text_start[words.doc[hit[first]]]
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(words.start[hit[first]] - at),
                    pa.array(words.end[hit[last]] - at),
                    pa.array(np.maximum.reduceat(marginal[hit], first) if len(hit) else np.zeros(0)),
                ],
                fields=list(span_type),
            )
            ends = np.append(0, np.cumsum(np.bincount(words.doc[hit[first]], minlength=words.n_docs))).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), flat)
            predicted = (value >= 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(predicted), spans], names=[id_col, "score", "predicted", "spans"])

    kind = small.schema[0].dataType.simpleString()
    return small.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start:long,stop:long,marginal:double>>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", fold: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled rows whose id's crc32 modulo ``fold`` is not ``held``; score every row."""
    out = score(docs, fit(docs, labels.where(remainder(id_col, fold) != held), id_col), id_col)
    return out.withColumn("held_out", remainder(id_col, fold) == held)
