"""Language identification of code-switched text by a linear-chain CRF.

Every word gets label marginals from forward-backward; a document's language is
the label with the largest mean marginal, so mixed documents also yield a
share for each language (``spans`` gives the runs).

Training: a bounded sample of labelled documents, whole texts: of each label the first
``per_language`` distinct rows in the order of a hash of id and text, as long as the rows before hold fewer
than ``LANGUAGE_BYTES`` bytes.  Every label is learned.
Since documents carry one label, training sequences are made of pieces of
documents of different languages, which is what the transitions are learned from.

Defined results: null text, empty text or text without a letter -> ``und`` with score 0;
no labelled row at all -> ``und`` for every document; null or repeated ids and repeated
rows stay as they are (one output row for each input row); columns other than the id and
text columns are ignored in prediction, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm import scratch
from pixelframe.llm.crf import Crf, Features, build_lexicon
from pixelframe.llm.textscan import Words, slices, string_buffers

#: Training documents of each language, and the bytes of text from which no further one is taken.
PER_LANGUAGE, LANGUAGE_BYTES = 300, 4_000_000
HASHES = 1_000_003
UNDETERMINED = "und"


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def _scan(texts: list[str] | list[bytes]) -> Words:
    return Words(*string_buffers(pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.large_binary())))


def _join(pieces: list[Words], spans: list[tuple[int, int, int]]) -> bytes:
    return b" ".join(bytes(pieces[d].bytes[pieces[d].start[i] : pieces[d].end[j - 1]]) for d, i, j in spans)


def train(labelled: list[tuple[str, str]], labels: list[str], seed: int = 7, epochs: int = 5, batch_words: int = 30_000) -> Crf:
    """Fit the field on (text, label) pairs."""
    rng = np.random.default_rng(seed)
    f = Features()
    scanned = [(_scan([text]), labels.index(label)) for text, label in labelled if label in labels]
    scanned = [(w, y) for w, y in scanned if len(w)]
    counted: dict[int, int] = {}
    for w, _ in scanned:
        for h in np.unique(w.hashes()).tolist():
            counted[h] = counted.get(h, 0) + 1
    frequent = sorted((h for h, c in counted.items() if c >= 3), key=lambda h: (counted[h], h))
    crf = Crf(labels, build_lexicon(np.array(frequent, np.uint64), f.lexicon_bits), f)
    # Pieces of 5 to 120 words, drawn in random order, make the code-switched sequences.
    pieces = []
    for d, (w, _) in enumerate(scanned):
        i = 0
        while i < len(w):
            j = min(len(w), i + int(rng.integers(5, 120)))
            pieces.append((d, i, j))
            i = j
    rng.shuffle(pieces)
    batches, texts, ys, n, i = [], [], [], 0, 0
    while i < len(pieces):
        some = [tuple(map(int, x)) for x in pieces[i : i + int(rng.integers(1, 5))]]
        i += len(some)
        texts.append(_join([w for w, _ in scanned], some))
        ys.append(np.concatenate([np.full(b - a, scanned[d][1]) for d, a, b in some]))
        n += len(ys[-1])
        if n >= batch_words or i >= len(pieces):
            batches.append((_scan(texts), np.concatenate(ys)))
            texts, ys, n = [], [], 0
    return crf.fit(batches, epochs)


def sample_labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, language_bytes: int = LANGUAGE_BYTES) -> list[tuple[str, str]]:
    """The bounded training rows of every label: its first distinct rows in the order of a hash of id and text."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).cast("string").alias("i"))
    rows = rows.withColumn("o", F.pmod(F.xxhash64("i", "t"), F.lit(HASHES)))
    counts = scratch.table(rows.groupBy("l").count(), "labels")
    most, labels = counts.agg(F.max("count"), F.count("*")).first()
    margin, taken = 2, []
    while labels:
        # Only rows of low hashes are ranked, so no label's rows meet as a whole; a label that gets too few asks for more.
        share = F.least(F.lit(1.0), margin * (per_language + 50.0) / F.col("count"))
        drawn = scratch.join_counted(rows, counts, ["l"], "inner", labels).where(F.col("o") < share * HASHES).select("l", "count", "o", "i", "t").distinct()
        first = Window.partitionBy("l").orderBy("o", "i", "t")
        before = F.sum(F.octet_length("t")).over(first.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("t")
        ranked = drawn.select("t", "l", "count", F.row_number().over(first).alias("n"), before.alias("before"), F.count("*").over(Window.partitionBy("l")).alias("drawn"))
        taken = ranked.where((F.col("n") <= per_language) & (F.col("before") < language_bytes)).orderBy("l", "n").collect()
        enough = sum(r["n"] == 1 and r["drawn"] >= min(per_language, r["count"]) for r in taken)
        if enough == labels or margin * (per_language + 50) >= most:
            break
        margin *= 8
    return [(r["t"], r["l"]) for r in taken]


def predict(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """id and ``keep`` columns (and ``__text``) with ``lang_pred``, ``score`` and ``switches`` (changes of the likeliest word label)."""
    keep = [c for c in (keep or []) if c not in (id_col, "lang_pred", "score", "switches")]
    small = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "__text"):
            text = batch.column(batch.num_columns - 1)
            words = Words(*string_buffers(text))
            n, lettered = words.n_docs, words.per_doc > 0
            # Runs of non-ASCII bytes may hold no letter at all (dashes, emoji): decide those exactly.
            plain = np.zeros(n, bool)
            if len(words):
                low = np.maximum.reduceat(((words.bytes >= 97) & (words.bytes <= 122)).astype(np.int8), words.text_start)
                plain = low > 0
            for i in np.flatnonzero(lettered & ~plain):
                lettered[i] = any(map(str.isalpha, text[int(i)].as_py()))
            label, score, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
            if model is not None and len(words):
                g = model.marginals(words)
                total = np.stack([np.bincount(words.doc, g[:, j], n) for j in range(g.shape[1])], 1)
                mean = total / np.maximum(words.per_doc, 1)[:, None]
                best = g.argmax(axis=1)
                change = np.append((best[1:] != best[:-1]) & (words.doc[1:] == words.doc[:-1]), False)
                switches = np.bincount(words.doc, change, n).astype(np.int64)
                label = np.where(lettered, mean.argmax(axis=1), -1)
                score = np.where(lettered, mean.max(axis=1), 0.0)
            names = np.array([*(model.labels if model else []), UNDETERMINED], object)
            passed = batch.num_columns - (not with_text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:passed], pa.array(names[label], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(switches)],
                names=[*batch.schema.names[:passed], "lang_pred", "score", "switches"],
            )

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields[: len(small.columns) - (not with_text)])
    return small.mapInArrow(run, f"{head}, lang_pred string, score double, switches long")


def fit(train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Crf | None:
    """Train on a bounded sample of ``train_docs``; None when nothing is labelled."""
    rows = sample_labelled(train_docs, id_col, text_col, lang_col, per_language)
    labels = sorted({label for _, label in rows})
    return train(rows, labels) if labels else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 3, held: int = 1) -> DataFrame:
    """Learn from rows whose id's crc32 modulo ``fold`` is not ``held``; predict every row."""
    crf = fit(docs.where(remainder(id_col, fold) != held), id_col, text_col, lang_col)
    return predict(docs, crf, id_col, text_col).withColumn("held_out", remainder(id_col, fold) == held)
