"""A training corpus from raw documents: each stage reads what the stage before it wrote.

1. language_id: documents in which no language is found go.
2. simhash: one document of each near-duplicate group stays (the one with the smallest id); SimHash fingerprints within
   three bits (BK-trees) and shared MinHash bands propose near duplicates, which have a Jaccard similarity of 0.8 or more over five-word
   shingles, checked exactly.
3. suffix_dedup: byte strings that an earlier document has too are removed from the text.
4. mixing: sources are repeated to a flatter mixture; every document is shown at least once.
5. packing: documents are cut into training sequences.

Defined results, at every stage: columns other than doc_id, text, source, lang and n_chars are carried
along whatever their names; an empty table gives an empty table.  Null and empty texts and texts without a
letter have no language and go at the first stage.  Handed to a later stage they are near copies
of each other (2), lose nothing (3), have no tokens and stay once for each row (4) and are a piece of their
end mark (5).  A document of the second stage is its id and text: of a group the one with the smallest id
stays (null after all others, then by SHA-256 of the text), so different texts under one id are judged apart; of
rows that are equal in both, the one whose other columns come first as JSON stays.  Rows with equal ids are documents of
their own in the other stages, as their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import language_id, mixing, near_copies, packing, suffix_dedup

#: A document whose best language has a smaller mean marginal than this is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.3
#: Target entropy of the sources (share of the largest) and most repetitions of a document.
MIX_ENTROPY, MIX_REPEATS = 0.9, 2.0


def _rest(docs: DataFrame) -> dict[str, str]:
    """Names under which the columns beside the text travel in one struct, whatever they are called."""
    return {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text with all columns beside the text in ``__row``."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in _rest(docs).items()]).alias("__row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a language is found."""
    crf = language_id.fit(docs.where(language_id.remainder("doc_id", 3) != 1))
    rest = _rest(docs)
    named = language_id.predict(_carried(docs), crf, keep=["__row"], with_text=True)
    kept = named.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col("__text").alias(c) if c == "text" else F.col("__row")[rest[c]].alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group."""
    key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    keyed = _carried(docs).withColumn("__key", key)
    groups = near_copies.near_copies(keyed, id_col="__key")
    first = groups.groupBy("near_group").agg(F.min("__key").alias("__key")).select("__key").distinct()
    one = F.min_by(F.struct("text", "__row"), F.to_json("__row")).alias("r")
    kept = keyed.join(first, "__key", "left_semi").groupBy("__key").agg(one).select("r.*")
    rest = _rest(docs)
    return kept.select(*[F.col("text") if c == "text" else F.col("__row")[rest[c]].alias(c) for c in docs.columns])


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; documents of which nothing is left go."""
    rest = _rest(docs)
    left = suffix_dedup.remove_repeats(_carried(docs), carry=["__row"], with_text=True)
    left = left.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col("__row")[rest[c]].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources come closer to even shares."""
    return mixing.mix(docs, MIX_ENTROPY, MIX_REPEATS, cover=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut documents into sequences of power-of-two lengths."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    from pixelframe.llm import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
