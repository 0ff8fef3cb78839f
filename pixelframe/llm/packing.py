"""Packing by power-of-two decomposition.

A document of n tokens (end mark included) is cut into the powers of two of n's
binary form, ``max_length`` at most, longest first.  A piece is a training sequence
of its own; pieces of equal length form a bucket, from which batches of equal shape
are drawn without padding, and no sequence crosses documents.

Token ids come from a byte-level BPE file of the ``tokenizers`` library, as its plain call gives them
(``add_special_tokens=False``).  BPE works on each pre-token by itself, so a task cuts texts where
the tokenizer's own pattern cuts them and encodes each distinct pre-token once.  A text that holds the
content of an added token goes to the library as a whole.

Defined results: a null or empty text has the end mark only (one piece of length 1);
repeated rows and rows with equal or null ids are packed separately (``sequence_id`` is
unique for each piece); further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.textscan import slices

END_ID = 1
MAX_LENGTH = 2048
#: Letters of the plain texts that the standard module splits like the tokenizer's pattern, only faster.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a task remembers.
CACHE = 400_000


def splitter(pattern: str):
    """text -> pre-tokens by ``pattern``."""
    exact = regex.compile(pattern).findall
    if pattern != _PLAIN_PATTERN:
        return exact
    fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
    other = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]").search
    return lambda text: exact(text) if other(text) else fast(text)


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level model: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """texts -> ids as uint32 byte strings (of little-endian machines)."""
    # A task has one core; a thread pool of the library in every task only adds switching.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(added)).search if added else lambda text: None
    split = splitter(pattern)
    known: dict[str, bytes] = {}
    plan = json.loads(tokenizer.to_str())
    level = plan["pre_tokenizer"] or {}
    if pattern == _PLAIN_PATTERN and plan["normalizer"] is None and level.get("type") == "ByteLevel" and not level["add_prefix_space"]:
        # A pre-token in the letters of the model is all that the library hands to it.
        merge, letters = tokenizer.model.tokenize, byte_letters()
        learn = lambda some: [[t.id for t in merge(p.encode().decode("latin-1").translate(letters))] for p in some]
    else:
        learn = lambda some: [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        pieces = [None if special(t) else split(t) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list(set().union(*(parts for parts in pieces if parts)).difference(known))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for p, ids in zip(some, learn(some), strict=True):
                known[p] = array("I", ids).tobytes()
        whole = lambda t: array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return [whole(t) if parts is None else b"".join(map(known.__getitem__, parts)) for t, parts in zip(texts, pieces, strict=True)]

    return encode


def cut(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: full pieces, then the binary form of the rest."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece.

    Columns: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``bucket`` (log2 of the
    length), ``sequence_id``, ``offset`` and with ``with_ids`` the token ``ids``.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    small = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kind = small.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, "__text"):
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, b in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                b += end
                at, n = 0, len(b) // 4
                for size in cut(n, max_length):
                    piece = b[4 * at : 4 * (at + size)]
                    rows.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at += size
            size = np.array(length, np.int64)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.log2(size).astype(np.int32))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    # Numbered right behind the scan: a task that is run again numbers its own rows alike.
    return small.mapInArrow(run, schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with ids, one folder for each length, ready to be batched without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
