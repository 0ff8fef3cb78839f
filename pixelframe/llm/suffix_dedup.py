"""Removal of byte strings that also start in an earlier document, by difference-cover suffix sorting.

Two documents share a 50-byte string only if the smallest hash among the string's 20-byte
windows is the same in both.  Runs of string starts with the same smallest hash are
*fragments*; equal strings therefore always lie in fragments of the same hash.  Fragments
are dealt by that hash (equal fragments of a slice of documents are combined first):

1. of equal fragments every one but the earliest is covered by it;
2. where fragments of a hash differ, the earliest of each kind is fetched as text and the
   difference-cover algorithm sorts the suffixes of a bucket: sampled triples are sorted
   and named, names are recursed on, the remaining suffixes are merged in, and adjacent
   prefixes of 50 bytes are compared.  Strings of an earlier document cover;
3. a hash with many kinds of fragments (the edge of a line that a third of all documents
   hold) is split into several buckets.  The strings of a bucket meet those of the other buckets first as
   four bytes of a digest, in parts whose number follows the fragments; only strings whose digest is met
   twice are sent whole, and the earliest of each covers the others.

Equal fragments are told by two independent 64-bit hashes of their bytes (the window hash and one over
three windows that cover the fragment), not compared byte by byte.  Fragments whose hash occurs in one document only hold no shared string, so sorting all suffixes
of the corpus would order text that the comparison cannot use: the sort covers what can match.

Defined results: a null text is empty; texts under 50 bytes lose nothing; a null id comes
after all others; rows with the same id and text are one document; rows with the same
id and different texts count as documents in the order of their SHA-256 digests.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm import scratch
from pixelframe.llm.textscan import _BYTE_VALUE, mix64, slices, string_buffers

#: Bytes of a shared string, of a hashed window, most string starts in a fragment, text scanned at once.
LENGTH, GRAM, STARTS, SLICE = 50, 20, 32, 1_000_000
#: Bytes of packed texts that are unpacked at once.
PACKED = 1_000_000
#: Kinds of fragments of a hash in one bucket.
KINDS = 1024
#: Least parts that the strings of split buckets meet in, and fragments for each part beyond that.
MEETINGS, MEETING_FRAGMENTS = 256, 10_000
_MEET = np.dtype([("string", "S50"), ("doc", "<i8"), ("run", "<i8")])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of GRAM bytes (two overlapping ones of 16) and of 32, by doubling."""
    h, size, half = _BYTE_VALUE[data], 1, None
    while size < 32:
        right = h[size:] ^ (h[size:] >> np.uint64(29))
        h = h[:-size] * np.uint64(0xD1342543DE82EF95) + right * np.uint64(0x9E3779B97F4A7C15 + 2 * size)
        size *= 2
        if size == 16:
            half = h
    return mix64(half[: len(half) - (GRAM - 16)] * np.uint64(0xBF58476D1CE4E5B9) + mix64(half[GRAM - 16 :])), h


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, document, start in it, number of string starts) of the fragments of some texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    gram, wide = _window_hashes(data)
    low = _sliding_min(gram, length - GRAM + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    first = np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0)) - np.maximum(np.diff(offsets) - length + 1, 0)
    at = np.arange(len(doc)) + (offsets[:-1] - first)[doc]
    value = low[at]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(value)))
    pieces = -(-size // STARTS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + nth * STARTS
    size = np.minimum(STARTS, np.repeat(size, pieces) - nth * STARTS)
    s = at[begin]
    end = s + size + length - 1
    # Three windows of 32 bytes cover a fragment of 50 to 81 bytes.
    kind = mix64(wide[s] * np.uint64(31) ^ mix64(wide[(s + end - 32) // 2] + np.uint64(7)) ^ (wide[end - 32] * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64))
    return value[begin], kind, doc[begin], s - offsets[doc[begin]], size


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffixes of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    bits = int(p.max()).bit_length()
    if 3 * bits > 62:
        raise ValueError("a bucket of more than two million bytes")
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with n itself if that ends the names of this class
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    triples = (p[sample] << (2 * bits)) | (p[sample + 1] << bits) | p[sample + 2]
    named, names = np.unique(triples, return_inverse=True)
    order = np.argsort(names) if len(named) == len(sample) else suffix_array(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rest = sample[order]
    rest = rest[rest < n]
    wide = len(sample).bit_length() + 1
    zero = np.arange(0, n, 3)
    one_key = lambda i: (p[i] << wide) | rank[i + 1]
    two_key = lambda i: (p[i] << (wide + bits)) | (p[i + 1] << wide) | rank[i + 2]
    zero = zero[np.argsort(one_key(zero))]
    before = np.searchsorted(one_key(rest[rest % 3 == 1]), one_key(zero)) + np.searchsorted(two_key(rest[rest % 3 == 2]), two_key(zero))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + before
    out[place] = zero
    free = np.ones(n, bool)
    free[place] = False
    out[free] = rest
    return out


def _column(batches: list[pa.RecordBatch], name: str, fill: int = 0) -> np.ndarray:
    parts = [b.column(b.schema.get_field_index(name)).fill_null(fill).to_numpy(zero_copy_only=False) for b in batches]
    return np.concatenate(parts)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (size[i] of them) of all i."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _code(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Start and number of string starts of a run in one long."""
    return start * 64 + size


def scan(docs: DataFrame) -> DataFrame:
    """(h, kind, doc, run) of the fragments of ``docs`` (doc long, text).

    Equal fragments of later documents of the slice are known to be covered and have a null kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            h, kind, at, start, size = fragments(*string_buffers(batch.column(1)))
            doc = np.asarray(batch.column(0))[at]
            order = np.lexsort((start, doc, kind, h))
            h, kind, doc, code = h[order], kind[order], doc[order], _code(start, size)[order]
            new = np.append(True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))[: len(h)]
            first = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else doc
            later = doc > first
            # they are dealt evenly, so that of a common fragment one document of a slice is sent
            spread = np.where(later, mix64((doc.astype(np.uint64) << np.uint64(20)) + code.astype(np.uint64)), h)
            yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(kind.view(np.int64), mask=later), pa.array(doc), pa.array(code)], names=["h", "kind", "doc", "run"])

    return docs.select("doc", "text").mapInArrow(run, "h long, kind long, doc long, run long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of a partition to (doc, run, bucket, split, starts): covered where bucket is null, to be sorted otherwise.

    ``starts`` has all places of the kind in its earliest document.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    known = np.concatenate([np.asarray(b.column(1).is_null()) for b in got])
    h, kind, doc, code = (_column(got, c) for c in ("h", "kind", "doc", "run"))
    del got
    out_doc, out_code = [doc[known]], [code[known]]
    h, kind, doc, code = (x[~known] for x in (h, kind, doc, code))
    order = np.lexsort((code, doc, kind, h))
    h, kind, doc, code = h[order], kind[order], doc[order], code[order]
    new_h = np.append(True, h[1:] != h[:-1])[: len(h)]
    new_k = new_h | np.append(True, kind[1:] != kind[:-1])[: len(h)]
    group = np.cumsum(new_h) - 1
    first = np.flatnonzero(new_k)
    later = doc > doc[first][np.cumsum(new_k) - 1] if len(h) else np.zeros(0, bool)
    out_doc.append(doc[later])
    out_code.append(code[later])
    kinds = np.bincount(group, new_k) if len(h) else np.zeros(0)
    lowest, highest = (np.full(len(kinds), f, np.int64) for f in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(lowest, group, doc)
    np.maximum.at(highest, group, doc)
    sort = first[((kinds > 1) & (highest > lowest))[group[first]]]
    nth = np.arange(len(first)) - np.repeat(np.flatnonzero(new_h[first]), kinds.astype(np.int64))
    salt = (nth // KINDS)[np.searchsorted(first, sort)]
    bucket = mix64(h[sort].view(np.uint64) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    n = len(out_doc[0]) + len(out_doc[1])
    own = np.bincount(np.cumsum(new_k) - 1, ~later, len(first)).astype(np.int64)[np.searchsorted(first, sort)]
    places = np.repeat(sort - (np.cumsum(own) - own), own) + np.arange(own.sum())
    ends = np.append(np.zeros(n, np.int32), np.cumsum(np.append(0, own)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([*out_doc, doc[sort]])),
            pa.array(np.concatenate([*out_code, code[sort]])),
            pa.array(np.append(np.zeros(n, np.int64), bucket), mask=np.arange(n + len(sort)) < n),
            pa.array(np.append(np.zeros(n, bool), kinds[group[sort]] > KINDS)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(code[places] >> 6)),
        ],
        names=["doc", "run", "bucket", "split", "starts"],
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, z, items) to (bucket, split, doc, starts, piece): the bytes of the fragments."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "z", PACKED):
        rows = []
        for doc, z, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(z)
            for item in items:
                start, size = item["run"] >> 6, item["run"] & 63
                rows.append((item["bucket"], item["split"], doc, item["starts"], text[start : start + size + LENGTH - 1]))
        if rows:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "split", "doc", "starts", "piece"])


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String starts joined to runs of at most STARTS."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[: len(doc)]
    head = np.flatnonzero(new)
    nth = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
    head = np.flatnonzero(nth % STARTS == 0)
    return doc[head], _code(start[head], np.diff(np.append(head, len(doc))))


def _sorted_bucket(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All string starts of some fragments in suffix order: (position, fragment, number of its string)."""
    size = np.diff(offsets) - LENGTH + 1
    piece = np.repeat(np.arange(len(size)), size)
    at = offsets[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    owner = np.full(len(data), -1)
    owner[at] = piece
    order = suffix_array(data.astype(np.int64) + 1)
    at = order[owner[order] >= 0]
    equal = np.ones(max(len(at) - 1, 0), bool)
    for j in range(LENGTH):  # adjacent prefixes
        b = data[at + j]
        equal &= b[1:] == b[:-1]
    return at, owner[at], np.cumsum(np.append(True, ~equal)) - 1


def _digests(data: np.ndarray, at: np.ndarray, parts: int) -> np.ndarray:
    """The part (above 32 bits) and 32 bits of a digest of the strings that start at ``at``."""
    h = np.zeros(len(at), np.uint64)
    for j, factor in enumerate(mix64(np.arange(LENGTH) + 1)):
        h += data[at + j] * factor
    h = mix64(h)
    return (h % np.uint64(parts) << np.uint64(32)) | (h >> np.uint64(32))


def _all_places(at: np.ndarray, piece: np.ndarray, offsets: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``at``, string start) for every place of the fragments in their documents."""
    n = place[piece + 1] - place[piece]
    which = np.repeat(np.arange(len(at)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, starts[place[piece[which]] + nth] + (at - offsets[piece])[which]


def _by_part(part: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The parts, and the packed ``rows`` of each."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    return pa.array(part[head].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(head, [*head[1:], len(rows)], strict=True)], pa.binary())


def _sort(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a partition to (doc, run, part, packed, unit): covered where unit is null.

    Split buckets that are sorted together are a unit.  It gives a row for each part with the digests of its
    different strings, and a row of null part with its fragments.
    """
    got = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=_PIECES)
    if not got.num_rows:
        return
    got = got.sort_by("bucket").combine_chunks()
    bucket = np.asarray(got.column("bucket"))
    data, offsets = string_buffers(got.column("piece").chunk(0))
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    doc, split = np.asarray(got.column("doc")), np.asarray(got.column("split"))
    lists = got.column("starts").chunk(0)
    starts, place = np.asarray(lists.flatten()), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
    context = TaskContext.get()
    unit = (context.partitionId() if context else 0) << 32
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(offsets[edges], offsets[edges[i]] + SLICE)))
        j = min(j, len(edges) - 1)
        a, b = edges[i], edges[j]
        i = j
        part = data[offsets[a] : offsets[b]]
        at, piece, string = _sorted_bucket(part, offsets[a : b + 1] - offsets[a])
        piece = piece + a
        d = doc[piece]
        head = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
        low = np.minimum.reduceat(d, head)[string]
        over = np.flatnonzero(d > low)
        which, where = _all_places(at[over] + offsets[a], piece[over], offsets, starts, place)
        cd, cr = _runs(d[over][which], where)
        n = len(cd)
        yield pa.RecordBatch.from_arrays([pa.array(cd), pa.array(cr), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=_SORTED)
        head = head[split[piece[head]]]
        if len(head):
            digest = _digests(part, at[head], parts)
            sent, packed = _by_part(digest >> np.uint64(32), digest.astype(np.uint32))
            own = pa.array([_packed(got.slice(a, b - a).filter(pa.array(split[a:b])))], pa.binary())
            n = len(sent) + 1
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.concat_arrays([sent, pa.nulls(1, pa.int32())]), pa.concat_arrays([packed, own]), pa.array(np.full(n, unit))], names=_SORTED)
            unit += 1


_SORTED = ["doc", "run", "part", "packed", "unit"]
_PIECES = pa.schema([("bucket", pa.int64()), ("split", pa.bool_()), ("doc", pa.int64()), ("starts", pa.list_(pa.int64())), ("piece", pa.binary())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, part, packed digests) to (unit, packed): the digests with their part that are met more than once."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    unit, part, size = _column(got, "unit"), _column(got, "part"), np.array([len(x.as_py()) // 4 for b in got for x in b.column(2)])
    digest = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for b in got for x in b.column(2)])
    digest = digest | (np.repeat(part.astype(np.uint64), size) << np.uint64(32))
    _, number, times = np.unique(digest, return_inverse=True, return_counts=True)
    again = times[number] > 1
    if not again.any():
        return
    unit, digest = np.repeat(unit, size)[again], digest[again]
    order = np.argsort(unit, kind="stable")
    unit, digest = unit[order], digest[order]
    head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])[: len(unit)])
    packed = [digest[a:b].tobytes() for a, b in zip(head, [*head[1:], len(digest)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(unit[head]), pa.array(packed, pa.binary())], names=["unit", "packed"])


def _strings(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fragments of a unit, its repeated digests) to (part, packed): the earliest places of the strings with these digests."""
    for batch in batches:
        for fragments_of, wanted in zip(batch.column(0), batch.column(1), strict=True):
            got = pa.ipc.open_stream(fragments_of.as_py()).read_all().combine_chunks()
            wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in wanted.as_py()])
            data, offsets = string_buffers(got.column("piece").chunk(0))
            size = np.diff(offsets) - LENGTH + 1
            piece = np.repeat(np.arange(len(size)), size)
            at = _spread(offsets[:-1], size)
            digest = _digests(data, at, parts)
            keep = np.isin(digest, wanted)
            at, piece, digest = at[keep], piece[keep], digest[keep]
            doc = np.asarray(got.column("doc"))[piece]
            string = np.ascontiguousarray(data[at[:, None] + np.arange(LENGTH)]).reshape(-1).view("S50")
            _, number = np.unique(string, return_inverse=True)
            low = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, number, doc)
            first = np.flatnonzero(doc == low[number])
            lists = got.column("starts").chunk(0)
            which, where = _all_places(at[first], piece[first], offsets, np.asarray(lists.flatten()), np.append(0, np.cumsum(np.asarray(lists.value_lengths()))))
            which = first[which]
            row = np.empty(len(which), _MEET)
            row["string"], row["doc"], row["run"] = string[which], doc[which], _code(where, 1)
            part, packed = _by_part(digest[which] >> np.uint64(32), row)
            yield pa.RecordBatch.from_arrays([part, packed], names=["part", "packed"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal strings of several units: all but those of the earliest document are covered."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    row = np.concatenate([np.frombuffer(x.as_py(), _MEET) for b in got for x in b.column(1)])
    _, number = np.unique(row["string"], return_inverse=True)
    doc, code = row["doc"], row["run"]
    low = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, number, doc)
    covered = doc > low[number]
    yield pa.RecordBatch.from_arrays([pa.array(doc[covered]), pa.array(code[covered])], names=["doc", "run"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``docs`` with an ordered key ``doc`` for each (id, text), and the bytes of all texts.

    The key is the id where ids are unique; otherwise a number in the order of (id, digest).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.withColumn("__text", text)
    ids = docs.groupBy(id_col).agg(F.count("*").alias("n"), F.sum(F.octet_length("__text")).alias("b"))
    most, total, nulls = ids.agg(F.max("n"), F.sum("b"), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    if (most or 0) <= 1 and not nulls:
        return docs.withColumn("doc", F.col(id_col).cast("long")), total or 0
    marked = docs.withColumns({"__i": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__d": F.sha2("__text", 256)})
    order = marked.select("__i", "__d").distinct().orderBy("__i", "__d").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
    numbers = scratch.table(docs.sparkSession.createDataFrame(order, "__i long, __d string, doc long"), "numbers")
    return marked.join(numbers, ["__i", "__d"]).drop("__i", "__d"), total or 0


def covered_runs(docs: DataFrame, total: int, packed: DataFrame) -> DataFrame:
    """(doc, run) of all string starts of ``docs`` (doc, text) that an earlier document shares; ``packed`` has (doc, z)."""
    spark = docs.sparkSession
    dealt = scan(docs).repartition(scratch.partitions(spark, total / 16, 600_000), "h")
    first = scratch.table(dealt.mapInArrow(_compare, "doc long, run long, bucket long, split boolean, starts array<long>"), "fragments")
    wanted = first.where("bucket is not null")
    n = wanted.count()
    items = wanted.groupBy("doc").agg(F.collect_list(F.struct("bucket", "split", "run", "starts")).alias("items"))
    pieces = packed.select("doc", "z").join(items, "doc").mapInArrow(_fetch, "bucket long, split boolean, doc long, starts array<long>, piece binary")
    parts, tasks = max(MEETINGS, n // MEETING_FRAGMENTS), scratch.partitions(spark, n, 60_000)
    second = pieces.repartition(tasks, "bucket").mapInArrow(functools.partial(_sort, parts), "doc long, run long, part int, packed binary, unit long")
    second = scratch.table(second, "sorted")
    met = scratch.partitions(spark, parts, 16)
    again = second.where("part is not null").select("unit", "part", "packed").repartition(met, "part").mapInArrow(_repeated, "unit long, packed binary")
    again = again.groupBy("unit").agg(F.collect_list("packed").alias("wanted"))
    units = second.where("unit is not null and part is null").select("unit", "packed").repartition(tasks, "unit")
    whole = units.join(again, "unit").select("packed", "wanted").mapInArrow(functools.partial(_strings, parts), "part int, packed binary")
    third = whole.repartition(met, "part").mapInArrow(_meet, "doc long, run long")
    done = first.where("bucket is null").select("doc", "run")
    return done.union(second.where("unit is null").select("doc", "run")).union(third)


def _pack(docs: DataFrame) -> DataFrame:
    """``__text`` replaced by its zstd bytes ``z`` (moved between tasks more cheaply)."""
    rest = [f for f in docs.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "__text"):
            z = pa.array([pack(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=[*batch.schema.names[:-1], "z"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*[f"`{f.name}`" for f in rest], "__text").mapInArrow(run, f"{head}, z binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """id and ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256 and with ``with_text`` the remaining ``kept`` text.

    A character whose bytes are removed in part is dropped from ``kept``.
    """
    carry = [c for c in carry or [] if c not in (id_col, text_col)]
    keyed, total = _keyed(docs.select(id_col, *carry, text_col), id_col, text_col)
    z = _pack(keyed.select("doc", id_col, *carry, "__text"))
    runs = covered_runs(keyed.select("doc", F.col("__text").alias("text")), total, z)
    lists = runs.groupBy("doc").agg(F.collect_list("run").alias("runs"))
    joined = z.join(lists, "doc", "left").select(id_col, *carry, "z", "runs")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", PACKED):
            sizes, removed, spans, digests, texts = [], [], [], [], []
            for packed, found in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                raw = unpack(packed.as_py())
                sizes.append(len(raw))
                if found.is_valid:
                    code = np.asarray(found.values)
                    mark = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mark, code >> 6, 1)
                    np.add.at(mark, (code >> 6) + (code & 63) + LENGTH - 1, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                digests.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    texts.append(raw.decode("utf-8", "ignore"))
            columns = [*batch.columns[:-2], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, f"{head}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
