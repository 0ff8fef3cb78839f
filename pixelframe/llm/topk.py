"""Exact BM25 top-k by block-max WAND over document shards.

Each text is read once: its terms and frequencies are written, a row for about a thousand documents, so
that no step holds large values; document frequencies, query terms and all rounds of queries are taken
from these rows, which tasks put together to shards.  The queries are packed once:
packets of bounded size hold the distinct terms of some queries with their weights, and each query as
numbers into them.  Rounds of packets of at most ``ROUND_BYTES`` are broadcast, and every task passes
its shards: it arranges a shard as an inverted index (postings with impacts, and the largest impact of
each frequent list in each block of documents) and passes all queries of the round.  In a large table a
sixteenth of the shards is passed ahead, so that all other tasks start with thresholds and return what
reaches them only.  The best k of all tasks are merged; document frequencies, the number of documents
and the mean length are those of the whole corpus, so scores compare exactly.

Blocks are runs of documents that all lists share, and the cursors of a batch of queries stand on
blocks.  Lists that many of the batch have and that many documents have are not opened: a block is
bounded by the best sum of the other lists, which are walked, in it plus the block maxima of these.
Where that stays below the query's k-th best score the cursor skips the block; where not, the block is
opened and its documents are scored, for all queries and neighbouring blocks at once by a product of
matrices.  A query without a threshold opens its most promising block first.  Documents of a shard are
ordered by leading word, length and a minimum hash of their terms, which brings alike documents into
one block and so lowers the bounds of all other blocks.

A term is a run of ASCII letters (lower-cased) and non-ASCII characters, told apart by a
64-bit hash; each distinct term of a query counts once.  score = sum of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)).
Single precision serves for bounds only; what may be among the best is scored in double precision.
Scores are rounded to 6 decimals and ties go to the smaller id.

Defined results: a query's own id is never a result; documents without a common term are
no results (fewer than k rows); null and empty texts match nothing but count for N; rows with
null ids are counted but neither ask nor are returned; repeated rows are results each, and
rows with one id are one query made of all their terms.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm import scratch
from pixelframe.llm.textscan import Words, mix64, slices, string_buffers

K1, B = 1.2, 0.75
#: Documents and postings of a shard, documents of a tile and of a block.
SHARD_DOCS, SHARD_POSTINGS, TILE, BLOCK = 8192, 4_000_000, 1024, 128
#: Documents and bytes of text of a row of the index; a task puts the rows that it reads together to shards.
ROW_DOCS, ROW_BYTES = 1024, 1 << 22
#: Of more than so many documents, a part of the shards (one in AHEAD) is passed ahead of the others and gives the queries their floors.
AHEAD_DOCS, AHEAD = 65_536, 16
#: Lists that may be multiplied (the longest ones, in at least this share of a shard's documents); they are
#: multiplied for queries where so large a share of the pairs (query, document) has them.
FREQUENT, FREQUENT_SHARE, WORTH = 1024, 0.01, 0.002
#: Share of open pairs (query, block) from which a tile is opened at once.
TOGETHER = 0.7
#: Term occurrences of a packet, bytes of packets that are broadcast at a time.
PACKET_TERMS, ROUND_BYTES = 500_000, 1 << 25
#: Queries that open blocks together, postings that are walked together; bytes of index that a task reads, if its files are that small.
BATCH, WALK, TASK_BYTES = 256, 30_000, 1 << 24
#: Bytes of rows that pass to Python at a time (one row, if it is larger): both sides of a task hold them several times.
ARROW_BYTES = 1 << 21
#: Documents that reach the floors of a batch of queries, from which the floors are raised before more are noted.
MOST_FOUND = 100_000
#: Postings of documents that are scored exactly together.
EXACT = 250_000
#: Documents of a query up to which their terms are looked up one document after another.
FEW = 4


def postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of some texts, by document and term."""
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    h, doc = h[order], words.doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (size[i] of them) of all i."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _runs(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices one after another with at most ``limit`` in sum, or of one."""
    ends, first = np.append(0, np.cumsum(size)), 0
    while first < len(size):
        last = max(int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1, first + 1)
        yield slice(first, last)
        first = last


class Queries:
    """Queries as term numbers; ``best`` holds what each has found, worst places filled with minus infinity."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray, term: np.ndarray, k: int):
        self.ids, self.k, self.vocabulary, self.weight, self.term = ids, k, vocabulary, weight, term
        self.start = np.append(0, np.cumsum(sizes))
        order = np.lexsort((term, np.repeat(np.arange(len(ids)), sizes)))
        self.term = term[order]
        self.floor = np.full(len(ids), -np.inf)
        self.clear()

    def clear(self) -> None:
        self.best_score = np.full((len(self.ids), self.k), -np.inf)
        self.best_id = np.zeros((len(self.ids), self.k), np.int64)
        self.opened = self.blocks = 0

    def fresh(self) -> Queries:
        """The same queries and floors, with nothing found."""
        out = copy.copy(self)
        out.clear()
        return out

    @classmethod
    def unpack(cls, packets: list[tuple[bytes, bytes, bytes, bytes, bytes]], k: int) -> Queries:
        """From packets of (ids, sizes, sorted vocabulary, weights, term numbers)."""
        kinds = (np.int64, np.int32, np.uint64, np.float64, np.int32)
        ids, sizes, terms, weights, numbers = zip(*([np.frombuffer(x, kind) for x, kind in zip(p, kinds, strict=True)] for p in packets), strict=True)
        vocabulary, first = np.unique(np.concatenate(terms), return_index=True)
        term = np.concatenate([np.searchsorted(vocabulary, v).astype(np.int32)[t] for v, t in zip(terms, numbers, strict=True)])
        ids, sizes, weight = np.concatenate(ids), np.concatenate(sizes), np.concatenate(weights)[first]
        # Queries with the same most frequent term, of one language mostly, are looked at together.
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((sizes, np.minimum.reduceat(weight.astype(np.float32)[term], start)))
        return cls(ids[order], sizes[order], vocabulary, weight, np.concatenate([term[start[i] : start[i] + sizes[i]] for i in order]), k)

    def lift(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores that k results of the queries ``ids`` are known to reach."""
        order = np.argsort(self.ids)
        self.floor[order[np.searchsorted(self.ids[order], ids)]] = scores

    def take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge some new results."""
        asked = np.unique(query)
        q = np.concatenate([np.repeat(asked, self.k), query])
        i = np.concatenate([self.best_id[asked].ravel(), ids])
        s = np.concatenate([self.best_score[asked].ravel(), scores])
        order = np.lexsort((i, -s, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[nth < self.k]
        self.best_id[asked], self.best_score[asked] = i[order].reshape(-1, self.k), s[order].reshape(-1, self.k)


class Documents:
    """Postings of the documents that were added, by document; terms are numbers into a sorted vocabulary."""

    #: Binary columns of a row and the kinds of their numbers; frequencies beyond a byte stand in ``many_tf``, at the places ``many``.
    KINDS = {"ids": np.int64, "asks": np.bool_, "sizes": np.int32, "lengths": np.int64, "vocabulary": np.uint64, "df": np.int32, "term": np.int32, "tf": np.uint8, "many": np.int32, "many_tf": np.int32}
    SCHEMA = ", ".join(f"{c} binary" for c in KINDS) + ", docs long, words long"

    def __init__(self):
        self.parts, self.n, self.bytes = [], 0, 0

    def add(self, ids: pa.Array, asks: pa.Array, words: Words) -> None:
        doc, term, tf = postings(words)
        # Copies, as a view of a column would keep the texts of its batch.
        known, ids, asks = np.array(ids.is_valid()), np.array(ids.fill_null(0)), np.array(asks)
        self.parts.append((np.bincount(doc, minlength=len(ids)).astype(np.int32), term, tf.astype(np.int32), known, ids, asks, words.per_doc))
        self.n += len(ids)
        self.bytes += len(words.bytes)

    def arrays(self) -> dict[str, np.ndarray]:
        """Documents without an id count for document frequencies only."""
        columns, self.parts = list(zip(*self.parts, strict=True)), []
        sizes, term, tf, known, ids, asks, lengths = (np.concatenate(columns.pop(0)) for _ in range(7))
        order = np.argsort(term)
        term = term[order]
        new = np.append(True, term[1:] != term[:-1])[: len(term)]
        vocabulary, df = term[new], np.diff(np.append(np.flatnonzero(new), len(term))).astype(np.int32)
        del term, new
        number = np.empty(len(order), np.int32)
        number[order] = np.repeat(np.arange(len(df), dtype=np.int32), df)
        del order
        if not known.all():
            keep = np.repeat(known, sizes)
            number, tf = number[keep], tf[keep]
        return {"ids": ids[known], "asks": asks[known], "sizes": sizes[known], "lengths": lengths[known], "vocabulary": vocabulary, "df": df, "term": number, "tf": tf, "words": lengths.sum()}

    def row(self) -> pa.RecordBatch:
        held = self.arrays()
        held["many"] = np.flatnonzero(held["tf"] > 255).astype(np.int32)
        held["many_tf"] = held["tf"][held["many"]]
        held["tf"] = np.minimum(held["tf"], 255).astype(np.uint8)
        some = [pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, held[c].nbytes], np.int32)), pa.py_buffer(held[c])]) for c in self.KINDS]
        return pa.RecordBatch.from_arrays([*some, pa.array([self.n]), pa.array([int(held["words"])])], names=[*self.KINDS, "docs", "words"])

    @classmethod
    def rows(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """The arrays of rows, as far as their columns are there."""
        for batch in batches:
            for i in range(batch.num_rows):
                held = {c: np.frombuffer(batch.column(j)[i].as_buffer(), cls.KINDS[c]) for j, c in enumerate(batch.schema.names)}
                if "tf" in held:
                    held["tf"] = held["tf"].astype(np.int32)
                    held["tf"][held["many"]] = held["many_tf"]
                yield held

    @classmethod
    def shards(cls, batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[dict[str, np.ndarray]]:
        """Arrays of rows one after another, of at most ``docs`` documents and SHARD_POSTINGS postings together (or of one row)."""
        some: list[dict[str, np.ndarray]] = []
        for held in cls.rows(batches):
            if some and (sum(len(h["ids"]) for h in some) + len(held["ids"]) > docs or sum(len(h["term"]) for h in some) + len(held["term"]) > SHARD_POSTINGS):
                yield cls.join(some)
            some.append(held)
        if some:
            yield cls.join(some)

    @staticmethod
    def join(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """The arrays of some rows as those of one; ``some`` is emptied."""
        out = {c: np.concatenate([h[c] for h in some]) for c in ("ids", "sizes", "lengths", "tf")}
        out["vocabulary"], number = np.unique(np.concatenate([h["vocabulary"] for h in some]), return_inverse=True)
        number, first = number.astype(np.int32), np.cumsum([0] + [len(h["vocabulary"]) for h in some])
        out["term"] = np.concatenate([number[at:][h["term"]] for at, h in zip(first, some)])
        some.clear()
        return out


class Shard:
    """Inverted index of some documents, of the terms that the queries have."""

    def __init__(self, mean: float, queries: Queries):
        self.mean, self.queries, self.documents = mean, queries, Documents()

    def add(self, ids: np.ndarray, words: Words) -> None:
        self.documents.add(pa.array(ids), pa.array(np.zeros(len(ids), bool)), words)

    def _arrange(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray, df: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Old numbers of the documents in their order: alike documents stand together."""
        here = np.flatnonzero(np.diff(first))
        first = first[here]
        lead, low = np.full(self.n, 64), np.zeros(self.n, np.uint64)
        top = np.argsort(-df, kind="stable")[:64]
        place = np.full(len(df), 64, np.int32)
        place[top] = np.arange(len(top))
        place = place[term]
        if len(here):
            most = tf * 64
            most += 63 - place
            most[place == 64] = 0
            lead[here] = 63 - np.maximum.reduceat(most, first) % 64
            del most, place
            low[here] = np.minimum.reduceat(mix64(np.arange(1, len(df) + 1))[term], first)
        return np.lexsort((low, (2 * np.log2(length + 1)).astype(int), lead))

    def close(self, held: dict[str, np.ndarray] | None = None) -> Shard:
        """Index ``held``, or what was added; terms and frequencies are taken out of it."""
        held = held or self.documents.arrays()
        self.n, known, tf, length = len(held["ids"]), held["vocabulary"], held.pop("tf"), held["lengths"]
        at = np.minimum(np.searchsorted(self.queries.vocabulary, known), len(self.queries.vocabulary) - 1)
        asked = self.queries.vocabulary[at] == known
        self.local = np.full(len(self.queries.vocabulary), -1, np.int32)
        self.local[at[asked]] = np.arange(asked.sum())
        weight = self.queries.weight[at[asked]]
        term = np.where(asked, np.cumsum(asked) - 1, -1).astype(np.int32)[held.pop("term")]
        keep = term >= 0
        term, tf = term[keep], tf[keep]
        doc = np.repeat(np.arange(self.n, dtype=np.int32), held["sizes"])[keep]
        del keep
        df = np.bincount(term, minlength=len(weight))
        first = np.searchsorted(doc, np.arange(self.n + 1, dtype=np.int32))
        del doc
        old = self._arrange(first, term, tf, df, length)
        self.ids = held["ids"][old]
        self.by_id = np.argsort(self.ids, kind="stable")
        soft = K1 * (1 - B + B * length[old] / max(self.mean, 1e-9))
        # Forward lists by document; terms are numbered in their order.
        size = np.diff(first)[old]
        at = _spread(first[:-1][old], size)
        self.forward, tf = term[at], tf[at]
        del at, term
        self.forward_start = np.append(0, np.cumsum(size))
        doc = np.repeat(np.arange(self.n, dtype=np.uint16 if self.n <= 1 << 16 else np.int32), size)
        part, below = tf * (K1 + 1), soft[doc]
        below += tf
        part /= below
        del tf, below
        self.value = weight[self.forward]
        self.value *= part
        del part
        self.bound = weight * (K1 + 1)  # of any document
        # Postings by term; the most frequent lists also as columns that can be multiplied.
        self.blocks = -(-self.n // BLOCK)
        order = np.argsort(self.forward, kind="stable")
        self.place, self.impact = doc[order], self.value.astype(np.float32)[order]
        del doc, order
        self.start = np.append(0, np.cumsum(df))
        top = np.argsort(-df, kind="stable")[:FREQUENT]
        self.top = top[df[top] >= max(FREQUENT_SHARE * self.n, 2)]
        self.column = np.full(len(df), -1, np.int32)
        self.column[self.top] = np.arange(len(self.top))
        self.size = df
        self.dense = np.zeros((len(self.top), self.blocks * BLOCK), np.float32)
        for row, t in zip(self.dense, self.top, strict=True):
            row[self.place[self.start[t] : self.start[t + 1]]] = self.impact[self.start[t] : self.start[t + 1]]
        self.most = self.dense.reshape(len(self.top), self.blocks, BLOCK).max(axis=2)
        self.score = np.empty((min(BATCH, len(self.queries.ids)), self.blocks * BLOCK), np.float32)
        return self

    def search_all(self) -> None:
        """Pass all queries."""
        for i in range(0, len(self.queries.ids), BATCH):
            self.search(i, min(i + BATCH, len(self.queries.ids)))

    def search(self, i: int, j: int) -> None:
        """Pass the queries from number ``i`` to ``j`` and keep their best."""
        q, n, wide = self.queries, j - i, self.blocks * BLOCK
        t = self.local[q.term[q.start[i] : q.start[j]]]
        asks = np.repeat(np.arange(n), np.diff(q.start[i : j + 1]))[t >= 0]
        t = t[t >= 0]
        slack = 1e-2 + 1e-5 * np.bincount(asks, self.bound[t], n)
        # Lists of many documents that many of these queries have are multiplied, the others are walked.
        inside = self.column[t] >= 0
        worth = np.bincount(self.column[t[inside]], minlength=len(self.top)) * self.size[self.top] >= WORTH * n * self.n
        inside[inside] = worth[self.column[t[inside]]]
        chosen, most = np.flatnonzero(worth), self.most[worth]
        asked = np.zeros((len(most), n), np.float32)
        asked[(np.cumsum(worth) - 1)[self.column[t[inside]]], asks[inside]] = 1
        score = self.score[:n]
        score[:] = 0
        rare, row = t[~inside], asks[~inside]
        for some in _runs(self.size[rare], WALK):
            size, first, last = self.size[rare[some]], row[some][0], row[some][-1] + 1
            at = _spread(self.start[rare[some]], size)
            flat = np.repeat((row[some] - first) * wide, size)
            flat += self.place[at]
            score[first:last] += np.bincount(flat, self.impact[at], (last - first) * wide).reshape(-1, wide)
        bound = asked.T @ most + score.reshape(n, self.blocks, BLOCK).max(axis=2)
        # A query's own rows are no results.
        low, high = (np.searchsorted(self.ids[self.by_id], q.ids[i:j], side=s) for s in ("left", "right"))
        own = np.repeat(np.arange(n), high - low), self.by_id[_spread(low, high - low)]
        score[own] = -np.inf
        closed = np.ones(bound.shape, bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def open_blocks(who: np.ndarray, first: int, last: int) -> None:
            """Score the documents of some blocks for the queries ``who`` and note those that reach the floor."""
            closed[who, first:last] = False
            every, some = len(who) == n, slice(first * BLOCK, last * BLOCK)
            scores = (asked if every else asked[:, who]).T @ self.dense[chosen, some]
            scores += score[:, some] if every else score[who, some]
            a, d = np.nonzero(scores >= (floor - slack)[who, None])
            found.append((who[a], first * BLOCK + d, scores[a, d]))
            if sum(len(f[0]) for f in found[1:]) > MOST_FOUND + len(found[0][0]):
                self._raise(floor, slack, found)

        def look(pairs: np.ndarray) -> None:
            """Open blocks, neighbours at once where most of their queries open most of them."""
            for first in range(0, self.blocks, TILE // BLOCK):
                some = pairs[:, first : first + TILE // BLOCK]
                who, here = np.flatnonzero(some.any(axis=1)), np.flatnonzero(some.any(axis=0))
                if len(who) and some[who, here[0] : here[-1] + 1].mean() >= TOGETHER:
                    open_blocks(who, first + here[0], first + here[-1] + 1)
                else:
                    for b in here:
                        open_blocks(np.flatnonzero(some[:, b]), first + b, first + b + 1)

        floor = np.maximum(q.best_score[i:j, -1], q.floor[i:j])
        new = np.flatnonzero(floor == -np.inf)
        if len(new):
            pairs = np.zeros(bound.shape, bool)
            pairs[new, bound[new].argmax(axis=1)] = True
            floor[new] = 0
            look(pairs & (bound > 0))
            self._raise(floor, slack, found)
        floor = np.maximum(floor, 1e-9)  # documents without a common term are no results
        look((bound + slack[:, None] >= floor[:, None]) & (bound > 0) & closed)
        q.opened += int((~closed).sum())
        q.blocks += closed.size
        who, doc, _ = self._raise(floor, slack, found)
        exact = self._exact(asks, t, who, doc)
        right = exact > 0
        if right.any():
            q.take(who[right] + i, self.ids[doc[right]], exact[right])

    def _raise(self, floor: np.ndarray, slack: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lift floors to the k-th best of what is found; (query, document, about score) by query."""
        who, doc, about = (np.concatenate([f[c] for f in found]) for c in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        at = np.unique(who * np.int64(self.blocks * BLOCK) + doc, return_index=True)[1]  # blocks may have been opened twice
        at = at[doc[at] < self.n]
        who, doc, about = who[at], doc[at], about[at]
        order = np.lexsort((-about, who))
        who, doc, about = who[order], doc[order], about[order]
        last = np.searchsorted(who, np.arange(len(floor))) + self.queries.k - 1
        full = last < np.searchsorted(who, np.arange(len(floor)), side="right")
        floor[full] = np.maximum(floor[full], about[last[full]] - slack[full])
        keep = about >= (floor - slack)[who]
        found[:] = [(who[keep], doc[keep], about[keep])]
        return found[0]

    def _exact(self, asks: np.ndarray, t: np.ndarray, who: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of pairs (query, document), by query, in double precision, summed in the order of terms."""
        out, has = np.zeros(len(who)), np.zeros(len(self.bound), bool)
        for q, begin, count in zip(*np.unique(who, return_index=True, return_counts=True), strict=True):
            own = t[np.searchsorted(asks, q) : np.searchsorted(asks, q, side="right")]
            if count <= FEW:
                for nth in range(begin, begin + count):
                    some = slice(self.forward_start[doc[nth]], self.forward_start[doc[nth] + 1])
                    at = np.searchsorted(self.forward[some], own)
                    at = at[at < some.stop - some.start]
                    common = at[self.forward[some][at] == own[: len(at)]]
                    out[nth] = np.bincount(np.zeros(len(common), int), self.value[some][common], 1)[0]
                continue
            has[own] = True
            for part in _runs(self.forward_start[doc[begin : begin + count] + 1] - self.forward_start[doc[begin : begin + count]], EXACT):
                some = slice(begin + part.start, begin + part.stop)
                size = self.forward_start[doc[some] + 1] - self.forward_start[doc[some]]
                at = _spread(self.forward_start[doc[some]], size)
                out[some] = np.bincount(np.repeat(np.arange(len(size)), size), self.value[at] * has[self.forward[at]], len(size))
            has[own] = False
        return np.round(out, 6)


def index(base: DataFrame, row_docs: int = ROW_DOCS) -> DataFrame:
    """(id, text, asks) to rows of at most ``row_docs`` documents: the columns of ``Documents``; each text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Documents()
        for part in slices(batches, "text"):
            for at in range(0, part.num_rows, row_docs):
                some = part.slice(at, row_docs)
                if held.n and (held.n + some.num_rows > row_docs or held.bytes > ROW_BYTES):
                    yield held.row()
                    held = Documents()
                held.add(some.column(0), some.column(2), Words(*string_buffers(some.column(1))))
        if held.n:
            yield held.row()

    return base.select("id", "text", "asks").mapInArrow(run, Documents.SCHEMA)


def _frequencies(shards: DataFrame) -> DataFrame:
    """(term, n): documents of some rows of the index with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Documents.rows(batches)
        while some := list(islice(rows, SHARD_DOCS // ROW_DOCS)):
            term, at = np.unique(np.concatenate([h["vocabulary"] for h in some]), return_inverse=True)
            n = np.bincount(at, np.concatenate([h["df"] for h in some]), len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    return shards.select("vocabulary", "df").mapInArrow(run, "term long, n long")


def _query_terms(shards: DataFrame) -> DataFrame:
    """(query, term) of the documents that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in Documents.rows(batches):
            who, start = np.flatnonzero(held["asks"]), np.append(0, np.cumsum(held["sizes"]))
            size = held["sizes"][who]
            term = held["vocabulary"][held["term"][_spread(start[who], size)]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held["ids"][who], size)), pa.array(term)], names=["query", "term"])

    return shards.select("ids", "asks", "sizes", "vocabulary", "term").mapInArrow(run, "query long, term long")


def _packets(lists: DataFrame) -> DataFrame:
    """(query, terms, w) to packets of at most PACKET_TERMS term occurrences (or one query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packet() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            sizes, terms, weights = (np.concatenate([h[c] for h in held]) for c in (1, 2, 3))
            each, first, number = np.unique(terms, return_index=True, return_inverse=True)
            parts = [ids, sizes.astype(np.int32), each, weights[first], number.astype(np.int32)]
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([sum(x.nbytes for x in parts)])], names=names)

        for batch in batches:
            i, (ids, lists, w) = 0, (batch.column(0).to_numpy(), batch.column(1), batch.column(2))
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            terms, weights = np.asarray(lists.flatten()).view(np.uint64), np.asarray(w.flatten())
            while i < len(ids):
                j = max(i + (not held), int(np.searchsorted(ends, ends[i] + PACKET_TERMS - n, side="right")) - 1)
                if j > i:
                    held.append((ids[i:j], np.diff(ends[i : j + 1]), terms[ends[i] : ends[j]], weights[ends[i] : ends[j]]))
                    n += int(ends[j] - ends[i])
                i = j
                if i < len(ids):
                    yield packet()
                    n = 0
        if held:
            yield packet()

    names = ["ids", "sizes", "vocabulary", "weights", "numbers", "bytes"]
    return lists.select("query", "terms", "w").mapInArrow(run, "ids binary, sizes binary, vocabulary binary, weights binary, numbers binary, bytes long")


def pass_shards(shards: DataFrame, queries: Queries, mean: float, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(query_id, id, score): each task's best of ``shards`` for ``queries``, from their floors on."""
    shared = shards.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value.fresh()
        for held in Documents.shards(batches, shard_docs):
            if len(held["ids"]):
                Shard(mean, queries).close(held).search_all()
        who, nth = np.nonzero(queries.best_score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[who]), pa.array(queries.best_id[who, nth]), pa.array(queries.best_score[who, nth])], names=["query_id", "id", "score"])

    return shards.select("ids", "sizes", "lengths", "vocabulary", "term", "tf", "many", "many_tf").mapInArrow(run, "query_id long, id long, score double")


def _written(df: DataFrame, name: str, **conf: str) -> DataFrame:
    """``scratch.table`` with ``conf`` and with batches of at most ARROW_BYTES on their way to Python."""
    session = df.sparkSession.conf
    conf = {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)} | conf
    before = {c: session.get(c, None) for c in conf}
    try:
        for c, value in conf.items():
            session.set(c, value)
        return scratch.table(df, name)
    finally:
        for c, value in before.items():
            session.set(c, value) if value is not None else session.unset(c)


#: Pages and groups of the index are closed after any row, and few of its rows are read at a time.
WRITE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(TASK_BYTES)}
READ_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "2"}


def _passed(shards: DataFrame, queries: Queries, mean: float, shard_docs: int) -> DataFrame:
    """``pass_shards``, written; files of a shard or two are not put together into one task."""
    return _written(pass_shards(shards, queries, mean, shard_docs), "found", **READ_ROWS | {"spark.sql.files.maxPartitionBytes": str(TASK_BYTES)})


def search(docs: DataFrame, queries: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, round_bytes: int = ROUND_BYTES, ahead_docs: int = AHEAD_DOCS) -> DataFrame:
    """The best ``k`` rows for each row that fulfils ``queries``: query_id, rank (from 1), the id column, score."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n = docs.count()
    # Small input partitions are put together, so that shards are large, but all cores have some.
    shards = index(base.coalesce(max(1, -(-n // shard_docs), min(2 * spark.sparkContext.defaultParallelism, n // 2048))), min(ROW_DOCS, shard_docs))
    shards = _written(shards.withColumn("row", F.monotonically_increasing_id()), "shards", **WRITE_ROWS)
    totals = shards.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    n = totals["n"] or 0
    mean = totals["words"] / n if n else 0.0
    df = _frequencies(shards).groupBy("term").agg(F.sum("n").alias("n")).where("n > 1")  # a term of one document finds no other
    df = _written(df, "terms", **READ_ROWS)
    asked = _query_terms(shards).distinct()
    idf = F.log1p((F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = asked.join(df, "term").select("query", F.struct("term", idf.alias("w")).alias("t"))
    lists = weighed.groupBy("query").agg(F.collect_list("t").alias("t")).select("query", F.col("t.term").alias("terms"), F.col("t.w").alias("w"))
    packets = _written(_packets(lists).withColumn("packet", F.monotonically_increasing_id()), "packets")
    sizes = packets.select("packet", "bytes").orderBy("packet").collect()  # one row for some 1500 queries
    rounds: list[list[int]] = []
    room = 0
    for r in sizes:
        if r["bytes"] > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(r["packet"])
        room -= r["bytes"]
    ahead: list[int] = []
    if n > ahead_docs:  # a number for about a thousand documents; of every AHEAD runs of rows, about a shard each, the first
        rows, each = [r["row"] for r in shards.select("row").orderBy("row").collect()], max(1, shard_docs // ROW_DOCS)
        ahead = [r for i, r in enumerate(rows) if i // each % AHEAD == 0]
    found = []
    for some in rounds:
        held = packets.where(F.col("packet").between(some[0], some[-1])).select("ids", "sizes", "vocabulary", "weights", "numbers").collect()
        held, rest = Queries.unpack([tuple(map(bytes, r)) for r in held], k), shards
        if ahead:
            first, rest = _passed(shards.where(F.col("row").isin(ahead)), held, mean, shard_docs), shards.where(~F.col("row").isin(ahead))
            reached = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)
            reached = reached.select("query_id", F.col("s")[k - 1].alias("s")).toArrow()  # a row for each query of the round at most
            held.lift(reached.column(0).to_numpy(), reached.column(1).to_numpy())
            found.append(first)
        found.append(_passed(rest, held, mean, shard_docs))
    if not found:
        found = [spark.createDataFrame([], "query_id long, id long, score double")]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
