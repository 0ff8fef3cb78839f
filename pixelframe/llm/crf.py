"""Linear-chain conditional random field over words.

Emissions are sums of learned weights of hashed features of one word (byte
bigrams and trigrams with word edges, prefixes and suffixes, and a lexicon of
frequent training words); transitions and starts are learned too.  Decoding is
exact forward-backward.  Long sequences are cut into chunks whose K x K
transfer matrices are multiplied first, so that the work is vectorised over
chunks and memory stays bounded, with the same marginals as one long pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np

from pixelframe.llm.textscan import Words, mix64

CHUNK = 96


@dataclass(frozen=True)
class Features:
    """Sizes of the hashed feature tables (powers of two)."""

    ngram_bits: int = 16
    affix_bits: int = 15
    lexicon_bits: int = 16

    @property
    def rows(self) -> int:
        return 2 * (1 << self.ngram_bits) + (1 << self.affix_bits) + (1 << self.lexicon_bits) + 1


class Sparse:
    """Feature rows of some words: flat ``ids`` with the first index of each word."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray]], single: list[np.ndarray]):
        self.groups, self.single = groups, single

    def emissions(self, weight: np.ndarray) -> np.ndarray:
        out = sum(weight[ids] for ids in self.single)
        for ids, first in self.groups:
            out = out + np.add.reduceat(weight[ids], first, axis=0)
        return out

    def compact(self) -> tuple[np.ndarray, Sparse]:
        """(feature rows that occur, the same words with rows numbered among those)."""
        sizes = [len(i) for i in self.single] + [len(i) for i, _ in self.groups]
        used, local = np.unique(np.concatenate([*self.single, *(i for i, _ in self.groups)]), return_inverse=True)
        parts = np.split(local, np.cumsum(sizes)[:-1])
        k = len(self.single)
        return used, Sparse([(i, first) for i, (_, first) in zip(parts[k:], self.groups, strict=True)], parts[:k])

    def gradient(self, per_word: np.ndarray, rows: int) -> np.ndarray:
        ids = [*self.single]
        owner = [np.arange(len(per_word))] * len(self.single)
        for group, first in self.groups:
            ids.append(group)
            owner.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group)))))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        return np.stack([np.bincount(ids, per_word[owner, k], rows) for k in range(per_word.shape[1])], 1)


def lexicon_slots(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def build_lexicon(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A table of word hashes by slot, rarest first so that the most frequent word keeps a shared slot."""
    table = np.zeros(1 << bits, np.uint64)
    table[lexicon_slots(hashes, bits)] = hashes
    return table


def featurise(words: Words, hashes: np.ndarray, lexicon: np.ndarray, f: Features) -> Sparse:
    """Feature rows of some words with their hashes."""
    at, first = words.letters()
    size = words.end - words.start
    b = words.bytes
    prev, cur, nxt = b[at - 1].astype(np.uint32), b[at].astype(np.uint32), b[at + 1].astype(np.uint32)
    last = first + size - 1
    prev[first] = 1
    nxt[last] = 2
    top = np.uint32(32 - f.ngram_bits)
    bigram = ((prev * np.uint32(257) + cur + np.uint32(7)) * np.uint32(2654435761)) >> top
    trigram = (((prev << np.uint32(16)) + (cur << np.uint32(8)) + nxt) * np.uint32(2246822519) + np.uint32(374761393)) >> top
    base = 1 << f.ngram_bits
    groups = [(bigram.astype(np.int64), first), (trigram.astype(np.int64) + base, first)]
    base *= 2
    single = []
    for length in (2, 3, 4):
        for side in (0, 1):
            value = np.full(len(size), np.uint64(length * 2 + side), np.uint64)
            for j in range(length):
                where = words.start + j if side == 0 else words.end - 1 - j
                value = value * np.uint64(263) + np.where(j < size, b[np.clip(where, 0, len(b) - 1)], 0).astype(np.uint64)
            single.append((mix64(value) >> np.uint64(64 - f.affix_bits)).astype(np.int64) + base)
    base += 1 << f.affix_bits
    slot = lexicon_slots(hashes, f.lexicon_bits)
    single.append(np.where(lexicon[slot] == hashes, slot + base, f.rows - 1))
    return Sparse(groups, single)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows or matrices divided by their sums; scale is free in what follows."""
    total = x.reshape(len(x), -1) @ np.ones(x[0].size if len(x) else 1)
    return x / np.maximum(total, 1e-300).reshape(-1, *[1] * (x.ndim - 1))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals (n, K) of sequences that lie one after another in ``emission``.

    With ``pairs`` also the expected transition counts (K, K) and the first
    positions.  ``lengths`` may hold zeros.
    """
    n, k = emission.shape
    p = np.exp(emission - reduce(np.maximum, emission.T)[:, None])
    a = np.exp(trans - trans.max())
    lengths = lengths[lengths > 0]
    doc_start = np.cumsum(lengths) - lengths
    chunks = -(-lengths // CHUNK)
    doc = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = doc_start[doc] + nth * CHUNK
    size = np.minimum(CHUNK, lengths[doc] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    opening = nth[order] == 0
    live = np.searchsorted(-size_o, -np.arange(1, size_o[0] + 1), side="right")
    # 1. transfer matrices of the chunks of sequences that have several
    many = bool((chunks > 1).any())
    if many:
        multi = np.flatnonzero(chunks[doc[order]] > 1)
        begin_m, size_m, opening_m = begin_o[multi], size_o[multi], opening[multi]
        m = np.zeros((len(multi), k, k))
        m[:] = np.eye(k)
        for t, c in enumerate(np.searchsorted(-size_m, -np.arange(1, size_m[0] + 1), side="right")):
            step = (m[:c].reshape(-1, k) @ a).reshape(-1, k, k)
            if not t:
                step[opening_m] = np.eye(k)
            step *= p[begin_m[:c] + t][:, None, :]
            m[:c] = _scaled(step) if t % 8 == 7 else step
        back = np.zeros((len(doc), k, k))
        back[order[multi]] = _scaled(m)
        m = back
    # 2. vectors at chunk edges
    entry = np.empty((len(doc), k))
    leave = np.ones((len(doc), k))
    entry[nth == 0] = np.exp(start - start.max())
    if many:
        head = np.cumsum(chunks) - chunks
        for j in range(1, int(chunks.max())):
            c = head[chunks > j] + j
            entry[c] = _scaled((entry[c - 1][:, None, :] @ m[c - 1])[:, 0, :])
        for j in range(int(chunks.max()) - 1, 0, -1):
            c = head[chunks > j] + j
            leave[c - 1] = _scaled((m[c] @ leave[c][:, :, None])[:, :, 0])
    # 3. exact passes within chunks
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v, w = entry[order], leave[order]
    for t, c in enumerate(live):
        at = begin_o[:c] + t
        step = v[:c] @ a if t else np.where(opening[:c, None], v[:c], v[:c] @ a)
        v[:c] = step * p[at]
        if t % 8 == 7:
            v[:c] = _scaled(v[:c])
        alpha[at] = v[:c]
    for t in range(len(live) - 1, -1, -1):
        c = live[t]
        at = begin_o[:c] + t
        beta[at] = w[:c]
        w[:c] = (w[:c] * p[at]) @ a.T
        if t % 8 == 7:
            w[:c] = _scaled(w[:c])
    gamma = _scaled(alpha * beta)
    if not pairs:
        return gamma
    inner = np.ones(n, bool)
    inner[doc_start] = False
    at = np.flatnonzero(inner)
    xi = alpha[at - 1][:, :, None] * a * (p[at] * beta[at])[:, None, :]
    return gamma, _scaled(xi).sum(axis=0), doc_start


class Crf:
    """A trained field: ``weight`` (feature rows x K), ``trans``, ``start``, ``lexicon``, ``labels``."""

    def __init__(self, labels: list, lexicon: np.ndarray, f: Features):
        k = len(labels)
        self.labels, self.lexicon, self.f = labels, lexicon, f
        self.weight = np.zeros((f.rows, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def marginals(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros((0, len(self.labels)))
        each, hashes, inverse = words.distinct()
        emission = featurise(each, hashes, self.lexicon, self.f).emissions(self.weight)
        return forward_backward(emission.astype(np.float64)[inverse], words.per_doc, self.trans, self.start)

    def fit(self, batches: list[tuple[Words, np.ndarray]], epochs: int, rate: float = 0.3, l2: float = 1e-5, seed: int = 0) -> Crf:
        """Maximise the conditional log likelihood by AdaGrad over word sequences with labels."""
        k = len(self.labels)
        seen = np.full(self.weight.shape, 1e-6, np.float32)
        seen_t, seen_s = np.full((k, k), 1e-6), np.full(k, 1e-6)
        made = []
        for words, y in batches:
            if len(words):
                each, hashes, inverse = words.distinct()
                made.append((*featurise(each, hashes, self.lexicon, self.f).compact(), inverse, words.per_doc, y))
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(made)):
                used, sparse, inverse, lengths, y = made[i]
                weight, weight_seen = self.weight[used], seen[used]
                emission = sparse.emissions(weight).astype(np.float64)[inverse]
                gamma, xi, first = forward_backward(emission, lengths, self.trans, self.start, True)
                n = len(y)
                truth = np.eye(k)[y]
                error = np.stack([np.bincount(inverse, (truth - gamma)[:, j] / n) for j in range(k)], 1)
                grad = sparse.gradient(error, len(used)).astype(np.float32) - np.float32(l2) * weight
                inner = np.ones(n, bool)
                inner[first] = False
                at = np.flatnonzero(inner)
                counts = np.zeros((k, k))
                np.add.at(counts, (y[at - 1], y[at]), 1)
                grad_t = (counts - xi) / n - l2 * self.trans
                grad_s = (truth[first] - gamma[first]).sum(axis=0) / n - l2 * self.start
                for value, g, s in ((weight, grad, weight_seen), (self.trans, grad_t, seen_t), (self.start, grad_s, seen_s)):
                    s += g * g
                    value += rate * g / np.sqrt(s)
                self.weight[used], seen[used] = weight, weight_seen
        return self
