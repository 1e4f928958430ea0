"""Segmentations of words into vocabulary pieces: marginal probabilities and expected piece counts, many words at a time.

A word of UTF-8 bytes is generated as a sequence of pieces that ends with a stop event, which cannot come first: its marginal
probability is the sum over all segmentations of the product of piece probabilities, times stop / (1 - stop). The piece
probabilities of a model sum to 1 - stop, so all words together have probability 1 at most. Every single byte is a piece, so
each word has a segmentation. The pieces come from a public vocabulary file and are never trained.

All recursions run in log space, over pieces of any length and words of any length. Words of one length go side by side as
arrays; where few words share a length each goes by itself, position by position. Both ways sum the same terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np

#: The stop probability of a vocabulary's own model (four pieces a word on average).
STOP = 0.25
#: Fewer words of one length than this go one by one; positions of a single word whose arcs are found at once.
FEW, BLOCK = 10, 1 << 16


class Vocabulary:
    """Distinct byte strings and their trie as tables: the next node by node and byte, and the piece that ends at a node."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        self.ids = {p: i for i, p in enumerate(pieces)}
        inner = {b"": 0}  # prefixes that go on, numbered; ends of pieces that do not go on come after them
        for p in pieces:
            for k in range(1, len(p)):
                inner.setdefault(p[:k], len(inner))
        self.inner = len(inner)
        leaves = [p for p in pieces if p not in inner]
        node = {**inner, **{p: self.inner + i for i, p in enumerate(leaves)}}
        self.next = np.full((self.inner, 256), -1, np.int32)
        for p, number in node.items():
            if p:
                self.next[inner[p[:-1]], p[-1]] = number
        self.piece = np.full(len(node), -1, np.int32)
        for p, i in self.ids.items():
            self.piece[node[p]] = i

    def arcs(self, text: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, piece ids) of the pieces of one word that start at first to last - 1, by length."""
        at, state, n = np.arange(first, last), np.zeros(last - first, np.int32), 0
        while len(at):
            inside = at + n < len(text)
            at, state = at[inside], state[inside]
            state = self.next[state, text[at + n]]
            met = state >= 0
            at, state, n = at[met], state[met], n + 1
            ids = self.piece[state]
            hit = ids >= 0
            if hit.any():
                yield n, at[hit], ids[hit]
            on = state < self.inner
            at, state = at[on], state[on]


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Vocabulary, np.ndarray]:
    """The pieces of a sentencepiece model (A-Z in lower case, without word marks) and probabilities by its scores.

    Scores are log probabilities of unigrams. A vocabulary of merges scores its pieces by their rank only, 0, -1, -2 ...;
    a piece of rank r then weighs 1 / (r + 10), as word frequencies fall with their ranks. Pieces that are the same bytes
    add up; single bytes that are no pieces weigh as the least piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranked = min(scores) < -1000
    for i, score in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", "").encode().lower()
        if piece:
            weights[piece] = weights.get(piece, 0.0) + (1.0 / (10.0 - score) if ranked else exp(score))
    least = min(weights.values())
    for b in range(256):
        weights.setdefault(bytes([b]), least)
    pieces = sorted(weights)
    p = np.array([weights[x] for x in pieces])
    return Vocabulary(pieces), p / p.sum() * (1 - STOP)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def groups(starts: np.ndarray, ends: np.ndarray, cells: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
    """(length, indices) of words of equal length, so many that they have about `cells` bytes together."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(part):
            n = int(length[part[0]])
            most = max(FEW, cells // n)
            for i in range(0, len(part), most):
                yield n, part[i : i + most]


def side_by_side(vocabulary: Vocabulary, text: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, words, piece ids) of the pieces in equally long words, the rows of text; starts ascend."""
    count, length = text.shape
    flat = text.reshape(-1)
    for i in range(length):
        at, state = np.arange(count), np.zeros(count, np.int32)
        for e in range(i + 1, length + 1):
            state = vocabulary.next[state, flat[at * length + (e - 1)]]
            met = state >= 0
            at, state = at[met], state[met]
            ids = vocabulary.piece[state]
            hit = ids >= 0
            if hit.any():
                yield i, e, at[hit], ids[hit]
            on = state < vocabulary.inner
            at, state = at[on], state[on]
            if not len(at):
                break


def forward(vocabulary: Vocabulary, word: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log sums over all segmentations of each beginning of one word (position 0: 0)."""
    alpha = [0.0]
    for first in range(0, len(word), BLOCK):
        last = min(first + BLOCK, len(word))
        ending: list[list[tuple[int, float]]] = [[] for _ in range(last - first)]
        for n, starts, ids in vocabulary.arcs(word, max(0, first - vocabulary.longest), last):
            inside = (starts + n > first) & (starts + n <= last)
            for s, x in zip(starts[inside].tolist(), logs[ids[inside]].tolist(), strict=True):
                ending[s + n - 1 - first].append((s, x))
        for terms in ending:
            sums = [alpha[s] + x for s, x in terms]
            top = max(sums)
            alpha.append(top + log(sum([exp(t - top) for t in sums])) if len(sums) > 1 else top)
    return np.array(alpha)


def marginals(vocabulary: Vocabulary, p: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(models, words) natural log marginals; p: (models, pieces), all above 0."""
    out = np.empty((len(p), len(starts)))
    logs = np.log(p)
    for length, part in groups(starts, ends):
        if len(part) < FEW:
            for w in part:
                word = data[starts[w] : ends[w]]
                out[:, w] = [forward(vocabulary, word, x)[-1] for x in logs]
            continue
        alpha = np.full((length + 1, len(p), len(part)), -np.inf)
        alpha[0] = 0
        for i, e, at, ids in side_by_side(vocabulary, data[starts[part][:, None] + np.arange(length)]):
            whole = len(at) == len(part)
            for m in range(len(p)):
                term = (alpha[i, m] if whole else alpha[i, m, at]) + logs[m, ids]
                if whole:
                    np.logaddexp(alpha[e, m], term, out=alpha[e, m])
                else:
                    alpha[e, m, at] = np.logaddexp(alpha[e, m, at], term)
        out[:, part] = alpha[-1]
    pieces = p.sum(axis=1, keepdims=True)
    return out + np.log((1 - pieces) / pieces)


def expected_counts(vocabulary: Vocabulary, p: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected numbers of uses of each piece over all segmentations of the words, each word counted by its weight."""
    counts = np.zeros(vocabulary.n)
    logs = np.log(p)
    for length, part in groups(starts, ends):
        if len(part) < FEW:
            for w in part:
                counts += weights[w] * uses(vocabulary, logs, data[starts[w] : ends[w]])
            continue
        met = list(side_by_side(vocabulary, data[starts[part][:, None] + np.arange(length)]))
        alpha, beta = np.full((2, length + 1, len(part)), -np.inf)
        alpha[0], beta[length] = 0, 0
        for i, e, at, ids in met:
            alpha[e, at] = np.logaddexp(alpha[e, at], alpha[i, at] + logs[ids])
        for i, e, at, ids in reversed(met):
            after = logs[ids] + beta[e, at]
            beta[i, at] = np.logaddexp(beta[i, at], after)
            counts += np.bincount(ids, weights[part][at] * np.exp(alpha[i, at] + after - alpha[length, at]), vocabulary.n)
    return counts


def uses(vocabulary: Vocabulary, logs: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Expected numbers of uses of each piece over all segmentations of one word."""
    counts, alpha, length = np.zeros(vocabulary.n), forward(vocabulary, word, logs), len(word)
    beta = np.zeros(length + 1)
    for first in reversed(range(0, length, BLOCK)):
        last = min(first + BLOCK, length)
        begins: list[list[tuple[int, float]]] = [[] for _ in range(last - first)]
        met = list(vocabulary.arcs(word, first, last))
        for n, at, ids in met:
            for s, x in zip(at.tolist(), logs[ids].tolist(), strict=True):
                begins[s - first].append((s + n, x))
        for s in range(last - 1, first - 1, -1):
            sums = [x + beta[e] for e, x in begins[s - first]]
            top = max(sums)
            beta[s] = top + log(sum([exp(t - top) for t in sums]))
        for n, at, ids in met:
            counts += np.bincount(ids, np.exp(alpha[at] + logs[ids] + beta[at + n] - alpha[length]), vocabulary.n)
    return counts


def smoothed(counts: np.ndarray, words: float, prior: np.ndarray, strength: float) -> np.ndarray:
    """Piece probabilities from the expected counts in so many words, with `strength` pseudo-counts dealt by a prior model."""
    return (counts + strength * prior) / (counts.sum() + words + strength)
