"""A linear-chain conditional random field over many concatenated sequences, without a Python step per token.

The chains of a batch are laid end to end; the step into a first token forgets the state before it, so
one pass serves all. The long chain is cut into blocks: the product of each block's step matrices is
made for all blocks at once, the block ends are linked one by one, and the inside of all blocks is
filled in at once. With blocks of about the square root of the length, few Python steps remain.
"""

from __future__ import annotations

from itertools import chain

import numpy as np


TOKENS_AT_ONCE = 100_000  # of a training set, in whole sequences


class Ragged:
    """The features of tokens, as many of each as it has."""

    def __init__(self, lists: list[list[int]]):
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.fromiter(chain.from_iterable(lists), np.int32, int(self.counts.sum()))

    def __len__(self) -> int:
        return len(self.counts)

    @property
    def tokens(self) -> np.ndarray:
        """The token of each feature in ``flat``."""
        return np.repeat(np.arange(len(self)), self.counts)


class Crf:
    """``weights[feature, label]``, ``trans[from, to]`` and ``start[label]``; labels are 0 to k-1."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start

    @property
    def k(self) -> int:
        return len(self.start)

    def scores(self, features: np.ndarray | Ragged) -> np.ndarray:
        """The labels' scores of each token: the sum of its features' weights (``features[token, slot]``, or ragged)."""
        if isinstance(features, Ragged):
            tokens = features.tokens
            return np.stack([np.bincount(tokens, self.weights[features.flat, j], len(features)) for j in range(self.k)], axis=1)
        out = self.weights[features[:, 0]].astype(np.float64)
        for j in range(1, features.shape[1]):
            out += self.weights[features[:, j]]
        return out

    def _steps(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log of the matrix [from, to] of the step into each token."""
        steps = np.broadcast_to(self.trans, (len(unary), self.k, self.k)).copy()
        steps[first] = self.start
        return steps + unary[:, None, :]

    @staticmethod
    def _blocks(n: int) -> tuple[int, int]:
        size = max(1, int(np.sqrt(n / 4)))
        return size, -(-n // size)

    def marginals(self, unary: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(label) of each token [n, k]; with ``pairs`` also the summed [from, to] of all inner steps."""
        n, k = unary.shape
        if not n:
            return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
        steps = self._steps(unary, first)
        steps = np.exp(steps - steps.max(axis=(1, 2), keepdims=True))
        size, blocks = self._blocks(n)
        padded = np.tile(np.eye(k), (size * blocks, 1, 1))
        padded[:n] = steps
        m = padded.reshape(blocks, size, k, k).transpose(1, 2, 3, 0).copy()  # [place, from, to, block]
        product = np.repeat(np.eye(k)[:, :, None], blocks, axis=2)
        for t in range(size):
            product = sum(product[:, j, None, :] * m[t][None, j, :, :] for j in range(k))
            product /= product.sum(axis=(0, 1))
        into, out = np.empty((k, blocks)), np.empty((k, blocks))
        a = np.full(k, 1 / k)
        for b in range(blocks):
            into[:, b] = a
            a = a @ product[:, :, b]
            a = a / a.sum()
        z = np.full(k, 1 / k)
        for b in range(blocks - 1, -1, -1):
            out[:, b] = z
            z = product[:, :, b] @ z
            z = z / z.sum()
        alpha, beta = np.empty((size, k, blocks)), np.empty((size, k, blocks))
        a = into
        for t in range(size):
            a = sum(a[j] * m[t, j] for j in range(k))
            a = a / a.sum(axis=0)
            alpha[t] = a
        z = out
        for t in range(size - 1, -1, -1):
            beta[t] = z
            z = sum(m[t, :, j] * z[j] for j in range(k))
            z = z / z.sum(axis=0)
        alpha = alpha.transpose(2, 0, 1).reshape(-1, k)[:n]
        beta = beta.transpose(2, 0, 1).reshape(-1, k)[:n]
        p = alpha * beta
        p /= p.sum(axis=1, keepdims=True)
        if not pairs:
            return p
        joint = alpha[:-1, :, None] * steps[1:] * beta[1:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return p, joint[~first[1:]].sum(axis=0)

    def viterbi(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all tokens; of equal paths the one of lower labels, from the end."""
        n, k = unary.shape
        if not n:
            return np.zeros(0, np.int64)
        steps = self._steps(unary, first)
        size, blocks = self._blocks(n)
        padded = np.tile(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (size * blocks, 1, 1))
        padded[:n] = steps
        m = padded.reshape(blocks, size, k, k).transpose(1, 2, 3, 0).copy()
        product = np.repeat(np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[:, :, None], blocks, axis=2)
        for t in range(size):
            product = (product[:, :, None, :] + m[t][None, :, :, :]).max(axis=1)
        into, a = np.empty((k, blocks)), np.zeros(k)
        for b in range(blocks):
            into[:, b] = a
            a = (a[:, None] + product[:, :, b]).max(axis=0)
        back, a = np.empty((size, k, blocks), np.int8), into
        for t in range(size):
            options = a[:, None, :] + m[t]
            back[t] = options.argmax(axis=0)
            a = options.max(axis=0)
        # From each label at a block's end to the label before its start; then along the blocks, then inside all.
        way = np.repeat(np.arange(k)[:, None], blocks, axis=1)
        columns = np.arange(blocks)
        for t in range(size - 1, -1, -1):
            way = back[t][way, columns].astype(np.int64)
        last = np.empty(blocks, np.int64)
        at = int(a[:, -1].argmax())
        for b in range(blocks - 1, -1, -1):
            last[b] = at
            at = int(way[at, b])
        labels = np.empty((size, blocks), np.int64)
        for t in range(size - 1, -1, -1):
            labels[t] = last
            last = back[t][last, columns].astype(np.int64)
        return labels.T.reshape(-1)[:n]


def train(features: np.ndarray | Ragged, labels: np.ndarray, first: np.ndarray, size: int, k: int = 2, rounds: int = 20, rate: float = 0.7, decay: float = 1e-4) -> Crf:
    """Fit by AdaGrad on the whole likelihood; ``size`` is the number of features."""
    crf = Crf(np.zeros((size, k)), np.zeros((k, k)), np.zeros(k))
    n = len(features)
    inner = np.flatnonzero(~first[1:])
    seen_pairs = np.bincount(labels[inner] * k + labels[inner + 1], minlength=k * k).reshape(k, k)
    sums = [np.full(x.shape, 1e-8) for x in (crf.weights, crf.trans, crf.start)]
    if isinstance(features, Ragged):
        parts = [(0, n)]
        places = lambda lo, hi: (features.flat, lambda g: g[features.tokens])
        some = lambda lo, hi: features
    else:
        # Whole sequences each, so that little is held at once.
        begins = np.append(np.flatnonzero(first), n)
        cuts = np.unique(np.append(begins[np.searchsorted(begins, np.arange(0, n, TOKENS_AT_ONCE))], n)).tolist()
        parts = list(zip([0, *cuts[1:-1]], cuts[1:], strict=True)) if len(cuts) > 1 else []
        places = lambda lo, hi: (features[lo:hi].T.ravel(), lambda g: np.tile(g, features.shape[1]))
        some = lambda lo, hi: features[lo:hi]
    eye = np.eye(k)
    for _ in range(rounds):
        grad, pairs, starts = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
        for lo, hi in parts:
            p, here = crf.marginals(crf.scores(some(lo, hi)), first[lo:hi], pairs=True)
            gap = eye[labels[lo:hi]] - p
            flat, spread = places(lo, hi)
            for j in range(k):
                grad[:, j] += np.bincount(flat, spread(gap[:, j]), size)
            pairs += here
            starts += gap[first[lo:hi]].sum(axis=0)
        for x, g, s in ((crf.weights, grad, sums[0]), (crf.trans, seen_pairs - pairs, sums[1]), (crf.start, starts, sums[2])):
            g = g - decay * n / max(size, 1) * x
            s += g * g
            x += rate * g / np.sqrt(s)
    return crf
