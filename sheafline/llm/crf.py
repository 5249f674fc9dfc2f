"""Linear-chain conditional random field over hashed binary features (NumPy), many chains at a time.

Chains are given flat: feature numbers in CSR form a position, and the offsets of the chains. All recursions run position
by position over every chain that is long enough, longest first, so cost follows the longest chain only by a short loop.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Order in which positions of many chains are visited."""

    def __init__(self, offsets: np.ndarray) -> None:
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        self.first, self.size = offsets[:-1][order], size[order]
        self.steps = int(self.size[0]) if len(order) else 0
        self.active = np.searchsorted(-self.size, -np.arange(self.steps), "left") if self.steps else np.zeros(0, int)

    def at(self, t: int) -> np.ndarray:
        """Positions number t of the chains that are longer than t."""
        return self.first[: self.active[t]] + t


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    def __init__(self, labels: int, n_features: int) -> None:
        self.emit = np.zeros((n_features, labels))
        self.move = np.zeros((labels, labels))
        self.start = np.zeros(labels)
        self.stop = np.zeros(labels)

    def scores(self, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Emission scores of positions; features of position i are features[begin[i]:begin[i + 1]], at least one."""
        return np.add.reduceat(self.emit[features], begin[:-1], axis=0) if len(begin) > 1 else np.zeros((0, len(self.start)))

    def forward_backward(self, emission: np.ndarray, chains: Chains, expect: bool = False) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, sum of log partitions, expected moves, starts, stops)."""
        n, labels = emission.shape
        alpha, beta = np.empty((n, labels)), np.empty((n, labels))
        moves, starts, stops = np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels)
        if not chains.steps:
            return np.zeros((n, labels)), 0.0, moves, starts, stops
        alpha[chains.at(0)] = self.start + emission[chains.at(0)]
        for t in range(1, chains.steps):
            here = chains.at(t)
            alpha[here] = emission[here] + _lse(alpha[here - 1][:, :, None] + self.move[None], 1)
        last = chains.first + chains.size - 1
        partition = _lse(alpha[last] + self.stop, 1)
        beta[last] = self.stop
        for t in range(chains.steps - 1, 0, -1):
            here = chains.at(t)
            after = beta[here] + emission[here]
            beta[here - 1] = _lse(self.move[None] + after[:, None, :], 2)
            if expect:
                z = partition[: len(here)]
                moves += np.exp(alpha[here - 1][:, :, None] + self.move[None] + after[:, None, :] - z[:, None, None]).sum(0)
        of = np.empty(n)
        for t in range(chains.steps):
            of[chains.at(t)] = partition[: chains.active[t]]
        marginal = np.exp(alpha + beta - of[:, None])
        if expect:
            starts, stops = marginal[chains.first].sum(0), marginal[last].sum(0)
        return marginal, float(partition.sum()), moves, starts, stops

    def marginals(self, emission: np.ndarray, offsets: np.ndarray, piece: int = 128) -> np.ndarray:
        """Exact marginals of chains of any length, in a number of vector steps that grows with the length only by 1 / piece.

        Chains are cut in pieces. The product of a piece's transitions, from the label before it to its last, is one small
        matrix; messages run over these matrices, piece by piece, and then all pieces run at once between their messages.
        """
        n, labels = emission.shape
        size = np.diff(offsets)
        many = -(-size // piece)
        chain = np.repeat(np.arange(len(size)), many)
        number = np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many)
        begin = offsets[:-1][chain] + piece * number
        pieces = Chains(np.append(begin, n))
        if not pieces.steps:
            return np.zeros((n, labels))
        order = np.searchsorted(begin, pieces.first)  # pieces in the order of their visits
        later = number[order] > 0  # only these have a label before them
        step = np.empty((len(begin), labels, labels))
        for t in range(pieces.steps if later.any() else 0):
            on = later[: pieces.active[t]]
            at, k = pieces.at(t)[on], order[: pieces.active[t]][on]
            step[k] = (self.move[None] if t == 0 else _lse(step[k][:, :, :, None] + self.move[None, None], 2)) + emission[at][:, None, :]
        head = np.flatnonzero(number == 0)
        length = many[chain[head]]
        into, onto = np.empty((len(begin), labels)), np.empty((len(begin), labels))  # before the first and after the last label
        into[head] = -np.inf
        last = head + length - 1
        onto[last] = self.stop
        # The first piece has no label before it: its message is made from its own forward pass below.
        alpha = np.empty((n, labels))
        first_end = self._forward(alpha, emission, begin[head], np.minimum(begin[head] + piece, offsets[1:][chain[head]]), None)
        carry = first_end
        for j in range(1, int(length.max())):
            on = np.flatnonzero(length > j)
            into[head[on] + j] = carry[on]
            carry[on] = _lse(carry[on][:, :, None] + step[head[on] + j], 1)
        for j in range(int(length.max()) - 1, 0, -1):
            on = np.flatnonzero(length > j)
            k = head[on] + j
            onto[k - 1] = _lse(step[k] + onto[k][:, None, :], 2)
        rest = np.flatnonzero(number > 0)
        end = np.minimum(begin + piece, offsets[1:][chain])
        self._forward(alpha, emission, begin[rest], end[rest], into[rest])
        beta = np.empty((n, labels))
        beta[end - 1] = onto
        for t in range(pieces.steps - 1, 0, -1):
            at = pieces.at(t)
            beta[at - 1] = _lse(self.move[None] + (beta[at] + emission[at])[:, None, :], 2)
        both = alpha + beta
        return np.exp(both - _lse(both, 1)[:, None])

    def _forward(self, alpha: np.ndarray, emission: np.ndarray, begin: np.ndarray, end: np.ndarray, into: np.ndarray | None) -> np.ndarray:
        """Fill ``alpha`` from begin to end, after the message ``into`` or at a chain's start; returns it at the last places."""
        if not len(begin):
            return np.empty((0, alpha.shape[1]))
        order = np.argsort(begin - end, kind="stable")
        first, size = begin[order], (end - begin)[order]
        alpha[first] = emission[first] + (self.start if into is None else _lse(into[order][:, :, None] + self.move[None], 1))
        for t in range(1, int(size[0])):
            at = first[: int(np.searchsorted(-size, -t, "left"))] + t
            alpha[at] = emission[at] + _lse(alpha[at - 1][:, :, None] + self.move[None], 1)
        return alpha[end - 1]

    def viterbi(self, emission: np.ndarray, chains: Chains) -> np.ndarray:
        """The best label of every position."""
        n, labels = emission.shape
        best, back, out = np.empty((n, labels)), np.zeros((n, labels), np.int64), np.zeros(n, np.int64)
        if not chains.steps:
            return out
        best[chains.at(0)] = self.start + emission[chains.at(0)]
        for t in range(1, chains.steps):
            here = chains.at(t)
            s = best[here - 1][:, :, None] + self.move[None]
            back[here] = s.argmax(1)
            best[here] = s.max(1) + emission[here]
        last = chains.first + chains.size - 1
        out[last] = (best[last] + self.stop).argmax(1)
        for t in range(chains.steps - 1, 0, -1):
            here = chains.at(t)
            out[here - 1] = back[here, out[here]]
        return out

    def fit(self, features: np.ndarray, begin: np.ndarray, offsets: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.3, l2: float = 1e-2) -> ChainCRF:
        """Maximise the likelihood of the labels by Adagrad over all chains; deterministic."""
        chains = Chains(offsets)
        labels = len(self.start)
        where = np.repeat(np.arange(len(label)), np.diff(begin))
        n_features = len(self.emit)
        gold = np.stack([np.bincount(features[label[where] == y], minlength=n_features) for y in range(labels)], 1)
        inside = np.ones(len(label), bool)
        inside[offsets[:-1][np.diff(offsets) > 0]] = False
        at = np.flatnonzero(inside)
        gold_move = np.bincount(label[at - 1] * labels + label[at], minlength=labels * labels).reshape(labels, labels)
        gold_start = np.bincount(label[chains.first], minlength=labels)
        gold_stop = np.bincount(label[chains.first + chains.size - 1], minlength=labels)
        scale = max(1, len(chains.first))
        seen: dict[str, np.ndarray] = {}
        for _ in range(rounds):
            m, _, moves, starts, stops = self.forward_backward(self.scores(features, begin), chains, True)
            expected = np.stack([np.bincount(features, m[where, y], minlength=n_features) for y in range(labels)], 1)
            for name, g in (("emit", gold - expected), ("move", gold_move - moves), ("start", gold_start - starts), ("stop", gold_stop - stops)):
                w = getattr(self, name)
                g = g / scale - l2 / scale * w
                seen[name] = seen.get(name, 0) + g * g
                w += rate * g / (np.sqrt(seen[name]) + 1e-8)
        return self
