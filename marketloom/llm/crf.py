"""A linear-chain conditional random field over sparse indicator features, in numpy.

Fitted on a bounded set of labelled chains by full-batch gradient steps (Adam) on the exact log-likelihood,
decoded by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Crf:
    """ids: feature -> row of weights (features, labels); moves[a, b]: weight of label b after label a; first: of the chain's first label."""

    ids: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    rows: dict = field(default_factory=dict)

    def emission(self, features: tuple[str, ...]) -> np.ndarray:
        """Summed weights of one position's features; features that training hasn't seen count nothing."""
        found = [self.ids[f] for f in features if f in self.ids]
        return self.weights[found].sum(axis=0) if found else np.zeros(self.weights.shape[1])

    def decode(self, emissions: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """The best label of each position (Viterbi); of equally good ones the lowest."""
        n, k = emissions.shape
        best = emissions[0] + (self.first if first is None else first)
        back = np.zeros((n, k), np.int64)
        for t in range(1, n):
            step = best[:, None] + self.moves
            back[t] = step.argmax(axis=0)
            best = step[back[t], np.arange(k)] + emissions[t]
        out = np.zeros(n, np.int64)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def train(chains: list[list[tuple[str, ...]]], labels: list[list[int]], n_labels: int, *, rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3, forbidden: tuple[tuple[int, int], ...] = (), not_first: tuple[int, ...] = ()) -> Crf:
    """Fit on labelled chains. forbidden: pairs (label, next label) that never occur; not_first: labels that no chain begins with."""
    pairs = [(c, y) for c, y in zip(chains, labels) if c]
    ids: dict[str, int] = {}
    for chain, _ in pairs:
        for features in chain:
            for f in features:
                ids.setdefault(f, len(ids))
    n, length = len(pairs), max((len(c) for c, _ in pairs), default=1)
    most = max((len(f) for c, _ in pairs for f in c), default=1)
    index = np.full((n, length, most), len(ids), np.int64)
    gold = np.zeros((n, length), np.int64)
    there = np.zeros((n, length), bool)
    for i, (chain, y) in enumerate(pairs):
        for t, features in enumerate(chain):
            index[i, t, : len(features)] = [ids[f] for f in features]
            gold[i, t], there[i, t] = y[t], True
    ban = np.zeros((n_labels, n_labels))
    for a, b in forbidden:
        ban[a, b] = -1e4
    start = np.zeros(n_labels)
    start[list(not_first)] = -1e4
    params = [np.zeros((len(ids) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    hot = np.eye(n_labels)[gold] * there[:, :, None]
    flat = index.reshape(n * length, most)
    for step in range(1, rounds + 1 if n else 1):
        w, moves, first = params[0], params[1] + ban, params[2] + start
        e = w[flat].sum(axis=1).reshape(n, length, n_labels)
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, length):
            new = _logsum(alpha[:, t - 1, :, None] + moves, 1) + e[:, t]
            alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros_like(e)
        pair_sum = np.zeros((n_labels, n_labels))
        for t in range(length - 2, -1, -1):
            into = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(there[:, t + 1, None], _logsum(moves + into[:, None, :], 2), 0.0)
            both = np.exp(np.minimum(alpha[:, t, :, None] + moves + into[:, None, :] - total[:, None, None], 0))
            pair_sum += both[there[:, t + 1]].sum(axis=0)
        mass = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * there[:, :, None]
        diff = (mass - hot).reshape(n * length, n_labels)
        grad_w = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, k], most), len(ids) + 1) for k in range(n_labels)], axis=1)
        seen = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
        grads = [grad_w / n + ridge * w, (pair_sum - seen) / n + ridge * params[1], (mass[:, 0] - hot[:, 0]).sum(axis=0) / n + ridge * params[2]]
        grads[0][-1] = 0
        for p, g, (m, v) in zip(params, grads, moment):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(ids, params[0][:-1], params[1] + ban, params[2] + start)
