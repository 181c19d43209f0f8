"""Linear-chain conditional random fields in numpy, over batches of padded sequences."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (batch, time, label) and expected transition counts (label, label).

    scores: (batch, time, label), padded at the end; lengths: real times of each row, at least 1.
    """
    b, t, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for i in range(1, t):
        alpha[:, i] = scores[:, i] + _logsumexp(alpha[:, i - 1, :, None] + trans, 1)
    for i in range(t - 2, -1, -1):
        inner = _logsumexp(trans + (scores[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where((i + 1 < lengths)[:, None], inner, 0)
    total = _logsumexp(alpha[np.arange(b), lengths - 1], 1)
    marginals = alpha + beta - total[:, None, None]
    marginals[np.arange(t)[None] >= lengths[:, None]] = -np.inf
    marginals = np.exp(marginals)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        rows = i < lengths
        if rows.any():
            pairs += np.exp(alpha[rows, i - 1, :, None] + trans + (scores[rows, i] + beta[rows, i])[:, None, :] - total[rows, None, None]).sum(0)
    return marginals, pairs


def viterbi(scores: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels (batch, time); what lies beyond a row's length has no meaning."""
    b, t, _ = scores.shape
    best, back = scores[:, 0], np.zeros(scores.shape, np.int8)
    last = best.copy()
    for i in range(1, t):
        through = best[:, :, None] + trans
        back[:, i] = through.argmax(1)
        best = scores[:, i] + through.max(1)
        last = np.where((i < lengths)[:, None], best, last)
    labels = np.zeros((b, t), np.int8)
    now = last.argmax(1)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        labels[inside, i] = now[inside]
        now = np.where(inside, back[np.arange(b), i, now], now)
    return labels


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays (time, ...) as one (batch, longest, ...), and their lengths."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), *rows[0].shape[1:]), rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def fit(features: list[np.ndarray], labels: list[np.ndarray], n_labels: int, rounds: int = 150, rate: float = 0.15, decay: float = 1e-4, n_features: int = 0, forbidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions (label, label) by gradient ascent on the penalised log-likelihood (Adam).

    features: for each sequence its values (time, feature), or the numbers (time, k) of the features that each time has, where
    n_features is given; forbidden: transitions that never happen. Sequences are grouped by length so that little is padded. The
    result is the same on every run.
    """
    size_of = n_features or features[0].shape[1]
    score = (lambda x, w: w[x].sum(2)) if n_features else (lambda x, w: x @ w)

    def slope(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        if not n_features:
            return np.tensordot(x, rest, ([0, 1], [0, 1]))
        return np.stack([np.bincount(x.ravel(), np.repeat(rest[:, :, j].ravel(), x.shape[2]), size_of) for j in range(n_labels)], 1)

    order = np.argsort([len(x) for x in features], kind="stable")
    groups = []
    for part in np.array_split(order, max(1, len(order) // 256)):
        x, n = padded([features[i] for i in part])
        y, _ = padded([labels[i] for i in part])
        one = np.eye(n_labels)[y] * (np.arange(x.shape[1])[None] < n[:, None])[:, :, None]
        seen = sum((one[:, i - 1, :, None] * one[:, i, None, :]).sum(0) for i in range(1, x.shape[1])) if x.shape[1] > 1 else 0
        groups.append((x, n, one, seen))
    weights = [np.zeros((size_of, n_labels)), np.zeros((n_labels, n_labels))]
    block = np.where(forbidden, -1e4, 0.0) if forbidden is not None else 0.0
    size = sum(int(n.sum()) for _, n, _, _ in groups)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        grads = [-decay * w * size for w in weights]
        for x, n, one, seen in groups:
            marginals, pairs = forward_backward(score(x, weights[0]), weights[1] + block, n)
            grads[0] += slope(x, one - marginals)
            grads[1] += seen - pairs
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / size
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights[0], weights[1] + block
