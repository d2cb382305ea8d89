"""A linear-chain conditional random field in numpy: training and batched Viterbi decoding."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class ChainCRF:
    """Weights of features by label, and of steps from label to label."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.index: dict[str, int] = {}
        self.state = np.zeros((1, len(labels)))
        self.step = np.zeros((len(labels), len(labels)))

    def _ids(self, rows: list[list[list[str]]]) -> list[list[list[int]]]:
        return [[[self.index[f] for f in token if f in self.index] for token in row] for row in rows]

    def _scores(self, ids: list[list[list[int]]], width: int) -> np.ndarray:
        """Label scores of every token, as rows x width x labels; one gather and one sum by token."""
        out = np.zeros((len(ids) * width, len(self.labels)))
        at = [(r * width + t, f) for r, row in enumerate(ids) for t, token in enumerate(row) for f in token]
        if at:
            where, which = np.array(at).T
            for k in range(len(self.labels)):
                out[:, k] = np.bincount(where, self.state[which, k], len(out))
        return out.reshape(len(ids), width, -1)

    def fit(self, rows: list[list[list[str]]], gold: list[list[str]], rounds: int = 150, l2: float = 0.02):
        """Maximum likelihood with an L2 penalty, by Adam on all rows at once."""
        for row in rows:
            for token in row:
                for f in token:
                    self.index.setdefault(f, len(self.index))
        n, width, k = len(rows), max(map(len, rows)), len(self.labels)
        ids = self._ids(rows)
        y = np.zeros((n, width), int)
        mask = np.zeros((n, width), bool)
        for r, row in enumerate(gold):
            y[r, : len(row)] = [self.labels.index(x) for x in row]
            mask[r, : len(row)] = True
        where, which = np.array(
            [(r * width + t, f) for r, row in enumerate(ids) for t, token in enumerate(row) for f in token]
        ).T
        truth = np.eye(k)[y] * mask[..., None]
        pairs = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        self.state = np.zeros((len(self.index), k))
        moments = [np.zeros_like(self.state), np.zeros_like(self.step)]
        seconds = [np.zeros_like(self.state), np.zeros_like(self.step)]
        for turn in range(1, rounds + 1):
            score = self._scores(ids, width)
            marginal, expected = self._expected(score, mask)
            delta = ((marginal - truth) * mask[..., None]).reshape(-1, k)
            grad_state = np.zeros_like(self.state)
            np.add.at(grad_state, which, delta[where])
            grads = [grad_state / n + l2 * self.state / n, (expected - pairs) / n + l2 * self.step / n]
            for i, (value, grad) in enumerate(zip((self.state, self.step), grads)):
                moments[i] = 0.9 * moments[i] + 0.1 * grad
                seconds[i] = 0.99 * seconds[i] + 0.01 * grad**2
                rate = 0.1 * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)
                value -= rate * moments[i] / (np.sqrt(seconds[i]) + 1e-8)
        return self

    def _expected(self, score: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals and summed step marginals by the forward-backward recursions."""
        n, width, k = score.shape
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, width):
            new = _lse(forward[:, t - 1, :, None] + self.step, 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = _lse(forward[:, -1], 1)
        for t in range(width - 2, -1, -1):
            new = _lse(self.step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        expected = np.zeros((k, k))
        for t in range(1, width):
            pair = forward[:, t - 1, :, None] + self.step + (score[:, t] + backward[:, t])[:, None, :]
            expected += (np.exp(pair - total[:, None, None]) * mask[:, t, None, None]).sum(0)
        return marginal, expected

    def decode(self, rows: list[list[list[str]]]) -> list[list[str]]:
        """Best labels of each row, all rows of a batch side by side."""
        if not rows:
            return []
        width = max(map(len, rows))
        score = self._scores(self._ids(rows), width)
        length = np.array([len(r) for r in rows])
        best, back = score[:, 0], np.zeros(score.shape, np.int8)
        for t in range(1, width):
            through = best[:, :, None] + self.step
            back[:, t] = through.argmax(1)
            best = np.where((t < length)[:, None], through.max(1) + score[:, t], best)
        at = best.argmax(1)
        out = np.zeros((len(rows), width), int)
        for t in range(width - 1, -1, -1):
            out[:, t] = at
            if t:
                at = np.where(t < length, back[np.arange(len(rows)), t, at], at)
        return [[self.labels[k] for k in row[:n]] for row, n in zip(out.tolist(), length.tolist())]
