"""A linear-chain conditional random field over binary features, in numpy.

Sequences are padded to one length and handled together, so training and tagging are array work. The objective is the
conditional log-likelihood with an L2 penalty, followed by Adam; with fixed input the result is fixed.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Sequences that are padded to one array.
AT_ONCE = 2000


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainCrf:
    """Weights: emission (features × tags), transition (tags × tags), start and end (tags)."""

    def __init__(self, features: int, tags: int):
        self.emit, self.move = np.zeros((features, tags)), np.zeros((tags, tags))
        self.begin, self.end = np.zeros(tags), np.zeros(tags)

    def _padded(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, t = len(sequences), max(map(len, sequences))
        x, mask = np.zeros((n, t, self.emit.shape[0])), np.zeros((n, t), dtype=bool)
        for i, s in enumerate(sequences):
            x[i, : len(s)], mask[i, : len(s)] = s, True
        return x, mask

    def fit(self, sequences: list[np.ndarray], tags: list[list[int]], rounds: int = 120, rate: float = 0.1, penalty: float = 1e-4, weights=None, before=None, after=None) -> ChainCrf:
        """sequences: one (length × features) 0/1 array each; tags: the tag of each element; weights: how often each
        occurs; before, after: the tags beside a sequence that is a piece of a longer one, -1 where it begins or ends."""
        n, k = len(sequences), len(self.begin)
        weights = np.ones(n) if weights is None else np.asarray(weights, dtype=float)
        before, after = (np.full(n, -1) if v is None else np.asarray(v) for v in (before, after))
        groups, want = [], {p: np.zeros_like(getattr(self, p)) for p in ("emit", "move", "begin", "end")}
        # Sequences of like length are padded together, so short ones do not pay for long ones.
        size = [next(i for i in itertools.count() if len(s) <= 2 << i) for s in sequences]
        for g in sorted(set(size)):
            alike = [i for i in range(n) if size[i] == g]
            for mine in (alike[i : i + AT_ONCE] for i in range(0, len(alike), AT_ONCE)):
                x, mask = self._padded([sequences[i] for i in mine])
                gold = np.zeros((*mask.shape, k))
                for row, i in enumerate(mine):
                    gold[row, range(len(tags[i])), tags[i]] = weights[i]
                last, rows = mask.sum(axis=1) - 1, np.arange(len(mine))
                groups.append((x, mask, last, rows, weights[mine], before[mine], after[mine]))
                want["emit"] += np.tensordot(x, gold, ([0, 1], [0, 1]))
                want["move"] += np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:] > 0)
                self._ends(want, gold[:, 0], gold[rows, last], before[mine], after[mine])
        first, second = {p: 0.0 for p in want}, {p: 0.0 for p in want}
        for r in range(1, rounds + 1):
            have = {p: np.zeros_like(v) for p, v in want.items()}
            for x, mask, last, rows, w, b, a in groups:
                alpha, beta, z, e = self._passes(x, mask, last, b, a)
                node = np.exp(alpha + beta - z[:, None, None]) * (mask * w[:, None])[:, :, None]
                pair = np.exp(alpha[:, :-1, :, None] + self.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * (mask[:, 1:] * w[:, None])[:, :, None, None]
                have["emit"] += np.tensordot(x, node, ([0, 1], [0, 1]))
                have["move"] += pair.sum(axis=(0, 1))
                self._ends(have, node[:, 0], node[rows, last], b, a)
            for p in want:
                g = (want[p] - have[p]) / weights.sum() - penalty * getattr(self, p)
                first[p], second[p] = 0.9 * first[p] + 0.1 * g, 0.999 * second[p] + 0.001 * g * g
                setattr(self, p, getattr(self, p) + rate * (first[p] / (1 - 0.9**r)) / (np.sqrt(second[p] / (1 - 0.999**r)) + 1e-8))
        return self

    @staticmethod
    def _ends(counts: dict, at_first: np.ndarray, at_last: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Add the tags at both ends of sequences: to begin and end, or to the moves from and to the tags beside."""
        for tag in np.unique(before):
            (counts["begin"] if tag < 0 else counts["move"][tag])[:] += at_first[before == tag].sum(axis=0)
        for tag in np.unique(after):
            (counts["end"] if tag < 0 else counts["move"][:, tag])[:] += at_last[after == tag].sum(axis=0)

    def _passes(self, x, mask, last, before=-1, after=-1):
        e = x @ self.emit
        begin, end = np.vstack([self.move, self.begin])[before], np.vstack([self.move.T, self.end])[after]
        n, t, _ = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = begin + e[:, 0]
        for i in range(1, t):
            step = _logsumexp(alpha[:, i - 1, :, None] + self.move, 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        rows = np.arange(n)
        z = _logsumexp(alpha[rows, last] + end, 1)
        beta[rows, last] = end
        for i in range(t - 2, -1, -1):
            step = _logsumexp(self.move[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where((i < last)[:, None], step, beta[:, i])
        return alpha, beta, z, e

    def tag(self, sequence: np.ndarray) -> list[int]:
        """The most likely tags of one (length × features) array."""
        e = sequence @ self.emit
        score, back = self.begin + e[0], []
        for row in e[1:]:
            way = score[:, None] + self.move
            back.append(way.argmax(axis=0))
            score = way.max(axis=0) + row
        out = [int((score + self.end).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
