"""A linear-chain conditional random field over sparse features, small enough to train on the driver."""

from __future__ import annotations

import math
import random

O, B, I = 0, 1, 2
LABELS = 3
#: a span's inside follows its begin or inside
_FORBIDDEN = {(O, I)}


class Crf:
    """Weights by feature and label, and by pair of labels; plain dicts, so that it pickles small."""

    def __init__(self, weights=None, moves=None):
        self.weights: dict[str, list[float]] = weights or {}
        self.moves: list[list[float]] = moves or [[0.0] * LABELS for _ in range(LABELS)]

    def _scores(self, features):
        w = self.weights
        out = [0.0] * LABELS
        for f in features:
            x = w.get(f)
            if x:
                out[0] += x[0]
                out[1] += x[1]
                out[2] += x[2]
        return out

    def viterbi(self, sequence: list[list[str]]) -> list[int]:
        """The best labels of a sequence of feature lists."""
        if not sequence:
            return []
        best = self._scores(sequence[0])
        best[I] = -1e9
        back = []
        for features in sequence[1:]:
            s = self._scores(features)
            row, new = [], []
            for y in range(LABELS):
                top, arg = -1e18, 0
                for x in range(LABELS):
                    if (x, y) not in _FORBIDDEN:
                        v = best[x] + self.moves[x][y]
                        if v > top:
                            top, arg = v, x
                row.append(arg)
                new.append(top + s[y])
            back.append(row)
            best = new
        y = max(range(LABELS), key=best.__getitem__)
        out = [y]
        for row in reversed(back):
            y = row[y]
            out.append(y)
        return out[::-1]

    def train(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.25, decay: float = 1e-4, seed: int = 7) -> "Crf":
        """Gradient of the log-likelihood, one sequence at a time, with AdaGrad steps and L2 decay."""
        rng = random.Random(seed)
        order = list(range(len(data)))
        w, g2 = self.weights, {}
        m2 = [[1e-3] * LABELS for _ in range(LABELS)]
        exp, log = math.exp, math.log
        allowed = [[x for x in range(LABELS) if (x, y) not in _FORBIDDEN] for y in range(LABELS)]
        for _ in range(epochs):
            rng.shuffle(order)
            for at in order:
                sequence, gold = data[at]
                n = len(sequence)
                s = [self._scores(f) for f in sequence]
                s[0][I] = -1e9
                forward = [s[0]]
                for k in range(1, n):
                    row = []
                    for y in range(LABELS):
                        v = [forward[-1][x] + self.moves[x][y] for x in allowed[y]]
                        top = max(v)
                        row.append(s[k][y] + top + log(sum(exp(a - top) for a in v)))
                    forward.append(row)
                top = max(forward[-1])
                z = top + log(sum(exp(a - top) for a in forward[-1]))
                backward = [[0.0] * LABELS for _ in range(n)]
                for k in range(n - 2, -1, -1):
                    for x in range(LABELS):
                        v = [self.moves[x][y] + s[k + 1][y] + backward[k + 1][y] for y in range(LABELS) if (x, y) not in _FORBIDDEN]
                        top = max(v)
                        backward[k][x] = top + log(sum(exp(a - top) for a in v))
                for k in range(n):
                    p = [exp(min(0.0, forward[k][y] + backward[k][y] - z)) for y in range(LABELS)]
                    grad = [(gold[k] == y) - p[y] for y in range(LABELS)]
                    if max(map(abs, grad)) < 1e-3:
                        continue
                    for f in sequence[k]:
                        x = w.get(f)
                        if x is None:
                            x = w[f] = [0.0] * LABELS
                            g2[f] = [1e-3] * LABELS
                        q = g2[f]
                        for y in range(LABELS):
                            d = grad[y] - decay * x[y]
                            q[y] += d * d
                            x[y] += rate * d / math.sqrt(q[y])
                for k in range(1, n):
                    for y in range(LABELS):
                        for x in allowed[y]:
                            p = exp(min(0.0, forward[k - 1][x] + self.moves[x][y] + s[k][y] + backward[k][y] - z))
                            d = (gold[k - 1] == x and gold[k] == y) - p
                            if abs(d) > 1e-3:
                                m2[x][y] += d * d
                                self.moves[x][y] += rate * d / math.sqrt(m2[x][y])
        return self
