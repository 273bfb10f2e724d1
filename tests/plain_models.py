"""Plain numpy models of one training set, for tests to compare with."""

import itertools

import numpy as np

from tidewell.operators import boosting


def softmax(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class PlainLogistic:
    """Balanced L2 logistic regression on standardised columns by Newton's method; two classes have one set of coefficients."""

    def __init__(self, c=1.0):
        self.c = c

    def fit(self, x, y):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale == 0] = 1.0
        self.classes, codes, counts = np.unique(y, return_inverse=True, return_counts=True)
        k, d = len(self.classes), x.shape[1] + 1
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        weight = (len(y) / (k * counts))[codes]
        free = range(1, k) if k == 2 else range(k)
        self.b = np.zeros((k, d))
        ridge = np.r_[np.full(d - 1, 1.0 / self.c), 0.0]
        for _ in range(60):
            p = softmax(z @ self.b.T)
            g = np.concatenate([((p[:, a] - (codes == a)) * weight) @ z + ridge * self.b[a] for a in free])
            h = np.block([[(z * (weight * p[:, a] * ((a == e) - p[:, e]))[:, None]).T @ z + (a == e) * np.diag(ridge) for e in free] for a in free])
            step = np.linalg.lstsq(h, g, rcond=1e-12)[0].reshape(len(free), d)
            self.b[list(free)] -= step
            if np.abs(step).max() < 1e-12:
                break
        return self

    @property
    def weights(self):
        """Coefficients and intercepts on the columns as they are."""
        w = self.b[:, :-1] / self.scale
        return w, self.b[:, -1] - w @ self.mean

    def predict(self, x):
        w, b = self.weights
        return self.classes[(x @ w.T + b).argmax(axis=1)]


class PlainBoosted:
    """Boosted trees with the same draws of rows and columns, one node after another."""

    def __init__(self, cuts, rounds, depth, rate=0.05, share=0.8, ridge=1.0, seed=42):
        self.cuts, self.rounds, self.depth, self.rate, self.share, self.ridge, self.seed = cuts, rounds, depth, rate, share, ridge, seed

    def fit(self, pid, x, y):
        self.classes, codes = np.unique(y, return_inverse=True)
        score, self.trees = np.zeros((len(x), len(self.classes))), []
        for r in range(self.rounds):
            own = boosting.drawn(pid, r, self.share, self.seed)
            columns = boosting.drawn_columns(x.shape[1], r, self.share, self.seed)
            p = softmax(score)
            grown = []
            for k in range(len(self.classes)):
                g, h = p[:, k] - (codes == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-9)
                grown.append(self._grow(x, g, h, own, columns, 0))
            self.trees.append(grown)
            for k, tree in enumerate(grown):
                score[:, k] += [self._value(tree, v) for v in x]
        return self

    def _grow(self, x, g, h, rows, columns, depth):
        gr, hr = g[rows].sum(), h[rows].sum()
        if depth == self.depth:
            return -self.rate * gr / (hr + self.ridge) if rows.any() else 0.0
        found = []
        for c in columns:
            for cut in self.cuts[c]:
                left = rows & (x[:, c] <= cut)
                right = rows & ~left
                if left.any() and right.any():
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + self.ridge) + (gr - gl) ** 2 / (hr - hl + self.ridge) - gr**2 / (hr + self.ridge)
                    found.append((gain, c, cut))
        top = max((f[0] for f in found), default=0.0)
        if top <= 1e-12:
            return -self.rate * gr / (hr + self.ridge) if rows.any() else 0.0
        c, cut = next((c, cut) for gain, c, cut in found if gain >= top - boosting.TIE * max(1.0, top))
        return (c, cut, self._grow(x, g, h, rows & (x[:, c] <= cut), columns, depth + 1), self._grow(x, g, h, rows & (x[:, c] > cut), columns, depth + 1))

    def _value(self, tree, v):
        while isinstance(tree, tuple):
            tree = tree[3] if v[tree[0]] > tree[1] else tree[2]
        return tree

    def scores(self, x):
        return np.array([[sum(self._value(grown[k], v) for grown in self.trees) for k in range(len(self.classes))] for v in x])


def plain_shap(columns, cuts, values, cover, row):
    """Shapley values of one tree over all subsets of its columns."""
    leaves = len(values)

    def mean(node, known):
        if node >= leaves - 1:
            return values[node - leaves + 1]
        if not np.isfinite(cuts[node]):
            return mean(2 * node + 1, known)
        sides = (2 * node + 1, 2 * node + 2)
        if columns[node] in known:
            return mean(sides[int(row[columns[node]] > cuts[node])], known)
        share = [reach(s) for s in sides]
        return sum(s * mean(n, known) for s, n in zip(share, sides, strict=True)) / sum(share)

    def reach(node):
        return cover[node - leaves + 1] if node >= leaves - 1 else reach(2 * node + 1) + reach(2 * node + 2)

    own = sorted({int(c) for c, cut in zip(columns, cuts, strict=True) if np.isfinite(cut)})
    made = np.zeros(len(row))
    for c in own:
        rest = [o for o in own if o != c]
        for size in range(len(rest) + 1):
            for some in itertools.combinations(rest, size):
                weight = np.prod([*range(1, size + 1)], dtype=float) * np.prod([*range(1, len(rest) - size + 1)], dtype=float) / np.prod([*range(1, len(own) + 1)], dtype=float)
                made[c] += weight * (mean(0, {*some, c}) - mean(0, {*some}))
    return made
