"""Fitted models as plain arrays that score a batch of rows for all points of a grid at once."""

import numpy as np

ROWS = 2048   # rows that are scored together


class Trees:
    """Nodes of several trees: ``feature`` (-1: a leaf), ``limit`` (to the left up to it), ``left``, ``right``, and ``roots``.

    ``values``: a row for each node, a column for each distinct shape (depth, split size) of the grid: what the tree gives a
    row that ends in the node, if the tree were cut to this shape. They are made where rows are scored: neither the driver nor what
    travels to the tasks has the columns of all shapes."""

    def __init__(self, nodes, roots, shapes):
        self.feature, self.limit, self.left, self.right, self.value, self.rows = nodes
        self.roots, self.shapes, self._values = np.asarray(roots), list(shapes), None

    @classmethod
    def cut(cls, nodes, roots, shapes):
        """``nodes``: feature, limit, left, right, value, rows, parents before children; ``shapes``: (most depth, least rows of a
        node that is split), None for no limit."""
        return cls([np.asarray(c) for c in nodes], roots, shapes)

    def __getstate__(self):
        return {**self.__dict__, "_values": None}

    @property
    def values(self):
        if self._values is None:
            values = np.repeat(self.value[:, None], len(self.shapes), axis=1)
            depth = np.array([np.inf if s[0] is None else s[0] for s in self.shapes])
            least = np.array([0 if s[1] is None else s[1] for s in self.shapes])
            level, closed = self.roots, np.zeros((len(self.feature), len(self.shapes)), bool)
            at = 0
            while len(level):
                level = level[self.feature[level] >= 0]
                ends = closed[level] | (at >= depth) | (self.rows[level][:, None] < least)
                for child in (self.left[level], self.right[level]):
                    closed[child] = ends
                    values[child] = np.where(ends, values[level], values[child])
                level, at = np.concatenate([self.left[level], self.right[level]]), at + 1
            self._values = values
        return self._values

    def ends(self, x):
        """The leaf of each row in each tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row, tree = np.nonzero(self.feature[at] >= 0)
        while len(row):
            here = at[row, tree]
            here = np.where(x[row, self.feature[here]] <= self.limit[here], self.left[here], self.right[here])
            at[row, tree] = here
            on = self.feature[here] >= 0
            row, tree = row[on], tree[on]
        return at

    def nbytes(self):
        return sum(a.nbytes for a in (self.feature, self.limit, self.left, self.right)) + 8 * len(self.feature) * (2 + len(self.shapes))


class Kernel:
    """Scores of class 1, a column for each point."""

    def probabilities(self, x):
        parts = [self._score(x[at:at + ROWS]) for at in range(0, len(x), ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, self.points))


class Forest(Kernel):
    """``points``: (number of trees, shape) each; a forest of n trees is the first n."""

    def __init__(self, trees, plan):
        self.trees, self.plan, self.points = trees, plan, len(plan)

    def _score(self, x):
        ends = self.trees.ends(x)
        return np.stack([self.trees.values[ends[:, :n], shape].mean(1) for n, shape in self.plan], axis=1)

    def nbytes(self):
        return self.trees.nbytes()


class Boosted(Kernel):
    """``series``: (trees, weights) by depth; ``plan``: (number of rounds, index of the series) of each point."""

    def __init__(self, series, plan):
        self.series, self.plan, self.points = series, plan, len(plan)

    def _score(self, x):
        margins = [np.cumsum(trees.values[trees.ends(x), 0] * weights, axis=1) for trees, weights in self.series]
        picked = np.stack([margins[s][:, n - 1] for n, s in self.plan], axis=1)
        return _squash(2 * picked)

    def nbytes(self):
        return sum(trees.nbytes() for trees, _ in self.series)


class Linear(Kernel):
    """``weights``: for each point an array of machines x (features + intercept); the score is the mean of the squashed margins."""

    def __init__(self, weights):
        self.weights, self.points = [np.atleast_2d(w) for w in weights], len(weights)

    def _score(self, x):
        return np.stack([_squash(x @ w[:, :-1].T + w[:, -1]).mean(1) for w in self.weights], axis=1)

    def nbytes(self):
        return sum(w.nbytes for w in self.weights)


class Networks(Kernel):
    """``nets``: for each point its layers (weights, offsets); squashed hidden layers, a soft maximum at the end."""

    def __init__(self, nets):
        self.nets, self.points = nets, len(nets)

    def _score(self, x):
        out = []
        for layers in self.nets:
            h = x
            for w, b in layers[:-1]:
                h = _squash(h @ w.T + b)
            z = h @ layers[-1][0].T + layers[-1][1]
            out.append(_squash(z[:, 1] - z[:, 0]))
        return np.stack(out, axis=1)

    def nbytes(self):
        return sum(w.nbytes + b.nbytes for layers in self.nets for w, b in layers)


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pick(kernel, i):
    """The kernel of one point of the grid."""
    if isinstance(kernel, (Forest, Boosted)):
        return type(kernel)(kernel.trees if isinstance(kernel, Forest) else kernel.series, [kernel.plan[i]])
    return type(kernel)([(kernel.weights if isinstance(kernel, Linear) else kernel.nets)[i]])
