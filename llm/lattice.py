"""The E8 lattice: nearest points, and the nearest points around them."""

import itertools

import numpy as np


def roots():
    """The 240 shortest vectors of E8: all (+-1, +-1, 0, ...) and all (+-1/2, ...) with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(list(signs))
    return np.array(out)


def _d8(x):
    """Nearest points of D8 (integers with an even sum): round, and if the sum is odd, round the worst one the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x):
    """Nearest E8 points: E8 is D8 and D8 shifted by one half."""
    one, two = _d8(x), _d8(x - 0.5) + 0.5
    better = ((x - two) ** 2).sum(1) < ((x - one) ** 2).sum(1)
    return np.where(better[:, None], two, one)
