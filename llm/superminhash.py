"""SuperMinHash signatures of many sets at once, on flat arrays."""

import numpy as np

from llm.textops import GOLDEN, mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(values, bounds, m):
    """An (n, m) array of ranks. Every element deals the m slots out in its own pseudo-random order (a
    Fisher-Yates shuffle drawn from its hash) and offers rank step + uniform to each; a slot keeps the smallest.

    All elements take step j together. Ranks of later steps are larger, so a set stops as soon as all its slots
    have one: large sets take one or two steps. Sets without elements keep ``EMPTY`` throughout."""
    n = len(bounds) - 1
    sig = np.full(n * m, EMPTY)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(n), counts)
    picked = []
    for j in range(m):
        if j:
            open_rows = (sig.reshape(n, m) == EMPTY).any(1)
            stay = open_rows[row]
            if not stay.any():
                break
            if not stay.all():
                values, row, picked = values[stay], row[stay], [k[stay] for k in picked]
        elif not len(row):
            break
        x = mix(values + np.uint64((j + 1) * int(GOLDEN) & int(EMPTY)))
        at = (((x & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int16) + np.int16(j)
        slot = at.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps left at this place
            slot[picked[i] == slot] = i
        picked.append(at)
        np.minimum.at(sig, row * m + slot, (np.uint64(j) << np.uint64(40)) | (x >> np.uint64(24)))
    return sig.reshape(n, m)


def band_keys(sig, rows):
    """A 64-bit key for each band of ``rows`` slots; the band's number is part of it."""
    n, m = sig.shape
    keys = np.empty((n, m // rows), np.uint64)
    for b in range(m // rows):
        key = np.full(n, np.uint64((b + 1) * int(GOLDEN) & int(EMPTY)))
        for i in range(rows):
            key = mix(key * GOLDEN + sig[:, b * rows + i])
        keys[:, b] = key
    return keys
