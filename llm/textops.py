"""Words, word hashes and shingles of Arrow text columns, computed on flat byte arrays inside tasks."""

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  # odd, so powers can be undone modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 18      # bytes of text handled at once; a longer text is a chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# bytes that are no part of a word, after lower-casing
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[:128] = True
NOT_ALPHANUMERIC[ord("0"):ord("9") + 1] = False
NOT_ALPHANUMERIC[ord("a"):ord("z") + 1] = False


def mix(x):
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


class _Powers:
    """Powers of an odd base modulo 2^64, extended as needed."""

    def __init__(self, base):
        self.base, self.values = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n):
        if len(self.values) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values[:n]


POWERS, INVERSES = _Powers(BASE), _Powers(BASE_INVERSE)


def text_bytes(column):
    """(bytes, offsets) of an Arrow string array; a null has no bytes."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets, limit=CHUNK_BYTES):
    """Ranges of rows of about ``limit`` bytes, at least one row each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(raw, offsets, breaks=SPACES):
    """Words of each text after lower-casing A-Z: (starts, ends, bounds), where the words of text i are those
    numbered bounds[i] to bounds[i + 1] and starts and ends are byte positions in ``raw``."""
    inside = ~breaks[LOWER[raw]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw, starts, ends):
    """64-bit hashes of the lower-cased words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[raw]] * POWERS.upto(len(raw)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * INVERSES.upto(len(raw))[starts]
    return mix(own + (ends - starts).astype(np.uint64) * GOLDEN)


def shingles(hashes, bounds, k):
    """Hashes of the runs of k words of each text, and their bounds. A text of fewer words has one: all its words."""
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < k)
    n = len(hashes)
    whole = np.zeros(0, np.uint64)
    if n >= k:
        whole = hashes[:n - k + 1].copy()
        for i in range(1, k):
            whole = mix(whole * GOLDEN + hashes[i:n - k + 1 + i])
    each = np.where(short, 1, np.maximum(counts - k + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(each)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], each) + np.arange(out_bounds[-1])
    is_short = np.repeat(short, each)
    out = np.empty(len(first), np.uint64)
    out[~is_short] = whole[first[~is_short]]
    for i in np.flatnonzero(short):
        own = hashes[bounds[i]:bounds[i + 1]]
        value = own[:1].copy()
        for j in range(1, len(own)):
            value = mix(value * GOLDEN + own[j:j + 1])
        out[out_bounds[i]] = mix(value + np.uint64(len(own)))[0]
    return out, out_bounds


def _distinct(values):
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(column, k, breaks=SPACES):
    """For each chunk of rows: (first row, hashes, bounds) with sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        own = raw[offsets[first]:offsets[last]]
        at = offsets[first:last + 1] - offsets[first]
        starts, ends, bounds = words(own, at, breaks)
        values, bounds = shingles(word_hashes(own, starts, ends), bounds, k)
        parts = [_distinct(values[bounds[i]:bounds[i + 1]]) for i in range(last - first)]
        sizes = np.array([len(p) for p in parts], np.int64)
        yield first, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
