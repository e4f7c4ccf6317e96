"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words of a chunk are one flat array of symbols. In a round every word finds its smallest pair rank (a segmented
minimum), merges the leftmost occurrences of that pair that do not overlap, and the array is compacted; words without
a known pair are done. Equal words are merged once per chunk."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import columns, tidy
from llm.textops import chunks, mix, text_bytes

CHUNK_BYTES = 1 << 19
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MARK = "▁"  # stands for a space


class Model:
    """The tables of a BPE model with identity normalisation, a leading space, and byte fallback."""

    def __init__(self, data: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.size = sp.vocab_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p, ok in zip(texts, plain) if ok):
            raise ValueError("a piece has a space after other characters: words cannot be cut at spaces")
        known = {p: i for i, (p, ok) in enumerate(zip(texts, plain)) if ok}
        _, order = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)
        self.rank = order.astype(np.int32)

        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)  # unknown characters follow the pieces
        for p, i in known.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[ord(" ")] = self.of_char[ord(MARK)]
        self.byte_id = np.full(256, self.unknown, np.int32)
        raw = []
        for i, p in enumerate(texts):
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_id[value] = i
                raw.append(bytes([value]))
            elif sp.is_control(i):
                raw.append(b"")
            elif i == self.unknown:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(p.replace(MARK, " ").encode())
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_size)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

        pairs = [(known[p[:c]] << 32 | known[p[c:]], i) for p, i in known.items()
                 for c in range(1, len(p)) if p[:c] in known and p[c:] in known]
        self._store(np.array([k for k, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int32))
        # pieces that can make a pair of the same or a smaller rank with a neighbour
        merged = self.rank[[i for _, i in pairs]]
        left, right = [k >> 32 for k, _ in pairs], [k & 0xFFFFFFFF for k, _ in pairs]
        self.risky = np.zeros(n + 0x110000, bool)
        for side in (left, right):
            side = np.array(side)
            self.risky[side[merged <= self.rank[side]]] = True
        # runs of spaces of one common, last rank are merged last, left to right; what a run becomes is tabulated
        self.space, self.runs = int(self.of_char[ord(MARK)]), None
        lengths = {len(p): i for p, i in known.items() if p == MARK * len(p)}
        longest = max(lengths, default=1)
        ranks = {int(self.rank[i]) for k, i in lengths.items() if k > 1}
        others = [i for p, i in known.items() if len(p) > 1 and p != MARK * len(p)]
        if len(ranks) == 1 and self.rank[others].max() < min(ranks):
            table = [self._run(n, lengths) for n in range(3 * longest + 1)]
            if all(table[n] == [longest] + table[n - longest] for n in range(longest, len(table))):
                self.runs, self.run_rank = [[lengths[k] for k in t] for t in table[:longest]], min(ranks)
                self.longest, self.of_longest = longest, lengths[longest]

    @staticmethod
    def _run(n, lengths):
        """Lengths of the pieces that n spaces become by merging the leftmost possible pair again and again."""
        row = [1] * n
        while True:
            at = next((i for i in range(len(row) - 1) if row[i] + row[i + 1] in lengths), None)
            if at is None:
                return row
            row[at:at + 2] = [row[at] + row[at + 1]]

    def _store(self, keys, ids):
        self.mask = np.uint64((1 << int(4 * len(keys)).bit_length()) - 1)
        self.keys = np.full(int(self.mask) + 1, EMPTY)
        self.merged = np.full(int(self.mask) + 1, -1, np.int32)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            slot = ((mix(keys[left]) + np.uint64(self.probes)) & self.mask).astype(np.int64)
            first = np.unique(slot, return_index=True)[1]
            first = first[self.merged[slot[first]] < 0]
            self.keys[slot[first]], self.merged[slot[first]] = keys[left[first]], ids[left[first]]
            left = np.delete(left, first)
            self.probes += 1

    def pairs(self, a, b):
        """(piece, rank) of each pair of neighbours; -1 and NONE where they make no piece."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = (mix(key) & self.mask).astype(np.int64)
        found = self.keys[slot]
        piece = np.where(found == key, self.merged[slot], np.int32(-1))
        left = np.flatnonzero((found != key) & (found != EMPTY))
        slot = slot[left]
        while len(left):  # the slot holds another pair: look at the next one
            slot = (slot + 1) & np.int64(self.mask)
            found = self.keys[slot]
            mine = found == key[left]
            piece[left[mine]] = self.merged[slot[mine]]
            more = ~mine & (found != EMPTY)
            left, slot = left[more], slot[more]
        return piece, np.where(piece >= 0, self.rank[piece], NONE)


@functools.lru_cache(maxsize=4)
def model(data: bytes) -> Model:
    return Model(data)


def merge_words(m: Model, symbols, bounds):
    """Symbols of words -> symbols after all merges, and their bounds."""
    n = len(bounds) - 1
    word = np.repeat(np.arange(n), np.diff(bounds))
    order = np.arange(len(symbols))  # position of a symbol in the whole array, for putting finished words back
    piece = np.full(len(symbols), -1, np.int32)
    rank = np.full(len(symbols), NONE, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    piece[inner], rank[inner] = m.pairs(symbols[inner], symbols[inner + 1])
    done = []
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
        live = least < NONE
        if m.runs is not None:
            live &= least != m.run_rank  # left for later: only spaces can still be merged
        if not live.all():
            out = np.repeat(~live, sizes)
            done.append((order[out], word[out], symbols[out]))
            stay = ~out
            symbols, word, order, piece, rank = symbols[stay], word[stay], order[stay], piece[stay], rank[stay]
            least, sizes = least[live], sizes[live]
            if not len(symbols):
                break
        goal = np.repeat(least, sizes)
        hit = np.flatnonzero(rank == goal)
        if len(hit) > 1:
            # of neighbouring occurrences every second one overlaps: keep the first, third, ... of each run
            joined = np.concatenate([[False], np.diff(hit) == 1])
            if joined.any():
                index = np.arange(len(hit))
                head = np.maximum.accumulate(np.where(joined, 0, index))
                hit = hit[(index - head) % 2 == 0]
            # a new pair of the same or a smaller rank comes before the next occurrence: then only the first counts
            risk = m.risky[piece[hit]]
            if risk.any():
                owner = word[hit]
                heads = np.concatenate([[True], owner[1:] != owner[:-1]])
                where = np.flatnonzero(heads)
                any_risk = np.repeat(np.logical_or.reduceat(risk, where), np.diff(np.concatenate([where, [len(hit)]])))
                hit = hit[heads | ~any_risk]
        symbols[hit] = piece[hit]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[hit] = True
        symbols, word, order, piece, rank, touched = (
            x[stay] for x in (symbols, word, order, piece, rank, touched))
        touched[:-1] |= touched[1:]
        at = np.flatnonzero(touched)
        with_next = at[at + 1 < len(symbols)]
        with_next = with_next[word[with_next] == word[with_next + 1]]
        piece[at], rank[at] = -1, NONE
        piece[with_next], rank[with_next] = m.pairs(symbols[with_next], symbols[with_next + 1])
    if done:
        order, word, symbols = (np.concatenate(x) for x in zip(*done))
        back = np.argsort(order, kind="stable")
        word, symbols = word[back], symbols[back]
    if m.runs is not None:
        symbols, word = _space_runs(m, symbols, word)
    return symbols, np.searchsorted(word, np.arange(n + 1))


def _space_runs(m, symbols, word):
    """What the runs of single spaces that are left become."""
    space = symbols == m.space
    follows = np.concatenate([[False], space[1:] & space[:-1] & (word[1:] == word[:-1])])
    if not follows.any():
        return symbols, word
    heads = np.flatnonzero(~follows)
    sizes = np.diff(np.concatenate([heads, [len(symbols)]]))
    whole, rest = sizes // m.longest, sizes % m.longest
    is_run = sizes > 1
    count = np.where(is_run, whole + np.array([len(t) for t in m.runs])[rest], 1)
    at = np.cumsum(count) - count
    out = np.repeat(symbols[heads], count)
    for i in np.flatnonzero(is_run).tolist():
        out[at[i]:at[i] + whole[i]] = m.of_longest
        out[at[i] + whole[i]:at[i] + count[i]] = m.runs[rest[i]]
    return out, np.repeat(word[heads], count)


def _ragged(starts, sizes):
    """Indices of the concatenation of ranges."""
    total = int(sizes.sum())
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(total)


def _with_bytes(m, symbols, bounds):
    """Unknown characters become their UTF-8 bytes' pieces."""
    odd = np.flatnonzero(symbols >= m.size)
    if not len(odd):
        return symbols, bounds
    parts = [m.byte_id[np.frombuffer(chr(c - m.size).encode(), np.uint8)] for c in symbols[odd].tolist()]
    sizes = np.ones(len(symbols), np.int64)
    sizes[odd] = [len(p) for p in parts]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(symbols, sizes)
    for i, p in zip(odd.tolist(), parts):
        out[at[i]:at[i + 1]] = p
    return out, at[bounds]


def encode(m: Model, raw, offsets):
    """UTF-8 texts -> (ids, bounds) without begin and end ids."""
    n = len(offsets) - 1
    if bytes([0xE2, 0x96, 0x81]) in raw.tobytes():  # the mark itself reads as a space
        texts = [raw[offsets[i]:offsets[i + 1]].tobytes().replace(MARK.encode(), b" ") for i in range(n)]
    else:
        whole = raw.tobytes()
        texts = [whole[offsets[i]:offsets[i + 1]] for i in range(n)]
    texts = [b" " + t if t else b"" for t in texts]
    own = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    if not data:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)
    space = flat == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[own[:-1][np.diff(own) > 0]] = True
    starts = np.flatnonzero(cut)
    array = pa.Array.from_buffers(pa.large_utf8(), len(starts), [
        None, pa.py_buffer(np.concatenate([starts, [len(flat)]]).astype(np.int64)), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    distinct = coded.dictionary
    chars = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le"), np.uint32)
    import pyarrow.compute as pc

    sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    symbols, bounds = merge_words(m, m.of_char[chars], bounds)
    symbols, bounds = _with_bytes(m, symbols, bounds)
    which = coded.indices.to_numpy().astype(np.int64)
    sizes = np.diff(bounds)[which]
    ids = symbols[_ragged(bounds[which], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ids, ends[np.searchsorted(starts, own)]


def decode(m: Model, ids, bounds):
    """Ids -> (bytes, offsets): pieces put together, the leading space taken off, odd bytes replaced."""
    sizes = m.piece_size[ids]
    data = m.piece_bytes[_ragged(m.piece_at[ids], sizes)].tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    out = []
    for i in range(len(at) - 1):
        text = data[at[i]:at[i + 1]]
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return out


TYPES = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def _tokenize(data, outputs):
    def run(batches):
        m = model(data)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for first, last in chunks(offsets, CHUNK_BYTES):
                ids, bounds = encode(m, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                n = last - first
                framed = np.empty(len(ids) + 2 * n, np.int32)
                own = bounds + 2 * np.arange(n + 1)
                framed[own[:-1]], framed[own[1:] - 1] = m.begin, m.end
                framed[np.arange(len(ids)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1] = ids
                made = {"doc_id": batch.column("doc_id").slice(first, n), "n_tokens": pa.array(np.diff(own))}
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(own.astype(np.int32), framed)
                if "ids_sha256" in outputs:
                    little = framed.astype("<u4").tobytes()
                    made["ids_sha256"] = pa.array([
                        hashlib.sha256(little[4 * own[i]:4 * own[i + 1]]).hexdigest() for i in range(n)])
                if {"decoded", "decoded_sha256"} & {*outputs}:
                    texts = decode(m, framed, own)
                    made["decoded"] = pa.array(texts, pa.string())
                    made["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
                names = ["doc_id", *outputs]
                yield pa.RecordBatch.from_arrays([made[x] for x in names], names)
    return run


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokenize(docs: DataFrame, model_path: str, outputs=("n_tokens", "ids"), id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and ``outputs`` of each row: n_tokens, ids (with begin and end ids), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded, decoded_sha256.

    Equal to the library's encoding without sampling, and its decoding. Nothing is shuffled; the model's bytes travel
    with the tasks, memory follows the largest text. A null text is an empty one: begin and end ids only. Ids may be
    null or repeated: rows are independent. An empty table gives no rows; other columns are ignored."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{x} {TYPES[x]}" for x in outputs)
    return rows.mapInArrow(tidy(_tokenize(read_model(model_path), tuple(outputs))), schema)


def _detokenize(data):
    def run(batches):
        m = model(data)
        for batch in batches:
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            bounds = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(decode(m, flat, bounds - bounds[0]), pa.string())],
                                             ["doc_id", "text"])
    return run


def detokenize(rows: DataFrame, model_path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """doc_id and text of rows of ids (array<int>); null ids give an empty text."""
    rows = columns(rows, doc_id=id_col, ids=ids_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_detokenize(read_model(model_path))), f"doc_id {kind}, text string")
