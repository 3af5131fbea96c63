"""Whole-batch views of texts: bytes, words and word hashes as numpy arrays.

A batch of texts is one byte buffer with offsets. Words are `[^\\x20\\x09-\\x0D]+`, found without a Python loop.
"""

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once inside a task: keeps the work arrays small whatever the batch; a longer text is handled alone.
SLICE_BYTES = 1 << 21


def mix(x):
    """A bijective scramble of unsigned 64-bit integers (the finalising step of SplitMix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {}


def powers(base, n):
    """base ** 0 .. base ** n modulo 2 ** 64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 12), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[: n + 1]


def spans_hash(values, starts, ends):
    """A 64-bit hash of each values[start:end]; equal sequences have equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets, most=SLICE_BYTES):
    """Ranges (i, j) of texts that together have at most `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of consecutive texts: byte positions, and the first word of each text."""

    def __init__(self, data, offsets):
        n = len(data)
        word = ~SPACE[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = word[cut]
        stops[cut - 1] = word[cut - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)  # first[i] .. first[i + 1] are the words of text i

    def hashes(self):
        return spans_hash(_BYTE_VALUE[self.data], self.starts, self.ends)

    def owners(self):
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def count_keys(keys, weights=None):
    """Sorted distinct keys and how often each occurs (or the sum of its weights)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)


class KeyCounter:
    """Counts of 64-bit keys, merged now and then so that memory follows the distinct keys."""

    def __init__(self, merge_at=1 << 21):
        self.parts, self.held, self.merge_at = [], 0, merge_at

    def add(self, keys):
        if len(keys):
            part = count_keys(keys)
            self.parts.append(part)
            self.held += len(part[0])
            if self.held > self.merge_at:
                self.merge()
                self.merge_at = max(self.merge_at, 2 * self.held)

    def merge(self):
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = [count_keys(keys, counts)]
        self.held = len(self.parts[0][0]) if self.parts else 0

    def result(self):
        self.merge()
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def batches(schema, columns, rows=1 << 16):
    """Arrow batches of bounded size from whole columns."""
    n = len(columns[0])
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + rows], type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with their words joined by single spaces."""
    n, last = len(words.data), words.first[1:] - 1
    kept = ~SPACE[words.data]
    inner = np.ones(len(words.ends), dtype=bool)
    inner[last[last >= words.first[:-1]]] = False
    gaps = words.ends[inner]
    kept[gaps] = True
    place = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(kept, out=place[1:])
    data = words.data[kept]
    data[place[gaps]] = 32
    sizes = np.zeros(len(words.first), dtype=np.int64)
    has = np.flatnonzero(words.first[1:] > words.first[:-1])
    sizes[has + 1] = place[words.ends[words.first[has + 1] - 1]] - place[words.starts[words.first[has]]]
    return data, np.cumsum(sizes)
