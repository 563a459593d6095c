"""Words of whole Arrow text columns as NumPy arrays: spans, 64-bit hashes and n-gram hashes, without a loop per word.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D in the UTF-8 text; A-Z are lower-cased for hashing.
Hashes are 64 bits wide: two different words or shingles among n collide with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
LOWER_PLUS_ONE = LOWER.astype(np.uint64) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PIECE = 1 << 21
SLICE_BYTES = 8 << 20

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse; tables of usual size are kept."""
    size = max(n, PIECE + 1)
    if "up" not in _powers or len(_powers["up"]) < size:
        made = []
        for factor in (BASE, INVERSE):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 8 * PIECE:
            return made[0], made[1]
        _powers["up"], _powers["down"] = made
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over all 64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # UTF-8 bytes of all texts, one blank after each
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # word at which each text begins, plus the total

    @property
    def docs(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    def trimmed(self) -> Words:
        """The same words without ASCII punctuation at either end; a word of nothing else becomes empty."""
        starts, ends = self.starts.copy(), self.ends.copy()
        left = np.arange(len(starts))
        while len(left):
            left = left[(ends[left] > starts[left])]
            left = left[PUNCTUATION[self.data[ends[left] - 1]]]
            ends[left] -= 1
        left = np.arange(len(starts))
        while len(left):
            left = left[(ends[left] > starts[left])]
            left = left[PUNCTUATION[self.data[starts[left]]]]
            starts[left] += 1
        return Words(self.data, starts, ends, self.first)

    def text(self, word: int) -> str:
        return self.data[self.starts[word]:self.ends[word]].tobytes().decode("utf-8", "replace")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; each text is followed by one blank, null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    blank = pa.array([" "], pa.large_string())[0]
    joined = pc.binary_join_element_wise(column, blank, pa.array([""], pa.large_string())[0])
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array) -> Words:
    if len(column) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(1, np.int64))
    data, offsets = _bytes(column)
    inside = np.zeros(len(data) + 1, np.int8)
    np.logical_not(SPACE[data], out=inside[1:].view(bool))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span. Spans are ascending; they are worked through in pieces of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    values = LOWER_PLUS_ONE if lower else PLUS_ONE
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        up, down = _power_tables(int(ends[b - 1] - low) + 1)
        n = int(ends[b - 1] - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[low:ends[b - 1]]] * up[:n], out=total[1:])
        at = starts[a:b] - low
        out[a:b] = (total[ends[a:b] - low] - total[at]) * down[at]
        a = b
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, with repeats, and the place where each text begins.

    A text with fewer than n words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    full = np.maximum(counts - n + 1, 0)
    per_text = np.where(counts == 0, 0, np.maximum(full, 1))
    begins = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros(begins[-1], np.uint64)
    if len(words) >= n:
        rolled = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            rolled += words[k:len(words) - n + 1 + k] * np.uint64(pow(int(BASE), k + 1, 1 << 64))
        # The place of shingle j of text d in `rolled` is first[d] + j.
        long = np.flatnonzero(full)
        where = np.arange(full[long].sum()) + np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(full[long])[:-1]]), full[long])
        target = np.arange(full[long].sum()) + np.repeat(begins[:-1][long] - np.concatenate([[0], np.cumsum(full[long])[:-1]]), full[long])
        out[target] = rolled[where]
    for d in np.flatnonzero((counts > 0) & (full == 0)):
        value = np.array([counts[d]], np.uint64) * INVERSE
        for k in range(first[d], first[d + 1]):
            value = mix(value * BASE + words[k:k + 1])
        out[begins[d]] = value[0]
    return mix(out), begins


def distinct_per_text(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and the place where each text begins."""
    kept, counts = [], [0]
    for d in range(len(begins) - 1):
        own = np.unique(values[begins[d]:begins[d + 1]])
        kept.append(own)
        counts.append(len(own))
    return np.concatenate(kept) if kept else values[:0], np.cumsum(counts)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes together; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
