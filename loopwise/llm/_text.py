"""Word and shingle hashing over whole Arrow string columns.

One call handles a slice of documents whose bytes lie one after another; each
document is processed to its last byte.  Slices are bounded in bytes so that a
task's memory does not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single document is its own slice.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of `[^\x20\x09-\x0D]+`; all bytes of a multi-byte character belong to words.
NON_SPACE = ~_SPACE
#: Bytes of letters, taking every multi-byte character as one.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; those of a slice are kept, longer runs are not."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Slice:
    """Rows `first` to `first + n` of a batch: lower-cased bytes and offsets."""

    def __init__(self, first: int, raw: np.ndarray, offsets: np.ndarray):
        self.first, self.raw, self.offsets = first, raw, offsets
        self.n = len(offsets) - 1

    def words(self, member: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of maximal runs of member bytes within one
        document, and per document the index of its first word (n + 1 long)."""
        w = member[self.raw]
        if not len(w):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n + 1, dtype=np.int64)
        before = np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        after = np.empty_like(w)
        after[-1], after[:-1] = False, w[1:]
        cuts = self.offsets[1:-1]
        before[cuts[cuts < len(w)]] = False
        after[cuts[cuts > 0] - 1] = False
        starts = np.flatnonzero(w & ~before)
        ends = np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each lower-cased word, alike at any position.  A long
        document goes through in stretches of whole words."""
        out, i = np.empty(len(starts), dtype=np.uint64), 0
        while i < len(starts):
            first = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, first + SLICE_BYTES, side="right")))
            data = LOWER[self.raw[first : ends[j - 1]]]
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[b] - sums[a]) * _power(_BASE_INVERSE, len(data) + 1)[a])
            i = j
        return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of an Arrow string column (null: empty) in slices of at
    most so many bytes, or of one document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n, wide = len(texts), pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    body = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Slice(at, body[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words over the whole slice; callers skip
    those that cross documents."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + n]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1)
        out ^= out >> np.uint64(32)
    return mix(out)
