"""Words, word hashes and window hashes of whole Arrow batches, without a loop over words.

Texts are read as UTF-8 bytes: all separators are ASCII, and no byte of a longer character is.
Hashes are 64-bit; what must be exact is compared by its words afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15  # any odd number
_BACK = pow(_BASE, -1, 1 << 64)

#: Bytes that part words: white space, or all of ASCII but digits and letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
MARKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

#: Bytes of text that are looked at together. A longer text is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest list so far is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.ones(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            while len(known) < size:
                known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        _POWERS[base] = known
    return known[:n]


@dataclass
class Words:
    """Words of a piece of rows. ``first[i]`` is the number of the first word of row i;
    ``starts`` and ``ends`` are places in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, begin: int, end: int) -> str:
        """Some words in a row, parted by single spaces."""
        spans = zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist(), strict=True)
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in spans).decode()


def words_of(texts: pa.Array, between: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Split every text of an array; a null text has no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low:high]
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~between[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    # A word also ends where its row does.
    begins = offsets[:-1][np.diff(offsets) > 0]
    opens[begins] = inside[1 + begins]
    later = begins[begins > 0]
    closes[later - 1] = inside[later]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
        hashed = mix((sums[ends] - sums[starts]) * _powers(_BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashed)


def window_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries, also across rows."""
    if len(hashed) < size:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashed) - size + 1, dtype=np.uint64)
        for k in range(size):
            total += hashed[k : k + len(total)] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mix(total)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of all windows that lie inside one row."""
    hashed = window_hashes(words.hash, size)
    row = words.row
    if not len(hashed):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), hashed
    at = np.flatnonzero(row[: len(hashed)] == row[size - 1 :])
    return row[at], at, hashed[at]


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches into stretches of rows with a bounded sum of text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(begin, end - begin)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted and disjoint intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.concatenate([fresh[1:], [True]])]
