"""Words of a block of texts as numpy arrays: positions, 64-bit hashes and n-gram hashes.

A word is a run of characters other than space and the control characters 9 to 13. In UTF-8 these are single
bytes that occur in no other character, so words are found on bytes, without decoding.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 .. n - 1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= BLOCK_BYTES + 1:  # those of a very long text are not kept
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def handing_back(run):
    """A task's function that, at its end, hands the memory it has freed back to the system; an idle worker would keep it."""
    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidy


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array with at most ``limit`` bytes, or one text."""
    for part in blocks(pa.record_batch({"text": texts}), "text", limit):
        yield part["text"]


def later_copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two flags per entry: an earlier entry has the same key; any other entry has it."""
    later, shared = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return later, shared | later


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes in ``column``, or one row."""
    if not batch.num_rows:
        return
    at = np.zeros(batch.num_rows + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), out=at[1:])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` of 64-bit values, read off prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start] ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def sums_between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the slices that begin at ``at[i]`` and end before ``at[i + 1]``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


class Words:
    """Words of the rows of a string array; a null text has none.

    ``start`` and ``end`` are byte positions in ``data``, ``row`` the row of each word, ``first[r]`` the index of the
    first word of row r (one entry more than rows), ``at[r]`` the position where the text of row r begins.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        body = texts.buffers()[2] if n else None
        data = np.frombuffer(body, dtype=np.uint8)[at[0]:at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cut = self.at[1:-1]
        cut = cut[inside[cut] & inside[cut + 1]]  # a word ends one text and another begins the next
        begins[cut] = True
        ends[cut] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.at)
        self._sums: np.ndarray | None = None
        self.row = np.repeat(np.arange(n), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: a polynomial in its bytes, read off prefix sums, then mixed with its length."""
        return self.span_hashes(self.start, self.end)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same hash for any byte spans."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * _power(_INVERSE, n + 1)[start]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def chars(self) -> np.ndarray:
        """Code points per word: bytes that do not continue a character."""
        return self.span_chars(self.start, self.end)

    def span_chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        heads = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return heads[end] - heads[start]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-word array over each row."""
        return sums_between(values, self.first)

    def ngrams(self, hashes: np.ndarray, n: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each ``n`` consecutive words of one row; ``among`` limits the first words."""
        at = np.arange(len(self)) if among is None else among
        at = at[at + n <= self.first[1:][self.row[at]]]
        g = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            g = g * _STEP + hashes[at + j]
        return at, mix(g + np.uint64(n))
