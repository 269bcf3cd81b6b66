"""Periodic runs of words, by maximal pairs of an LCP-interval tree.

Two equal stretches of words that start at i < j and can be extended neither to the left nor to the right are a maximal pair.
If their distance j - i is no greater than their length, they overlap or touch, and together are a run of period j - i: its
ends are those of the pair, so nothing is extended afterwards. A text's tree is built bottom-up over the suffixes that can
take part. Each node keeps the positions below it in order, cut into lists of equal left words; children are
merged small into large, and a position visits the lists of other left words within the distance only. Whole lists of its own
left word are skipped, so the work follows the number of pairs found, which is below the sum of the runs' exponents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, later_copies, mix, text_blocks

_U = np.uint64

FOUND = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Suffixes:
    """Suffixes of a block's texts that share their first ``seed`` words with another one of their text, in suffix order.

    ``at`` holds their first words in order of suffixes, ``lcp[k]`` the number of words that entry k shares with the one before it
    (0 where fewer than ``seed``). Words are ordered by their hashes, a suffix ends with its text. All suffixes are ranked by
    their first ``seed`` words, those alike further by 2, 4 .. seeds, each from two ranks of the level before.
    """

    def __init__(self, w: Words, hashes: np.ndarray, seed: int):
        self.w, self.hashes, self.seed = w, hashes, seed
        at, g = w.ngrams(hashes, seed)
        at = at[later_copies(g ^ mix(w.row[at].astype(_U) + _U(1)))[1]]
        self.at = self.lcp = np.zeros(0, np.int64)
        if not len(at):
            return
        begins = self._begins()
        n, row = len(at), w.row[at]
        self.index = np.full(len(w), -1, dtype=np.int64)
        self.index[at] = np.arange(n)
        rank = np.unique(row * (len(w) + 1) + begins[at], return_inverse=True)[1]
        self.group, levels, length = rank, [], seed
        while True:
            levels.append(rank.astype(np.int32))
            next_ = at + length
            inside = next_ < w.first[1:][row]
            next_ = np.where(inside, next_, 0)
            second = np.where(inside, begins[next_] * (n + 1) + np.where(self.index[next_] >= 0, rank[self.index[next_]] + 1, 0), 0)
            order = np.lexsort((second, rank))
            new = np.cumsum(np.append(False, (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)))
            if new[-1] == rank.max():  # nothing more to tell apart
                break
            rank = np.empty(n, np.int64)
            rank[order] = new
            length *= 2
        order = np.argsort(rank, kind="stable")
        self.at, self.group = at[order], self.group[order]
        self.lcp = self._common(levels)

    def _begins(self) -> np.ndarray:
        """Rank of every word's place by its next ``seed`` words, from 1; past the end of its text there is nothing, which comes first."""
        w, n = self.w, len(self.w)
        rank, have = np.unique(self.hashes, return_inverse=True)[1] + 1, 1
        ends = w.first[1:][w.row]
        while have < self.seed:
            step = min(have, self.seed - have)
            next_ = np.arange(n) + step
            second = np.where(next_ < ends, rank[np.minimum(next_, n - 1)], 0)
            rank, have = np.unique(rank * (n + 1) + second, return_inverse=True)[1] + 1, have + step
        return rank

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        w, n = self.w, len(self.at)
        lcp = np.zeros(n, dtype=np.int64)
        k = np.flatnonzero(self.group[1:] == self.group[:-1]) + 1
        if not len(k):
            return lcp
        a, b = self.at[k - 1].copy(), self.at[k].copy()
        end_a, end_b = (w.first[1:][w.row[x]] for x in (a, b))
        for depth in range(len(levels) - 1, -1, -1):
            x = np.where(a < end_a, self.index[np.minimum(a, len(w) - 1)], -1)
            y = np.where(b < end_b, self.index[np.minimum(b, len(w) - 1)], -1)
            same = (x >= 0) & (y >= 0) & (levels[depth][np.maximum(x, 0)] == levels[depth][np.maximum(y, 0)])
            step = np.where(same, self.seed << depth, 0)
            a, b = a + step, b + step
        going = np.arange(len(k))
        for _ in range(self.seed - 1):  # fewer than a seed are left to compare
            going = going[(a[going] < end_a[going]) & (b[going] < end_b[going])]
            going = going[self.hashes[a[going]] == self.hashes[b[going]]]
            a[going] += 1
            b[going] += 1
        lcp[k] = a - self.at[k - 1]
        return lcp

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """``at`` and ``lcp`` without suffixes that share less with every other one than lies between it and the next with its seed."""
        n = len(self.at)
        if not n:
            return self.at, self.lcp
        most = np.maximum(self.lcp, np.append(self.lcp[1:], 0))
        order = np.lexsort((self.at, self.group))
        gap = np.where(np.diff(self.group[order]) == 0, np.diff(self.at[order]), np.iinfo(np.int64).max)
        nearest = np.full(n, np.iinfo(np.int64).max)
        nearest[order[1:]] = gap
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
        keep = np.flatnonzero(nearest <= most)
        if not len(keep):
            return self.at[:0], self.lcp[:0]
        # what two kept neighbours share is the least of what lies between
        least = np.minimum.reduceat(self.lcp[:keep[-1] + 1], np.append(0, keep[:-1] + 1))
        return self.at[keep], np.append(0, least[1:])


def _merge(large: tuple[list[int], list[int]], small: tuple[list[int], list[int]], left: dict[int, int], depth: int, least: int,
           found: list[tuple[int, int, int]]) -> None:
    """Pairs of one position from each child, with other left words, at a distance of ``least`` to ``depth``; then ``small`` joins ``large``.

    A child is its positions in order and, among them, those where a list of equal left words begins.
    """
    places, heads = large
    for x in small[0]:
        of = left[x]
        k, stop = bisect_right(places, x), x + depth
        low = k - 1
        while k < len(places) and (y := places[k]) <= stop:
            if left[y] != of:
                if y - x >= least:
                    found.append((x, y - x, depth))
                k += 1
            else:
                after = bisect_right(heads, y)
                if after == len(heads):
                    break
                k = bisect_left(places, heads[after], k)
        k, stop = low, x - depth
        while k >= 0 and (y := places[k]) >= stop:
            if left[y] != of:
                if x - y >= least:
                    found.append((y, x - y, depth))
                k -= 1
            else:
                k = bisect_left(places, heads[bisect_right(heads, y) - 1], 0, k + 1) - 1
    for x in small[0]:
        k = bisect_left(places, x)
        before = left[places[k - 1]] if k else None
        if k < len(places):
            y = places[k]
            begins, now = before is None or left[y] != before, left[y] != left[x]
            if begins and not now:
                del heads[bisect_left(heads, y)]
            elif now and not begins:
                insort(heads, y)
        places.insert(k, x)
        if before is None or left[x] != before:
            insort(heads, x)


def maximal_pairs(at: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Maximal pairs as rows (first position, distance, length): distance at most the length, both together at least ``least``."""
    found: list[tuple[int, int, int]] = []
    of = dict(zip(at.tolist(), left.tolist(), strict=True))
    stack: list[tuple[int, tuple[list[int], list[int]]]] = []

    def joined(depth: int, one, two):
        large, small = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
        _merge(large, small, of, depth, max(1, least - depth), found)
        return large

    places = at.tolist()
    for x, shared in zip(places, [*lcp.tolist()[1:], 0]):
        node = ([x], [x])
        while stack and stack[-1][0] > shared:
            depth, other = stack.pop()
            node = joined(depth, other, node)
        if shared:
            if stack and stack[-1][0] == shared:
                node = joined(shared, stack.pop()[1], node)
            stack.append((shared, node))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def find_runs(w: Words, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (in the block), length and smallest period of every run of the block's texts, by first word and period."""
    at, lcp = Suffixes(w, hashes, max(1, -(-min_words // 2))).near()
    starts_text = at == w.first[w.row[at]]
    left = np.where(starts_text, -1, np.unique(hashes[at - 1], return_inverse=True)[1]) if len(at) else at
    pairs = maximal_pairs(at, lcp, left, min_words)
    start, period, length = pairs[:, 0], pairs[:, 1], pairs[:, 1] + pairs[:, 2]
    # a run is also found with the multiples of its period
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[:len(start)]
    start, period, length = start[new], period[new], length[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(w: Words, gone: np.ndarray) -> pa.Array:
    """Words that stay, a space between two."""
    stays = np.flatnonzero(~gone)
    row = w.row[stays]
    last = np.append(row[1:] != row[:-1], True)[:len(stays)]
    body = w.data.copy()
    change = np.zeros(len(body) + 2, dtype=np.int8)
    change[w.start[stays]] += 1
    # the white space after a word becomes its space
    space = w.end[stays][~last]
    body[space] = 32
    stop = w.end[stays] + ~last
    change[stop[stop < len(body)]] -= 1
    use = np.cumsum(change[:len(body)], dtype=np.int8).astype(bool)
    ends = np.zeros(len(body) + 1, dtype=np.int64)
    np.cumsum(use, out=ends[1:])
    text = pa.Array.from_buffers(pa.large_string(), len(w.at) - 1, [None, pa.py_buffer(ends[w.at].tobytes()), pa.py_buffer(body[use].tobytes())])
    return text.cast(pa.string())


def _measured(texts: pa.Array, min_words: int) -> pa.Array:
    w = Words(texts)
    start, length, period = find_runs(w, w.hashes(), min_words)
    change = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    row = w.row[start]
    runs = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), runs)
    return pa.StructArray.from_arrays([pa.array(np.diff(w.first), pa.int64()), lists, _collapsed(w, gone)], ["n_words", "runs", "collapsed"])


def periodic(text: Column, min_words: int = 12) -> Column:
    """``n_words, runs, collapsed`` per text, see ``periodic_runs``."""
    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_blocks(texts):
                yield _measured(part, min_words)

    return run(text)


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 12) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of words with smallest period q, at least ``min_words`` and at least 2 q words long, that no neighbouring word
    extends. ``runs`` holds start, length and period by start, then period; ``collapsed`` is the text without words that
    a run holds after its first q, words joined by one space. Each text is looked at by itself and nothing is shuffled. Null and
    empty texts have no words, no runs and an empty ``collapsed``; repeated rows are rows; an empty table gives none; other columns are ignored.
    """
    if min_words < 2:
        raise ValueError("a run has two words at least")
    return docs.select(*keep, periodic(F.col(text), min_words).alias("__p")).select(*keep, "__p.*")
