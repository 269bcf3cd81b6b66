"""N-gram Jaccard join: small sets meet in enumerated subsets, large sets in inverted lists; sizes decide by cost.

Two sets link when the Jaccard similarity of their word shingles reaches ``num / den``, exactly.

* Small sets. Sets of sizes a and b link if and only if they share a subset of c(a, b) shingles, so a small set lists all its
  subsets of the sizes its possible partners ask for.
* Large sets. The shingles of a size class are dealt by their hash into more parts than two linking sets can have
  differences. At least one part that is not empty is then equal in both, and the inverted lists, keyed by a part with all
  it holds, bring them together. A list per single shingle would be as long as the most frequent shingle is common.
* The boundary is the size from which enumerating costs more than the lists.

A list is never expanded into pairs. Each member is compared with the head of its list; equal sets need no comparison.
Members of lists that then lie in several components are listed once more, by what tells them from one document of their
group of lists: two sets differ by what their differences from it don't share. The passages a group has in common cancel out, so members
meet only where they share changes, and no link that joins two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sizing import broadcast_if_small
from tidemark.session import release, setting, staged, written

from .components import components
from .words import Words, handing_back, mix, text_blocks

#: Least number of parts beyond those needed. Sets with more empty parts than a class has to spare list these, too.
SLACK = 2
#: What an entry of an inverted list costs in entries of a subset list: it can lead to a comparison of texts.
LIST_COST = 4
#: Buckets of the table of shingle frequencies, a fixed size.
RARITY = 1 << 18
#: Bits of a set's sketch for each difference that two linking sets may have.
SKETCH = 4
#: Documents that are compared with one document by a task.
MEMBERS = 256
#: Signatures that one task combines before they are shuffled.
COMBINE = 1 << 19
#: Bytes of rows that go to a Python worker at a time: texts are looked at in blocks of as much, and a batch is held several times on its way.
BATCH_BYTES = "1m"

_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    num: int = 90
    den: int = 100
    words: int = 3

    def overlap(self, a: int, b: int) -> int:
        """Smallest intersection with which sets of these sizes link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, a: int, b: int | None = None) -> int:
        """Most shingles in one set only with which sets of these sizes link; without ``b``, for any size that can link with a."""
        return (self.den - self.num) * (a + (self.den * a // self.num if b is None else b)) // (self.den + self.num)

    def partners(self, a: int) -> range:
        return range(-(-self.num * a // self.den), self.den * a // self.num + 1)


@dataclass
class Classes:
    """Size classes up to a largest size: sets of one class link with that class and the two beside it only."""

    t: Threshold
    starts: list[int] = field(default_factory=lambda: [1])

    def upto(self, size: int) -> None:
        while self.starts[-1] <= size or len(self.starts) < 3:
            self.starts.append(self.starts[-1] * self.t.den // self.t.num + 1)
        for _ in range(2):
            self.starts.append(self.starts[-1] * self.t.den // self.t.num + 1)

    def differences(self, tag: int) -> int:
        """Most shingles that are in one set only, for linked sets of class ``tag`` or the one below."""
        top = self.starts[tag + 1] - 1
        return 2 * top * (self.t.den - self.t.num) // (self.t.den + self.t.num)

    def spare(self, tag: int) -> int:
        """Parts beyond those needed, so many that hardly a set leaves as many empty: an equal part of two sets then holds something.

        The smallest sets that are listed under ``tag``, those of the class below, leave about m exp(-n / m) of m parts empty.
        """
        n, spare = self.starts[max(tag - 1, 0)], SLACK
        for _ in range(4):
            m = self.differences(tag) + 1 + spare
            empty = m * math.exp(-n / m)
            spare = max(SLACK, math.ceil(empty + 4 * math.sqrt(empty)))
        return spare

    def parts(self, tag: int) -> int:
        return self.differences(tag) + 1 + self.spare(tag)


def subset_sizes(a: int, t: Threshold) -> list[int]:
    return sorted({c for b in t.partners(a) if b for c in [t.overlap(a, b)] if c <= min(a, b)})


def boundary(t: Threshold) -> int:
    """The first size for which its subsets cost more than its list entries."""
    classes = Classes(t)
    a = 1
    while True:
        classes.upto(a)
        tag = int(np.searchsorted(classes.starts, a, side="right")) - 1
        if sum(math.comb(a, c) for c in subset_sizes(a, t)) > LIST_COST * (classes.parts(tag) + classes.parts(tag + 1)):
            return a
        a += 1


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row. A text with fewer than n words has one shingle, all its words."""
    w = Words(texts, lower=True)
    h, count = w.hashes(), np.diff(w.first)
    found = [w.ngrams(h, n)]
    for k in range(1, n):
        found.append(w.ngrams(h, k, w.first[:-1][count == k]))
    at, g = (np.concatenate(x) for x in zip(*found))
    row = w.row[at]
    key = g ^ mix(row.astype(_U) + _U(1))
    keep = np.unique(key, return_index=True)[1]
    keep = keep[np.argsort(row[keep], kind="stable")]
    return row[keep], g[keep]


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(texts: pa.Array, t: Threshold, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each row's set (0: no set), and row and value of each signature (even; odd ones are fingerprints)."""
    row, g = shingle_sets(texts, t.words)
    rows = len(texts)
    size = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(size)])
    g = mix(g)
    whole = _row_sums(g, first)
    print_ = np.where(size > 0, mix(whole ^ mix(size.astype(_U))) | _U(1), _U(0))
    of, sig = [], []

    def add(r: np.ndarray, s: np.ndarray) -> None:
        of.append(r)
        sig.append(s & ~_U(1))

    for a in np.unique(size[(size > 0) & (size < limit)]).tolist():
        r = np.flatnonzero(size == a)
        h = g[first[r][:, None] + np.arange(a)]
        for c in subset_sizes(a, t):
            salt = mix(np.array([c + (1 << 40)], dtype=_U))
            left_out = np.array(list(combinations(range(a), a - c)), dtype=np.int64).reshape(math.comb(a, c), a - c)
            sums = whole[r][:, None] - h[:, left_out].sum(axis=2, dtype=_U)
            add(np.repeat(r, len(left_out)), mix(sums.ravel() ^ salt))

    listed = size * t.den >= limit * t.num  # can link with a large set
    if listed.any():
        classes = Classes(t)
        classes.upto(int(size.max()))
        class_of = np.searchsorted(classes.starts, size, side="right") - 1
        table, spare = (np.array([f(i) for i in range(int(class_of.max()) + 2)]) for f in (classes.parts, classes.spare))
        member = listed[row]
        for step in (0, 1):
            tag = class_of + step
            m = np.where(listed, table[np.maximum(tag, 0)], 0)
            begin = np.concatenate([[0], np.cumsum(m)])
            cell = begin[row[member]] + (mix(g[member] + _U(99)) % m[row[member]].astype(_U)).astype(np.int64)
            n = np.bincount(cell, minlength=begin[-1])
            low, high = (np.bincount(cell, (x & _U(0xFFFFFFFF)).astype(np.float64), begin[-1]).astype(_U) for x in (g[member], g[member] >> _U(32)))
            owner = np.repeat(np.arange(rows), m)
            part = np.arange(begin[-1]) - begin[owner]
            empty = np.bincount(owner, n == 0, rows) > spare[np.maximum(tag, 0)]
            use = (n > 0) | empty[owner]
            value = mix(low + mix(high + mix((tag[owner].astype(_U) << _U(32)) + part.astype(_U) + _U(3 << 60))))
            add(owner[use], value[use])
    if not of:
        return print_, np.zeros(0, np.int64), np.zeros(0, _U)
    return print_, np.concatenate(of), np.concatenate(sig)


_LIST = "sig long, doc long, head long"


def _entries(t: Threshold, limit: int, key: str, text: str):
    """List entries ``sig, doc`` of a task's rows, and links ``sig, doc, head`` where a block already holds a smaller member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, prints, of, sigs, held, base = [], [], [], [], 0, 0

        def combined() -> pa.RecordBatch:
            doc, mark = np.concatenate(docs), np.concatenate(prints)
            order = np.lexsort((doc, mark))
            same = np.concatenate([[False], mark[order[1:]] == mark[order[:-1]]])
            copies = np.zeros(len(doc), dtype=bool)
            copies[order[same]] = True  # equal sets in the block: the smallest one stands for all
            o, s = np.concatenate(of), np.concatenate(sigs)
            stays = ~copies[o]
            has = mark != 0
            d, s = np.concatenate([doc[o[stays]], doc[has]]), np.concatenate([s[stays], mark[has]])
            order = np.argsort(s)
            d, s = d[order], s[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            low = np.minimum.reduceat(d, new) if len(s) else d
            head = np.repeat(low, np.diff(np.append(new, len(s))))
            far = np.flatnonzero(d != head)
            # an entry for the smallest member of each list, a link for each of the others
            return pa.record_batch({"sig": pa.array(np.concatenate([s[new], s[far]]).view(np.int64)), "doc": pa.array(np.concatenate([low, d[far]])),
                                    "head": pa.concat_arrays([pa.nulls(len(new), pa.int64()), pa.array(head[far], pa.int64())])})

        for batch in batches:
            ids = batch[key].to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            for part in text_blocks(batch[text]):
                mark, o, s = signatures(part, t, limit)
                docs.append(ids[at:at + len(part)])
                prints.append(mark)
                of.append(o + base)
                sigs.append(s)
                at, base, held = at + len(part), base + len(part), held + len(s)
                if held >= COMBINE:
                    yield combined()
                    docs, prints, of, sigs, held, base = [], [], [], [], 0, 0
        if docs:
            yield combined()

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by list and document become links to the first document of the list; links pass."""
    last, first = None, None
    for batch in batches:
        known = batch["head"].is_valid().to_numpy(zero_copy_only=False)
        sig, doc = batch["sig"].to_numpy(), batch["doc"].to_numpy()
        s, d = sig[~known], doc[~known]
        if len(s):
            new = np.concatenate([[last is None or s[0] != last], s[1:] != s[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            head = np.where(at >= 0, d[np.maximum(at, 0)], first if first is not None else 0)
            last, first = s[-1], head[-1]
            use = ~new & (d != head)
            s, d, head = s[use], d[use], head[use]
        else:
            head = d
        passed = batch.filter(pa.array(known))
        yield pa.record_batch({"sig": np.concatenate([s, passed["sig"].to_numpy()]), "doc": np.concatenate([d, passed["doc"].to_numpy()]),
                               "head": np.concatenate([head, passed["head"].to_numpy()])})


def n_shingles(text: Column, words: int) -> Column:
    @F.arrow_udf("long")
    @handing_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.bincount(shingle_sets(p, words)[0], minlength=len(p)) for p in text_blocks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return run(text)


def _sketch(text: Column, t: Threshold) -> Column:
    """Size of each set and, for buckets of shingles, whether it holds an odd number of them: as bits of 64-bit numbers.

    Two sets differ in no fewer shingles than their sketches in bits. The number of buckets is a power of two and follows the size, so sets
    that link only by chance look alike at any size; sketches of twice the buckets fold into those of half.
    """
    @F.arrow_udf("struct<n:bigint,bits:array<bigint>>")
    @handing_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in text_blocks(texts):
                row, g = shingle_sets(part, t.words)
                n = np.bincount(row, minlength=len(part))
                most = (t.den - t.num) * (n + t.den * n // t.num) // (t.den + t.num)
                size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, SKETCH * most))).astype(np.int64))
                at = np.concatenate([[0], np.cumsum(size)])
                bucket = (mix(g + _U(7)) & (size[row] - 1).astype(_U)).astype(np.int64)
                odd = np.bincount(at[row] + bucket, minlength=at[-1]) & 1
                bits = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(at // 64, pa.int32()), pa.array(bits))
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], ["n", "bits"])

    return run(text)


def _bits_apart(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded."""
    def folded(a: Column, b: Column) -> Column:
        n = F.size(b)
        half = F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(a) > n, half).otherwise(a)

    apart = F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(apart, F.lit(0), lambda total, n: total + n)


_COMPARED = "a long, b long, n long, n_b long, apart long"


def _members(batches: Iterator[pa.RecordBatch], t: Threshold) -> Iterator[list]:
    """The members in pieces: (a, b, members of b, set, sets of b's texts). In a block the texts of b come first; a set is sorted hashes."""
    block, heads = None, []
    for batch in batches:
        at = 0
        for part in text_blocks(batch["text"]):
            row, g = shingle_sets(part, t.words)
            order = np.lexsort((g, row))
            row, g = row[order], g[order]
            first = np.searchsorted(row, np.arange(len(part) + 1))
            ids = [batch[c].slice(at, len(part)).to_pylist() for c in ("a", "b", "block", "k")]
            out = []
            for i, (a, b, piece, k) in enumerate(zip(*ids)):
                own = g[first[i]:first[i + 1]]
                if (b, piece) != block:
                    block, heads = (b, piece), []
                if a is not None:
                    if len(own) and heads:
                        out.append((a, b, k, own, heads))
                elif len(own) and not any(np.array_equal(own, h) for h in heads):
                    heads.append(own.copy())
            if out:
                yield out
            at += len(part)


def _in(own: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``own`` are in ``head``, and where; both sorted."""
    place = np.minimum(np.searchsorted(head, own), len(head) - 1)
    both = head[place] == own
    return both, place[both]


def _compared(t: Threshold):
    """In how many shingles each member is apart from its b; of several texts of b the nearest counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _members(batches, t):
            out = []
            for a, b, _, own, heads in piece:
                found = [(len(own), len(h), len(own) + len(h) - 2 * int(_in(own, h)[0].sum())) for h in heads]
                n, m, apart = min(found, key=lambda x: x[2] / (x[0] + x[1]))
                out.append((a, b, n, m, apart))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n", "n_b", "apart"])

    return run


def _against(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs ``a, b`` of documents the rows that :func:`_members` reads.

    Pairs are grouped by b, in blocks: the text of b travels once to each block, that of a once to each of its pairs.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = pairs.groupBy("b").agg(F.count("*").alias("k")).withColumnRenamed("b", "b_")
    block = F.pmod(F.xxhash64("a"), F.ceil(F.col("k") / MEMBERS)).alias("block")
    dealt = staged(pairs.join(count, F.col("b") == F.col("b_")).select("a", "b", block, "k"))
    # few pairs go to where the texts are; if they are not few, both are shuffled
    members = texts.join(broadcast_if_small(dealt), F.col("a") == F.col("id")).select("a", "b", "block", "k", "text")
    heads = texts.join(broadcast_if_small(dealt.select("b", "block", "k").distinct()), F.col("b") == F.col("id"))
    rows = members.unionByName(heads.select(F.lit(None).cast("long").alias("a"), "b", "block", "k", "text"))
    # a hash of both: blocks of one document go to many tasks
    return rows.repartition(parts, "b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first(), F.xxhash64("text"))


def _marks(texts: DataFrame, t: Threshold) -> DataFrame:
    """Size and sketch of each set."""
    s = texts.select(F.col("id").alias("m"), _sketch(F.col("text"), t).alias("s"))
    return s.select("m", F.col("s.n").alias("n"), F.col("s.bits").alias("bits"))


def _verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, t: Threshold) -> DataFrame:
    """The pairs ``a, b`` that link. Most others are ruled out without loss, by size, then by sketch; only then do texts travel."""
    def sized(side: str) -> DataFrame:
        return marks.select(F.col("m").alias(f"m_{side}"), F.col("n").alias(f"n_{side}"))

    def sketched(side: str) -> DataFrame:
        return marks.select(F.col("m").alias(f"m_{side}"), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))

    n, m = F.col("n_a"), F.col("n_b")
    near = pairs.join(sized("a"), F.col("a") == F.col("m_a")).join(sized("b"), F.col("b") == F.col("m_b"))
    near = staged(near.where(t.den * F.least(n, m) >= t.num * F.greatest(n, m)).select("a", "b").distinct())
    near = near.join(sketched("a"), F.col("a") == F.col("m_a")).join(sketched("b"), F.col("b") == F.col("m_b"))
    near = near.where((t.num + t.den) * _bits_apart(F.col("bits_a"), F.col("bits_b")) <= (t.den - t.num) * (n + m))
    found = _against(staged(near.select("a", "b").distinct()), texts).mapInArrow(handing_back(_compared(t)), _COMPARED)
    return found.where(_links(F.col("apart"), F.col("n"), F.col("n_b"), t)).select("a", "b").distinct()


def _links(apart: Column, n: Column, m: Column, t: Threshold) -> Column:
    return (t.num + t.den) * apart <= (t.den - t.num) * (n + m)


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, component`` of every document that links with another one, ``component`` the smallest doc_id reachable.

    Ids are whole numbers. Null and empty texts link with nothing, nor do rows without a doc_id. Rows that repeat a
    doc_id are one document and link if any of their texts does. Other columns are ignored.
    """
    t = Threshold(num, den, words)
    limit = boundary(t)
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = texts.mapInArrow(handing_back(_entries(t, limit, "id", "text")), _LIST)
    lists = entries.repartition(parts, "sig").sortWithinPartitions("sig", "doc").mapInArrow(_heads, _LIST)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), written(lists) as links_by_list, written(_marks(texts, t)) as marks:
        release(spark)
        return _joined_up(links_by_list, texts, marks, t)


def _joined_up(lists: DataFrame, texts: DataFrame, marks: DataFrame, t: Threshold) -> DataFrame:
    """Components from the links ``sig, doc, head`` that may hold; all that is returned has been computed."""
    pairs = staged(lists.groupBy(F.col("doc").alias("a"), F.col("head").alias("b")).agg(F.max(F.col("sig") % 2 != 0).alias("equal")))
    sure = pairs.where("equal").select("a", "b")
    links = staged(sure.unionByName(_verified(pairs.where("not equal").select("a", "b"), texts, marks, t)))
    release(texts.sparkSession)
    found = staged(components(links))

    # members of lists that hold three documents or more and do not lie in one component yet
    members = lists.select("sig", "doc").unionByName(lists.select("sig", F.col("head").alias("doc"))).distinct()
    members = members.join(found, F.col("doc") == F.col("node"), "left").select("sig", "doc", F.coalesce("component", "doc").alias("comp"))
    open_ = members.groupBy("sig").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_ = open_.where("n > 2 and low <> high").select(F.col("sig").alias("open"))
    edges = staged(lists.join(open_, F.col("sig") == F.col("open")).select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct())
    if edges.isEmpty():
        return found
    more = _across(edges, found, links, texts, marks, pairs, t)
    return staged(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))


def _frequencies(words: int):
    """How many shingles of a task fall into each of the fixed number of buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, dtype=np.int64)
        for batch in batches:
            for part in text_blocks(batch["text"]):
                total += np.bincount((shingle_sets(part, words)[1] & _U(RARITY - 1)).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "n": total[at]})

    return run


_LISTED = "key long, doc long, place int, small boolean, n long, n_b long, apart long"


def _listed(t: Threshold, frequency: np.ndarray):
    """Rows of two kinds: a member's sizes (without ``key``), and the rarest of its differences from b, as many as it needs to meet sets with
    more of them that it may link with (``small``), and sets with fewer."""
    def rows(keys: list, docs: list, small: list, sizes: list) -> pa.RecordBatch:
        top = np.array([len(k) for k in keys], dtype=np.int64)
        n, m = int(top.sum()), len(sizes)
        place = np.arange(n) - np.repeat(np.cumsum(top) - top, top)
        doc, *of_set = (np.array(x, dtype=np.int64) for x in zip(*sizes))
        listing = [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(place.astype(np.int32)), pa.array(np.repeat(np.array(small, dtype=bool), top))]
        key, place, small = (pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in listing)
        doc = pa.array(np.concatenate([np.repeat(np.array(docs, dtype=np.int64), top), doc]))
        return pa.RecordBatch.from_arrays([key, doc, place, small, *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in of_set)],
                                          ["key", "doc", "place", "small", "n", "n_b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _members(batches, t):
            keys, docs, smalls, sizes = [], [], [], []
            for a, b, k, own, heads in piece:
                head = heads[0]
                both, place = _in(own, head)
                stays = np.ones(len(head), dtype=bool)
                stays[place] = False
                added, gone = own[~both], head[stays]
                # a shingle of b is a difference of all members that lack it; any order is right, a good one lists what few have
                often = np.concatenate([frequency[(added & _U(RARITY - 1)).astype(np.int64)],
                                        np.maximum(k // 16, k - frequency[(gone & _U(RARITY - 1)).astype(np.int64)])])
                # those of one group only: the document they are measured from is part of the key
                key = mix(np.concatenate([added, gone]) ^ mix(np.array([b]).view(_U))).view(np.int64)
                key = key[np.lexsort((key, often))]
                size, n = len(key), len(own)
                sizes.append((a, n, len(head), size))
                # two sets share half of what both differ by beyond what they may differ in, and at least one
                for small, share in ((True, size - t.differ(n) // 2), (False, size - t.differ(n))):
                    top = size - max(1, share) + 1
                    if size and top > 0:
                        keys.append(key[:top])
                        docs.append(a)
                        smalls.append(small)
            yield rows(keys, docs, smalls, sizes)

    return run


def _across(edges: DataFrame, found: DataFrame, links: DataFrame, texts: DataFrame, marks: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """Links between components among the documents of ``edges`` (a member of an open list, its head).

    Documents that are joined by such edges are a group, and two that link are in one. The member with most links is its
    centre. Two sets x and y differ in |dx| + |dy| - 2 |dx & dy| shingles, where dx and dy are their differences from the centre. Sets that
    link with the centre are in its component. Any other one shares changes with each set it links with, at least half of what both have beyond the
    differences allowed, so that the rarest of them suffice as lists: the smaller set is listed under as many as it needs to meet
    larger ones, the larger one under as many as it needs to meet smaller ones. What meets is compared if places and sizes allow a link.
    """
    spark = texts.sparkSession
    group = staged(components(edges))
    degree = links.groupBy(F.col("b").alias("node_")).agg(F.count("*").alias("k"))
    centre = group.join(degree, F.col("node") == F.col("node_"), "left").groupBy(F.col("component").alias("group_")).agg(
        F.max_by("node", F.struct(F.coalesce("k", F.lit(0)), -F.col("node"))).alias("centre"))
    measured = group.join(centre, F.col("component") == F.col("group_")).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    measured = staged(measured)
    frequency = np.zeros(RARITY, dtype=np.int64)
    for r in texts.mapInArrow(handing_back(_frequencies(t.words)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    listed = _against(measured, texts).mapInArrow(handing_back(_listed(t, frequency)), _LISTED)
    with written(listed) as rows:
        release(spark)
        sizes = rows.where("key is null").select(F.col("doc").alias("d"), "n", "n_b", "apart")
        known = found.select(F.col("node").alias("node_"), "component")
        sizes = sizes.join(known, F.col("d") == F.col("node_"), "left").withColumn("comp", F.coalesce("component", "d")).drop("node_", "component")
        sizes = staged(sizes.withColumn("minor", ~_links(F.col("apart"), F.col("n"), F.col("n_b"), t)))
        sure = sizes.where("not minor").select(F.col("d").alias("a")).join(measured, "a").where("a <> b").select("a", "b")
        entries = rows.where("key is not null").select("key", "doc", "place", "small")
        # a shingle of one document leads nowhere
        several = entries.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select(F.col("key").alias("k"))
        met = entries.join(several, F.col("key") == F.col("k"), "left_semi").join(sizes, F.col("doc") == F.col("d")).drop("d", "n_b")
        met = staged(met)
    x = met.where("small").select("key", *(F.col(c).alias(f"{c}_x") for c in ("doc", "place", "apart", "n", "minor", "comp")))
    y = met.where("not small").withColumnRenamed("key", "key_y")
    shared = F.least(F.col("apart") - F.col("place"), F.col("apart_x") - F.col("place_x"))
    least = (t.num + t.den) * (F.col("apart") + F.col("apart_x") - 2 * shared) <= (t.den - t.num) * (F.col("n") + F.col("n_x"))
    fits = ((F.col("key") == F.col("key_y")) & (F.col("comp") != F.col("comp_x")) & (F.col("minor") | F.col("minor_x")) & (F.col("apart_x") <= F.col("apart"))
            & (t.den * F.least("n", "n_x") >= t.num * F.greatest("n", "n_x")) & least)
    across = x.join(y, fits).select(F.greatest("doc", "doc_x").alias("a"), F.least("doc", "doc_x").alias("b")).distinct()
    seen = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    across = staged(across.join(seen, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"))
    release(spark)
    return staged(sure.unionByName(_verified(across, texts, marks, t)))


def jaccard_groups(docs: DataFrame, num: int = 90, den: int = 100, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; a document without links is its own component, one without an id has none."""
    found = jaccard_components(docs, num, den, words, doc_id, text)
    d = docs.select(F.col(doc_id).alias("doc_id"), n_shingles(F.col(text), words).alias("n_shingles"))
    d = d.join(found, F.col("doc_id") == F.col("node"), "left")
    return d.select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id").cast("long")).alias("component_id"))
