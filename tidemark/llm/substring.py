"""Substring deduplication: words inside a window whose words also start earlier in the corpus go.

Each window of ``window`` words is known by its minimiser, the smallest hash among its n-grams of words. Consecutive windows with the
same one form a segment, and the minimiser is the segment's key: equal windows have equal keys wherever they stand. Segments
whose key occurs once hold nothing that repeats. Equal segments are collapsed to the first one before the shuffle and after it. The
other different segments of a key lie in one shard: an FM-index is built over them, the segments are streamed through it backwards,
and the matches that reach the window's length tell, for each window, whether the same words start earlier.

A key with very many different segments (a line that many texts share) is cut into its single windows, which have
keys of their own; so no shard grows with one line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import staged

from .fmindex import FMIndex
from .words import Words, blocks, mix, run_hashes, text_blocks

WINDOW, NGRAM = 20, 5
#: Segments that one task combines before they are shuffled, and segments of a shard.
COMBINE, SHARD = 1 << 18, 20_000
#: Least number of different segments of a key that is cut into windows.
FREQUENT = 2000

_U = np.uint64
_VARIANT, _START = 47, 18  # a place: variant of the row, first word (29 bits), number of words
_SIZE = (1 << _START) - 1
_RUN = 4096  # spans joined at most
_ENTRY = "key long, content long, doc long, place long, copy boolean"


def variant(text: Column) -> Column:
    """Tells rows with the same doc_id and other texts apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 16))


def _place(variants: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return variants << _VARIANT | start << _START | size


def _segments(texts: pa.Array, variants: np.ndarray, frequent: np.ndarray, window: int, ngram: int):
    """Row, key, content and place of the segments of a block, and of the windows whose minimiser is frequent."""
    w = Words(texts)
    h = w.hashes()
    at, g = w.ngrams(h, ngram)
    least = np.full(len(w) + window, np.iinfo(_U).max, dtype=_U)
    least[at] = g
    grams = least.copy()
    width = window - ngram + 1
    have = 1
    while have < width:  # the minimum of `have` neighbours becomes that of up to twice as many
        step = min(have, width - have)
        least[:-step] = np.minimum(least[:-step], least[step:])
        have += step
    first = np.arange(len(w))
    first = first[first + window <= w.first[1:][w.row]]
    key = least[first]
    often = np.isin(key, frequent) if len(frequent) else np.zeros(len(key), bool)
    single = first[often]
    runs, key = first[~often], key[~often]
    # a run ends where its minimiser, the leftmost if several are equal, is left behind; so equal windows are in two segments
    new = np.ones(len(runs), bool)
    new[1:] = (key[1:] != key[:-1]) | (runs[1:] != runs[:-1] + 1) | (grams[runs[:-1]] == key[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(runs))) + window - 1
    start = runs[head]
    content = run_hashes(h, start, start + size)
    row = w.row[start]
    if np.diff(w.first).max(initial=0) >> _VARIANT - _START:
        raise ValueError("a text has more words than a place can number")
    places = _place(variants[row], start - w.first[row], size)
    srow = w.row[single]
    own = run_hashes(h, single, single + window)
    return (np.concatenate([row, srow]), np.concatenate([key[head], mix(run_hashes(mix(h + _U(5)), single, single + window))]),
            np.concatenate([content, own]), np.concatenate([places, _place(variants[srow], single - w.first[srow], window)]))


def _joined(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words, those of one text that touch or overlap made one (as far as a place can hold it)."""
    if not len(doc):
        return doc, place
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    begin, size = place >> _START, place & _SIZE
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > (begin + size)[:-1])
    head = np.flatnonzero(new)
    head = np.concatenate([h + np.arange(0, n, _RUN) for h, n in zip(head, np.diff(np.append(head, len(doc))), strict=True)])
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], place[head] >> _START << _START | (begin[last] + size[last] - begin[head])


def _collected(window: int, ngram: int, frequent: list[int], counts_only: bool):
    """Entries of a task's rows, equal segments of a block behind the first one marked as copies; or the number of entries per key."""
    often = np.sort(np.array(frequent, dtype=np.int64).view(_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.RecordBatch:
            doc, key, content, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, doc, content, key))
            doc, key, content, place = doc[order], key[order].view(np.int64), content[order].view(np.int64), place[order]
            if not len(key):
                copy = np.zeros(0, bool)
            else:
                copy = np.concatenate([[False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])])
            if counts_only:
                keys, n = np.unique(key[~copy], return_counts=True)
                return pa.record_batch({"key": keys, "n": n.astype(np.int64)})
            lead = np.maximum.accumulate(np.where(copy, 0, np.arange(len(key))))
            again = copy & ((doc != doc[lead]) | (place != place[lead]))  # a repeated row is not a copy of itself
            d, p = _joined(doc[again], place[again])
            k = mix(d.view(_U) + p.view(_U)).view(np.int64)  # copies are decided and go anywhere
            key, content, doc, place = (np.concatenate([x[~copy], y]) for x, y in ((key, k), (content, k), (doc, d), (place, p)))
            return pa.record_batch({"key": key, "content": content, "doc": doc, "place": place, "copy": np.arange(len(key)) >= len(key) - len(k)})

        for batch in batches:
            ids, variants, at = batch["id"].to_numpy(), batch["variant"].to_numpy(), 0
            for part in text_blocks(batch["text"]):
                row, *rest = _segments(part, variants[at:at + len(part)], often, window, ngram)
                held.append((ids[at:at + len(part)][row], *rest))
                at, size = at + len(part), size + len(row)
                if size >= COMBINE:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by key, content, doc and place: copies (``copy``), and the first of each content where a key has several."""
    last = None  # key and content of the last entry, its first doc and place
    held: dict[str, np.ndarray] | None = None  # the first entry of the last key
    shown = False
    names = ("key", "content", "doc", "place")
    for batch in batches:
        copies = batch["copy"].to_numpy(zero_copy_only=False)
        passed = {n: batch[n].to_numpy()[copies] for n in names}
        e = {n: batch[n].to_numpy()[~copies] for n in names}
        out = [passed]
        if len(e["key"]):
            prev = {n: np.concatenate([[last[n] if last else 0], e[n][:-1]]) for n in ("key", "content")}
            fresh = (e["key"] != prev["key"]) | (e["content"] != prev["content"])
            if last is None:
                fresh[0] = True
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
            lead_doc, lead_place = (np.where(lead >= 0, e[n][np.maximum(lead, 0)], last[n] if last else 0) for n in ("doc", "place"))
            later = ~fresh & ((e["doc"] != lead_doc) | (e["place"] != lead_place))
            out.append({n: e[n][later] for n in names})
            last = {"key": e["key"][-1], "content": e["content"][-1], "doc": lead_doc[-1], "place": lead_place[-1]}
            r = {n: e[n][fresh] for n in names}
            was = np.zeros(len(r["key"]), bool)
            if held is not None:
                r = {n: np.concatenate([held[n], r[n]]) for n in names}
                was = np.concatenate([[shown], was])
            begin = np.flatnonzero(np.concatenate([[True], r["key"][1:] != r["key"][:-1]]))
            count = np.diff(np.append(begin, len(r["key"])))
            several = np.repeat(count > 1, count)
            held, shown = {n: r[n][begin[-1]:begin[-1] + 1] for n in names}, bool(was[begin[-1]] or count[-1] > 1)
            first = {n: r[n][several & ~was] for n in names}
        else:
            first = {n: e[n] for n in names}
        found = {n: np.concatenate([x[n] for x in out]) for n in names}
        copy = np.concatenate([np.ones(len(found["key"]), bool), np.zeros(len(first["key"]), bool)])
        yield pa.record_batch({n: np.concatenate([found[n], first[n]]) for n in names} | {"copy": pa.array(copy)})


def _cut(doc_id: str, text: str):
    """``key, doc, place, words`` of the wanted segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, text)):
            keys, docs, places, texts = [], [], [], []
            for t, found in zip(batch[text], batch["__w"].to_pylist(), strict=True):
                words = t.as_buffer().to_pybytes().split()
                for x in found["wanted"]:
                    start, size = x["place"] >> _START & (1 << _VARIANT - _START) - 1, x["place"] & _SIZE
                    keys.append(x["key"])
                    docs.append(found["d"])
                    places.append(x["place"])
                    texts.append(b" ".join(words[start:start + size]))
            yield pa.record_batch({"key": pa.array(keys, pa.int64()), "doc": pa.array(docs, pa.int64()), "place": pa.array(places, pa.int64()),
                                   "words": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def _matched(window: int):
    """The places of a shard's segments that repeat an earlier place: one FM-index, all segments through it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        doc, place = table["doc"].to_numpy(), table["place"].to_numpy()
        w = Words(table["words"].chunk(0))
        index = FMIndex(w.hashes(), w.first, window)
        seq, at, group = index.windows(np.diff(w.first))
        begin = place >> _START  # variant and first word
        begin = begin[seq] + at
        order = np.lexsort((begin, doc[seq]))
        rank = np.empty(len(order), np.int64)  # equal places are one
        b, d = begin[order], doc[seq][order]
        rank[order] = np.cumsum(np.concatenate([[0], (b[1:] != b[:-1]) | (d[1:] != d[:-1])]))
        earliest = np.full(len(index.same[1]), np.iinfo(np.int64).max)
        np.minimum.at(earliest, group, rank)
        again = np.flatnonzero(rank > earliest[group])
        again = again[np.lexsort((at[again], seq[again]))]
        s, a = seq[again], at[again]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] != a[:-1] + 1)]) if len(s) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(s))) + window - 1
        yield pa.record_batch({"doc": doc[s[head]], "place": begin[again[head]] << _START | size})

    return run


def _usable(doc_id: str, text: str) -> Column:
    return F.col(doc_id).isNotNull() & F.col(text).isNotNull()


def _same_text(doc_id: str, text: str, doc: str, of: str) -> Column:
    return (F.col(doc_id).cast("long") == F.col(doc)) & (variant(F.col(text)) == F.col(of))


def repeated_places(docs: DataFrame, window: int = WINDOW, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, variant, spans``: for each text with repeated windows the runs of words they cover, ``array<struct<start,stop>>``."""
    spark = docs.sparkSession
    known = docs.where(_usable(doc_id, text))
    texts = known.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = texts.withColumn("variant", variant(F.col("text")))

    # keys with so many different segments that one partition would stand out; at most half as many as partitions
    seen = Observation()
    counts = marked.mapInArrow(_collected(window, ngram, [], True), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = staged(counts.observe(seen, F.sum("n").alias("total")).where(F.col("n") > FREQUENT))
    bound = max(FREQUENT, 2 * (seen.get["total"] or 0) // parts)
    frequent = [r["key"] for r in counts.where(F.col("n") > bound).collect()]

    entries = marked.mapInArrow(_collected(window, ngram, frequent, False), _ENTRY)
    found = entries.repartition(parts, "key").sortWithinPartitions("key", "content", "doc", "place").mapInArrow(_repeats, _ENTRY)
    found = staged(found)
    several = found.where("not copy")
    shards = max(1, -(-several.count() // SHARD))
    wanted = several.groupBy(F.col("doc").alias("d"), F.shiftright("place", _VARIANT).alias("v")).agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    wanted = known.join(wanted.select(F.struct("*").alias("__w")), _same_text(doc_id, text, "__w.d", "__w.v"))
    segments = wanted.mapInArrow(_cut(doc_id, text), "key long, doc long, place long, words string").repartition(shards, "key")
    matched = segments.mapInArrow(_matched(window), "doc long, place long")
    spans = found.where("copy").select("doc", "place").unionByName(matched)
    start = F.shiftright("place", _START).bitwiseAND(F.lit((1 << _VARIANT - _START) - 1))
    span = F.struct(start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(_SIZE))).alias("stop"))
    return spans.groupBy("doc", F.shiftright("place", _VARIANT).alias("variant")).agg(F.collect_list(span).alias("spans"))


def _left(texts: pa.Array, gone: pa.Array) -> pa.Array:
    total, removed, kept = [], [], []
    for t, cuts in zip(texts, gone, strict=True):
        words = t.as_buffer().to_pybytes().split() if t.is_valid else []
        total.append(len(words))
        if cuts.is_valid:
            stay = np.ones(len(words), dtype=bool)
            for a, b in zip(cuts.values.field("start").to_pylist(), cuts.values.field("stop").to_pylist(), strict=True):
                stay[a:b] = False
            words = [words[i] for i in np.flatnonzero(stay)]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words))
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                      ["n_words", "n_removed", "kept"])


def _without(text: Column, spans: Column) -> Column:
    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            at = 0
            for part in text_blocks(texts):  # the texts left are as large as the texts, so they go out in small pieces
                yield _left(part, gone.slice(at, len(part)))
                at += len(part)

    return run(text, spans)


def substring_dedup(docs: DataFrame, window: int = WINDOW, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text",
                    out: str = "dedup") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_removed, spans (those found, null if none) and kept (words left, a space between).

    Earlier means a smaller doc_id, or the same one and an earlier start. Windows are judged on the input. Null and empty texts have
    no words. Rows without a doc_id are kept whole and nothing is earlier because of them. Equal rows are one text and
    all keep what it keeps; rows of one doc_id with other texts come in a fixed order of their texts. A column ``out`` of ``docs`` is replaced.
    """
    # both joins with the texts ask for the same columns in the same order, so Spark shuffles the texts once
    p = repeated_places(docs, window, ngram, doc_id, text).select(F.struct("*").alias("__p"))
    d = docs.where(_usable(doc_id, text)).join(p, _same_text(doc_id, text, "__p.doc", "__p.variant"), "left")
    rest = docs.where(~_usable(doc_id, text)).withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType))
    names = [c for c in docs.columns if c != out]
    d = d.unionByName(rest).select(*names, F.col("__p.spans").alias("__spans")).withColumn("__d", _without(F.col(text), F.col("__spans")))
    return d.select(*names, F.struct("__d.n_words", "__d.n_removed", F.col("__spans").alias("spans"), "__d.kept").alias(out))
