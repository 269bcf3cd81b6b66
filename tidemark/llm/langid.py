"""Language identification of words by a linear-chain conditional random field, for texts that switch languages.

A word's emission score is the sum of learned weights of its features: byte n-grams, affixes and the word itself
(lexicon). Learned transitions tie neighbouring words; forward-backward gives each word's distribution over
languages. A document's language has the largest mean over its words with letters, which is also the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, handing_back, mix, text_blocks

#: Bound of the training sample: texts per language and characters per text. Longer texts are not sampled.
SAMPLE_TEXTS, SAMPLE_CHARS = 150, 8000
BUCKETS = 1 << 17
NGRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3)
UNKNOWN = "und"
#: Words times labels that are decoded together: a step costs the same for few sequences as for many, so that many long texts should share it.
DECODE_CELLS = 1 << 21
#: Bytes of text whose words get their features together.
FEATURE_BYTES = 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Distinct:
    """Distinct words of a block with their feature buckets; ``of[i]`` is the distinct word of word i."""

    def __init__(self, w: Words):
        h = w.hashes()
        unique, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        start, size = w.start[at], w.end[at] - w.start[at]
        n = len(at)
        # the words side by side with a space (a byte no word has) on both sides
        first = np.concatenate([[0], np.cumsum(size + 2)])
        body = np.full(first[-1], 32, dtype=np.uint8)
        inner = np.repeat(first[:-1] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if n else np.zeros(0, np.int64)
        body[inner] = w.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())] if n else 0
        word = np.repeat(np.arange(n), size + 2)
        self.letters = np.bincount(word, _LETTER[body], n) > 0 if n else np.zeros(0, bool)
        b = body.astype(np.uint64)
        owner, bucket = [np.arange(n)], [mix(unique + np.uint64(7))]
        g = b.copy()
        for k in range(2, max(*NGRAMS, *AFFIXES) + 2):
            g = g[:-1] * np.uint64(257) + b[k - 1:] if len(b) >= k else g[:0]
            inside = word[:len(g)] == word[k - 1:] if len(g) else np.zeros(0, bool)
            if k in NGRAMS:
                owner.append(word[:len(g)][inside])
                bucket.append(mix(g[inside] + np.uint64(k << 40)))
            if k - 1 in AFFIXES and len(g):  # with the space before or after it
                long = np.flatnonzero(size + 2 >= k)
                for kind, pos in ((64, first[:-1][long]), (96, first[1:][long] - k)):
                    owner.append(long)
                    bucket.append(mix(g[pos] + np.uint64(kind + k << 40)))
        self.n, self.owner = n, np.concatenate(owner)
        self.bucket = (np.concatenate(bucket) % np.uint64(BUCKETS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Emission scores per distinct word and label; words without a letter have none."""
        out = np.stack([np.bincount(self.owner, weights[self.bucket, k], self.n) for k in range(weights.shape[1])], axis=1)
        return out * self.letters[:, None]


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, as a column; of many short rows by adding columns in order, which gives the same numbers faster."""
    if len(x) < 128 or not 1 < x.shape[1] < 8:
        return np.add.reduce(x, axis=1, keepdims=True)
    total = x[:, :1] + x[:, 1:2]
    for k in range(2, x.shape[1]):
        total += x[:, k:k + 1]
    return total


class Lattice:
    """Sequences side by side: step t of all sequences longer than t lies together, longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[self.order]
        steps = int(sorted_[0]) if len(sorted_) else 0
        self.active = np.searchsorted(-sorted_, -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        seq = np.concatenate([np.arange(a) for a in self.active]) if steps else np.zeros(0, np.int64)
        self.place = begin[seq]  # of each cell, the word in the original order
        self.place += np.repeat(np.arange(steps), self.active)
        self.seq = self.order[seq]  # and the sequence

    def marginals(self, emission: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
        """Each word's distribution (original order), and with ``pairs`` the sum of the pairwise ones and of the first ones.

        ``emission``, ``trans`` and ``start`` are positive factors, not logarithms.
        """
        gamma, total, first = self.decoded(emission[self.place].astype(np.float32), trans, start, pairs)
        out = np.empty_like(gamma)
        out[self.place] = gamma
        return (out, total, first) if pairs else out

    def decoded(self, e: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distributions of the cells, in their order, with the sums of the pairwise ones (if asked for) and of the first ones.

        ``e`` has the factors of the cells, as an array of its own: they are overwritten.
        """
        shape, trans = trans.shape, trans.astype(np.float32)
        alpha, steps = np.empty_like(e), len(self.active)
        at = self.offset.tolist()
        prev = start.astype(np.float32)
        for t in range(steps):
            a, b = at[t], at[t + 1]
            x = alpha[a:b]
            if t:
                np.matmul(prev[:b - a], trans, out=x)
                x *= e[a:b]
            else:
                np.multiply(prev, e[a:b], out=x)
            x /= _sums(x)
            prev = x
        total = np.zeros(shape)
        back = trans.T.copy()
        for t in range(steps - 2, -1, -1):
            a, b, c = at[t], at[t + 1], at[t + 2]
            nxt, left = e[b:c], alpha[a:a + c - b]  # the next cells' factors times what follows them
            if pairs:
                z = _sums((left @ trans) * nxt)
                total += (left / z).T @ nxt * trans
            into = nxt @ back
            into /= _sums(into)
            e[a:a + c - b] *= into
            left *= into
        alpha /= _sums(alpha)
        first = alpha[:self.active[0]].sum(axis=0) if steps else np.zeros(shape[0])
        return alpha, total, first


def factors(scores: np.ndarray) -> np.ndarray:
    """Scores as positive factors, the largest 1; bounded, so that no product of a row vanishes."""
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30.0)) if scores.size else scores


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its label (-1: no word with a letter) and its score."""
        sums, counts = [], []
        held: list[tuple] = []  # of each block: words of its texts, of each word the distinct one, their factors, whether they have letters

        def decode():
            lengths = np.concatenate([x[0] for x in held])
            base = np.cumsum([0, *(len(x[2]) for x in held)])
            lattice = Lattice(lengths)
            of = np.concatenate([x[1] + n for x, n in zip(held, base, strict=False)])[lattice.place]
            table, letters = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])[of]
            held.clear()
            p = lattice.decoded(table[of], np.exp(self.trans), np.exp(self.start))[0]
            sums.append(np.stack([np.bincount(lattice.seq, p[:, k] * letters, len(lengths)) for k in range(p.shape[1])], axis=1))
            counts.append(np.bincount(lattice.seq, letters, len(lengths)).astype(np.int64))

        size = 0
        for part in text_blocks(texts, FEATURE_BYTES):
            w = Words(part, lower=True)
            d = Distinct(w)
            held.append((np.diff(w.first), d.of.astype(np.int32), factors(d.scores(self.weights)).astype(np.float32), d.letters))
            size += len(w)
            if size * len(self.labels) >= DECODE_CELLS:
                decode()
                size = 0
        if held:
            decode()
        if not sums:
            return np.zeros(0, np.int64), np.zeros(0)
        mean = np.concatenate(sums) / np.maximum(np.concatenate(counts), 1)[:, None]
        best = np.where(np.concatenate(counts) > 0, mean.argmax(axis=1), -1)
        return best, np.clip(np.where(best < 0, 0.0, mean.max(axis=1)), 0.0, 1.0)


    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """Per block of texts: number of runs of each text, and first word, word behind the last and label of each run of words alike."""
        for part in text_blocks(texts):
            w = Words(part, lower=True)
            d = Distinct(w)
            e = factors(d.scores(self.weights))[d.of].astype(np.float32)
            p = Lattice(np.diff(w.first)).marginals(e, np.exp(self.trans), np.exp(self.start))
            # words without a letter belong to no run, nor do they end one
            at = np.flatnonzero(d.letters[d.of] > 0)
            best, row = p[at].argmax(axis=1), w.row[at]
            head = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (row[1:] != row[:-1]))[:len(at)])
            last = np.append(head[1:], len(at))[:len(head)] - 1
            of = row[head]
            yield np.bincount(of, minlength=len(part)), at[head] - w.first[of], at[last] - w.first[of] + 1, best[head]

def train(texts: list[str], langs: list[str], rounds: int = 50, seed: int = 7, l2: float = 1e-4) -> Model:
    """Fit by Adam on whole texts and on seeded sequences that switch between texts every few words."""
    labels = sorted(set(langs))
    w = Words(pa.array(texts, pa.string()), lower=True)
    d = Distinct(w)
    target = np.array([labels.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    pieces = [np.arange(a, b) for a, b in zip(w.first[:-1], w.first[1:], strict=True) if b > a]
    lengths = [len(p) for p in pieces]
    cuts = [x for p in pieces for x in np.split(p, np.cumsum(rng.integers(4, 40, len(p) // 4 + 1)))]
    cuts = [cuts[i] for i in rng.permutation(len(cuts)) if len(cuts[i])]
    for i in range(0, len(cuts), 12):
        pieces += cuts[i:i + 12]
        lengths.append(sum(map(len, cuts[i:i + 12])))
    words = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    lattice, of, y = Lattice(np.array(lengths, dtype=np.int64)), d.of[words], target[w.row[words]]
    n, count = len(labels), max(1, len(words))
    inner = np.ones(len(words), dtype=bool)
    inner[np.cumsum([0, *lengths[:-1]])] = False
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    seen_first = np.bincount(y[~inner], minlength=n)
    truth = np.zeros((d.n, n))
    np.add.at(truth, (of, y), 1)
    params = [np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for r in range(1, rounds + 1):
        e = factors(d.scores(params[0]))[of]
        p, pairs, first = lattice.marginals(e, np.exp(params[1]), np.exp(params[2]), pairs=True)
        seen = np.stack([np.bincount(of, p[:, k], d.n) for k in range(n)], axis=1)
        per_word = (seen - truth) * d.letters[:, None] / count
        grads = [np.stack([np.bincount(d.bucket, per_word[d.owner, k], BUCKETS) for k in range(n)], axis=1),
                 (pairs - seen_pairs) / count, (first - seen_first) / count]
        for k, (p_, g, (m, v)) in enumerate(zip(params, grads, moments, strict=True)):
            g = g + l2 * p_ * (k > 0)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= 0.05 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-12)
    return Model(labels, params[0].astype(np.float32), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, texts_per_lang: int = SAMPLE_TEXTS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``text, lang`` of at most ``texts_per_lang`` different texts of each language, chosen by the hash of their id.

    Texts of up to ``max_chars`` characters come first; of a longer one, taken where these are too few, the first ``max_chars`` are used for
    fitting. Repeated rows are one text.
    """
    fit = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    part = F.substring("text", 1, max_chars)
    fit = fit.where(part.rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"), (F.length("text") > max_chars).alias("long"))
    place = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", F.lit("langid")), "doc_id", "h")
    chosen = fit.select("doc_id", "lang", "h", "long").withColumn("n", F.dense_rank().over(place)).where(F.col("n") <= texts_per_lang)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), F.col("h").alias("hash")).distinct()
    # at most texts_per_lang rows per language
    found = fit.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")) & (F.col("h") == F.col("hash")))
    return found.groupBy("id", "lang", "h").agg(F.first(part).alias("text")).select("text", "lang")


def fit(docs: DataFrame) -> Model | None:
    """A model from the bounded sample, which is all that reaches the driver; None if nothing is labelled."""
    rows = sorted((r["lang"], r["text"]) for r in sample(docs.select("doc_id", "text", "lang")).collect())
    return train([t for _, t in rows], [x for x, _ in rows]) if rows else None


def language(text: Column, model: Model | None) -> Column:
    """A struct of ``lang_pred`` and ``score``: ``und`` and 0 for null texts and texts without a letter."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @handing_back
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best, score = model.label(texts)
            names = np.array([*model.labels, UNKNOWN], dtype=object)[best]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], fields=list(kind))

    und = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return und
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), run(text)).otherwise(und)


def word_languages(text: Column, model: Model) -> Column:
    """The languages of a text's words, as runs ``start, stop, lang`` by word number (``stop`` exclusive); null and empty texts have none."""
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])

    @F.arrow_udf("array<struct<start:bigint,stop:bigint,lang:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(model.labels, dtype=object)
        for texts in batches:
            for n, start, stop, label in model.runs(texts):
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(names[label], pa.string())], fields=list(kind))
                yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), spans)

    return run(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; learns from ``docs`` if no model is given.

    Nothing is shuffled but the sample. Equal texts get equal results, repeated rows and rows without an id are rows like others (the latter are never
    learned from nor held out); null texts and texts without a letter are ``und``; without labelled texts all are; an empty table gives no rows.
    Other columns are ignored.
    """
    model = model or fit(docs)
    p = docs.select("doc_id", language(F.col("text"), model).alias("p"))
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
