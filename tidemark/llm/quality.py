"""Quality rules from repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, later_copies, mix, sums_between, text_blocks

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

#: N-gram length and largest share of word characters inside repeated n-grams of that length.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Fixed value: largest share of characters inside repeated lines.
LINE_SHARE = 0.20


@dataclass(frozen=True)
class Rules:
    """Limits. ``min_words`` and ``max_repeat_pct`` make the base verdict, the shares the verdict on repetition."""

    min_words: int = 50
    window: int = 3
    max_repeat_pct: int = 50
    line_share: float = LINE_SHARE
    ngram_shares: tuple[tuple[int, float], ...] = tuple(NGRAM_SHARES.items())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars")


def _measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """Counts per text. ``dup_ngram_chars_n``: characters of words inside an n-gram that an earlier n-gram equals."""
    w = Words(texts)
    rows = len(texts)
    chars = w.chars()
    out = {"n_words": np.diff(w.first), "word_chars": w.per_row(chars), "n_symbols": sums_between(_SYMBOL[w.data], w.at)}

    # lines with a word
    newline = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.at[:-1][np.diff(w.at) > 0], newline + 1]))
    start = start[start < len(w.data)]
    row = np.searchsorted(w.at, start, side="right") - 1
    stop = np.append(newline, len(w.data))
    end = np.minimum(stop[np.searchsorted(newline, start)], w.at[row + 1])
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))  # keeps the rows of a block apart
    later, _ = later_copies(w.span_hashes(start, end) ^ salt[row])
    length = w.span_chars(start, end)
    out["n_dup_lines"] = np.bincount(row, later, rows).astype(np.int64)
    out["line_chars"] = np.bincount(row, length, rows).astype(np.int64)
    out["dup_line_chars"] = np.bincount(row, length * later, rows).astype(np.int64)

    # n-grams: one that occurs twice begins where a shorter one occurs twice, so longer ones look at those only
    h = w.hashes()
    at, g = w.ngrams(h, rules.window)
    _, shared = later_copies(g ^ salt[w.row[at]])
    out["n_repeat_words"] = w.per_row(_covered(at[shared], rules.window, len(w)))
    for n, _share in rules.ngram_shares:
        at, g = w.ngrams(h, n, at[shared] if n >= rules.window else None)
        later, shared = later_copies(g ^ salt[w.row[at]])
        out[f"dup_ngram_chars_{n}"] = w.per_row(chars * _covered(at[later], n, len(w)))
    return out


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each word inside one of the n-grams that begin at ``at``."""
    change = np.zeros(size + 1, dtype=np.int64)
    change[:-1] += np.bincount(at, minlength=size)[:size]
    change -= np.bincount(at + n, minlength=size + 1)
    return np.cumsum(change)[:-1] > 0


def repetition(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of counts per text; a null or empty text has zeros. Equal texts have equal counts."""
    if list(dict(rules.ngram_shares)) != sorted(n for n, _ in rules.ngram_shares) or min(dict(rules.ngram_shares)) < rules.window:
        raise ValueError("n-gram lengths must increase and be no shorter than the window")
    names = [*COUNTS, *(f"dup_ngram_chars_{n}" for n, _ in rules.ngram_shares)]

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in names) + ">")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_measure(part, rules) for part in text_blocks(texts)]
            columns = [np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return counts(text)


def base_failed(q: Column, rules: Rules = Rules()) -> Column:
    return (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat_pct * q["n_words"])


def kept(q: Column, rules: Rules = Rules()) -> Column:
    """False if the base verdict fails or repeated lines or n-grams hold more characters than their share."""
    bad = base_failed(q, rules) | (q["dup_line_chars"] > rules.line_share * q["line_chars"])
    for n, share in rules.ngram_shares:
        bad = bad | (q[f"dup_ngram_chars_{n}"] > share * q["word_chars"])
    return ~bad


def quality_rules(docs: DataFrame, text: str = "text", rules: Rules = Rules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, the counts, ``base_failed`` and ``kept``.

    Nothing is shuffled; a text is measured by itself. Null texts have zero counts and fail. Other columns are ignored.
    """
    measured = docs.select(*keep, repetition(docs[text], rules).alias("__q"))
    q = F.col("__q")
    return measured.select(*keep, "__q.*", base_failed(q, rules).alias("base_failed"), kept(q, rules).alias("kept"))
