"""Secret scans: patterns with a known form, and random strings that cost a tokenizer too many tokens.

A vocabulary of byte pairs holds what its language repeats, so names and words need a token for three characters or more, random
letters and digits one for less than two. A string of letters and digits below a ratio of characters to tokens is a secret, unless it has
the form of a digest of known length or of an identifier. Everything happens inside a text, by code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .words import text_blocks

#: The base patterns in the order of their kinds, and the least length of the group that counts.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Kind of the spans that the token test adds.
RANDOM = "random"
KINDS = (*(name for name, *_ in BASE), RANDOM)
#: Hexadecimal lengths of common digests.
DIGESTS = (32, 40, 56, 64, 96, 128)

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_HEX = re.compile(r"(?:(?:md5|sha\d{1,3})[-=])?([0-9a-fA-F]+)", re.A)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A piece of an identifier: words in camel case or in one case and at most four digits behind, or a number, also of a date with a time.
_PIECE = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Za-z])*\d{0,4}|\d+(?:[A-Za-z]\d{0,4})?")
_SPLIT = re.compile(r"[+/_.=-]+")


@dataclass(frozen=True)
class TokenTest:
    """Limits of the token test: shortest string, most characters per token, and characters that are encoded together."""

    min_chars: int = 16
    max_ratio: float = 2.0
    piece: int = 512


def identifier(s: str) -> bool:
    """Whether a string has the form of a digest, a UUID, a number or a name made of words."""
    if _UUID.fullmatch(s) or (m := _HEX.fullmatch(s)) and len(m[1]) in DIGESTS:
        return True
    if s.isalpha():
        return _words(s)
    if not any(map(str.isalpha, s)):
        return True
    pieces = [x for x in _SPLIT.split(s) if x]
    # short pieces between marks say little; random text of 16 characters or more has longer ones
    return all(_PIECE.fullmatch(x) and (len(x) < 16 or _words(x)) for x in pieces)


def _words(piece: str) -> bool:
    """Whether a long piece is words: few of what its capitals cut are shorter than three letters."""
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", piece)
    return 3 * sum(len(x) < 3 for x in words) <= len(words)


def _in_address(text: str, start: int, stop: int) -> bool:
    """Part of an e-mail address or of a URL."""
    return text[start - 1:start] == "@" or text[stop:stop + 1] == "@" or text.startswith("//", start) and text[start - 1:start] == ":" \
        or text.startswith("www.", start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, stop`` of the base matches that are long enough, sorted."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(_COMPILED):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


_COMPILED = [(name, re.compile(pattern, re.A), group, least) for name, pattern, group, least in BASE]


def random_spans(text: str, encode, test: TokenTest, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``start, kind number, stop`` of strings that fail the token test and overlap nothing in ``taken``."""
    found, at = [], 0
    for m in _candidates(test.min_chars).finditer(text):
        # marks around it are not part of a string, but equal signs may end one
        s = m[0]
        start = m.start() + len(s) - len(s.lstrip("+/_.=-"))
        stop = m.start() + len(s.rstrip("+/_.-"))
        s = text[start:stop]
        if stop - start < test.min_chars or identifier(s) or _in_address(text, m.start(), m.end()):
            continue
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        if any(a < stop and start < b for a, _, b in taken[max(0, at - len(BASE)):at + len(BASE)]):
            continue
        tokens = sum(len(encode(s[i:i + test.piece])) for i in range(0, len(s), test.piece))
        if len(s) < test.max_ratio * tokens:
            found.append((start, len(BASE), stop))
    return found


def _candidates(least: int) -> re.Pattern:
    return re.compile(_CANDIDATE.pattern[:-1] + f"{{{least},}}")


SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def secrets(text: Column, vocabulary: Vocabulary, test: TokenTest = TokenTest()) -> Column:
    """Spans ``kind, start, stop`` per text, see ``scan_secrets``."""
    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = vocabulary.encoder(whole=True)
        for texts in batches:
            for part in text_blocks(texts):
                rows = []
                for t in part.to_pylist():
                    base = base_spans(t or "")
                    every = sorted(base + random_spans(t or "", encode, test, base))
                    rows.append([{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in every])
                yield pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))

    return run(text)


def scan_secrets(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), test: TokenTest = TokenTest()) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and ``spans``, by start, then kind in the order of ``KINDS``.

    Positions count code points, ``stop`` is exclusive. Base spans always stay; a span of kind ``random`` overlaps none of them.
    Null and empty texts have no spans. Repeated rows are rows; an empty table gives none; other columns are ignored.
    """
    return docs.select(*keep, secrets(F.col(text), vocabulary, test).alias("spans"))
