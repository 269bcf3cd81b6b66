import pytest

from conftest import SMALL
from tidemark.llm.queries import workers_find_package

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def llm(spark):
    workers_find_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in each column, empty and very long texts, repeated rows, one id with two texts, clashing column names."""
    passage = " ".join(f"shared{i}" for i in range(45))
    rows = [
        (1, f"alpha beta {passage} gamma", "en", "a"), (2, f"other start {passage}", "en", "a"), (3, passage, None, None),
        (3, passage, None, None), (4, None, "en", "b"), (5, "", "fr", "b"), (6, " \n\t ", None, "a"), (7, "one two", "en", ""),
        (8, "ONE two", "en", "c"), (9, "one two three", "en", "c"), (None, passage, "fr", "c"), (None, None, None, None),
        (10, LONG, "de", "a"), (11, LONG + " end", "de", "a"), (12, "be " * 60, "en", "b"), (13, "été 日本語 \u0085 x y 𝄞", "fr", "d"),
        (14, "12 34 !!", "en", "d"), (15, f"x {passage} y", "en", "d"), (15, f"z z z {passage}", "en", "d"),
    ]
    base = [(i, t, x, s, None if t is None else len(t)) + ("extra",) * 9 for i, t, x, s in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    return llm.createDataFrame(base, names + "".join(f", {c} string" for c in ("id", "doc", "size", "place", "node", "sig", "head", "mix", "dedup")))


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SMALL}/documents.parquet")
