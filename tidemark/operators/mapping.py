"""Field mapping between source and target schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import MappedField, looks_like_key


def apply_mapping(df: DataFrame, mapping: Sequence[MappedField]) -> DataFrame:
    """Keep the mapped columns under their target names; an empty mapping keeps everything.
    Names match without case; an unknown source column is an error."""
    if not mapping:
        return df
    have = {c.lower(): c for c in df.columns}
    unknown = [m.source for m in mapping if m.source.lower() not in have]
    if unknown:
        raise ValueError(f"mapped source columns not found: {unknown}; have {df.columns}")
    return df.select(*[F.col(have[m.source.lower()]).alias(m.target) for m in mapping])


def auto_map(source: Sequence[str], target: Sequence[str]) -> tuple[list[MappedField], list[str], list[str]]:
    """Pairs with equal names ignoring case, then the unmatched source and target columns."""
    wanted = {t.lower(): t for t in target}
    pairs = [MappedField(s, wanted[s.lower()], looks_like_key(s)) for s in source if s.lower() in wanted]
    used = {p.source.lower() for p in pairs}
    return (pairs, [s for s in source if s.lower() not in used], [t for t in target if t.lower() not in used])


def known_columns(source: DataFrame, target: T.StructType) -> DataFrame:
    """Source columns the target knows, under the target's spelling; the others are dropped."""
    names = {f.name.lower(): f.name for f in target}
    return source.select(*[F.col(c).alias(names[c.lower()]) for c in source.columns if c.lower() in names])
