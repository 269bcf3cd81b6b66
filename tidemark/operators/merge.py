"""Merge semantics as pure functions ``(target, source) -> DataFrame``; sinks write the result.

Column rules: the written columns are the source columns the target knows; target-only columns keep
their value on update and are NULL on insert. Keys are unique in the source after :func:`last_wins`. Inserts without a key check
can leave a key in the target more than once: an update then changes all its rows, and a source row still counts once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.mapping import known_columns
from tidemark.operators.sizing import is_small
from tidemark.session import staged
from tidemark.spec import SyncMode

def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order`` (NULL ranks lowest).

    The rank filter is applied per input partition before the shuffle (WindowGroupLimit), so a key
    holding a third of all rows sends at most one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def has_key(keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(mergeable rows, rejected rows without a full key)."""
    return df.where(has_key(keys)), df.where(~has_key(keys))


def _values(keys, columns):
    lower = {k.lower() for k in keys}
    return [c for c in columns if c.lower() not in lower]


def _tagged(source, keys):
    """Source values under private names plus a presence flag, ready to be joined on ``keys``."""
    return source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in _values(keys, source.columns)],
                         F.lit(True).alias("_in_source"))


def _inserts(rows, target):
    """Source rows in the shape of the target; missing columns are NULL."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in target.schema])


def _updated(joined, target, source, keys):
    """Target columns of a join result, overwritten where the source had the key."""
    written = {c.lower(): c for c in _values(keys, source.columns)}
    out = []
    for f in target.schema:
        src = written.get(f.name.lower())
        col = F.col(f.name)
        if src is not None:
            col = F.when(F.col("_in_source"), F.col(f"_s_{src}").cast(f.dataType)).otherwise(col)
        out.append(col.alias(f.name))
    return joined.select(*out)


def _absent_from(source, target, keys, small):
    """Source rows whose key the target lacks. If the source is small, so are the keys found in the target:
    the target is then only filtered by a broadcast of the source keys and never shuffled."""
    if not small:
        return source.join(target.select(*keys), list(keys), "left_anti")
    found = target.select(*keys).join(F.broadcast(source.select(*keys)), list(keys), "left_semi").distinct()
    return source.join(F.broadcast(found), list(keys), "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """Update matched keys, insert the others, keep the rest of the target. The source has one row per key.

    Small source (checked, unless the caller knows): target left join broadcast source, plus the absent source rows; the
    target is not shuffled. Otherwise one full outer join. If every column is a key there is nothing to update.
    """
    source, _ = split_null_keys(known_columns(source, target.schema), keys)
    if not _values(keys, source.columns):
        return insert_absent(target, source, keys, small)
    small = is_small(source) if small is None else small
    tagged = _tagged(source, keys)
    if small:
        updated = _updated(target.join(F.broadcast(tagged), list(keys), "left"), target, source, keys)
        return updated.unionByName(_inserts(_absent_from(source, target, keys, True), target))
    return _updated(target.join(tagged, list(keys), "full_outer"), target, source, keys)


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    """Insert new keys, never touch existing rows."""
    source, _ = split_null_keys(known_columns(source, target.schema), keys)
    small = is_small(source) if small is None else small
    return target.unionByName(_inserts(_absent_from(source, target, keys, small), target))


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    """Plain insert; duplicates stay."""
    return target.unionByName(_inserts(known_columns(source, target.schema), target))


def replace(target: DataFrame, source: DataFrame) -> DataFrame:
    """The source alone, in the shape of the target."""
    return _inserts(known_columns(source, target.schema), target)


def union_batches(batches: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Batches as one source: a later batch wins, inside a batch the last by ``order``."""
    parts = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return last_wins(rows, keys, ["_batch", *order]).drop("_batch")


def classify(target: DataFrame, source: DataFrame, keys: Sequence[str], small: bool | None = None,
             guard: Sequence[str] = ()) -> DataFrame:
    """Source rows with ``kind``: insert, update or unchanged (null-safe comparison of the written columns), or ``stale`` if
    a target row is beyond the source row in the ``guard`` columns (NULL ranks lowest). One row per source row, however
    often the target has its key."""
    source, _ = split_null_keys(known_columns(source, target.schema), keys)
    values = _values(keys, source.columns)
    small = is_small(source) if small is None else small
    tagged = _tagged(source, keys).drop("_in_source")
    types = {f.name.lower(): f.dataType for f in target.schema}
    new = {c.lower(): F.col(f"_s_{c}").cast(types[c.lower()]) for c in values}
    same = functools.reduce(lambda a, b: a & b, [new[c.lower()].eqNullSafe(F.col(c)) for c in values], F.lit(True))
    order = [c for c in guard if c.lower() in new]
    beyond = F.struct(*order) > F.struct(*[new[c.lower()].alias(c) for c in order]) if order else F.lit(False)
    kept = target.select(*keys, *values)
    pairs = kept.join(F.broadcast(tagged) if small else tagged, list(keys))
    pairs = pairs.groupBy(*keys).agg(F.bool_and(same).alias("_same"), F.bool_or(beyond).alias("_beyond"))
    # at most as many rows as the source has
    joined = source.join(F.broadcast(pairs) if small else pairs, list(keys), "left")
    kind = (F.when(F.col("_same").isNull(), "insert").when(F.col("_same"), "unchanged").when(F.col("_beyond"), "stale")
            .otherwise("update"))
    return joined.select(*source.columns, kind.alias("kind"))


def apply_classified(target: DataFrame, changes: DataFrame, keys: Sequence[str], small: bool,
                     no_update: bool = False) -> DataFrame:
    """The target with classified source rows applied. Only the updates meet the target, the inserts are known
    to be absent, and unchanged rows are left out."""
    inserts = _inserts(changes.where("kind = 'insert'").drop("kind"), target)
    if no_update:
        return target.unionByName(inserts)
    updates = changes.where("kind = 'update'").drop("kind")
    tagged = _tagged(updates, keys)
    joined = target.join(F.broadcast(tagged) if small else tagged, list(keys), "left")
    return _updated(joined, target, updates, keys).unionByName(inserts)


def merge_marked(target: DataFrame, source: DataFrame, keys: Sequence[str], place: Sequence[Column], guard: Sequence[str] = ()) -> DataFrame:
    """All rows of both in the shape of the target, with ``_old`` (a row of the target) and ``kind`` as :func:`classify` gives it (NULL: the source
    lacks the key). Rows of the target are as they are after the update. The source has one row per key and columns that are no keys.

    Both are shuffled once and together, by the columns ``place``, which follow from the key and are kept: equal keys lie in one task.
    """
    source, _ = split_null_keys(known_columns(source, target.schema), keys)
    have = {c.lower() for c in _values(keys, source.columns)}
    written = [f.name for f in target.schema if f.name.lower() in have]
    order = [c for g in guard for c in written if c.lower() == g.lower()]
    rows = target.withColumn("_old", F.lit(True)).unionByName(_inserts(source, target).withColumn("_old", F.lit(False)))
    rows = rows.select("*", *place)
    beside = rows.columns[len(target.columns) + 1:]
    group = Window.partitionBy(*beside, *keys)
    old = F.col("_old")
    rows = rows.repartition(*beside).withColumn("_new", F.first(F.when(~old, F.struct(*written)), ignorenulls=True).over(group))
    new = {c: F.col("_new").getField(c) for c in written}
    same = functools.reduce(lambda a, b: a & b, [new[c].eqNullSafe(F.col(c)) for c in written])
    beyond = F.struct(*order) > F.struct(*[new[c].alias(c) for c in order]) if order else F.lit(False)
    rows = rows.withColumns({"_same": F.bool_and(F.when(old, same)).over(group), "_beyond": F.bool_or(F.when(old, beyond)).over(group)})
    kind = (F.when(F.col("_new").isNull(), None).when(F.col("_same").isNull(), "insert").when(F.col("_same"), "unchanged")
            .when(F.col("_beyond"), "stale").otherwise("update"))
    update = old & (F.col("kind") == "update")
    columns = [F.when(update, new[f.name]).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in target.schema]
    return rows.withColumn("kind", kind).select(*columns, "_old", *beside, "kind")


def change_counts(target: DataFrame, source: DataFrame, keys: Sequence[str], small: bool | None = None) -> DataFrame:
    return classify(target, source, keys, small).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


def default_order(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Without a marker the largest values win: arbitrary, but the same on every run."""
    lower = {k.lower() for k in keys}
    return [f.name for f in df.schema if f.name.lower() not in lower and not isinstance(f.dataType, T.MapType)] or list(keys)


def apply_mode(target: DataFrame, source: DataFrame, keys: Sequence[str], mode: SyncMode | int | None = None,
               no_update: bool = False, order: Sequence[str] = (), small: bool | None = None,
               unique: bool = False) -> DataFrame:
    """Rows of any DataFrame applied in the given mode; an unknown mode is MERGE. Unless the caller knows the source to be
    ``unique`` by key, its last row per key by ``order`` is taken first."""
    mode = SyncMode.of(mode)
    if mode == SyncMode.INSERT_ONLY:
        return append(target, source)
    rows = source if unique else last_wins(source.where(has_key(keys)), keys, order or default_order(source, keys))
    if mode == SyncMode.CLEAN_INSERT:
        return replace(target, rows)
    if not unique and small is None:
        rows = staged(rows)  # it is measured first and then used several times
    return insert_absent(target, rows, keys, small) if no_update else upsert(target, rows, keys, small)
