"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizing import BROADCAST_LIMIT_BYTES
from tidemark.session import staged

#: A source's rows are cut into this many slices of the seeded order, so that no running sum crosses a whole source.
SLICES = 4096
#: Bound of one row of the plan, for the check before it is broadcast.
PLAN_ROW_BYTES = 1024


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; null for null."""
    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, counts in batches:
            yield pa.array([None if t is None else _head(t, k) for t, k in zip(texts.to_pylist(), counts.to_pylist(), strict=True)],
                           pa.string())

    return cut(text, n)


def _head(text: str, n: int) -> str:
    end = 0
    for m in islice(re.finditer(r"[^\x20\x09-\x0D]+", text), n):
        end = m.end()
    return text[:end]


def seeded(doc_id: Column, seed: str) -> Column:
    """The seeded place of a document among those of its source, as text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"/{seed}")))


def targets(totals: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``source, source_size`` with the ``target`` of each source.

    Sources by code point, null last, weigh ``weights`` in turn. A source is clamped at ``max_epochs`` times its size if
    its share of what the more easily filled ones leave exceeds that. Sorted by size per weight the clamped ones
    come first, so running sums replace the repeated redistribution. The windows hold a row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    d = totals.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)) for w in weights)), turn).cast("long"))
    d = d.withColumn("level", (F.sum("source_size").over(everything).cast("double") * F.lit(float(share))
                               - (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs).cast("double"))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    clamped = cap <= F.col("level") * F.col("weight").cast("double")
    d = d.withColumn("water", F.max(F.when(~clamped, F.col("level"))).over(everything))
    return d.select("source", "source_size", F.when(clamped, cap).otherwise(F.col("water") * F.col("weight").cast("double")).alias("target"))


def mixing_plan(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per source from ``source, size, place``: source_size, target, whole, and the place where the fraction ends.

    A source takes ``floor(target)`` words: ``whole`` times all its documents and the rest along the seeded places. Places
    below ``cut_place`` (then sizes below ``cut_size``) are taken once more; rows exactly there take ``cut_words`` each.
    """
    slice_of = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    slices = sizes.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("slice_size"))
    slices = staged(slices)
    plan = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    goal = F.floor("target").cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = staged(plan.withColumn("rest", goal - F.col("whole") * F.col("source_size")))

    def cut(parts: DataFrame, size: str, order: list[str], rest: str) -> DataFrame:
        """The row of each source in which the running size passes ``rest``."""
        w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0)))
        return parts.where((F.col("__before") <= F.col(rest)) & (F.col(rest) < F.col("__before") + F.col(size)))

    open_sources = plan.where("rest > 0").select(F.col("source").alias("source_"), "rest")
    same = F.col("source").eqNullSafe(F.col("source_"))
    edge = cut(slices.join(open_sources, same), "slice_size", ["slice"], "rest")
    edge = edge.select("source_", F.col("slice").alias("slice_"), (F.col("rest") - F.col("__before")).alias("rest"))
    ties = sizes.join(small(edge), same & (slice_of == F.col("slice_"))).groupBy("source", "place", "size", "rest").count()
    ties = cut(ties.withColumn("both", F.col("size") * F.col("count")), "both", ["place", "size"], "rest")
    ties = ties.select(F.col("source").alias("source_"), F.col("place").alias("cut_place"), F.col("size").alias("cut_size"),
                       F.floor((F.col("rest") - F.col("__before")) / F.col("count")).alias("cut_words"))
    return staged(plan.join(ties, same, "left").drop("source_", "rest"))


def small(per_source: DataFrame) -> DataFrame:
    """A table with a row per source, broadcast if its counted rows are within the library's bound."""
    per_source = staged(per_source)
    return F.broadcast(per_source) if per_source.count() * PLAN_ROW_BYTES <= BROADCAST_LIMIT_BYTES else per_source


def apply_plan(docs: DataFrame, plan: DataFrame, size: Column, place: Column, source: str = "source", out: str = "mix") -> DataFrame:
    """``docs`` with one more struct ``out``: size, source_size, target, whole, extra and taken (words, repeats counted)."""
    plan = small(plan).select(F.struct("*").alias("__plan"))
    d = docs.withColumns({"__size": size, "__place": place})
    d = d.join(plan, d[source].eqNullSafe(plan["__plan.source"]), "left")
    p = F.col("__plan")
    earlier = (F.col("__place") < p["cut_place"]) | ((F.col("__place") == p["cut_place"]) & (F.col("__size") < p["cut_size"]))
    extra = (F.when(earlier, F.col("__size"))
             .when((F.col("__place") == p["cut_place"]) & (F.col("__size") == p["cut_size"]), p["cut_words"])
             .otherwise(F.lit(0)).cast("long"))
    mix = F.struct(F.col("__size").alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"),
                   p["whole"].alias("whole"), extra.alias("extra"), (p["whole"] * F.col("__size") + extra).alias("taken"))
    return d.select(*(d[c] for c in docs.columns), mix.alias(out))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
                seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source`` and the columns of ``mix`` for each row of ``docs``.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own; rows that
    repeat a doc_id and size share a cut equally, rounded down; an empty table gives no rows; other columns are ignored.
    """
    sizes = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"))
                   .withColumn("place", seeded(F.col("doc_id"), seed)))
    plan = mixing_plan(sizes, weights, share, max_epochs)
    return apply_plan(sizes, plan, F.col("size"), F.col("place")).select("doc_id", "source", "mix.*")


def repeated(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
             seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, one cut to its first words where the fraction ends.

    Null and empty texts have no words and are never taken. A null source is a source of its own, the last one; rows without a doc_id have a
    place like others, and repeated rows are rows. An empty table gives none. All columns of ``docs`` stay.
    """
    size, place = words_of(F.col(text)), seeded(F.col(doc_id), seed)
    sizes = staged(docs.select(F.col(source).alias("source"), size.alias("size"), place.alias("place")))
    mixed = apply_plan(docs, mixing_plan(sizes, weights, share, max_epochs), size, place, source, "__mix")
    m = F.col("__mix")
    times = (m["whole"] + F.when(m["extra"] > 0, 1).otherwise(0)).cast("int")
    mixed = mixed.where(m["taken"] > 0).select("*", F.posexplode(F.array_repeat(F.lit(0), times)).alias("__time", "__0"))
    part = (F.col("__time") == m["whole"]) & (m["extra"] < m["size"])
    cut = first_words(F.when(part, F.col(text)), m["extra"])
    return mixed.select(*(F.when(part, cut).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns))
