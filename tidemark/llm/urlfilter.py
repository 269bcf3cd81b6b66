"""URL filters: dated list entries become validity intervals; an as-of join finds those active when a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a time bucket of the join. An interval is joined in each bucket it touches, so that a rule with a long
#: history does not meet all captures of a frequent host.
BUCKET_SECONDS = 32 * 86400


def intervals(entries: DataFrame) -> DataFrame:
    """``list_id, rule, valid_from, valid_to`` (open: null) from ``list_id, rule, action, dated``.

    An ``add`` holds until the next entry of the same list and rule, whatever that is; a repeated ``add`` begins a new interval.
    Of entries at the same time a ``remove`` counts last. Entries with a null in any of these columns are ignored.
    """
    history = Window.partitionBy("list_id", "rule").orderBy("dated", "action")
    d = entries.dropna(subset=["list_id", "rule", "action", "dated"]).select("list_id", "rule", "action", "dated")
    d = d.withColumn("valid_to", F.lead("dated").over(history))
    d = d.where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("dated"))))
    return d.select("list_id", "rule", F.col("dated").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """Lower-cased host without user and port; null if the URL has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def url_rules(url: Column) -> Column:
    """The rules a URL can meet: ``||domain`` for its host and each parent, ``|host/path/`` for each folder of its path."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("||"), F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    folders = F.split(F.regexp_replace(path, r"[^/]*$", ""), "/")  # '', 'a', 'b', ''
    prefixes = F.transform(F.sequence(F.lit(1), F.size(folders) - 1),
                           lambda i: F.concat(F.lit("|"), host, F.concat_ws("/", F.slice(folders, 1, i)), F.lit("/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, F.when(F.size(folders) > 1, prefixes).otherwise(F.array().cast("array<string>")))))


def filter_urls(captures: DataFrame, valid: DataFrame, kinds: dict[str, str], page: str = "page_id", url: str = "url",
                fetched: str = "fetched_at", bucket: int = BUCKET_SECONDS) -> DataFrame:
    """``page, url, fetched`` with n_block, n_allow, verdict and the strongest rule, judged by the entries active at fetch time.

    ``kinds`` says for each list_id whether it blocks or allows. An allowing rule wins over blocking ones. Equal rows of
    ``captures`` are one capture. A null or odd URL meets no rule and a null time no entry: the verdict is ``pass``.
    No captures give no rows, and without entries every capture passes. Other columns are ignored, whatever their names; a very long URL has
    a key per parent of its host. Times are whole seconds. Only keys and times are shuffled, never page bodies, and a join with frequent
    hosts is split by Spark, as its sides are shuffled for it alone.
    """
    c = captures.select(page, url, fetched).distinct()
    keys = c.select(page, url, fetched, F.explode_outer(url_rules(F.col(url))).alias("rule"), F.floor(F.col(fetched) / bucket).alias("bucket"))
    last = c.agg(F.max(fetched).alias("last"))  # one row
    v = valid.crossJoin(F.broadcast(last)).where(F.col("valid_from") <= F.col("last"))
    span = F.sequence(F.floor(F.col("valid_from") / bucket), F.floor(F.least(F.col("valid_to") - 1, F.col("last")) / bucket))
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)) if kinds else F.create_map().cast("map<string,string>")
    v = v.select(F.col("rule").alias("v_rule"), F.explode(span).alias("v_bucket"), "valid_from", "valid_to", kind[F.col("list_id")].alias("kind"))
    at = F.col(fetched)
    active = ((F.col("rule") == F.col("v_rule")) & (F.col("bucket") == F.col("v_bucket")) & (F.col("valid_from") <= at)
              & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
    met = keys.join(v, active, "left")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = met.groupBy(page, url, fetched).agg(n("block").alias("n_block"), n("allow").alias("n_allow"),
                                              F.min(F.when(F.col("kind") == "allow", F.col("rule"))).alias("__allow"),
                                              F.min(F.when(F.col("kind") == "block", F.col("rule"))).alias("__block"))
    verdict = F.when(F.col("n_allow") > 0, "allow").when(F.col("n_block") > 0, "block").otherwise("pass")
    return out.select(page, url, fetched, "n_block", "n_allow", verdict.alias("verdict"), F.coalesce("__allow", "__block").alias("rule"))
