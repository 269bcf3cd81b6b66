"""Registered queries: merges, ranges, resume, jobs and the streaming upsert."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timing import ntz
from tidemark.operators import discovery, mapping, merge, ranges
from tidemark.plans import job, state
from tidemark.plans.fixtures import NOW, SAVED_COMPLETED, SAVED_GAPS
from tidemark.plans.registry import query
from tidemark.plans.state import StateTable
from tidemark.session import scratch_path, staged
from tidemark.sinks.versioned import VersionedTable
from tidemark.spec import MappedField, SyncMode, SyncSpec
from tidemark.streaming import marker as marker_stream
from tidemark.streaming import upsert as stream

KEY = ["o_orderkey"]
COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _upsert_oracle(src: str = "orders_src", written=COLS) -> str:
    """Update matched rows, add the absent ones; columns that are not written keep or get NULL."""
    upd = ", ".join(f"case when s.o_orderkey is not null then s.{c} else t.{c} end as {c}" if c in written else f"t.{c}"
                    for c in COLS)
    ins = ", ".join(f"s.{c}" if c in written else "null" for c in COLS)
    return f"""
select t.o_orderkey, {upd}, t.tgt_only from orders_tgt t left join {src} s on t.o_orderkey = s.o_orderkey
union all
select s.o_orderkey, {ins}, null from {src} s where not exists
  (select 1 from orders_tgt t where t.o_orderkey = s.o_orderkey)"""


ABSENT_ORACLE = f"""
select * from orders_tgt union all
select s.o_orderkey, {', '.join('s.' + c for c in COLS)}, null from orders_src s where not exists
  (select 1 from orders_tgt t where t.o_orderkey = s.o_orderkey)"""
APPEND_ORACLE = f"select * from orders_tgt union all select o_orderkey, {', '.join(COLS)}, null from orders_src"
REPLACE_ORACLE = f"select o_orderkey, {', '.join(COLS)}, cast(null as varchar) as tgt_only from orders_src"


@query("merge_upsert", _upsert_oracle())
def merge_upsert(t):
    return merge.upsert(t.orders_tgt, t.orders_src, KEY)


@query("merge_upsert_shuffled", _upsert_oracle())
def merge_upsert_shuffled(t):
    return merge.upsert(t.orders_tgt, t.orders_src, KEY, small=False)


@query("merge_partial", _upsert_oracle(written=["o_totalprice"]))
def merge_partial(t):
    return merge.upsert(t.orders_tgt, t.orders_src.select("o_orderkey", "o_totalprice"), KEY)


@query("insert_if_absent", ABSENT_ORACLE)
def insert_if_absent(t):
    return merge.insert_absent(t.orders_tgt, t.orders_src, KEY)


@query("insert_only", APPEND_ORACLE)
def insert_only(t):
    return merge.append(t.orders_tgt, t.orders_src)


@query("clean_insert_whole", f"select o_orderkey, {', '.join(COLS)}, cast(null as varchar) as tgt_only from orders")
def clean_insert_whole(t):
    """A full load: all orders replace the stale target."""
    return merge.replace(t.orders_tgt, t.orders)


MERGE_COUNTS = """
with j as (select t.o_orderkey as tk, s.o_custkey is not distinct from t.o_custkey
                  and s.o_orderstatus is not distinct from t.o_orderstatus
                  and s.o_totalprice is not distinct from t.o_totalprice
                  and s.o_orderdate is not distinct from t.o_orderdate
                  and s.o_orderpriority is not distinct from t.o_orderpriority as same
           from orders_src s left join orders_tgt t on s.o_orderkey = t.o_orderkey)
select case when tk is null then 'insert' when same then 'unchanged' else 'update' end as kind, count(*) as n_rows
from j group by 1"""


@query("merge_counts", MERGE_COUNTS)
def merge_counts(t):
    return merge.change_counts(t.orders_tgt, t.orders_src, KEY)


@query("classify_bitmap", MERGE_COUNTS)
def classify_bitmap(t):
    """As merge_counts, but keys that the target lacks are told from bitmaps of its keys; only the others meet its rows."""
    bitmaps = staged(discovery.key_bitmaps(t.orders_tgt, "o_orderkey"))
    changes = discovery.classify_by_bitmap(t.orders_tgt, t.orders_src, "o_orderkey", bitmaps)
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"))


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LAST_LINE = ("row_number() over (partition by l_orderkey, l_linenumber "
             "order by l_shipdate desc, l_partkey desc, l_suppkey desc)")


@query("dedupe_last_wins", f"select * from lineitem qualify {LAST_LINE} = 1")
def dedupe_last_wins(t):
    return merge.last_wins(t.lineitem, LINE_KEY, LINE_ORDER)


@query("merge_composite", f"""
with tgt as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, 0.0::double as l_quantity, l_extendedprice, l_discount,
                    l_tax, l_returnflag, l_linestatus, l_shipdate
             from lineitem where l_shipdate <= timestamp '1999-01-01 00:00:00' qualify {LAST_LINE} = 1),
     src as (select * from lineitem where l_shipdate > timestamp '1998-01-01 00:00:00' qualify {LAST_LINE} = 1)
select * from src union all
select * from tgt t where not exists
  (select 1 from src s where s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber)""")
def merge_composite(t):
    old = t.lineitem.where("l_shipdate <= timestamp_ntz '1999-01-01 00:00:00'")
    new = t.lineitem.where("l_shipdate > timestamp_ntz '1998-01-01 00:00:00'")
    target = merge.last_wins(old, LINE_KEY, LINE_ORDER).withColumn("l_quantity", F.lit(0.0))
    return merge.upsert(target, staged(merge.last_wins(new, LINE_KEY, LINE_ORDER)), LINE_KEY)


@query("merge_keys_only", "select distinct c_nationkey, c_mktsegment from customer")
def merge_keys_only(t):
    keys = ["c_nationkey", "c_mktsegment"]
    target = t.customer.where("c_acctbal < 0").select(*keys).distinct()
    return merge.upsert(target, t.customer.select(*keys).distinct(), keys)


@query("merge_union_batches", f"""
with urgent as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice, o_orderdate, o_orderpriority
                from orders_src where o_orderpriority = '1-URGENT'),
     batches as (select * from urgent union all
                 select * from orders_src where o_orderkey not in (select o_orderkey from urgent))
{_upsert_oracle('batches')}""")
def merge_union_batches(t):
    src = t.orders_src
    batches = [src.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    batches.append(src.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return merge.upsert(t.orders_tgt, staged(merge.union_batches(batches, KEY)), KEY)


MODES = {"merge": (SyncMode.MERGE, False, _upsert_oracle()), "insert_only": (SyncMode.INSERT_ONLY, False, APPEND_ORACLE),
         "clean_insert": (SyncMode.CLEAN_INSERT, False, REPLACE_ORACLE), "no_update": (SyncMode.MERGE, True, ABSENT_ORACLE)}


@query("apply_mode", " union all ".join(
    f"select '{name}' as mode, count(*) as n_rows, cast(sum(cast(o_totalprice as decimal(18,3))) as double) as price_sum "
    f"from ({sql})" for name, (_, _, sql) in MODES.items()))
def apply_mode(t):
    out = None
    for name, (mode, no_update, _) in MODES.items():
        rows = merge.apply_mode(t.orders_tgt, t.orders_src, KEY, mode, no_update)
        part = rows.agg(F.lit(name).alias("mode"), F.count(F.lit(1)).alias("n_rows"),
                        F.sum(F.col("o_totalprice").cast("decimal(18,3)")).cast("double").alias("price_sum"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- ranges and resume

RANGES_ORACLE = """
ranges as (
  select batch_no, min(prev_m) filter (where first_of_batch) as lo, max(m) as hi, cast(sum(n) as bigint) as n_rows from (
    select *, row_number() over (partition by batch_no order by m) = 1 as first_of_batch from (
      select m, n, lag(m) over (order by m) as prev_m,
             cast(floor((sum(n) over (order by m) - n) / 1000) as bigint) as batch_no
      from (select l_shipdate as m, count(*) as n from lineitem group by l_shipdate))) group by batch_no)"""


@query("batch_ranges", f"with {RANGES_ORACLE} select * from ranges")
def batch_ranges(t):
    return ranges.plan_ranges(t.lineitem, "l_shipdate", 1000)


def _with_progress(t):
    """Every seventh batch is still open."""
    return batch_ranges(t).withColumn("done", F.col("batch_no") % 7 != 3)


DONE_ORACLE = RANGES_ORACLE + ", progress as (select *, batch_no % 7 <> 3 as done from ranges)"
WATERMARK = """select count(*) filter (where not done) as open_ranges,
       coalesce(min_by(lo, batch_no) filter (where not done), max(hi)) as completed from progress"""


@query("completed_watermark", f"with {DONE_ORACLE} {WATERMARK}")
def completed_watermark(t):
    return ranges.completed_watermark(_with_progress(t))


@query("checkpoint_roundtrip", f"""
with {DONE_ORACLE}, mark as ({WATERMARK})
select (select completed from mark) as completed, lo, hi from progress where not done""")
def checkpoint_roundtrip(t):
    progress = staged(_with_progress(t))  # a row per range
    completed = ranges.completed_watermark(progress).select("completed").scalar()
    saved = ranges.encode_checkpoint(progress.where(~F.col("done")), completed)
    return ranges.decode_checkpoint(saved, "timestamp_ntz")


IN_GAPS = " or ".join(f"(event_id > {lo} and event_id <= {hi})" for lo, hi in SAVED_GAPS)


@query("resume_rows", f"select * from events where {IN_GAPS} or event_id > {SAVED_COMPLETED}")
def resume_rows(t):
    return ranges.resume_rows(t.events, "event_id", SAVED_GAPS, SAVED_COMPLETED)


@query("many_windows", """
with ranges as (
  select batch_no, max(m) as hi, min(prev_m) filter (where first_of_batch) as lo from (
    select *, row_number() over (partition by batch_no order by m) = 1 as first_of_batch from (
      select m, lag(m) over (order by m) as prev_m, cast(floor((sum(n) over (order by m) - n) / 20) as bigint) as batch_no
      from (select l_shipdate as m, count(*) as n from lineitem group by l_shipdate))) group by batch_no)
select l.l_orderkey, l.l_linenumber, l.l_shipdate, r.batch_no from lineitem l left join (select * from ranges where batch_no % 2 = 1) r
on l.l_shipdate <= r.hi and (r.lo is null or l.l_shipdate > r.lo)""")
def many_windows(t):
    """Every line with the window that holds it, if it is one of every other of some thousand planned windows."""
    planned = ranges.plan_ranges(t.lineitem, "l_shipdate", 20).where("batch_no % 2 = 1")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return ranges.window_of(lines, "l_shipdate", planned).select("*", "window.batch_no").drop("window")


@query("sketch_ranges", """
with m as (select case when l_orderkey % 3 = 0 then timestamp '1995-06-17 00:00:00' else l_shipdate end as m from lineitem)
select 'every row in its range' as what, count(m) as n_rows from m
union all select 'ranges as large as asked for', 1
union all select 'range of the hot marker ends with it', count(*) from (select distinct m from m where m = timestamp '1995-06-17 00:00:00')
union all select 'first without start, last up to the end', count(*) from (select max(m) from m)""")
def sketch_ranges(t):
    """A third of the lines share one marker; each range is counted again by the merge of windows and rows."""
    hot = ntz("1995-06-17 00:00:00")
    lines = t.lineitem.select(F.when(F.col("l_orderkey") % 3 == 0, hot).otherwise(F.col("l_shipdate")).alias("m"))
    parts = 40
    planned = staged(ranges.sketch_ranges(lines, "m", parts))
    again = ranges.window_of(lines, "m", planned).where("window is not null").groupBy("window.batch_no").agg(F.count(F.lit(1)).alias("again"))
    planned = planned.join(again, "batch_no", "left")
    # a part, the error at its two ends, and the ties that stay together
    ties = lines.groupBy("m").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.when(F.col("m") != hot, F.col("n")))).scalar()
    n = lines.agg(F.count("m")).scalar()
    room = n * (1 / parts + 2 * ranges.sketch_error(ranges.sketch_size(parts))) + 2 * ties
    holds_hot = (F.col("hi") == hot)
    facts = planned.agg(F.sum(F.when(F.col("again") == F.col("n_rows"), F.col("n_rows"))).alias("n"),
                        F.bool_and((F.col("n_rows") <= room) | holds_hot).cast("long").alias("even"), F.count_if(holds_hot).alias("hot"),
                        F.count_if(F.col("lo").isNull()).alias("first"), F.max("hi").alias("end"))
    ends = F.when(F.col("end") == lines.agg(F.max("m")).scalar(), F.col("first"))
    rows = (("every row in its range", "n"), ("ranges as large as asked for", "even"), ("range of the hot marker ends with it", "hot"))
    return facts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("what"), F.col(c).alias("n_rows")) for x, c in rows], F.struct(
        F.lit("first without start, last up to the end").alias("what"), ends.alias("n_rows")))))


@query("gap_replay", f"select * from events where {IN_GAPS}")
def gap_replay(t):
    return ranges.read_windows(t.events, "event_id", SAVED_GAPS)


@query("pause_vs_stop", f"""
select 'pause' as action, count(*) as n_rows from events where {IN_GAPS} or event_id > {SAVED_COMPLETED}
union all select 'stop', count(*) from events""")
def pause_vs_stop(t):
    """What the run after a pause and after a stop reads, by running it from the saved state."""
    parts = []
    for action in ("pause", "stop"):
        spec = SyncSpec(action, keys=("event_id",), marker="event_id")
        table, state_table = _stored(t, f"after-{action}", t.events, ["event_id"])
        gaps = [(str(lo), str(hi)) for lo, hi in SAVED_GAPS]
        state_table.save(spec.task_id, NOW, "paused", None, gaps, str(SAVED_COMPLETED), backfilled=True)
        if action == "stop":
            state_table.stop(spec.task_id, NOW)
        job.run_sync(t.events, table, spec, state_table)
        parts.append(table.read().agg(F.lit(action).alias("action"), F.count(F.lit(1)).alias("n_rows")))
    return parts[0].unionByName(parts[1])


@query("null_marker_backfill", "select * from events_nm where ts is null and event_type <> 'view'")
def null_marker_backfill(t):
    return ranges.without_marker(t.events_nm, "ts", "event_type <> 'view'")


@query("all_null_fallback", "select event_id, cast(null as timestamp) as ts, user_id, event_type, value, props from events")
def all_null_fallback(t):
    unmarked = t.events.select("event_id", F.lit(None).cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
                               "value", "props")
    target = t.events.where("event_type = 'view'")
    return merge.upsert(target, ranges.without_marker(unmarked, "ts"), ["event_id"])


# ---- jobs

ORDERS = SyncSpec("orders", keys=("o_orderkey",), marker="o_orderdate")


@query("sync_incremental", f"""
with increment as (select * from orders where o_orderdate > timestamp '1999-06-01 00:00:00')
{_upsert_oracle('increment')}""")
def sync_incremental(t):
    """The stale target as a table, and a task whose earlier run stored the marker."""
    table, state_table = _stored(t, "sync-incremental", t.orders_tgt, KEY)
    table.write(t.orders_tgt)
    state_table.save(ORDERS.task_id, NOW, "stopped", "1999-06-01", backfilled=True)
    job.run_sync(t.orders, table, ORDERS, state_table)
    return table.read()


@query("sync_full", f"""
select l_orderkey as ORDER_ID, l_linenumber as LINE_NO, l_partkey as PART_ID, l_suppkey as SUPPLIER_ID,
       l_extendedprice as PRICE, l_shipdate as SHIPPED_AT
from lineitem qualify {LAST_LINE} = 1""")
def sync_full(t):
    names = {"l_orderkey": "ORDER_ID", "l_linenumber": "LINE_NO", "l_partkey": "PART_ID", "l_suppkey": "SUPPLIER_ID",
             "l_extendedprice": "PRICE", "l_shipdate": "SHIPPED_AT"}
    spec = SyncSpec("lines", keys=("ORDER_ID", "LINE_NO"), mode=SyncMode.CLEAN_INSERT,
                    mapping=tuple(MappedField(s, g) for s, g in names.items()),
                    order=("SHIPPED_AT", "PART_ID", "SUPPLIER_ID"))
    table, state_table = _stored(t, "sync-full", mapping.apply_mapping(t.lineitem, spec.mapping), list(spec.keys))
    job.run_sync(t.lineitem, table, spec, state_table)
    return table.read()


def _stored(t, name, source, keys, buckets=8):
    """A fresh versioned table and task state below the shared folder."""
    path = scratch_path(t.spark, name)
    return VersionedTable(t.spark, f"{path}/table", source.schema, keys, buckets), StateTable(t.spark, f"{path}/state")


@query("run_twice", f"""
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders
where o_orderdate > timestamp '2000-01-01 00:00:00' union all
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders_tgt""")
def run_twice(t):
    """A first run loads the stale rows and stores its marker, a second one reads only what lies beyond it."""
    table, state_table = _stored(t, "run-twice", t.orders, KEY)
    job.run_sync(t.orders_tgt.drop("tgt_only"), table, ORDERS, state_table)
    job.run_sync(t.orders, table, ORDERS, state_table)
    return table.read()


@query("run_resumed", f"select * from lineitem qualify {LAST_LINE} = 1")
def run_resumed(t):
    """A run in four marker windows is paused after the second; the next run resumes with the saved ones."""
    spec = SyncSpec("lines", keys=tuple(LINE_KEY), marker="l_shipdate", order=("l_partkey", "l_suppkey"))
    table, state_table = _stored(t, "run-resumed", t.lineitem, LINE_KEY)
    asked = []

    def pause():
        asked.append(True)
        return len(asked) > 2
    job.run_sync(t.lineitem, table, spec, state_table, parts=4, should_stop=pause)
    job.run_sync(t.lineitem, table, spec, state_table)
    return table.read()


@query("marker_advance", """
select task_id, max(end_time) as last_marker from run_log where status = 2 group by task_id""")
def marker_advance(t):
    """The markers of all tasks are stored after the runs up to noon of the day, and moved on after the others."""
    _, state_table = _stored(t, "marker-advance", t.run_log, ["id"])
    for log in (t.run_log.where(F.col("end_time") <= ntz(NOW)), t.run_log):
        state_table.advance(state.advance(log.withColumn("task_id", F.col("task_id").cast("string"))), NOW)
    return state_table.newest().select(F.col("task_id").cast("bigint").alias("task_id"),
                                       F.col("last_marker").cast("timestamp_ntz").alias("last_marker"))


@query("marker_replay", """
select event_type, count(*) as n_rows from events where ts > timestamp '2024-01-25 00:00:00' group by event_type""")
def marker_replay(t):
    return state.replayed(t.events, "ts", "2024-01-25").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("multi_table_sync", " union all ".join(
    f"select '{name}' as table_name, count(*) as n_rows, cast(sum({key}) as bigint) as key_sum from {name}"
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))))
def multi_table_sync(t):
    """Each item is a full run into a table of its own."""
    keys, jobs = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}, {}
    for name, key in keys.items():
        table, state_table = _stored(t, f"multi-{name}", getattr(t, name), [key])
        jobs[name] = (getattr(t, name), table, SyncSpec(name, keys=(key,), mode=SyncMode.CLEAN_INSERT))
    failed = [r for r in job.run_tables(jobs, state_table).values() if isinstance(r, Exception)]
    if failed:
        raise failed[0]
    parts = [table.read().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(keys[name]).alias("key_sum"))
             for name, (_, table, _) in jobs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("run_timestamp_marker", "select o_orderkey, epoch_us(o_orderdate) as micros, o_totalprice from orders")
def run_timestamp_marker(t):
    """A marker that is a point in time, stored by the first run and read by the second, in windows."""
    source = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("changed"), "o_totalprice")
    spec = SyncSpec("instants", keys=("o_orderkey",), marker="changed")
    table, state_table = _stored(t, "run-instants", source, KEY)
    job.run_sync(source.where("changed <= timestamp '2000-01-01 00:00:00'"), table, spec, state_table, parts=2)
    job.run_sync(source, table, spec, state_table, parts=2)
    return table.read().select("o_orderkey", F.unix_micros("changed").alias("micros"), "o_totalprice")


@query("run_null_backfill_resumed", "select event_id, ts, user_id, event_type, value, props from events_nm")
def run_null_backfill_resumed(t):
    """Rows without a marker are a window like the others: a run that is paused before it comes back to them."""
    spec = SyncSpec("unmarked", keys=("event_id",), marker="ts")
    table, state_table = _stored(t, "run-unmarked", t.events_nm, ["event_id"])
    job.run_sync(t.events_nm, table, spec, state_table, parts=3, should_stop=lambda: True)
    job.run_sync(t.events_nm, table, spec, state_table)
    return table.read()


@query("run_insert_all_null", "select event_id, user_id, event_type from events")
def run_insert_all_null(t):
    """Plain inserts of rows that have no marker at all happen once."""
    source = t.events.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    table, state_table = _stored(t, "run-inserts", source, ["event_id"])
    for _ in range(2):
        job.run_sync(source, table, SyncSpec("inserts", keys=("event_id",), marker="ts", mode=SyncMode.INSERT_ONLY), state_table)
    return table.read().select("event_id", "user_id", "event_type")


@query("merge_duplicate_target", f"""
with t as (select * from orders_tgt union all select * from orders_tgt where o_orderkey % 3 = 0),
     kinds as (select s.o_orderkey, case when count(t.o_orderkey) = 0 then 'insert'
                      when bool_and({' and '.join(f's.{c} is not distinct from t.{c}' for c in COLS)}) then 'unchanged' else 'update' end as kind
               from orders_src s left join t on s.o_orderkey = t.o_orderkey group by s.o_orderkey)
select 'kind ' || kind as what, count(*) as n_rows from kinds group by kind
union all select 'merged', (select count(*) from t) + (select count(*) from kinds where kind = 'insert')""")
def merge_duplicate_target(t):
    """A key that the target has twice is one source row still."""
    target = t.orders_tgt.unionByName(t.orders_tgt.where("o_orderkey % 3 = 0"))
    changes = staged(merge.classify(target, t.orders_src, KEY))
    merged = merge.apply_classified(target, changes, KEY, True)
    kinds = changes.groupBy(F.concat(F.lit("kind "), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n_rows"))
    return kinds.unionByName(merged.agg(F.lit("merged").alias("what"), F.count(F.lit(1)).alias("n_rows")))


@query("stream_upsert", """
select user_id, event_id, ts, event_type, value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def stream_upsert(t):
    """All events in four batches whose order is not that of the marker, so later batches meet newer rows."""
    path = scratch_path(t.spark, "stream-upsert")
    columns = ["user_id", "event_id", "ts", "event_type", "value"]
    t.events.select(*columns).repartitionByRange(4, F.pmod(F.xxhash64("event_id"), F.lit(1000))).write.parquet(f"{path}/in")
    table = stream.target(t.spark, f"{path}/table", t.events.select(*columns).schema, ["user_id"], buckets=8)
    source = stream.read_files(t.spark, f"{path}/in", "*.parquet", t.events.select(*columns).schema, files_per_batch=1)
    stream.run_available(source, table, ["ts", "event_id"], f"{path}/progress")
    return table.read()


@query("stream_by_marker", """
select user_id, event_id, ts, event_type, value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def stream_by_marker(t):
    """The events as a stream of marker windows, stopped after two batches and started again from the stored marker."""
    columns = ["user_id", "event_id", "ts", "event_type", "value"]
    events = t.events.select(*columns)
    spec = SyncSpec("events", keys=("user_id",), marker="ts", order=("event_id",))
    path = scratch_path(t.spark, "stream-by-marker")
    table, state_table = _stored(t, "stream-table", events, ["user_id"])
    n = -(-events.count() // 5)
    marker_stream.run(events, table, spec, state_table, path, n, max_batches=2)
    marker_stream.run(events, table, spec, state_table, path, n)
    return table.read()


@query("blob_coerce", """
select doc_id, case when text is null or trim(text) = '' then null else md5(text) end as content_md5 from documents where doc_id is not null and doc_id % 3 <> 0""")
def blob_coerce(t):
    """Texts as data URIs into a binary column through a run; those of every third row are no base64 and are rejected."""
    coded = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", ""))
    content = F.when(F.col("doc_id") % 3 == 0, "%no base64%").when(F.trim("text") != "", coded)
    source = t.documents.select("doc_id", content.alias("content"))
    path = scratch_path(t.spark, "blob-coerce")
    table = VersionedTable(t.spark, f"{path}/table", T.StructType.fromDDL("doc_id bigint, content binary"), ["doc_id"], 8)
    job.run_sync(source, table, SyncSpec("blobs", keys=("doc_id",)), StateTable(t.spark, f"{path}/state"))
    return table.read().select("doc_id", F.md5("content").alias("content_md5"))


@query("coerce_fraction", """
select event_id, cast(v as bigint) as whole, cast(w as decimal(12,2)) as two_digits, cast(d as date) as day from (
  select event_id, case when event_id % 4 = 0 then floor(value) + 0.5 else floor(value) end as v,
         case when event_id % 5 = 0 then floor(value) + 0.125 else floor(value) + 0.25 end as w,
         case when event_id % 7 = 0 then date_trunc('day', ts) + interval 1 second else date_trunc('day', ts) end as d from events)
where event_id % 4 <> 0 and event_id % 5 <> 0 and event_id % 7 <> 0""")
def coerce_fraction(t):
    """What a narrower type would cut is rejected by the run: fractions, digits, times of day."""
    e, value, day = F.col("event_id"), F.floor("value").cast("double"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    source = t.events.select("event_id", F.when(e % 4 == 0, value + 0.5).otherwise(value).alias("whole"),
                             F.when(e % 5 == 0, value + 0.125).otherwise(value + 0.25).alias("two_digits"),
                             F.when(e % 7 == 0, day + F.make_dt_interval(secs=F.lit(1))).otherwise(day).alias("day"))
    path = scratch_path(t.spark, "coerce-fraction")
    table = VersionedTable(t.spark, f"{path}/table", T.StructType.fromDDL("event_id bigint, whole bigint, two_digits decimal(12,2), day date"), ["event_id"], 8)
    job.run_sync(source, table, SyncSpec("fractions", keys=("event_id",)), StateTable(t.spark, f"{path}/state"))
    return table.read()
