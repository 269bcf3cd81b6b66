import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.plans.state import StateTable, TaskBusy
from tidemark.spec import SyncSpec
from tidemark.streaming import marker
from tidemark.streaming import upsert as stream

SCHEMA = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string, value double"


def expected(df):
    from tidemark.operators import merge
    return rows(merge.last_wins(df, ["user_id"], ["ts", "event_id"]))


@pytest.fixture
def setup(spark, tables, tmp_path):
    events = tables.events.select("user_id", "event_id", "ts", "event_type", "value")
    folder, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = stream.target(spark, str(tmp_path / "table"), events.schema, ["user_id"], buckets=4)

    def add(part):
        part.coalesce(1).write.mode("append").parquet(folder)

    def go(**kw):
        source = stream.read_files(spark, folder, "*.parquet", events.schema, **kw)
        stream.run_available(source, table, ["ts", "event_id"], progress)
    return events, table, add, go, folder, progress


def test_arriving_files_are_merged_once(setup):
    events, table, add, go, _, _ = setup
    early, late = events.where("event_id < 400"), events.where("event_id >= 400")
    add(early)
    go()
    assert rows(table.read()) == expected(early)
    version = table.current()
    go()
    assert table.current() == version
    add(late)
    go()
    assert rows(table.read()) == expected(events)


def test_a_repeated_batch_does_nothing(setup):
    events, table, _, _, _, _ = setup
    write = stream.batch_writer(table, ["ts", "event_id"])
    write(events.where("event_id < 400"), 0)
    before, version = rows(table.read()), table.current()
    write(events, 0)
    assert table.current() == version and rows(table.read()) == before
    write(events.where("event_id >= 400").union(events.limit(1).withColumn("user_id", F.lit(None).cast("bigint"))), 1)
    assert rows(table.read()) == expected(events)


def test_stopping_leaves_a_resume_point(spark, setup):
    events, table, add, go, folder, progress = setup
    for lo, hi in ((0, 300), (300, 600), (600, 2000)):
        add(events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)))
    source = stream.read_files(spark, folder, "*.parquet", events.schema, files_per_batch=1)
    query = stream.start(source, table, ["ts", "event_id"], progress, trigger={"processingTime": "200 milliseconds"})
    query.processAllAvailable()
    query.stop()
    done = table.current()
    assert rows(table.read()) == expected(events) and done == 3
    add(events.limit(1).withColumn("user_id", F.lit(-5).cast("bigint")))
    go()
    assert table.current() == done + 1 and table.read().where("user_id = -5").count() == 1


def test_an_older_row_of_a_later_batch_changes_nothing(spark, setup):
    events, table, _, _, _, _ = setup
    write = stream.batch_writer(table, ["ts", "event_id"])
    row = lambda ts, n: spark.sql(f"select 1L as user_id, {n}L as event_id, timestamp_ntz '{ts}' as ts, 'x' as event_type, 1.5D as value")
    write(row("2024-01-09 00:00:00", 9), 0)
    write(row("2024-01-03 00:00:00", 3), 1)
    assert [r["event_id"] for r in table.read().collect()] == [9]
    write(row("2024-01-09 00:00:00", 10), 2)
    assert [r["event_id"] for r in table.read().collect()] == [10]


@pytest.fixture
def by_marker(spark, tables, tmp_path):
    events = tables.events.select("user_id", "event_id", "ts", "event_type", "value")
    table = stream.target(spark, str(tmp_path / "table"), events.schema, ["user_id"], buckets=4)
    states, spec = StateTable(spark, str(tmp_path / "state")), SyncSpec("events", keys=("user_id",), marker="ts", order=("event_id",))
    return events, table, states, lambda df, **k: marker.run(df, table, spec, states, str(tmp_path / "progress"), **k)


def test_a_stream_in_marker_order_stops_and_goes_on_from_its_offset(by_marker, tmp_path):
    events, table, states, run = by_marker
    assert run(events, rows_per_batch=200, max_batches=2) == 2
    reached = states.latest("events").last_marker
    done = events.where(F.col("ts") <= F.lit(reached).cast("timestamp_ntz"))
    assert 0 < done.count() < events.count() and rows(table.read()) == expected(done)
    offsets = sorted((tmp_path / "progress" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    assert json.loads(offsets[1].read_text().splitlines()[-1]) == {"marker": reached}
    # a batch that was broken off before Spark noted it comes again
    assert run(events, rows_per_batch=200) in (3, 4) and rows(table.read()) == expected(events)
    assert run(events, rows_per_batch=200) == 0


def test_a_stream_takes_what_has_arrived_beyond_its_marker(by_marker):
    events, table, states, run = by_marker
    early = events.where("ts <= timestamp_ntz '2024-01-15 00:00:00'")
    assert run(early, rows_per_batch=10_000) == 1 and rows(table.read()) == expected(early)
    more = events.unionByName(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("user_id", F.lit(-7).cast("bigint")))
    assert run(more, rows_per_batch=300) == 2 and rows(table.read()) == expected(events)
    with states.claim("events"), pytest.raises(TaskBusy):
        run(events)


def test_a_batch_that_was_committed_but_not_recorded_changes_nothing(by_marker, monkeypatch):
    events, table, states, run = by_marker
    real = StateTable.save

    def lost(*a, **k):
        raise SystemError("lost")
    monkeypatch.setattr(StateTable, "save", lost)
    with pytest.raises(Exception):
        run(events, rows_per_batch=500)
    assert table.current() == 1
    monkeypatch.setattr(StateTable, "save", real)
    assert run(events, rows_per_batch=500) == 2
    assert table.current() == 2 and rows(table.read()) == expected(events)
