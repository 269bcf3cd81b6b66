import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import rows, ts
from tidemark.functions import predicates
from tidemark.operators import ranges


def plan(df, marker, n):
    return sorted(ranges.plan_ranges(df, marker, n).collect(), key=lambda r: r["batch_no"])


def test_ranges_partition_the_rows(tables):
    df = tables.lineitem
    got = plan(df, "l_shipdate", 500)
    assert got[0]["lo"] is None
    assert all(a["hi"] == b["lo"] for a, b in zip(got, got[1:]))
    assert sum(r["n_rows"] for r in got) == df.count()
    for r in got[:3]:
        part = df.where(F.col("l_shipdate") <= r["hi"])
        if r["lo"] is not None:
            part = part.where(F.col("l_shipdate") > r["lo"])
        assert part.count() == r["n_rows"]


def test_a_hot_marker_stays_whole(spark):
    """A third of the rows on one marker value: one larger range, exact counts around it, NULL markers in none."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(500)).when(F.col("id") < 1100, None).otherwise(F.col("id")).alias("m"))
    got = plan(df, "m", 100)
    assert sum(r["n_rows"] for r in got) == 2900
    hot = got[0]
    assert hot["lo"] is None and hot["hi"] == 500 and hot["n_rows"] == 1000
    assert all(r["n_rows"] <= 100 for r in got[1:])
    assert [r["hi"] for r in got[:-1]] == [r["lo"] for r in got[1:]]


def test_ranges_against_a_running_count(spark):
    rng = random.Random(7)
    values = [int(rng.paretovariate(0.7)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "m bigint").repartition(7)
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    want, before, prev = {}, 0, None
    for v in sorted(counts):
        b = before // 50
        lo, _, n = want.get(b, (prev, None, 0))
        want[b] = (lo, v, n + counts[v])
        before, prev = before + counts[v], v
    assert {r["batch_no"]: (r["lo"], r["hi"], r["n_rows"]) for r in plan(df, "m", 50)} == want


def test_many_windows_select_the_same_rows_as_a_scan(spark):
    """Beyond the pushed OR rows and windows are merged; both must agree with brute force, ends and NULLs included."""
    rng = random.Random(3)
    df = spark.range(2000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("m"))
    for n in (1, 2, 5, 16, 17, 40, 100):
        cuts = sorted(rng.sample(range(1, 2000), 2 * n))
        windows = list(zip(cuts[::2], cuts[1::2]))
        for first, last in ((windows[0][0], windows[-1][1]), (None, None)):
            ws = [(first, windows[0][1]), *windows[1:]] if n > 1 else [(first, windows[0][1])]
            ws[-1] = (ws[-1][0], last)
            want = [m for m in range(2000) if m % 50 and any((lo is None or m > lo) and (hi is None or m <= hi)
                                                            for lo, hi in ws)]
            assert sorted(r["m"] for r in ranges.read_windows(df, "m", ws).collect()) == want
    assert ranges.read_windows(df, "m", []).count() == 0


def test_open_windows_keep_the_rows_of_all_bins(spark):
    """Touching windows with an open end, text with a common prefix and fractions, against a plain OR."""
    longs = spark.range(100).withColumnRenamed("id", "m")
    text = longs.select(F.concat(F.lit("invoice-"), F.lpad("m", 3, "0")).alias("m"))
    cases = [(longs, [(None, 5), (5, None)]), (longs, [(None, 5), (5, 5 + 1), (6, None)]), (longs, [(None, None)]),
             (longs.select((F.col("m") / 200).alias("m")), [(None, 0.1), (0.2, 0.25), (0.25, None)]),
             (text, [(None, "invoice-005"), ("invoice-010", "invoice-020"), ("invoice-020", None)])]
    for df, windows in cases:
        want = [r["m"] for r in df.collect() if any((lo is None or r["m"] > lo) and (hi is None or r["m"] <= hi)
                                                    for lo, hi in windows)]
        assert sorted(r["m"] for r in ranges.read_windows(df, "m", windows).collect()) == sorted(want)
    assert ranges.resume_rows(longs, "m", [(None, 5)], 5).count() == 100


def test_windows_of_wall_clock_times_ignore_the_session_zone(spark, tables):
    """Windows of minutes around the changes of New York's clocks, and over the events."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for day in ("2024-03-09 18:00:00", "2024-11-02 18:00:00"):
            start = ts(day)
            df = spark.range(24 * 60).select(
                (F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("m"))
            places = [r[0] for r in df.orderBy("m").select(predicates.position(F.col("m"), df.schema["m"].dataType)).collect()]
            assert all(b - a == 60e6 for a, b in zip(places, places[1:]))
            windows = [(start + dt.timedelta(minutes=i), start + dt.timedelta(minutes=i + 10)) for i in range(0, 24 * 60, 15)]
            want = [r["m"] for r in df.collect() if any(lo < r["m"] <= hi for lo, hi in windows)]
            assert sorted(r["m"] for r in ranges.read_windows(df, "m", windows).collect()) == want
        low, high = tables.events.agg(F.min("ts"), F.max("ts")).first()
        windows, lo = [], low
        while lo < high:
            windows.append((lo, lo + dt.timedelta(minutes=20)))
            lo += dt.timedelta(minutes=30)
        want = [t for t, in rows(tables.events, "ts") if any(lo < t <= hi for lo, hi in windows)]
        assert [t for t, in rows(ranges.read_windows(tables.events, "ts", windows), "ts")] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_range_number(spark):
    df = spark.range(100).withColumnRenamed("id", "m").union(spark.sql("select cast(null as bigint)"))
    cuts = [3, 10, 11, 50, 98]
    got = {r["m"]: r["n"] for r in df.select("m", predicates.range_number(df, "m", cuts).alias("n")).collect()}
    assert got == {**{m: sum(m > c for c in cuts) for m in range(100)}, None: None}


def test_resume_windows():
    assert ranges.resume_windows([(100, 250), (400, 420)], 500, 900) == [(100, 250), (400, 420), (500, 900)]
    assert ranges.resume_windows([(100, 250), (200, 300)], 300, None) == [(100, 300), (300, None)]
    assert ranges.resume_windows([(None, 10)], 20, 20) == [(None, 10)]
    assert ranges.resume_windows([], None, 5) == [(None, 5)]
    assert ranges.resume_windows([(5, 10), (10, 15), (15, 20)], 20, 30) == [(5, 10), (10, 15), (15, 20), (20, 30)]


def test_resuming_after_losing_ranges_equals_a_full_run(tables):
    df = tables.events
    planned = plan(df, "event_id", 90)
    rng = random.Random(1)
    stopped = planned[len(planned) // 2]["hi"]
    lost = [r for r in planned if r["hi"] <= stopped and rng.random() < 0.4]
    done = df.where(F.col("event_id") <= stopped)
    for r in lost:
        inside = F.col("event_id") <= r["hi"]
        done = done.where(~(inside & (F.col("event_id") > r["lo"]) if r["lo"] is not None else inside))
    rest = ranges.resume_rows(df, "event_id", [(r["lo"], r["hi"]) for r in lost], stopped)
    assert rows(done.select("event_id").union(rest.select("event_id"))) == rows(df.select("event_id"))


def test_checkpoint_is_lossless_and_bounded(spark):
    gaps = spark.range(2500).select(F.col("id").alias("batch_no"), (F.col("id") * 10).alias("lo"),
                                    (F.col("id") * 10 + 5).alias("hi"))
    gaps = gaps.withColumn("lo", F.when(F.col("batch_no") > 0, F.col("lo")))
    saved = ranges.encode_checkpoint(gaps, 12345)
    assert saved.count() == 3
    back = ranges.decode_checkpoint(saved, "bigint")
    assert rows(back.select("lo", "hi")) == rows(gaps.select("lo", "hi"))
    assert [r[0] for r in back.select("completed").distinct().collect()] == [12345]
    text = saved.orderBy("part").first()["checkpoint"]
    assert text.startswith('{"c":"12345","g":[[null,"5"],["10","15"]')


def test_markers_are_compared_in_their_own_type(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "m bigint")
    assert rows(df.where(predicates.after(df, "m", "9"))) == [(10,), (100,)]
    micro = spark.sql("select timestamp_ntz '2024-01-01 00:00:00.500001' as m")
    assert micro.where(predicates.up_to(micro, "m", "2024-01-01 00:00:00.5")).count() == 0
    assert micro.where(predicates.after(micro, "M", "2024-01-01 00:00:00.5")).count() == 1


def test_each_row_meets_its_window_in_a_merge(spark):
    """Windows as a table with columns of their own, one far away, a hot marker, NULL markers, clashing names; any number of slices."""
    rng = random.Random(5)
    values = [None] * 40 + [500] * 700 + [rng.randrange(2000) for _ in range(1000)] + [10 ** 12]
    df = spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "m bigint, w int, window string").repartition(5)
    cuts = sorted(rng.sample(range(2000), 300))
    table = [(lo, hi, n) for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if n % 3] + [(10 ** 12 - 1, None, 900), (None, cuts[0], 901)]
    table += [(cuts[3], cuts[3], 902)]  # holds nothing
    windows = spark.createDataFrame(table, "lo bigint, hi bigint, name int")
    want = sorted((i, next((n for lo, hi, n in table if (lo is None or v > lo) and (hi is None or v <= hi)), -1) if v is not None else -1)
                  for i, v in enumerate(values))
    for parts in (1, 2, 7, 64):
        got = ranges.window_of(df, "m", windows, "window", parts)
        assert got.columns == ["m", "w", "window"]
        assert sorted((r["w"], -1 if r["window"] is None else r["window"]["name"]) for r in got.collect()) == want
    assert ranges.window_of(df, "m", windows.where("false")).where("window is null").count() == len(values)
    assert ranges.window_of(df.where("false"), "m", windows).count() == 0
    # the hot marker is dealt into piles: no slice holds it whole
    assert len([c for c in ranges.quantile_cuts(df, "m", 64) if c == 500]) > 20


def test_merge_plan_has_no_join_and_no_limit_of_windows(spark):
    df, windows = spark.range(10).withColumnRenamed("id", "m"), spark.createDataFrame([(1, 4)], "lo bigint, hi bigint")
    text = ranges.window_of(df, "m", windows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "CartesianProduct" not in text
    assert [r["m"] for r in ranges.read_windows(df, "m", windows).orderBy("m").collect()] == [2, 3, 4]


def test_sketched_ranges_partition_the_rows(spark, tables):
    for df, marker, parts in ((tables.lineitem, "l_shipdate", 20), (tables.events, "event_id", 1), (tables.documents, "text", 7),
                              (tables.events.where("false"), "ts", 5), (tables.events.select((F.col("value") / 7).alias("v")), "v", 50)):
        planned = ranges.sketch_ranges(df, marker, parts)
        got = sorted(planned.collect(), key=lambda r: r["batch_no"])
        total = df.where(F.col(marker).isNotNull()).count()
        assert [r["batch_no"] for r in got] == list(range(len(got))) and sum(r["n_rows"] for r in got) == total and len(got) <= parts
        assert all(a["hi"] == b["lo"] for a, b in zip(got, got[1:])) and all(r["lo"] is None for r in got[:1])
        again = {r["batch_no"]: r["n"] for r in ranges.window_of(df, marker, spark.createDataFrame(got, planned.schema)).where("window is not null")
                 .groupBy("window.batch_no").agg(F.count(F.lit(1)).alias("n")).collect()} if total else {}
        assert again == {r["batch_no"]: r["n_rows"] for r in got}
