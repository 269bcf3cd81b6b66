import base64

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.functions import coerce, lob, predicates
from tidemark.operators import mapping, profile
from tidemark.sources import database as db_source
from tidemark.sources import scan
from tidemark.sinks import database as db_sink
from tidemark.spec import MappedField, SyncMode, SyncSpec, looks_like_key, parse_keys, parse_mapping


def test_coercion_reports_bad_values(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-02 03:04:05"), ("", " ", ""), ("12.5", "x", "soon"),
                                (None, None, None), ("99999999999999999999", "1e3", "2024-02-30 00:00:00")],
                               "n string, d string, t string")
    target = T.StructType.fromDDL("N bigint, D double, T timestamp_ntz")
    got = rows(coerce.to_schema(df, target).select("n", "d", F.col("t").cast("string")))
    assert got == rows(spark.createDataFrame([(1, 1.5, "2024-01-02 03:04:05"), (None, None, None), (None, None, None),
                                              (None, None, None), (None, 1000.0, None)], "n bigint, d double, t string"))
    assert rows(coerce.reject_counts(df, target)) == [("d", 1), ("n", 2), ("t", 2)]
    good, bad = coerce.split(df, target)
    assert good.count() == 3 and bad.count() == 2


def test_decimals_keep_their_fraction(spark):
    df = spark.createDataFrame([("12345678901234567890.12",)], "n string")
    assert coerce.to_schema(df, T.StructType.fromDDL("n decimal(38,2)")).first()[0].as_tuple().exponent == -2


def test_text_cap_and_binary(spark):
    df = spark.createDataFrame([("é" * 20,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(lob.cap_text(F.col("t"), 10)).collect()]
    assert got == ["é" * 10 + "...[truncated]", "short", None]
    data = bytes(range(256)) * 5
    one = spark.createDataFrame([(bytearray(data),)], "b binary")
    encoded = one.select(lob.encode_binary(F.col("b")).alias("e"), lob.encode_binary(F.col("b"), 100).alias("n")).first()
    assert encoded["e"] == base64.b64encode(data).decode() and encoded["n"] is None
    texts = spark.createDataFrame([(encoded["e"],), ("data:image/png;base64," + encoded["e"],), ("%%%",), (None,)], "t string")
    back = [r[0] for r in texts.select(lob.decode_binary(F.col("t"))).collect()]
    assert [bytes(b) if b is not None else None for b in back] == [data, data, None, None]


def test_predicates(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "m int")

    def pick(c):
        return rows(df.where(c))
    assert pick(predicates.marker_range(df, "m", 1, 2)) == [(2,)]
    assert pick(predicates.marker_range(df, "m", hi=1)) == [(1,), (None,)]
    assert pick(predicates.marker_range(df, "m", lo=1)) == [(2,), (3,)]
    assert pick(predicates.marker_range(df, "m")) == [(None,)]
    assert pick(predicates.all_of([])) == pick(F.lit(True))
    assert pick(predicates.incremental(df, "m", 1, "m = 1 or m = 3")) == [(3,)]
    assert pick(predicates.incremental(df, "m", None, " ")) == pick(F.lit(True))
    with pytest.raises(ValueError):
        predicates.after(df, "missing", 1)


def test_bounds_reach_the_scan(tables):
    df = tables.events.where(predicates.marker_range(tables.events, "ts", "2024-01-10", "2024-01-11")).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-10T00:00)" in plan and "LessThanOrEqual(ts,2024-01-11T00:00)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_mapping_and_spec(spark):
    assert parse_mapping('{"A": "B"}') == [MappedField("A", "B")]
    assert parse_mapping('[{"srcField":"LSH","tgtField":"ID","isPk":true},{"srcField":"x"}]') == [MappedField("LSH", "ID", True)]
    assert parse_mapping(" ") == [] and parse_keys(" a, b,,c ") == ["a", "b", "c"]
    assert SyncMode.of(None) == SyncMode.MERGE and SyncMode.of(2) == SyncMode.INSERT_ONLY and SyncMode.of(7) == SyncMode.MERGE
    assert looks_like_key("ID") and looks_like_key("order id") and not looks_like_key("name")
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert mapping.apply_mapping(df, [MappedField("B", "x")]).columns == ["x"]
    assert mapping.apply_mapping(df, []) is df
    with pytest.raises(ValueError):
        mapping.apply_mapping(df, [MappedField("nope", "x")])
    pairs, left, right = mapping.auto_map(["Id", "A", "Z"], ["ID", "a", "q"])
    assert [(p.source, p.target, p.is_key) for p in pairs] == [("Id", "ID", True), ("A", "a", False)]
    assert (left, right) == (["Z"], ["q"])
    spec = SyncSpec.from_row({"id": 7, "strategy": "full", "marker_field": "M", "primary_keys": "k"})
    assert spec.mode == SyncMode.CLEAN_INSERT and spec.marker is None
    spec = SyncSpec.from_row({"id": 7, "strategy": "cdc", "sync_mode": 3, "marker_field": "M",
                              "field_mapping": '[{"srcField":"m","tgtField":"T","isPk":true}]'})
    assert spec.mode == SyncMode.MERGE and spec.keys == ("T",) and spec.marker_in_target() == "T"
    with pytest.raises(ValueError):
        SyncSpec("x")


def test_pages_walk_the_whole_table(tables):
    df, order = tables.lineitem.limit(1000), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = df.checkpoint() if tables.spark.sparkContext.getCheckpointDir() else df.persist()
    want = [tuple(r) for r in df.orderBy(*order).select(*order).collect()]
    got, last = [], None
    while True:
        part = [tuple(r) for r in scan.page_after(df, order, last, 170).select(*order).collect()]
        if not part:
            break
        got, last = got + part, part[-1]
    assert len(got) == len(set(want)) and got == sorted(set(want))
    second = [tuple(r) for r in scan.page(df, order, 2, 170).select(*order).collect()]
    assert second == want[170:340]
    assert scan.page(df, order, 100, 170).count() == 0


def test_ordered_rows_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 10))
                                  .alias("g"), (F.col("id") * 7919 % 3001).alias("m"))
    got = scan.ordered_within(df, F.col("g"), ["m"]).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["row_no"], r["m"]))
    assert sum(map(len, by_group.values())) == 3000
    for pairs in by_group.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [m for _, m in pairs] == sorted(m for _, m in pairs)


def test_ordered_files(spark, tables, tmp_path):
    path = str(tmp_path / "ordered")
    scan.write_ordered(tables.events, path, "ts")
    bounds = (spark.read.parquet(path).groupBy(F.input_file_name().alias("f"))
              .agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect())
    assert all(x["b"] <= y["a"] for x, y in zip(bounds, bounds[1:]))
    assert spark.read.parquet(path).count() == tables.events.count()


def test_only_queries_are_accepted_as_sources(spark):
    from pyspark.errors import PySparkException
    for text in ("drop table x", "create table x (a int)", "insert into x values (1)"):
        with pytest.raises(PySparkException):
            scan.read_sql(spark, text)
    assert scan.read_sql(spark, "with q as (select 1 as a) select * from q where a = :x;", {"x": 1}).count() == 1


def test_key_check_and_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert scan.key_check(df, ["k"]).first().asDict() == {"key_columns": "k", "n_rows": 3, "n_keys": 2, "is_unique": False,
                                                          "is_not_null": False}
    assert scan.key_check(df.where("k > 5"), ["k"]).first()["n_rows"] == 0
    assert rows(profile.candidate_profile(df, ["k", "v"])) == [("k", 3, 1, 1, "1", "1"), ("v", 3, 0, 3, "a", "c")]
    assert profile.increment_candidates(T.StructType.fromDDL("a int, b string")) == ["a", "b"]
    assert profile.increment_candidates(T.StructType.fromDDL("a int, updated int, d date")) == ["updated", "d"]
    assert scan.list_tables(spark).columns


def test_database_texts():
    opts = db_source.jdbc_options("jdbc:x", "T", " select 1 ; ")
    assert opts["dbtable"] == "(select 1) src"
    assert db_source.marker_slices("m", []) == ["1 = 1"]
    assert db_source.marker_slices("m", [1, 5]) == ["m <= 1 OR m IS NULL", "m > 1 AND m <= 5", "m > 5"]
    assert db_source.marker_slices("m", ["o'x"], nulls=False) == ["m <= 'o''x'", "m > 'o''x'"]
    cols, keys = ["id", "a", "b"], ["ID"]
    assert db_sink.upsert_statement("postgresql", "t", "s", cols, keys) == (
        "INSERT INTO t (id, a, b) SELECT id, a, b FROM s ON CONFLICT (ID) DO UPDATE SET a = EXCLUDED.a, b = EXCLUDED.b")
    assert db_sink.upsert_statement("postgresql", "t", "s", cols, keys, update=False).endswith("DO NOTHING")
    assert "ON DUPLICATE KEY UPDATE a = VALUES(a)" in db_sink.upsert_statement("mysql", "t", "s", cols, keys)
    merge = db_sink.upsert_statement("oracle", "t", "s", cols, keys)
    assert merge.startswith("MERGE INTO t t USING s s ON (t.ID = s.ID) WHEN MATCHED THEN UPDATE SET t.a = s.a, t.b = s.b")
    assert "WHEN MATCHED" not in db_sink.upsert_statement("dm", "t", "s", ["id"], ["id"])
    with pytest.raises(ValueError):
        db_sink.upsert_statement("other", "t", "s", cols, keys)
