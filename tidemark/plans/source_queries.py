"""Registered queries: scans, predicates, profiles, mapping and coercion."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import coerce, lob, predicates
from tidemark.functions.timing import ntz
from tidemark.operators import discovery, mapping, profile
from tidemark.plans.registry import query
from tidemark.sources import ranged, scan
from tidemark.spec import MappedField

CUSTOM_SQL = """
select o.o_orderkey, c.c_name, n.n_name, o.o_totalprice
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
where o.o_orderstatus = 'F'"""
CUSTOM_ORACLE = CUSTOM_SQL.replace("{", "").replace("}", "")


def custom_source(t):
    return scan.read_sql(t.spark, CUSTOM_SQL, orders=t.orders, customer=t.customer, nation=t.nation)


@query("scan_table", "select * from orders")
def scan_table(t):
    return scan.resolve_source(t.spark, t.folder, "orders")


@query("scan_custom_sql", CUSTOM_ORACLE)
def scan_custom_sql(t):
    return scan.resolve_source(t.spark, t.folder, "orders", CUSTOM_SQL, orders=t.orders, customer=t.customer,
                               nation=t.nation)


@query("scan_columns", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def scan_columns(t):
    return scan.read_columns(t.orders, ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 100000)


@query("page_offset", """
select *, (select count(*) from orders) as total from orders order by o_orderkey limit 100 offset 200""")
def page_offset(t):
    return scan.with_total(scan.page(t.orders, ["o_orderkey"], number=3, size=100), t.orders)


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("page_keyset", """
select * from lineitem
where l_orderkey > 10 or (l_orderkey = 10 and (l_linenumber > 3 or (l_linenumber = 3 and
      (l_partkey > 0 or (l_partkey = 0 and l_suppkey > 0)))))
order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500""")
def page_keyset(t):
    return scan.page_after(t.lineitem, LINE_KEY, (10, 3, 0, 0), 500)


CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]


@query("range_read", """
select event_id, case when ts <= timestamp '2024-01-08 00:00:00' then 0 when ts <= timestamp '2024-01-15 00:00:00' then 1
                      when ts <= timestamp '2024-01-22 00:00:00' then 2 else 3 end as range_no
from events""")
def range_read(t):
    return t.events.select("event_id", predicates.range_number(t.events, "ts", CUTS).alias("range_no"))


@query("range_source", "select * from events")
def range_source(t):
    """The events through the source whose partitions are planned ranges."""
    return ranged.read_by_ranges(t.spark, f"{t.folder}/events.parquet", "ts", 8)


def _numbered(orders):
    rows = orders.select("o_orderkey", "o_orderdate")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    return scan.ordered_within(rows.withColumn("month_no", month), F.col("month_no"), ["o_orderdate", "o_orderkey"])


@query("ordered_scan_whole", """
select o_orderkey, o_orderdate, year(o_orderdate) * 100 + month(o_orderdate) as month_no,
       row_number() over (partition by year(o_orderdate) * 100 + month(o_orderdate) order by o_orderdate, o_orderkey) as row_no
from orders""")
def ordered_scan_whole(t):
    return _numbered(t.orders)


@query("clob_cap", """
select doc_id, case when length(text) > 500 then concat(substr(text, 1, 500), '...[truncated]') else text end as capped,
       length(text) > 500 as is_cut, length(text) as n_chars, md5(text) as text_md5
from documents""")
def clob_cap(t):
    text = F.col("text")
    return t.documents.select("doc_id", lob.cap_text(text, 500).alias("capped"), lob.is_cut(text, 500).alias("is_cut"),
                              F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


@query("blob_encode", """
select doc_id, case when octet_length(encode(text)) <= 2000 then base64(encode(text)) end as encoded,
       octet_length(encode(text)) as n_bytes
from documents""")
def blob_encode(t):
    data = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", lob.encode_binary(data, 2000).alias("encoded"),
                              F.octet_length(data).cast("bigint").alias("n_bytes"))


@query("blob_decode", """
select doc_id, octet_length(from_base64(base64(encode(text)))) as n_bytes, md5(text) as bytes_md5 from documents""")
def blob_decode(t):
    uri = F.concat(F.lit("data:image/png;base64,"), lob.encode_binary(F.encode("text", "UTF-8")))
    data = lob.decode_binary(uri)
    return t.documents.select("doc_id", F.octet_length(data).cast("bigint").alias("n_bytes"), F.md5(data).alias("bytes_md5"))


@query("preview_sample", """
with src as (select * from events where ts > timestamp '2024-01-20 00:00:00')
select *, (select count(*) from src) as total from src order by event_id limit 10""")
def preview_sample(t):
    return scan.preview(t.events.where(predicates.after(t.events, "ts", "2024-01-20")), ["event_id"])


@query("sql_test", f"""
with src as ({CUSTOM_ORACLE}) select *, (select count(*) from src) as total from src order by o_orderkey limit 5""")
def sql_test(t):
    return scan.preview(custom_source(t), ["o_orderkey"], 5)


@query("schema_probe", f"""
with src as ({CUSTOM_ORACLE})
select 'o_orderkey' as column_name, 'number' as family, count(o_orderkey) as n_values from src
union all select 'c_name', 'text', count(c_name) from src union all select 'n_name', 'text', count(n_name) from src
union all select 'o_totalprice', 'number', count(o_totalprice) from src""")
def schema_probe(t):
    return scan.column_report(custom_source(t))


def _key_oracle(table, keys):
    cols = ", ".join(keys)
    nn = " and ".join(f"{k} is not null" for k in keys)
    return (f"select '{table}({','.join(keys)})' as key_columns, cast(sum(n) as bigint) as n_rows, count(*) as n_keys, "
            f"max(n) = 1 as is_unique, bool_and({nn}) as is_not_null "
            f"from (select {cols}, count(*) as n from {table} group by {cols})")


KEY_CANDIDATES = [("orders", ["o_orderkey"]), ("lineitem", LINE_KEY[:2]), ("lineitem", LINE_KEY)]


@query("key_check", " union all ".join(_key_oracle(*c) for c in KEY_CANDIDATES))
def key_check(t):
    parts = [scan.key_check(getattr(t, table), keys, f"{table}({','.join(keys)})") for table, keys in KEY_CANDIDATES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KEY_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus", "l_shipdate"],
}


def _minimal_keys(table):
    """Every set of one or two columns whose values identify each row, without those that hold another."""
    columns = KEY_COLUMNS[table]
    sets = [*combinations(columns, 1), *combinations(columns, 2)]
    unique = ", ".join(f"count(distinct ({', '.join(s)})) = count(*) and {' and '.join(f'count({c}) = count(*)' for c in s)} as u{i}"
                       for i, s in enumerate(sets))
    rows = " union all ".join(
        f"select '{table}' as table_name, '{','.join(s)}' as key_columns from unique_{table} where u{i}"
        + "".join(f" and not u{j}" for j, k in enumerate(sets[:len(columns)]) if len(s) > 1 and k[0] in s) for i, s in enumerate(sets))
    return f"unique_{table} as (select {unique} from {table})", rows


@query("key_discovery", f"with {', '.join(_minimal_keys(x)[0] for x in KEY_COLUMNS)} {' union all '.join(_minimal_keys(x)[1] for x in KEY_COLUMNS)}")
def key_discovery(t):
    rows = [(x, ",".join(k)) for x, columns in KEY_COLUMNS.items() for k in discovery.key_discovery(getattr(t, x), 2, columns)]
    return t.spark.createDataFrame(rows, "table_name string, key_columns string")


# ---- predicates

LOW, HIGH = "2024-01-10 09:30:00.5", "2024-01-20 00:00:00"


@query("marker_gt", f"select * from events where ts > timestamp '{LOW}'")
def marker_gt(t):
    return t.events.where(predicates.after(t.events, "ts", LOW))


@query("marker_le", f"select * from events where ts <= timestamp '{LOW}'")
def marker_le(t):
    return t.events.where(predicates.up_to(t.events, "ts", LOW))


@query("marker_window", f"select * from events where ts > timestamp '{LOW}' and ts <= timestamp '{HIGH}'")
def marker_window(t):
    return t.events.where(predicates.marker_range(t.events, "ts", LOW, HIGH))


@query("marker_null", "select * from events_nm where ts is null")
def marker_null(t):
    return t.events_nm.where(predicates.marker_range(t.events_nm, "ts"))


@query("marker_open_start", "select * from events_nm where ts is null or ts <= timestamp '2024-01-10 00:00:00'")
def marker_open_start(t):
    return t.events_nm.where(predicates.marker_range(t.events_nm, "ts", hi="2024-01-10"))


INCREMENT_ORACLE = """
select * from events where ts > timestamp '2024-01-10 00:00:00' and (event_type = 'click' or value > 100)"""


@query("incremental_where", INCREMENT_ORACLE)
def incremental_where(t):
    return t.events.where(predicates.incremental(t.events, "ts", "2024-01-10", "event_type = 'click' or value > 100"))


@query("sql_params", INCREMENT_ORACLE)
def sql_params(t):
    text = "select * from {events} where ts > cast(:low as timestamp_ntz) and (event_type = :kind or value > :least)"
    return scan.read_sql(t.spark, text, {"low": "2024-01-10", "kind": "click", "least": 100}, events=t.events)


# ---- profiles

def _not_view(t):
    return t.events_nm.where(F.col("event_type") != "view")


@query("source_count", "select count(*) as n_rows from events_nm where event_type <> 'view'")
def source_count(t):
    return profile.row_count(_not_view(t))


@query("marker_min", "select min(ts) as min_marker from events_nm where event_type <> 'view'")
def marker_min(t):
    return profile.marker_min(_not_view(t), "ts")


@query("marker_max", "select max(ts) as max_marker from events_nm where event_type <> 'view'")
def marker_max(t):
    return profile.marker_max(_not_view(t), "ts")


@query("marker_profile", """
select count(*) as n_rows, count(*) - count(ts) as n_null, min(ts) as min_marker, max(ts) as max_marker
from events_nm where event_type <> 'view'""")
def marker_profile(t):
    return profile.marker_profile(_not_view(t), "ts")


FOOTER_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"]


@query("footer_profile", " union all ".join(
    f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, {f.format(f'min({c})')} as min_value, "
    f"{f.format(f'max({c})')} as max_value from lineitem" for c in FOOTER_COLUMNS
    for f in ["strftime({}, '%Y-%m-%d %H:%M:%S')" if c == "l_shipdate" else "cast({} as varchar)"]))
def footer_profile(t):
    """Counts and bounds of lineitem's columns out of the files' footers, where these hold them."""
    return profile.footer_profile(t.spark, f"{t.folder}/lineitem.parquet", FOOTER_COLUMNS)


@query("source_max_batch", """
with maxima as (select 'T0' as source_table, max(o_orderdate) as source_max from orders
                union all select 'T1', max(l_shipdate) from lineitem union all select 'T2', max(ts) from events)
select s.id, s.source_table, m.source_max,
       date_diff('day', date '2000-01-01', cast(m.source_max as date)) as lag_days
from sync_task s left join maxima m on s.source_table = m.source_table""")
def source_max_batch(t):
    found = profile.source_max(t.sync_task.select("id", "source_table"), {
        "T0": (t.orders, "o_orderdate"), "T1": (t.lineitem, "l_shipdate"), "T2": (t.events, "ts")})
    return found.select("id", "source_table", "source_max",
                        profile.lag_days(F.col("source_max"), ntz("2000-01-01")).alias("lag_days"))


@query("marker_candidates", " union all ".join(
    f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, "
    f"cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from events_nm" for c in ("event_id", "ts", "user_id")))
def marker_candidates(t):
    return profile.candidate_profile(t.events_nm)


# ---- mapping and coercion

@query("field_mapping", "select event_id as ID, ts as HAPPENED_AT, event_type as KIND from events")
def field_mapping(t):
    return mapping.apply_mapping(t.events, [MappedField("EVENT_ID", "ID", True), MappedField("ts", "HAPPENED_AT"),
                                            MappedField("event_type", "KIND")])


@query("auto_map", "select c_custkey as C_CUSTKEY, c_name as C_NAME, c_acctbal as C_ACCTBAL from customer")
def auto_map(t):
    pairs, _, _ = mapping.auto_map(t.customer.columns, ["C_CUSTKEY", "C_NAME", "C_ACCTBAL", "EXTRA"])
    return mapping.apply_mapping(t.customer, pairs)


TYPED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("n_txt", T.LongType()),
                      T.StructField("d_txt", T.DoubleType()), T.StructField("t_txt", T.TimestampNTZType())])
CONVERTED = {"n_txt": "try_cast(nullif(trim(n_txt), '') as bigint)", "d_txt": "try_cast(nullif(trim(d_txt), '') as double)",
             "t_txt": "try_strptime(nullif(trim(t_txt), ''), '%Y-%m-%d %H:%M:%S')"}


@query("coerce_types", "select event_id, " + ", ".join(f"{e} as {c}" for c, e in CONVERTED.items()) + " from raw_text")
def coerce_types(t):
    return coerce.to_schema(t.raw_text, TYPED)


@query("coerce_rejects", " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where trim({c}) <> '' and {e} is null) as rejected from raw_text"
    for c, e in CONVERTED.items()))
def coerce_rejects(t):
    return coerce.reject_counts(t.raw_text, TYPED)


@query("reject_rows", """
select * from raw_text where """ + " or ".join(f"(trim({c}) <> '' and {e} is null)" for c, e in CONVERTED.items()))
def reject_rows(t):
    return coerce.split(t.raw_text, TYPED)[1]


@query("column_intersect_whole", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""")
def column_intersect_whole(t):
    return mapping.known_columns(t.orders.withColumn("not_in_target", F.lit(1)), t.orders_tgt.schema)
