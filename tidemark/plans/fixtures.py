"""The given tables and the control tables derived from them.

The derived tables are SQL texts over whole given tables that both engines understand up to two spellings, so that Spark and the
oracle see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scan import read_table

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

# Parameters shared by queries and oracle.
NOW = "2024-01-15 12:00:00"
DAY = "2024-01-15"

DERIVED = {
    # every event as one run of the task numbered like its user
    "run_log": """
select event_id as id, user_id as task_id, concat('Sync T', cast(user_id % 8 as string)) as task_name,
       case event_type when 'error' then 3 when 'signup' then 1 else 2 end as status,
       cast(cast(floor(value * 10) as int) + 3 as bigint) as total_count,
       cast(floor(value * 10) as int) + 3 - event_id % 3 as success_count, event_id % 3 as fail_count,
       case when event_type = 'error' then concat('failed ', props) end as error_msg,
       ts as start_time,
       case when event_type = 'signup' then null else ts + interval '1' second * (event_id * 37 % 600) end as end_time
from events""",
    # the same with what each run changed
    "run_log_counts": """
select event_id as id, user_id as task_id, concat('Sync T', cast(user_id % 8 as string)) as task_name,
       case event_type when 'error' then 3 when 'signup' then 1 else 2 end as status,
       cast(cast(floor(value * 10) as int) + 3 as bigint) as total_count,
       cast(floor(value * 10) as int) + 3 - event_id % 3 as success_count, event_id % 3 as fail_count,
       case when event_id % 5 = 0 then null else event_id % 11 end as insert_count, event_id % 13 as update_count,
       case when event_id % 6 = 0 then null else event_id % 4 end as skip_count,
       case when event_type = 'error' then concat('failed ', props) end as error_msg,
       ts as start_time,
       case when event_type = 'signup' then null else ts + interval '1' second * (event_id * 37 % 600) end as end_time
from events""",
    # every customer as one task
    "sync_task": """
select c_custkey as id, c_name as name, concat('T', cast(c_nationkey as string)) as source_table,
       concat('D', cast(c_nationkey as string)) as target_table, cast(c_nationkey % 5 as bigint) as source_conn_id,
       cast((c_nationkey + 1) % 6 as bigint) as target_conn_id,
       case when c_mktsegment = 'HOUSEHOLD' then null else cast(c_nationkey % 3 as bigint) end as schedule_id,
       case when c_mktsegment = 'FURNITURE' then '' else c_mktsegment end as task_group,
       case c_custkey % 4 when 0 then 'running' when 1 then 'paused' when 2 then 'stopped' else 'error' end as run_status,
       case when c_acctbal < 0 then 0 else 1 end as status
from customer""",
    "db_conn": """
select cast(r_regionkey as bigint) as id, r_name as name,
       case r_regionkey % 4 when 0 then 'oracle' when 1 then 'mysql' when 2 then 'dm' else 'postgresql' end as db_type
from region""",
    "schedule": """
select cast(r_regionkey as bigint) as id, r_name as name, r_regionkey <> 1 as enabled, r_regionkey = 2 as once
from region where r_name <> 'MIDDLE EAST'""",
    # events of which one type carries no marker
    "events_nm": """
select event_id, case when event_type = 'signup' then null else ts end as ts, user_id, event_type, value, props
from events""",
    # a target loaded up to 2000-01-01 and gone stale since for two priorities, with a column of its own
    "orders_tgt": """
select o_orderkey, o_custkey,
       case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'X' else o_orderstatus end as o_orderstatus,
       case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_totalprice * 0.5 else o_totalprice end as o_totalprice,
       o_orderdate, o_orderpriority, 'kept' as tgt_only
from orders where o_orderdate <= timestamp '2000-01-01 00:00:00'""",
    # the increment beyond the stored marker: it overlaps the target by one year
    "orders_src": """
select * from orders where o_orderdate > timestamp '1999-01-01 00:00:00'""",
    # text columns with blanks and values that do not convert
    "raw_text": """
select event_id, case when event_type = 'view' then '' else cast(event_id as string) end as n_txt,
       case when event_type = 'click' then 'bad' else cast(user_id as string) end as d_txt,
       case event_type when 'error' then 'not a date' when 'signup' then ''
            else strftime(ts, '%Y-%m-%d %H:%M:%S') end as t_txt
from events""",
}

# a run that stopped with two ranges open, on the marker event_id
SAVED_GAPS = ((100, 250), (400, 420))
SAVED_COMPLETED = 500


def to_spark(text: str) -> str:
    text = text.replace("timestamp '", "timestamp_ntz '")
    return re.sub(r"strftime\((\w+), '%Y-%m-%d %H:%M:%S'\)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss')", text)


class Tables:
    """Attribute access to given and derived tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return read_table(self.spark, self.folder, name)
        if name not in DERIVED:
            raise AttributeError(name)
        text = to_spark(DERIVED[name])
        base = re.search(r"\bfrom (\w+)", text).group(1)
        text = re.sub(rf"\bfrom {base}\b", "from {" + base + "}", text)
        return self.spark.sql(text, **{base: getattr(self, base)})


def with_derived(sql: str) -> str:
    """Oracle text with the derived tables it mentions as CTEs in front."""
    used = [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ", ".join(f"{n} as ({DERIVED[n].strip()})" for n in used)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        return f"with {ctes}, {body[4:].lstrip()}"
    return f"with {ctes} {body}"
