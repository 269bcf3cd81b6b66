"""Database targets: Spark writes in parallel, an upsert goes through a stage table and one statement.

No row passes the driver: it only sends the statement that moves stage rows to the target inside the database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_rows(df: DataFrame, options: dict[str, str], table: str, clean: bool = False, batch_size: int = 1000,
               connections: int | None = None) -> None:
    """Append rows, or empty the table first and keep its definition. ``connections`` bounds the parallel writers."""
    rows = df.coalesce(connections) if connections else df
    writer = rows.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", str(batch_size))
    if clean:
        writer.mode("overwrite").option("truncate", "true").save()
    else:
        writer.mode("append").save()


def upsert_statement(kind: str, target: str, stage: str, columns: Sequence[str], keys: Sequence[str],
                     update: bool = True) -> str:
    """One statement that applies the stage table. ``kind``: oracle, dm, postgresql or mysql."""
    lower = {k.lower() for k in keys}
    values = [c for c in columns if c.lower() not in lower] if update else []
    names = ", ".join(columns)
    if kind == "mysql":
        changes = ", ".join(f"{c} = VALUES({c})" for c in values) or f"{keys[0]} = {target}.{keys[0]}"
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {stage} ON DUPLICATE KEY UPDATE {changes}"
    if kind == "postgresql":
        action = "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in values) if values else "DO NOTHING"
        return f"INSERT INTO {target} ({names}) SELECT {names} FROM {stage} ON CONFLICT ({', '.join(keys)}) {action}"
    if kind not in ("oracle", "dm"):
        raise ValueError(f"unknown database kind {kind!r}")
    match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    changes = " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in values) if values else ""
    return (f"MERGE INTO {target} t USING {stage} s ON ({match}){changes} WHEN NOT MATCHED THEN INSERT ({names}) "
            f"VALUES ({', '.join('s.' + c for c in columns)})")


def execute(spark: SparkSession, options: dict[str, str], statement: str) -> None:
    """Run one statement on a driver-side connection and commit it."""
    props = spark._jvm.java.util.Properties()
    for key in ("user", "password"):
        if key in options:
            props.setProperty(key, options[key])
    conn = spark._jvm.java.sql.DriverManager.getConnection(options["url"], props)
    try:
        conn.setAutoCommit(False)
        conn.createStatement().executeUpdate(statement)
        conn.commit()
    finally:
        conn.close()


def upsert(df: DataFrame, options: dict[str, str], kind: str, table: str, stage: str, keys: Sequence[str],
           update: bool = True) -> None:
    """Load the (key-unique) rows into the stage table, then apply it in one transaction. Repeating it after a
    failure gives the same target: the stage is replaced and the statement is idempotent."""
    write_rows(df, options, stage, clean=True)
    execute(df.sparkSession, options, upsert_statement(kind, table, stage, df.columns, keys, update))
