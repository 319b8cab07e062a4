"""Cell logs made of the star-schema tables, without chance: the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.session import table


def micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, whatever the session's zone is."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    return F.unix_micros(c)


def _log(df: DataFrame, row, cf, qual, ts, kind, value, seq) -> DataFrame:
    return df.select(row.alias("row"), cf.alias("cf"), qual.alias("qual"), ts.alias("ts"), kind.cast("byte").alias("type"), value.alias("value"), seq.alias("seq"))


def user_row() -> Column:
    return F.lpad(F.col("user_id").cast("string"), 8, "0")


def cells_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return _log(e, user_row(), F.lit("ev"), F.col("event_type"), micros(e, "ts"), F.lit(5), F.col("value"), F.col("event_id"))


CELLS = """SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, event_type AS qual, epoch_us(ts) AS ts, 5 AS type, value, event_id AS seq FROM events"""

_KINDS = {1: 101, 2: 53, 3: 11, 4: 7}


def cells_with_deletes(spark: SparkSession, d: str, kinds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """cells_events with every 101st entry a row delete, 53rd a family delete, 11th a column delete, 7th a version delete; only of the kinds given."""
    e = table(spark, d, "events")
    kind = F.lit(5)
    for k in sorted(kinds, reverse=True):
        kind = F.when(F.col("event_id") % _KINDS[k] == 0, k).otherwise(kind)
    e = e.withColumn("_k", kind)
    return _log(e, user_row(), F.when(F.col("_k") == 1, "").otherwise("ev"), F.when(F.col("_k") <= 2, "").otherwise(F.col("event_type")), micros(e, "ts"), F.col("_k"), F.when(F.col("_k") == 5, F.col("value")), F.col("event_id"))


def deletes_sql(kinds: tuple[int, ...] = (1, 2, 3, 4)) -> str:
    kind = "CASE " + " ".join(f"WHEN event_id % {_KINDS[k]} = 0 THEN {k}" for k in sorted(kinds)) + " ELSE 5 END"
    return f"""SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", CASE WHEN k = 1 THEN '' ELSE 'ev' END AS cf, CASE WHEN k <= 2 THEN '' ELSE event_type END AS qual, epoch_us(ts) AS ts, k AS type, CASE WHEN k = 5 THEN value END AS value, event_id AS seq
FROM (SELECT *, {kind} AS k FROM events)"""


def counter_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return _log(e, user_row(), F.lit("cnt"), F.col("event_type"), micros(e, "ts"), F.when(F.col("event_id") % 19 == 0, 5).otherwise(10), F.floor("value").cast("bigint"), F.col("event_id"))


def append_events(spark: SparkSession, d: str, kind: int = 9) -> DataFrame:
    e = table(spark, d, "events")
    return _log(e, user_row(), F.lit("log"), F.col("event_type"), micros(e, "ts"), F.when(F.col("event_id") % 23 == 0, 5).otherwise(kind), F.col("event_id").cast("string"), F.col("event_id"))


def orders_cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return _log(o, F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("ord"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), micros(o, "o_orderdate"), F.lit(5), F.col("o_totalprice"), F.col("o_orderkey"))


ORDERS = """SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS "row", 'ord' AS cf, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS qual, epoch_us(o_orderdate) AS ts, 5 AS type, o_totalprice AS value, o_orderkey AS seq FROM orders"""


def tablets(spark: SparkSession, n: int = 12, step: int = 15) -> DataFrame:
    """n tablets that cover all user rows, `step` users each but for the last."""
    i = F.col("id")
    return spark.range(0, n, 1, 1).select(F.format_string("t%03d", i).alias("name"), F.when(i == 0, "").otherwise(F.lpad((i * step).cast("string"), 8, "0")).alias("start"), F.when(i == n - 1, "").otherwise(F.lpad(((i + 1) * step).cast("string"), 8, "0")).alias("end"))


def tablets_sql(n: int = 12, step: int = 15) -> str:
    return f"""SELECT printf('t%03d', i) AS name, CASE WHEN i = 0 THEN '' ELSE lpad(CAST(i * {step} AS VARCHAR), 8, '0') END AS "start", CASE WHEN i = {n - 1} THEN '' ELSE lpad(CAST((i + 1) * {step} AS VARCHAR), 8, '0') END AS "end" FROM range({n}) r(i)"""


def damaged_tablets(spark: SparkSession) -> DataFrame:
    """Tablets with gaps (every fifth is gone), overlaps (every fourth reaches too far) and one that is inside out."""
    t = tablets(spark, 30, 10).withColumn("_i", F.substring("name", 2, 3).cast("int"))
    far = F.lpad((F.col("_i") * 10 + 14).cast("string"), 8, "0")
    end = F.when(F.col("_i") == 7, "00000001").when(F.col("_i") % 4 == 1, far).otherwise(F.col("end"))
    return t.where("_i % 5 <> 3").select("name", "start", end.alias("end"))


def damaged_sql() -> str:
    return f"""SELECT name, "start", CASE WHEN i = 7 THEN '00000001' WHEN i % 4 = 1 THEN lpad(CAST(i * 10 + 14 AS VARCHAR), 8, '0') ELSE "end" END AS "end" FROM (SELECT *, CAST(substr(name, 2, 3) AS INTEGER) AS i FROM ({tablets_sql(30, 10)})) WHERE i % 5 <> 3"""
