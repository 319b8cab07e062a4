"""Observers: notified cells are dispatched to the functions registered for their columns, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.resolve import CELL, VALUE

NOTIFY = "_N_"
ACK_TIMEOUT_S = 3600


@dataclass(frozen=True)
class Observer:
    name: str
    table: str
    cf: str
    qual: str
    txn: str = "none"  # or row, global


def legal(observer: Observer, table_txn: str) -> bool:
    """An observer's transactions must be its table's kind; one without may watch a table of row transactions."""
    return observer.txn == table_txn or (observer.txn == "none" and table_txn == "row")


def notifications(log: DataFrame) -> DataFrame:
    """Entries of the notification family as row, cf, qual, ts; names without a colon, or with an empty side, are left out."""
    parts = F.split("qual", ":", 2)
    out = log.where((F.col("cf") == NOTIFY) & (F.col("type") == VALUE)).where(F.instr("qual", ":") > 1)
    return out.select("row", parts[0].alias("cf"), parts[1].alias("qual"), "ts").where("qual <> ''")


def notify(puts: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Notification entries for puts (row, cf, qual, ts, ..., seq) to watched columns."""
    watched = F.lit(False)
    for cf, qual in columns:
        watched |= (F.col("cf") == cf) & (F.col("qual") == qual)
    return puts.where(watched & (F.col("type") == VALUE)).select("row", F.lit(NOTIFY).alias("cf"), F.concat("cf", F.lit(":"), "qual").alias("qual"), "ts", F.lit(VALUE).cast("byte").alias("type"), F.lit(None).cast("string").alias("value"), "seq")


def acknowledge(handled: DataFrame, start_ts: int) -> DataFrame:
    """Entries that delete handled notifications (row, cf, qual) up to start_ts."""
    return handled.select("row", F.lit(NOTIFY).alias("cf"), F.concat("cf", F.lit(":"), "qual").alias("qual"), F.lit(start_ts).cast("long").alias("ts"), F.lit(3).cast("byte").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(start_ts).cast("long").alias("seq"))


def observer_table(spark: SparkSession, observers: list[Observer]) -> DataFrame:
    return spark.createDataFrame([(o.name, o.cf, o.qual) for o in observers], "observer string, cf string, qual string")


def dispatch(noted: DataFrame, observers: DataFrame, cells: DataFrame, acks: DataFrame | None = None, start_ts: int | None = None, timeout_s: int = ACK_TIMEOUT_S) -> DataFrame:
    """(row, cf, qual, ts, value, observer) to be called: notified, registered, still there, and not acknowledged by that observer since.

    acks: row, cf, qual, observer, ack_ts. An acknowledgement at or after the cell's timestamp silences it until the
    timeout has passed at start_ts.
    """
    told = noted.groupBy(*CELL).agg(F.max("ts").alias("noted_ts")).join(F.broadcast(observers), ["cf", "qual"])  # observers are code, a handful
    out = told.join(cells.select(*CELL, "ts", "value"), CELL).select(*CELL, "ts", "value", "observer")
    if acks is None:
        return out
    last = acks.groupBy(*CELL, "observer").agg(F.max("ack_ts").alias("ack_ts"))
    quiet = (F.col("ack_ts") >= F.col("ts")) & (F.lit(start_ts) - F.col("ack_ts") < timeout_s * 1_000_000)
    return out.join(last, [*CELL, "observer"], "left").where(~F.coalesce(quiet, F.lit(False))).drop("ack_ts")


def run(changes: DataFrame, observers: dict[Observer, Callable[[DataFrame], None]], checkpoint: str, cells: Callable[[], DataFrame] | None = None, before: Callable[[int], None] | None = None, after: Callable[[int], None] | None = None):
    """Start a stream over a log of changes that calls each observer's function with its cells of every batch.

    cells: the resolved table at call time; without it the changed values of the batch themselves are shown, newest of
    each cell. Delivery is at least once, so functions must stand a repeated batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        if before:
            before(number)
        df = df.persist()
        now = cells() if cells else df.where(F.col("type") == VALUE).groupBy(*CELL).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "seq")).alias("x")).select(*CELL, "x.*")
        noted = df.where(F.col("type") == VALUE).select(*CELL, "ts")
        calls = dispatch(noted, observer_table(df.sparkSession, list(observers)), now).persist()
        for o, function in observers.items():
            function(calls.where(F.col("observer") == o.name).drop("observer"))
        calls.unpersist()
        df.unpersist()
        if after:
            after(number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
