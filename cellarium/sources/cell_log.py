"""Cell logs in files: one folder of Parquet for each family group, rows clustered by key.

A batch of mutations is one append, which is what makes it whole or absent. The folder name `lg=` prunes families of
other groups; min/max statistics of the clustered rows prune key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.resolve import DEL_ROW, LOG_COLUMNS, log_schema
from cellarium.schema import TableSchema


#: A key-value table's entries: expire in seconds, null for never; gone for a deletion.
KV_SCHEMA = "row string, value string, seq long, expire long, gone boolean"


def _group(schema: TableSchema):
    out = F.lit("all")
    for f in schema.families:
        out = F.when((F.col("cf") == f.name) & (F.col("type") != DEL_ROW), f.group).otherwise(out)
    return out


def append(log: DataFrame, schema: TableSchema, path: str, partitions: int | None = None) -> None:
    """Append entries; those of a row delete go to group `all`, which every read takes."""
    keyed = log.select(*LOG_COLUMNS, _group(schema).alias("lg"))
    dealt = keyed.repartitionByRange(partitions, "lg", "row") if partitions else keyed.repartitionByRange("lg", "row")
    dealt.sortWithinPartitions("lg", "row", "cf", "qual", F.desc("ts")).write.mode("append").option("parquet.bloom.filter.enabled#row", "true").partitionBy("lg").parquet(path)


def read(spark: SparkSession, schema: TableSchema, path: str, families: set[str] | None = None, value=None) -> DataFrame:
    log = spark.read.schema(log_schema(value).add("lg", "string")).parquet(path)
    if families:
        log = log.where(F.col("lg").isin(sorted({"all", *(schema.family(f).group for f in families)})))
    return log.select(*LOG_COLUMNS)


def append_kv(log: DataFrame, path: str) -> None:
    log.repartitionByRange("row").sortWithinPartitions("row").write.mode("append").option("parquet.bloom.filter.enabled#row", "true").parquet(path)


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KV_SCHEMA).parquet(path)


def good_and_bad_kv(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    why = F.when(F.length("row") >= 64 << 10, "row too large").when(F.length("value") >= 32 << 20, "value too large")
    told = log.withColumn("reason", why)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def good_and_bad(log: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """Entries that may be written, and the others with a reason: limits on sizes, unknown families."""
    why = F.when(F.length("row") >= 64 << 10, "row too large").when(F.length("qual") >= 64 << 10, "qualifier too large").when(F.length(F.col("value").cast("string")) >= 32 << 20, "value too large")
    why = why.when((F.col("type") != DEL_ROW) & ~F.col("cf").isin(schema.names), "unknown family")
    told = log.withColumn("reason", why)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")
