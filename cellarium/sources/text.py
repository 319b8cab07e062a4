"""Text sources: `row family:qualifier value` lines, and tab-separated load files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.codecs import family_of, qualifier_of
from cellarium.operators.resolve import VALUE


def parse_put_lines(lines: DataFrame) -> DataFrame:
    """lines (value) to row, cf, qual, value; lines of under three fields are left out."""
    parts = F.split(F.trim("value"), " +", 3)
    return lines.select(parts.alias("p")).where(F.size("p") == 3).select(F.col("p")[0].alias("row"), family_of(F.col("p")[1]).alias("cf"), qualifier_of(F.col("p")[1]).alias("qual"), F.col("p")[2].alias("value"))


def read_puts(spark: SparkSession, path: str, first_ts: int = 1) -> DataFrame:
    """A log of puts from a file of such lines; timestamps rise from first_ts in an order fixed by the lines."""
    cells = parse_put_lines(spark.read.text(path))
    n = F.monotonically_increasing_id()
    return cells.select("row", "cf", "qual", (n + first_ts).alias("ts"), F.lit(VALUE).cast("byte").alias("type"), "value", n.alias("seq"))


def parse_mark_lines(lines: DataFrame, mixed: bool = False) -> DataFrame:
    """`row \\t value [\\t cf:q1,q2;cf2:q3] [\\t ts]` to op, row, cf, qual, ts, value. mixed: each line begins with PUT or GET, and GET lines have no value."""
    parts = F.split("value", "\t")
    s = lines.select(parts.alias("p"))
    if mixed:
        s = s.select(F.upper(F.col("p")[0]).alias("op"), F.slice("p", 2, 10).alias("p"))
    else:
        s = s.select(F.lit("PUT").alias("op"), "p")
    put = F.col("op") == "PUT"
    at = lambda i: F.get(F.col("p"), F.when(put, i).otherwise(i - 1))
    s = s.select("op", F.col("p")[0].alias("row"), F.when(put, F.get("p", F.lit(1))).alias("value"), F.coalesce(at(2), F.lit("")).alias("cols"), at(3).try_cast("bigint").alias("ts"))
    fam = s.select("op", "row", "value", "ts", F.explode(F.split("cols", ";")).alias("c")).select("op", "row", "value", "ts", family_of(F.col("c")).alias("cf"), F.explode(F.split(qualifier_of(F.col("c")), ",")).alias("qual"))
    return fam.select("op", "row", "cf", "qual", "ts", "value")


def workload_lines(ops: DataFrame, family: str = "cf0") -> DataFrame:
    """Lines of a mixed load file from operations (op, row, fields map, ts): reads make GET lines, inserts and updates a PUT line for each field, others none."""
    fields = F.explode_outer(F.when(F.col("op").isin("insert", "update"), F.map_entries("fields")).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    each = ops.select("op", "row", "ts", fields.alias("f"))
    put = F.when(F.col("f").isNotNull(), F.concat_ws("\t", F.lit("PUT"), "row", "f.value", F.concat(F.lit(f"{family}:"), "f.key"), F.col("ts").cast("string")))
    get = F.when(F.col("op") == "read", F.concat_ws("\t", F.lit("GET"), "row", F.lit(f"{family}:")))
    return each.select(F.coalesce(put, get).alias("value")).where("value is not null")
