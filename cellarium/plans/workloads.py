"""Order-processing transactions over the star schema, for all districts (nations) at once instead of one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.session import table

RECENT, THRESHOLD = 20, 10


def stock_level(spark: SparkSession, d: str, recent: int = RECENT, threshold: int = THRESHOLD) -> DataFrame:
    """Per nation: lines of its `recent` newest orders whose part has under `threshold` in stock (the part's size stands for stock)."""
    cust, orders = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    mine = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    # the newest of each task first, so that a large nation's orders aren't ordered in one
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_orderkey")))
    last = mine.withColumn("_i", place).where(F.col("_i") <= recent).select("c_nationkey", "o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    stock = table(spark, d, "part").select("p_partkey", "p_size")
    return lines.join(stock, F.col("l_partkey") == F.col("p_partkey")).groupBy("c_nationkey").agg(F.count_if(F.col("p_size") < threshold).alias("low_stock"), F.count(F.lit(1)).alias("n_lines"))


def order_status(spark: SparkSession, d: str) -> DataFrame:
    """Per market segment and nation the middle customer by name (the lower one of two), its newest order, and that order's lines."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    group = Window.partitionBy("c_mktsegment", "c_nationkey")
    mid = cust.withColumns({"_i": F.row_number().over(group.orderBy("c_name", "c_custkey")), "_n": F.count(F.lit(1)).over(group)}).where(F.col("_i") == F.floor((F.col("_n") + 1) / 2))
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_quantity")), 2).alias("quantity"))
    return mid.join(last, "c_custkey", "left").join(lines, "o_orderkey", "left").select("c_mktsegment", "c_nationkey", "c_custkey", "o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "quantity")


def delivery(spark: SparkSession, d: str) -> DataFrame:
    """Per nation its oldest open order: who gets it, and the balance after its lines are added."""
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    opened = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    first = opened.groupBy("c_nationkey").agg(F.min_by(F.struct("o_orderkey", "c_custkey", "c_acctbal"), "o_orderkey").alias("x")).select("c_nationkey", "x.*")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("amount"))
    out = first.join(sums, "o_orderkey", "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    return out.select("c_nationkey", "o_orderkey", "c_custkey", F.round("amount", 2).alias("amount"), F.round(F.col("c_acctbal") + F.col("amount"), 2).alias("c_balance"), F.lit(1).cast("bigint").alias("c_delivery_cnt"))


def payment(spark: SparkSession, d: str) -> DataFrame:
    """Payments (events of purchases, the user as customer) taken from balances: per customer the sums and counts."""
    paid = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum("value").alias("_p"), F.count(F.lit(1)).alias("_n"))
    out = table(spark, d, "customer").join(paid, "c_custkey")
    return out.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") - F.col("_p"), 2).alias("c_balance"), F.round("_p", 2).alias("c_ytd_payment"), F.col("_n").alias("c_payment_cnt"))


def payment_totals(spark: SparkSession, d: str) -> DataFrame:
    """Year-to-date sums by nation and region."""
    nation = table(spark, d, "nation")
    return payment(spark, d).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.round(F.sum("c_ytd_payment"), 2).alias("ytd"), F.sum("c_payment_cnt").alias("n_payments"))


def new_order(spark: SparkSession, d: str, discount: float = 0.05, tax: float = 0.1) -> DataFrame:
    """Per order its total, the stock left after it, and how many of its parts are of a generic brand."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", "p_name")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    left = F.when(F.col("p_size") > F.col("l_quantity") + 10, F.col("p_size") - F.col("l_quantity")).otherwise(F.col("p_size") - F.col("l_quantity") + 91)
    return j.groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")) * (1 - discount) * (1 + tax), 6).alias("total"), F.round(F.sum(left), 2).alias("stock_left"), F.count_if(F.contains("p_name", F.lit("widget"))).alias("n_generic")
    )


#: Shares of the five transactions in a hundred, in the order stock level, order status, delivery, payment, new order.
MIX = {"stock_level": 4, "order_status": 4, "delivery": 4, "payment": 43, "new_order": 45}


def mix(numbers: DataFrame, number: str = "event_id") -> DataFrame:
    """numbers with the transaction of each: the same for the same number, and in MIX's shares of any run of a hundred."""
    place, upto, out = F.pmod(F.col(number), F.lit(100)), 100, F.lit(None).cast("string")
    for name, share in reversed(MIX.items()):
        upto -= share
        out = F.when((place >= upto) & out.isNull(), F.lit(name)).otherwise(out)
    return numbers.withColumn("txn", out)
