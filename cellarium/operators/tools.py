"""Table tools: dump, diff, repair, roll-ups, series, availability, quotas and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.resolve import CELL, DEL_ROW, VALUE


def dump(cells: DataFrame, window: tuple[int, int] | None = None, families: dict[str, str] | None = None) -> DataFrame:
    """Cells of a time window (both ends within) of the named families, renamed."""
    if window:
        cells = cells.where(F.col("ts").between(*window))
    if families is not None:
        name = F.lit(None).cast("string")
        for old, new in families.items():
            name = F.when(F.col("cf") == old, new).otherwise(name)
        cells = cells.where(F.col("cf").isin(list(families))).withColumn("cf", name)
    return cells


def dump_to(cells: DataFrame, path: str, window: tuple[int, int] | None = None, families: dict[str, str] | None = None) -> None:
    """Write cells of a window and of families, renamed, for load_from."""
    dump(cells, window, families).select(*CELL, "ts", "value").write.mode("errorifexists").parquet(path)


def load_from(spark: SparkSession, path: str, tables: dict[str, set[str]], failed: str, first_seq: int = 1) -> dict[str, DataFrame]:
    """Logs for tables (name -> its families) from a dump's cells; cells of a family that no table has are written to `failed` with the reason.

    Sequence numbers rise from first_seq; a dump has each cell version once, so that their order tells nothing.
    """
    cells = spark.read.parquet(path)
    known = sorted(set().union(*tables.values())) if tables else []
    bad = cells.where(~F.coalesce(F.col("cf").isin(known), F.lit(False))).withColumn("reason", F.lit("unknown family"))
    bad.write.mode("errorifexists").parquet(failed)
    log = cells.select(*CELL, "ts", F.lit(VALUE).cast("byte").alias("type"), "value", (F.monotonically_increasing_id() + first_seq).alias("seq"))
    return {name: log.where(F.col("cf").isin(sorted(families))) for name, families in tables.items()}


def stat_records(found: DataFrame, now_us: int) -> DataFrame:
    """A log of corruption records: one row `!tablet` for each of found (tablet, what), which a later record replaces; without `what` the record is erased."""
    return found.select(F.concat(F.lit("!"), "tablet").alias("row"), F.lit("corruption").alias("cf"), F.lit("what").alias("qual"), F.lit(now_us).cast("long").alias("ts"), F.when(F.col("what").isNull(), DEL_ROW).otherwise(VALUE).cast("byte").alias("type"), F.col("what").alias("value"), F.lit(now_us).cast("long").alias("seq"))


def diff(src: DataFrame, dest: DataFrame, multi_version: list[str] | None = None) -> DataFrame:
    """Each cell of either table with its state: only_in_src, only_in_dest, both_but_diff or both_same.

    Timestamps tell cells apart only in families of several versions.
    """
    key = F.when(F.col("cf").isin(multi_version), F.col("ts")).otherwise(F.lit(0)) if multi_version else F.lit(0)
    a = src.select(*CELL, key.cast("long").alias("at"), F.col("value").alias("src_value"), F.lit(True).alias("_s"))
    b = dest.select(*CELL, key.cast("long").alias("at"), F.col("value").alias("dest_value"), F.lit(True).alias("_d"))
    state = F.when(F.col("_d").isNull(), "only_in_src").when(F.col("_s").isNull(), "only_in_dest").when(F.col("src_value").eqNullSafe(F.col("dest_value")), "both_same").otherwise("both_but_diff")
    return a.join(b, [*CELL, "at"], "full_outer").select(*CELL, "at", "src_value", "dest_value", state.alias("state"))


def diff_counts(d: DataFrame) -> DataFrame:
    return d.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def repair(src: DataFrame, dest: DataFrame) -> DataFrame:
    """Cells of src that dest lacks, to be appended to it."""
    return src.join(dest.select(*CELL), CELL, "left_anti")


def backup_diff(now: DataFrame, backup: DataFrame) -> DataFrame:
    """Tablets (path, start, end) against a backup: differs, missing or same."""
    b = backup.select("path", F.col("start").alias("_s"), F.col("end").alias("_e"))
    state = F.when(F.col("_s").isNull(), "missing").when((F.col("_s") != F.col("start")) | (F.col("_e") != F.col("end")), "differs").otherwise("same")
    return now.join(b, "path", "left").select("path", state.alias("state"))


def table_counters(loads: DataFrame, by: str = "table") -> DataFrame:
    """Sums and maxima of tablets (by, name, n_cells, bytes) for each table and, where it is null, for all."""
    return loads.rollup(by).agg(F.count(F.lit(1)).alias("n_tablets"), F.sum("n_cells").alias("n_cells"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("max_bytes"))


def metric_windows(points: DataFrame, seconds: int) -> DataFrame:
    """points (name, ts timestamp, value) by interval: latest, max, min, sum, queries a second and throughput."""
    w = F.window("ts", f"{seconds} seconds")
    out = points.groupBy("name", w.alias("w")).agg(F.max_by("value", "ts").alias("latest"), F.max("value").alias("max"), F.min("value").alias("min"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("_n"))
    return out.select("name", F.col("w.start").alias("start"), "latest", "max", "min", "sum", (F.col("_n") / seconds).alias("qps"), (F.col("sum") / seconds).alias("throughput"))


def percentiles(points: DataFrame, by: str, value: str, ps: list[float]) -> DataFrame:
    return points.groupBy(by).agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps))


def fill_series(points: DataFrame, interval: int) -> DataFrame:
    """points (server, ts in seconds, value) with empty points where the next is over 1.5 intervals away; `real` tells them apart."""
    nxt = F.lead("ts").over(Window.partitionBy("server").orderBy("ts"))
    gaps = points.withColumn("_next", nxt)
    spaced = F.when(F.col("_next") - F.col("ts") > 1.5 * interval, F.sequence(F.col("ts") + interval, F.col("_next") - 1, F.lit(interval))).otherwise(F.array().cast("array<bigint>"))
    empty = gaps.select("server", F.explode(spaced).alias("ts"), F.lit(None).cast(points.schema["value"].dataType).alias("value"), F.lit(False).alias("real"))
    return points.select("server", "ts", "value", F.lit(True).alias("real")).unionByName(empty)


def real_share(filled: DataFrame) -> DataFrame:
    """Real points in a million, by server."""
    return filled.groupBy("server").agg((F.count_if("real") * 1_000_000 / F.count(F.lit(1))).cast("long").alias("av_ratio"))


def availability(states: DataFrame, now: int, bounds: tuple[int, int, int] = (60, 600, 3600)) -> DataFrame:
    """states (table, tablet, ready, since in seconds): not-ready tablets by how long, and the ready share."""
    age = F.lit(now) - F.col("since")
    late = ~F.col("ready")
    warning, error, fatal = bounds
    return states.groupBy("table").agg(
        F.count(F.lit(1)).alias("n_tablets"), F.count_if(late & (age >= fatal)).alias("fatal"), F.count_if(late & (age >= error) & (age < fatal)).alias("error"), F.count_if(late & (age >= warning) & (age < error)).alias("warning"),
        F.count_if("ready").alias("n_ready"),
    ).withColumn("ready_share", F.round(F.col("n_ready") / F.col("n_tablets"), 6))


def ready_time(spells: DataFrame, period: int, n_tablets: int) -> DataFrame:
    """Percent of tablet seconds that were ready. spells: seconds of each time a tablet wasn't."""
    return spells.agg((100.0 * (1 - F.coalesce(F.sum("seconds"), F.lit(0)) / F.lit(float(period) * n_tablets))).alias("ready_percent"))


def over_quota(requests: DataFrame, limits: DataFrame, period: int) -> DataFrame:
    """requests (table, op, ts in seconds, amount) by fixed window against limits (table, op, most; under 0 for none)."""
    used = requests.groupBy("table", "op", (F.floor(F.col("ts") / period) * period).alias("window")).agg(F.sum("amount").alias("used"))
    return used.join(limits, ["table", "op"]).select("table", "op", "window", "used", ((F.col("most") >= 0) & (F.col("used") > F.col("most"))).alias("over"))


def allowed(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests (user, roles array, table, cf, qual, action) with ok: any role with a permission that reaches that far.

    permissions: role, scope (global, namespace, table, family, column), namespace, table, cf, qual, action.
    """
    r = requests.withColumn("_r", F.monotonically_increasing_id())
    asked = r.select("_r", F.explode("roles").alias("role"), F.split("table", ":", 2)[0].alias("_ns"), "table", "cf", "qual", "action")
    p = permissions.select("role", "action", "scope", *(F.col(c).alias(f"p_{c}") for c in ("namespace", "table", "cf", "qual")))
    far = (F.col("scope") == "global") | ((F.col("scope") == "namespace") & (F.col("p_namespace") == F.col("_ns")))
    table = F.col("p_table") == F.col("table")
    far |= (F.col("scope") == "table") & table | (F.col("scope") == "family") & table & (F.col("p_cf") == F.col("cf")) | (F.col("scope") == "column") & table & (F.col("p_cf") == F.col("cf")) & (F.col("p_qual") == F.col("qual"))
    good = asked.join(p, ["role", "action"]).where(far).select("_r").distinct().withColumn("_ok", F.lit(True))
    return r.join(good, "_r", "left").withColumn("ok", F.coalesce("_ok", F.lit(False))).drop("_r", "_ok")


def node_costs(loads: DataFrame) -> DataFrame:
    """Per node sums of loads (node, bytes, reads, writes, scans) and each sum's place between the least and greatest node, 0 to 1."""
    sums = loads.groupBy("node").agg(F.count(F.lit(1)).alias("n_tablets"), *(F.sum(c).alias(c) for c in ("bytes", "reads", "writes", "scans")))
    every = Window.partitionBy()

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    return sums.select("*", *(F.round(scaled(c), 6).alias(f"{c}_cost") for c in ("n_tablets", "bytes", "reads", "writes", "scans")))


def corruption_messages(log: DataFrame, phase: str | None = None, table: str | None = None, tablet: str | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """Messages (tablet, table, phase, ts, message) that fit all that is given."""
    for c, v in (("phase", phase), ("table", table), ("tablet", tablet)):
        if v is not None:
            log = log.where(F.col(c) == v)
    return log.where(F.col("ts").between(*window)) if window else log
