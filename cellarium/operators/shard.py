"""Key ranges of tables: delimiters, splitting, merging, locating and checking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_delimiters(n: int) -> list[str]:
    """n - 1 equally spaced 16-digit hexadecimal keys; none for n under 2."""
    step = ((1 << 64) - 1) // n if n > 1 else 0
    return [f"{step * i:016x}" for i in range(1, n)] if n > 1 else []


def delimiters_ascend(keys: DataFrame) -> DataFrame:
    """keys (i, delimiter): one row, ok and the number of those not above the one before."""
    before = F.lag("delimiter").over(Window.orderBy("i"))
    bad = keys.select((before >= F.col("delimiter")).alias("bad"))
    return bad.agg(F.count_if("bad").alias("n_bad")).select((F.col("n_bad") == 0).alias("ok"), "n_bad")


def average_key(start: bytes, end: bytes) -> bytes | None:
    """A key between start and end (empty: unbounded), about the middle; None where there is none."""
    if end and start >= end:
        return None
    width = max(len(start), len(end)) + 1
    low = int.from_bytes(start.ljust(width, b"\0"), "big")
    high = int.from_bytes(end.ljust(width, b"\0"), "big") if end else 256**width - 1
    mid = ((low + high) // 2).to_bytes(width, "big")
    least = 0  # the shortest prefix of the midpoint that still lies within
    while least <= width:
        if mid[:least] > start and (not end or mid[:least] < end):
            return mid[:least]
        least += 1
    return b"\0" if end == b"\1" and not start else None


def tablet_loads(cells: DataFrame, tablets: DataFrame) -> DataFrame:
    """Cells and bytes of each tablet (name, start, end). Ranges are few against cells; a broadcast is Spark's choice by size."""
    rows = cells.groupBy("row").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.length("row") + F.length("qual") + 16).alias("bytes"))
    return locate(rows, tablets).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_cells").alias("n_cells"), F.sum("bytes").alias("bytes"))


def split_key(cells: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The least row below which lies at least `ratio` of all bytes: one row (split_row), after a grouping by row.

    Sizes are summed by hashed-free key prefixes first, so that no task orders all rows: only rows of the prefix that holds the point are.
    """
    rows = cells.groupBy("row").agg(F.sum(F.length("row") + F.length("qual") + 16).alias("bytes"))
    by_prefix = rows.groupBy(F.substring("row", 1, 6).alias("_p")).agg(F.sum("bytes").alias("_b"))
    total = F.sum("_b").over(Window.partitionBy())
    run = F.sum("_b").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    hit = by_prefix.select("_p", (run - F.col("_b")).alias("_before"), run.alias("_run"), (total * ratio).alias("_goal")).where("_run >= _goal and _before < _goal")
    near = rows.withColumn("_p", F.substring("row", 1, 6)).join(F.broadcast(hit), "_p")  # one prefix
    upto = F.sum("bytes").over(Window.partitionBy("_p").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return near.withColumn("_upto", upto).where("_upto >= _goal").agg(F.min("row").alias("split_row"))


def merge_candidates(loads: DataFrame, mergesize: int) -> DataFrame:
    """Tablets under mergesize bytes with the smaller of their neighbours. loads: name, start, bytes."""
    w = Window.orderBy("start")
    near = loads.withColumns({"_pn": F.lag("name").over(w), "_pb": F.lag("bytes").over(w), "_nn": F.lead("name").over(w), "_nb": F.lead("bytes").over(w)})
    partner = F.when(F.col("_pn").isNull(), F.col("_nn")).when(F.col("_nn").isNull(), F.col("_pn")).when(F.col("_pb") <= F.col("_nb"), F.col("_pn")).otherwise(F.col("_nn"))
    return near.where(F.col("bytes") < mergesize).select("name", partner.alias("partner")).where("partner is not null")


def locate(keys: DataFrame, tablets: DataFrame) -> DataFrame:
    """keys (row, ...) with the name of the tablet (name, start, end) that has them."""
    return keys.join(tablets, (F.col("row") >= F.col("start")) & ((F.col("end") == "") | (F.col("row") < F.col("end")))).drop("start", "end")


def _ordered() -> Window:
    return Window.orderBy("start", F.when(F.col("end") == "", 1).otherwise(0), "end")


def coverage(ranges: DataFrame) -> DataFrame:
    """Touching or overlapping ranges (start, end; an empty end is unbounded) merged: islands."""
    top = F.lit("\U0010ffff")
    r = ranges.select("start", F.when(F.col("end") == "", top).otherwise(F.col("end")).alias("end"))
    before = F.max("end").over(Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = r.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
    isle = F.sum("_new").over(Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("_isle", isle).groupBy("_isle").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select("start", F.when(F.col("end") == top, "").otherwise(F.col("end")).alias("end"))


def range_health(tablets: DataFrame) -> DataFrame:
    """tablets (name, start, end) with a state against the ones before in key order: invalid, covered, overlap, miss or ok."""
    top = F.lit("\U0010ffff")
    e = F.when(F.col("end") == "", top).otherwise(F.col("end"))
    w = Window.orderBy("start", "_e", "name").rowsBetween(Window.unboundedPreceding, -1)
    t = tablets.withColumn("_e", e).withColumn("_before", F.coalesce(F.max("_e").over(w), F.lit("")))
    state = F.when(F.col("start") >= F.col("_e"), "invalid").when(F.col("_e") <= F.col("_before"), "covered").when(F.col("start") < F.col("_before"), "overlap").when(F.col("start") > F.col("_before"), "miss").otherwise("ok")
    return t.select("name", "start", "end", state.alias("state"))


def gap_fillers(tablets: DataFrame) -> DataFrame:
    """Ranges (start, end) that no tablet has: before the first, between, and after the last."""
    isles = coverage(tablets)
    inner = isles.select(F.coalesce(F.lag("end").over(Window.orderBy("start")), F.lit("")).alias("start"), F.col("start").alias("end")).where("start < end")
    last = isles.agg(F.max_by("end", "start").alias("start")).where("start <> ''").select("start", F.lit("").alias("end"))
    return inner.unionByName(last)


def without_overlaps(tablets: DataFrame) -> DataFrame:
    """Of two neighbours that overlap, the greater name stays."""
    w = Window.orderBy("start", "end", "name")
    nxt = tablets.withColumns({"_n": F.lead("name").over(w), "_s": F.lead("start").over(w), "_p": F.lag("name").over(w), "_pe": F.lag("end").over(w)})
    loses = ((F.col("_s") < F.col("end")) | ((F.col("end") == "") & F.col("_s").isNotNull())) & (F.col("_n") > F.col("name"))
    loses |= ((F.col("_pe") > F.col("start")) | (F.col("_pe") == "")) & (F.col("_p") > F.col("name"))
    return nxt.where(~F.coalesce(loses, F.lit(False))).select(*tablets.columns)


def bucket_of(key_index: int, n_keys: int, buckets: int) -> int:
    """Bucket of the i-th of n keys when they are dealt to buckets as evenly as can be, in order."""
    size, more = divmod(n_keys, buckets)
    return key_index // (size + 1) if key_index < more * (size + 1) else more + (key_index - more * (size + 1)) // size
