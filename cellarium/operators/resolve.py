"""Cell resolution: what of a log of cell entries is visible, as windows over one sort of one exchange.

A log has the columns row, cf, qual, ts, type, value and seq. The rules, in order: snapshot and rollbacks; known
families; time to live; the newest of equal entries; row, family and column deletes; deletes of one version; atomic
operations hidden by a later put; the version limit; merging of atomic operations.

All windows are over prefixes of (row, cf, qual, -ts, type), so an exchange by row and a sort by that list serve them
all. Predicates on row are pushed below by Catalyst; those on families are written below by `scan`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellarium.functions.codecs import decode_counter, encode_counter
from cellarium.schema import TableSchema

#: Types of entries.
DEL_ROW, DEL_FAMILY, DEL_COLUMNS, DEL_COLUMN, VALUE, ADD, PUT_IF_ABSENT, APPEND, ADD_INT64 = 1, 2, 3, 4, 5, 7, 8, 9, 10
ATOMIC = (ADD, PUT_IF_ABSENT, APPEND, ADD_INT64)
CELL = ["row", "cf", "qual"]
LOG_COLUMNS = [*CELL, "ts", "type", "value", "seq"]


def log_schema(value: T.DataType | None = None, key: T.DataType | None = None) -> T.StructType:
    key = key or T.StringType()
    return T.StructType([T.StructField("row", key, False), T.StructField("cf", T.StringType()), T.StructField("qual", key), T.StructField("ts", T.LongType()), T.StructField("type", T.ByteType()), T.StructField("value", value or T.StringType()), T.StructField("seq", T.LongType())])


def visible_at(log: DataFrame, snapshot: int | None = None, rollbacks: Iterable[tuple[int, int]] = ()) -> DataFrame:
    """Entries of a snapshot that no rollback (after the first sequence number, up to the second) took back."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    for low, high in rollbacks:
        log = log.where(~((F.col("seq") > low) & (F.col("seq") <= high)))
    return log


def _by_family(schema: TableSchema, attribute: str, default: int) -> Column:
    """A family's setting as a literal CASE on cf."""
    out = F.lit(default)
    for value in sorted({getattr(f, attribute) for f in schema.families} - {default}):
        out = F.when(F.col("cf").isin([f.name for f in schema.families if getattr(f, attribute) == value]), value).otherwise(out)
    return out


def live_entries(log: DataFrame, schema: TableSchema, now_us: int | None = None) -> DataFrame:
    """Entries of known families (row deletes have none) that haven't expired; deletes never expire."""
    log = log.where(F.col("cf").isin(schema.names) | (F.col("type") == DEL_ROW))
    if now_us is not None and any(f.ttl for f in schema.families):
        ttl = _by_family(schema, "ttl", 0).cast("long")
        log = log.where((F.col("type") < VALUE) | (ttl == 0) | (F.col("ts") + ttl * 1_000_000 > now_us))
    return log


def resolve(log: DataFrame, schema: TableSchema, now_us: int | None = None, snapshot: int | None = None, rollbacks: Iterable[tuple[int, int]] = (), merge: bool = True, strict: bool = False) -> DataFrame:
    """Visible cells: row, cf, qual, ts, value and version (1 for a cell's newest).

    merge: fold atomic operations that are newest in their cell; without it they are shown as they are.
    strict: a version delete hides only an entry of its very timestamp.
    """
    entries = live_entries(visible_at(log, snapshot, rollbacks), schema, now_us)
    numeric = not isinstance(log.schema["value"].dataType, (T.StringType, T.BinaryType))
    s = entries.select(*LOG_COLUMNS, (-F.col("ts")).alias("_age")).repartition("row")
    w_row, w_cf, w_cell = Window.partitionBy("row"), Window.partitionBy("row", "cf"), Window.partitionBy(*CELL)
    newest = F.row_number().over(Window.partitionBy(*CELL, "_age", "type").orderBy(F.desc("seq")))
    s = s.withColumn("_n", newest).where("_n = 1").drop("_n")
    deleted = lambda kind, w: F.max(F.when(F.col("type") == kind, F.col("ts"))).over(w)
    s = s.withColumn("_dc", deleted(DEL_COLUMNS, w_cell)).withColumn("_df", deleted(DEL_FAMILY, w_cf)).withColumn("_dr", deleted(DEL_ROW, w_row))
    gone = F.coalesce(F.greatest("_dc", "_df", "_dr"), F.lit(-(1 << 62)))
    s = s.where((F.col("type") >= DEL_COLUMN) & (F.col("ts") > gone)).drop("_dc", "_df", "_dr")
    ordered = w_cell.orderBy("_age", "type")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    hit = F.lag("type").over(ordered) == DEL_COLUMN
    if strict:
        hit &= F.lag("ts").over(ordered) == F.col("ts")
    s = s.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    is_value = F.col("type") == VALUE
    s = s.withColumns({
        "_puts": F.coalesce(F.sum((is_value & ~F.col("_hit")).cast("int")).over(before), F.lit(0)),
        "_dels": F.coalesce(F.sum((F.col("type") == DEL_COLUMN).cast("int")).over(before), F.lit(0)),
        "_rank": F.sum(is_value.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
    })
    limit = _by_family(schema, "maxversions", 1)
    shown = ~F.col("_hit") & F.when(is_value, F.col("_rank") <= limit).otherwise((F.col("type") > VALUE) & (F.col("_puts") == 0))
    s = s.where(shown)
    if merge:
        s = _merged(s, w_cell, ordered, numeric)
    return s.withColumn("version", F.row_number().over(ordered)).select(*CELL, "ts", "value", "version")


def _merged(s: DataFrame, w_cell, ordered, numeric: bool) -> DataFrame:
    """Fold each cell's chain: its newest atomic operation, older ones of that kind, and the first put below, up to any delete."""
    head_type, head_dels, head_ts = (F.first(c).over(ordered) for c in ("type", "_dels", "ts"))
    s = s.withColumns({"_ht": head_type, "_hd": head_dels, "_hts": head_ts, "_dup": F.lag("_age").over(ordered)})
    in_chain = (F.col("_ht") > VALUE) & (F.col("_puts") == 0) & (F.col("_dels") == F.col("_hd"))
    counts = in_chain & F.col("type").isin(VALUE, F.col("_ht")) & F.coalesce(F.col("_dup") != F.col("_age"), F.lit(True))
    s = s.withColumns({"_chain": in_chain, "_use": counts})
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = s.schema["value"].dataType
    raw = isinstance(kind, T.BinaryType)  # counters are eight bytes then
    number = decode_counter(F.col("value")) if raw else F.col("value")
    total = F.sum(F.when(F.col("_use") & F.col("_ht").isin(ADD, ADD_INT64), number.cast("decimal(38,0)"))).over(whole).cast("long")
    total = encode_counter(total) if raw else total.cast(kind)
    oldest = F.last(F.when(F.col("_use") & (F.col("_ht") == PUT_IF_ABSENT), F.col("value")), ignorenulls=True).over(whole)
    folded = F.when(F.col("_ht") == PUT_IF_ABSENT, oldest).when(F.col("_ht").isin(ADD, ADD_INT64), total)
    if not numeric:
        parts = F.collect_list(F.when(F.col("_use") & (F.col("_ht") == APPEND), F.col("value"))).over(whole)
        joined = F.unhex(F.array_join(F.transform(F.reverse(parts), lambda v: F.hex(v)), "")) if raw else F.array_join(F.reverse(parts), "").cast(kind)
        folded = folded.when(F.col("_ht") == APPEND, joined)
    s = s.withColumn("_folded", folded)
    head = F.col("_chain") & (F.row_number().over(ordered) == 1)
    return s.withColumn("_head", head).where("not _chain or _head").withColumn("value", F.when(F.col("_head"), F.col("_folded")).otherwise(F.col("value")))


def compact(log: DataFrame, schema: TableSchema, now_us: int | None = None) -> DataFrame:
    """The log rewritten as the puts that are visible in it: reading either gives the same cells."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return resolve(log, schema, now_us).select(*CELL, "ts", F.lit(VALUE).cast("byte").alias("type"), "value", F.lit(top).cast("long").alias("seq"))


def row_maps(cells: DataFrame) -> DataFrame:
    """Each row as a map of families to maps of qualifiers to maps of timestamps to values."""
    stamps = cells.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("ts", "value"))).alias("stamps"))
    quals = stamps.groupBy("row", "cf").agg(F.map_from_entries(F.collect_list(F.struct("qual", "stamps"))).alias("quals"))
    return quals.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("cf", "quals"))).alias("families"))
