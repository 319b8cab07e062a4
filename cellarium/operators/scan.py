"""Scans and gets over a cell log: key ranges, projections, versions, qualifiers, filters and time ranges, in that order."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.filters import FilterList, ValueFilter
from cellarium.operators.resolve import CELL, DEL_ROW, resolve
from cellarium.schema import TableSchema

OUT = [*CELL, "ts", "value"]
#: Keys that round_down looks at first.
ROUND_KEYS = 64


def key_range(start: str = "", end: str = "") -> Column:
    """start is within, end is not, an empty one is no bound."""
    out = F.lit(True)
    if start:
        out &= F.col("row") >= start
    if end:
        out &= F.col("row") < end
    return out


def prefix_range(prefix: str) -> tuple[str, str]:
    """The key range of a prefix: up to the least key that is greater than all that begin so."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            return prefix, prefix[:i] + chr(ord(prefix[i]) + 1)
    return prefix, ""


@dataclass
class ScanDescriptor:
    start: str = ""
    end: str = ""
    families: set[str] = field(default_factory=set)
    columns: set[tuple[str, str]] = field(default_factory=set)
    time_range: tuple[int, int] | None = None
    max_versions: int = 1
    max_qualifiers: int | None = None
    filter: ValueFilter | FilterList | None = None
    snapshot: int | None = None
    #: Limits of one message in an online store: they don't limit a result, so they do nothing here.
    number_limit: int | None = None
    buffer_size: int = 65536

    def add_column_family(self, cf: str) -> ScanDescriptor:
        self.families.add(cf)
        return self

    def add_column(self, cf: str, qual: str) -> ScanDescriptor:
        self.columns.add((cf, qual))
        return self


@dataclass
class RowReader:
    row: str
    families: set[str] = field(default_factory=set)
    columns: set[tuple[str, str]] = field(default_factory=set)
    time_range: tuple[int, int] | None = None
    max_versions: int = 1
    snapshot: int | None = None


def _wanted(families: set[str], columns: set[tuple[str, str]]) -> Column | None:
    """A family of which columns are named is restricted to them."""
    whole = families - {cf for cf, _ in columns}
    parts = [F.col("cf").isin(sorted(whole))] if whole else []
    for cf in sorted({cf for cf, _ in columns}):
        parts.append((F.col("cf") == cf) & F.col("qual").isin(sorted(q for c, q in columns if c == cf)))
    out = None
    for p in parts:
        out = p if out is None else out | p
    return out


def _read(log: DataFrame, families: set[str], where: Column) -> DataFrame:
    """The part of the log that a read needs; row deletes count for every family."""
    log = log.where(where)
    return log.where(F.col("cf").isin(sorted(families)) | (F.col("type") == DEL_ROW)) if families else log


def scan(log: DataFrame, schema: TableSchema, d: ScanDescriptor | None = None, now_us: int | None = None, rollbacks: Iterable[tuple[int, int]] = ()) -> DataFrame:
    d = d or ScanDescriptor()
    if d.filter is not None and d.max_versions != 1:
        raise ValueError("a value filter needs max_versions = 1")
    asked = d.families | {cf for cf, _ in d.columns}
    read = asked | d.filter.families() if asked and d.filter is not None else asked
    cells = resolve(_read(log, read, key_range(d.start, d.end)), schema, now_us, d.snapshot, rollbacks)
    cells = cells.where(F.col("version") <= d.max_versions)
    if d.max_qualifiers is not None:
        place = F.dense_rank().over(Window.partitionBy("row", "cf").orderBy("qual"))
        cells = cells.withColumn("_q", place).where(F.col("_q") <= d.max_qualifiers).drop("_q")
    if d.filter is not None:
        cells = cells.withColumn("_keep", d.filter.keeps()).where("_keep").drop("_keep")
    if (wanted := _wanted(d.families, d.columns)) is not None:
        cells = cells.where(wanted)
    if d.time_range:
        cells = cells.where(F.col("ts").between(*d.time_range))
    return cells.select(*OUT)


def get(log: DataFrame, schema: TableSchema, r: RowReader, now_us: int | None = None, rollbacks: Iterable[tuple[int, int]] = ()) -> DataFrame:
    """One row's cells. Named columns are limited to their newest versions within the time range; otherwise this is a scan of one row."""
    if not r.columns or r.families:
        return scan(log, schema, ScanDescriptor(r.row, r.row + "\0", r.families, r.columns, r.time_range, r.max_versions, snapshot=r.snapshot), now_us, rollbacks)
    return read_columns(log.where(F.col("row") == r.row), schema, r.columns, r.time_range, r.max_versions, r.snapshot, now_us, rollbacks)


def read_columns(log: DataFrame, schema: TableSchema, columns: set[tuple[str, str]], time_range: tuple[int, int] | None = None, max_versions: int = 1, snapshot: int | None = None, now_us: int | None = None, rollbacks: Iterable[tuple[int, int]] = ()) -> DataFrame:
    cells = resolve(_read(log, {cf for cf, _ in columns}, F.lit(True)), schema, now_us, snapshot, rollbacks).where(_wanted(set(), columns))
    if time_range:
        cells = cells.where(F.col("ts").between(*time_range))
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("ts")))
    return cells.withColumn("_v", place).where(F.col("_v") <= max_versions).select(*OUT)


def batch_get(log: DataFrame, schema: TableSchema, keys: DataFrame, now_us: int | None = None, max_versions: int = 1, snapshot: int | None = None, rollbacks: Iterable[tuple[int, int]] = ()) -> DataFrame:
    """Cells of the rows in keys (row). The semi join stands below the resolution, so only asked rows are resolved; Spark picks its kind by size."""
    return resolve(log.join(keys.select("row").distinct(), "row", "left_semi"), schema, now_us, snapshot, rollbacks).where(F.col("version") <= max_versions).select(*OUT)


def missing_rows(log: DataFrame, schema: TableSchema, keys: DataFrame, now_us: int | None = None) -> DataFrame:
    """Asked rows that have no cell."""
    return keys.select("row").distinct().join(batch_get(log, schema, keys, now_us).select("row").distinct(), "row", "left_anti")


def round_down(log: DataFrame, schema: TableSchema, key: str, now_us: int | None = None) -> DataFrame:
    """Cells of the greatest row up to key.

    The greatest stored keys are resolved, ROUND_KEYS of them and then ever more, until one of them has a cell: a key
    whose cells are all deleted has none.
    """
    below, n = log.where(F.col("row") <= key), ROUND_KEYS
    while True:
        keys = [r.row for r in below.select("row").distinct().orderBy(F.desc("row")).limit(n).collect()]
        # of the least key on, Spark reads files from there only
        cells = resolve(below.where(F.col("row") >= keys[-1]), schema, now_us).where("version = 1") if keys else resolve(below.limit(0), schema, now_us)
        last = cells.agg(F.max("row")).first()[0] if keys else None
        if last is not None or len(keys) < n:
            return cells.where(F.col("row") == F.lit(last)).select(*OUT)
        below, n = below.where(F.col("row") < keys[-1]), min(16 * n, 1 << 16)


def resume_after(cells: DataFrame, last: tuple[str, str, str, int]) -> DataFrame:
    """Cells that come after the cell `last` (row, cf, qual, ts) in scan order, which has newer versions first: where a scan that was cut off goes on."""
    row, cf, qual, ts = last
    same = lambda *c: functools.reduce(Column.__and__, [F.col(n) == v for n, v in zip(CELL, c)])
    return cells.where((F.col("row") > row) | (same(row) & (F.col("cf") > cf)) | (same(row, cf) & (F.col("qual") > qual)) | (same(row, cf, qual) & (F.col("ts") < ts)))


def observed(cells: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """cells, and what a scan of them counts as it runs: n_cells, n_rows about, and bytes of keys and values."""
    counts = Observation(name)
    size = F.length("row") + F.length("cf") + F.length("qual") + F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit("")))
    return cells.observe(counts, F.count(F.lit(1)).alias("n_cells"), F.approx_count_distinct("row").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), counts


def row_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.countDistinct("row").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"))


def kv_rows(log: DataFrame, now_us: int | None = None) -> DataFrame:
    """(row, value) of a stored key-value log (row, value, seq, expire, gone): newest values that are neither deleted nor expired."""
    newest = log.groupBy("row").agg(F.max_by(F.struct("value", "expire", "gone"), "seq").alias("x")).select("row", "x.*").where("not gone")
    return (newest if now_us is None else newest.where(F.col("expire").isNull() | (F.col("expire") > now_us // 1_000_000))).select("row", "value")


def kv_latest(log: DataFrame, now_s: int | None = None) -> DataFrame:
    """Newest value of each key of a key-value log (key, value, seq[, expire]); expire is in seconds, null or under 0 for never."""
    cols = ["value", "seq", *(["expire"] if "expire" in log.columns else [])]
    out = log.groupBy("key").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("key", "x.*")
    if now_s is not None and "expire" in cols:
        out = out.where(F.col("expire").isNull() | (F.col("expire") < 0) | (F.col("expire") > now_s))
    return out.select("key", "value")
