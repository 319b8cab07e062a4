"""One query for each operator, with the SQL that says the same; sort order doesn't count, names and values do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions import codecs
from cellarium.operators import scan as scans
from cellarium.operators import shard, tools, txn
from cellarium.operators.filters import ColumnFilter, FilterList, ValueFilter
from cellarium.operators.resolve import compact, resolve, row_maps
from cellarium.operators.scan import RowReader, ScanDescriptor, get, read_columns, scan
from cellarium.plans import fixtures as fx
from cellarium.plans import workloads
from cellarium.schema import Family, TableSchema
from cellarium.session import scratch, table
from cellarium.sources.store import Client, RowMutation
from cellarium.sources.text import parse_mark_lines, parse_put_lines, workload_lines
from cellarium.streaming import observe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: 10 and 20 January 2024, and the time that time to live is judged at.
T1, T2, NOW = 1_704_844_800_000_000, 1_705_708_800_000_000, 1_706_659_200_000_000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ev(maxversions: int = 1, ttl: int = 0) -> TableSchema:
    return TableSchema("events", (Family("ev", maxversions=maxversions, ttl=ttl),))


def _newest(n: int = 1, src: str = fx.CELLS, more: str = "") -> str:
    return f"""SELECT "row", cf, qual, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY "row", cf, qual ORDER BY ts DESC, seq DESC) AS v FROM ({src})) WHERE v <= {n} {more}"""


# --- scans and gets ------------------------------------------------------------


@query(_newest())
def scan_latest(spark, d):
    return scan(fx.cells_events(spark, d), ev())


@query(_newest(3))
def scan_versions3(spark, d):
    return scan(fx.cells_events(spark, d), ev(5), ScanDescriptor(max_versions=3))


@query(_newest(3, more=f"AND ts BETWEEN {T1} AND {T2}"))
def scan_time_range(spark, d):
    return scan(fx.cells_events(spark, d), ev(3), ScanDescriptor(max_versions=3, time_range=(T1, T2)))


@query(_newest(2, f"SELECT * FROM ({fx.CELLS}) WHERE qual IN ('click', 'view') AND ts BETWEEN {T1} AND {T2}"))
def get_time_range(spark, d):
    return read_columns(fx.cells_events(spark, d), ev(10_000_000), {("ev", "click"), ("ev", "view")}, (T1, T2), 2)


@query(f"""SELECT "row", cf, qual, ts, value FROM (SELECT *, dense_rank() OVER (PARTITION BY "row", cf ORDER BY qual) AS q FROM ({_newest()})) WHERE q <= 2""")
def scan_max_qualifiers(spark, d):
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(max_qualifiers=2))


@query(_newest(more="""AND "row" >= '00000020' AND "row" < '00000060'"""))
def scan_key_range(spark, d):
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor("00000020", "00000060"))


@query(_newest(more="""AND "row" LIKE '0000001%'"""))
def scan_prefix(spark, d):
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(*scans.prefix_range("0000001")))


@query(_newest(2, more="""AND "row" = '00000007'"""))
def get_row(spark, d):
    return get(fx.cells_events(spark, d), ev(9), RowReader("00000007", max_versions=2))


@query(_newest(more="""AND "row" = '00000007' AND qual IN ('click', 'error')"""))
def get_columns(spark, d):
    return get(fx.cells_events(spark, d), ev(9), RowReader("00000007", columns={("ev", "click"), ("ev", "error")}))


@query(_newest(more="AND qual IN ('purchase')"))
def scan_columns(spark, d):
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(families={"ev"}).add_column("ev", "purchase"))


def _keys(spark, d):
    return table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("row"))


_KEYS = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer"


@query(_newest(more=f'AND "row" IN ({_KEYS})'))
def batch_get(spark, d):
    return scans.batch_get(fx.cells_events(spark, d), ev(), _keys(spark, d))


@query(f"""SELECT k AS "row" FROM ({_KEYS}) x(k) WHERE k NOT IN (SELECT "row" FROM ({fx.CELLS}))""")
def batch_get_missing(spark, d):
    return scans.missing_rows(fx.cells_events(spark, d), ev(), _keys(spark, d))


@query(_newest(more=f"""AND "row" = (SELECT max("row") FROM ({fx.CELLS}) WHERE "row" <= '00000033x')"""))
def round_down(spark, d):
    return scans.round_down(fx.cells_events(spark, d), ev(), "00000033x")


@query(f"""SELECT count(DISTINCT "row") AS n_rows, count(*) AS n_cells FROM ({_newest()})""")
def row_count(spark, d):
    return scans.row_count(scan(fx.cells_events(spark, d), ev()))


@query(f"""SELECT "row", max(value) AS best, arg_max(qual, value) AS best_order, count(*) AS n FROM ({_newest(src=fx.ORDERS)}) GROUP BY "row" """)
def orders_best(spark, d):
    """What a client finds by scanning a prefix by hand: here an aggregate over the scan."""
    cells = scan(fx.orders_cells(spark, d), TableSchema("orders", (Family("ord"),)))
    return cells.groupBy("row").agg(F.max("value").alias("best"), F.max_by("qual", "value").alias("best_order"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT "row", count(DISTINCT cf) AS n_families, count(DISTINCT qual) AS n_quals, count(*) AS n_cells FROM ({_newest(3)}) GROUP BY "row" """)
def row_map(spark, d):
    """Nested maps, measured: a row's families, qualifiers and cells."""
    maps = row_maps(scan(fx.cells_events(spark, d), ev(3), ScanDescriptor(max_versions=3)))
    inner = F.flatten(F.transform(F.map_values("families"), lambda q: F.map_values(q)))
    return maps.select("row", F.size("families").cast("bigint").alias("n_families"), F.size(inner).cast("bigint").alias("n_quals"), F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, m: a + F.size(m)).alias("n_cells"))


# --- resolution ----------------------------------------------------------------


def _resolved_sql(src: str, versions: int) -> str:
    """The rules as SQL, by counting windows over the log."""
    return f"""
WITH l AS ({src}),
g AS (SELECT *, max(CASE WHEN type = 1 THEN ts END) OVER (PARTITION BY "row") AS dr, max(CASE WHEN type = 2 THEN ts END) OVER (PARTITION BY "row", cf) AS df, max(CASE WHEN type = 3 THEN ts END) OVER (PARTITION BY "row", cf, qual) AS dc FROM l),
s AS (SELECT * FROM g WHERE type >= 4 AND ts > greatest(coalesce(dr, -1), coalesce(df, -1), coalesce(dc, -1))),
h AS (SELECT *, coalesce(lag(type) OVER w = 4, false) AS hit FROM s WINDOW w AS (PARTITION BY "row", cf, qual ORDER BY ts DESC, type)),
r AS (SELECT *, sum(CASE WHEN type = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY "row", cf, qual ORDER BY ts DESC, type ROWS UNBOUNDED PRECEDING) AS v FROM h)
SELECT "row", cf, qual, ts, value FROM r WHERE type = 5 AND NOT hit AND v <= {versions}"""


def _deletes(kinds: tuple[int, ...], name: str, versions: int = 3) -> None:
    def f(spark, d):
        return resolve(fx.cells_with_deletes(spark, d, kinds), ev(versions)).drop("version")

    f.__name__ = name
    query(_resolved_sql(fx.deletes_sql(kinds), versions))(f)


_deletes((1,), "deletes_row")
_deletes((2,), "deletes_family")
_deletes((3,), "deletes_columns")
_deletes((4,), "deletes_column")
_deletes((1, 2, 3, 4), "deletes_all")


@query(_newest(5, f"SELECT * FROM ({fx.CELLS}) WHERE ts + CAST(864000 AS BIGINT) * 1000000 > {NOW}"))
def ttl_scan(spark, d):
    return scan(fx.cells_events(spark, d), ev(5, ttl=864000), ScanDescriptor(max_versions=5), now_us=NOW)


@query(_newest(2, f"SELECT * FROM ({fx.CELLS}) WHERE seq <= 500"))
def snapshot_scan(spark, d):
    return scan(fx.cells_events(spark, d), ev(2), ScanDescriptor(max_versions=2, snapshot=500))


@query(_newest(2, f"SELECT * FROM ({fx.CELLS}) WHERE NOT (seq > 300 AND seq <= 900)"))
def rollback_scan(spark, d):
    return scan(fx.cells_events(spark, d), ev(2), ScanDescriptor(max_versions=2), rollbacks=[(300, 900)])


@query(_newest(1, fx.CELLS.replace("event_type AS qual", "CAST(event_id % 3 AS VARCHAR) AS qual").replace("epoch_us(ts) AS ts", "CAST(0 AS BIGINT) AS ts")))
def overwrite_same_stamp(spark, d):
    """Entries of one timestamp: the newest sequence number wins."""
    log = fx.cells_events(spark, d).withColumns({"qual": (F.col("seq") % 3).cast("string"), "ts": F.lit(0).cast("bigint")})
    return scan(log, ev())


@query("""SELECT "row", cf, qual, ts, value FROM (SELECT 'x' AS "row", 'x' AS cf, 'x' AS qual, CAST(0 AS BIGINT) AS ts, CAST(0 AS DOUBLE) AS value) WHERE false""")
def dropped_family(spark, d):
    """A family that the schema no longer has is not seen."""
    return scan(fx.cells_events(spark, d), TableSchema("events", (Family("other"),)))


_CHAIN = """
WITH l AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", event_type AS qual, epoch_us(ts) AS ts, event_id, value, CASE WHEN event_id % {m} = 0 THEN 5 ELSE {kind} END AS type FROM events),
c AS (SELECT *, coalesce(sum(CASE WHEN type = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY "row", qual ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS puts FROM l)
SELECT "row", '{cf}' AS cf, qual, max(ts) AS ts, {what} AS value FROM c WHERE puts = 0 GROUP BY "row", qual"""


@query(_CHAIN.format(m=19, kind=10, cf="cnt", what="CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT)"))
def counter_merge(spark, d):
    return scan(fx.counter_events(spark, d), TableSchema("c", (Family("cnt"),)))


@query(_CHAIN.format(m=23, kind=9, cf="log", what="string_agg(CAST(event_id AS VARCHAR), '' ORDER BY ts)"))
def append_merge(spark, d):
    return scan(fx.append_events(spark, d), TableSchema("a", (Family("log"),)))


@query(_CHAIN.format(m=23, kind=8, cf="log", what="arg_min(CAST(event_id AS VARCHAR), ts)"))
def put_if_absent(spark, d):
    return scan(fx.append_events(spark, d, 8), TableSchema("a", (Family("log"),)))


@query(_resolved_sql(fx.deletes_sql(), 3))
def compact_then_read(spark, d):
    """A compacted log reads as the log does."""
    return resolve(compact(fx.cells_with_deletes(spark, d), ev(3)), ev(3)).drop("version")


# --- filters -------------------------------------------------------------------


def _filter_sql(keep: str) -> str:
    return f"""WITH c AS ({_newest()}), k AS (SELECT "row" FROM c GROUP BY "row" HAVING {keep}) SELECT "row", cf, qual, ts, value FROM c SEMI JOIN k USING ("row")"""


def _has(qual: str, test: str, missing: bool = True) -> str:
    return f"coalesce(bool_and(CASE WHEN qual = '{qual}' THEN {test} END), {str(missing).lower()})"


def _filter(name: str, f: ValueFilter | FilterList, sql: str) -> None:
    def run(spark, d):
        return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(filter=f))

    run.__name__ = name
    query(_filter_sql(sql))(run)


_gt = ValueFilter("ev", "click", ">", 40.0)
_lt = ValueFilter("ev", "view", "<", 60.0)
_int = ValueFilter("ev", "error", ">=", 25, "int32")
_filter("filter_gt", _gt, _has("click", "value > 40"))
_filter("filter_missing_drop", ValueFilter("ev", "refund", "<", 1.0, if_missing_drop=True), _has("refund", "value < 1", False))
_filter("filter_missing_keep", ValueFilter("ev", "refund", "<", 1.0), _has("refund", "value < 1"))
_filter("filter_forall", ValueFilter("ev", "", "<", 150.0), "bool_and(value < 150)")
_filter("filter_int", _int, _has("error", "CAST(trunc(value) AS INTEGER) >= 25"))
_filter("filter_decimal_eps", ValueFilter("ev", "click", "!=", 10.0), _has("click", "abs(value - 10) >= 1e-10"))
_filter("filter_and", FilterList("and", (_gt, _lt)), f"{_has('click', 'value > 40')} AND {_has('view', 'value < 60')}")
_filter("filter_or", FilterList("or", (_gt, _lt)), f"{_has('click', 'value > 40')} OR {_has('view', 'value < 60')}")
_filter("filter_nested", FilterList("or", (FilterList("and", (_gt, _lt)), _int)), f"({_has('click', 'value > 40')} AND {_has('view', 'value < 60')}) OR {_has('error', 'CAST(trunc(value) AS INTEGER) >= 25')}")
_filter("filter_empty_list", FilterList(), "true")


@query(_filter_sql(_has("click", "value > 40")).replace("SELECT \"row\", cf, qual, ts, value FROM c SEMI", "SELECT \"row\", cf, qual, ts, value FROM (SELECT * FROM c WHERE qual = 'view') c SEMI"))
def filter_unprojected(spark, d):
    """A filter sees columns that the result lacks."""
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(columns={("ev", "view")}, filter=_gt))


# --- key-value tables ------------------------------------------------------------


def _kv(spark, d, ttl: int):
    e = table(spark, d, "events")
    at = F.floor(fx.micros(e, "ts") / 1_000_000).cast("bigint")
    return e.select(fx.user_row().alias("key"), "value", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(at + ttl).cast("bigint").alias("expire"))


_KV = "SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, arg_max(value, event_id) AS value, max(event_id) AS id, arg_max(epoch_us(ts) // 1000000, event_id) AS seen FROM events GROUP BY user_id"


@query(f"SELECT key, value FROM ({_KV})")
def kv_latest(spark, d):
    return scans.kv_latest(_kv(spark, d, 0))


@query(f"SELECT key, value FROM ({_KV}) WHERE id % 5 = 0 OR seen + 86400 > {NOW // 1_000_000 - 86400}")
def kv_ttl(spark, d):
    return scans.kv_latest(_kv(spark, d, 86400), NOW // 1_000_000 - 86400)


@query(f"SELECT key, value FROM ({_KV}) WHERE key >= '00000010' AND key < '00000030'")
def kv_scan_range(spark, d):
    return scans.kv_latest(_kv(spark, d, 0).where("key >= '00000010' and key < '00000030'"))


# --- shards ----------------------------------------------------------------------


@query(f"""WITH r AS (SELECT "row", sum(length("row") + length(qual) + 16) AS b FROM ({_newest()}) GROUP BY "row"), w AS (SELECT "row", sum(b) OVER (ORDER BY "row") AS upto, sum(b) OVER () AS total FROM r) SELECT min("row") AS split_row FROM w WHERE upto >= total * 0.5""")
def split_key(spark, d):
    return shard.split_key(scan(fx.cells_events(spark, d), ev()))


_LOADS = f"""SELECT t.name AS name, count(DISTINCT "row") AS n_rows, count(*) AS n_cells, CAST(sum(length("row") + length(qual) + 16) AS BIGINT) AS bytes FROM ({_newest()}) c JOIN ({fx.tablets_sql()}) t ON "row" >= "start" AND ("end" = '' OR "row" < "end") GROUP BY t.name"""


@query(_LOADS)
def tablet_loads(spark, d):
    return shard.tablet_loads(scan(fx.cells_events(spark, d), ev()), fx.tablets(spark))


@query(f"""SELECT k AS "row", name FROM ({_KEYS}) x(k) JOIN ({fx.tablets_sql()}) t ON k >= "start" AND ("end" = '' OR k < "end")""")
def tablet_locate(spark, d):
    return shard.locate(_keys(spark, d), fx.tablets(spark))


@query(f"""WITH l AS (SELECT t.name, "start", bytes FROM ({_LOADS}) l JOIN ({fx.tablets_sql()}) t USING (name)),
n AS (SELECT name, bytes, lag(name) OVER w AS pn, lag(bytes) OVER w AS pb, lead(name) OVER w AS nn, lead(bytes) OVER w AS nb FROM l WINDOW w AS (ORDER BY "start"))
SELECT name, CASE WHEN pn IS NULL THEN nn WHEN nn IS NULL THEN pn WHEN pb <= nb THEN pn ELSE nn END AS partner FROM n WHERE bytes < 2200 AND (pn IS NOT NULL OR nn IS NOT NULL)""")
def merge_candidates(spark, d):
    loads = shard.tablet_loads(scan(fx.cells_events(spark, d), ev()), fx.tablets(spark))
    return shard.merge_candidates(loads.join(fx.tablets(spark), "name").select("name", "start", "bytes"), 2200)


@query(f"""SELECT bool_and(coalesce(b < s, true)) AS ok, count(*) FILTER (b >= s) AS n_bad FROM (SELECT "start" AS s, lag("start") OVER (ORDER BY name) AS b FROM ({fx.damaged_sql()}))""")
def delimiters_ascend(spark, d):
    t = fx.damaged_tablets(spark)
    return shard.delimiters_ascend(t.select(F.col("name").alias("i"), F.col("start").alias("delimiter")))


@query(f"""WITH r AS (SELECT "start" AS s, CASE WHEN "end" = '' THEN chr(1114111) ELSE "end" END AS e FROM ({fx.damaged_sql()})),
m AS (SELECT *, CASE WHEN max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM r),
i AS (SELECT *, sum(n) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT min(s) AS "start", CASE WHEN max(e) = chr(1114111) THEN '' ELSE max(e) END AS "end" FROM i GROUP BY g""")
def range_cover(spark, d):
    return shard.coverage(fx.damaged_tablets(spark))


@query(f"""WITH r AS (SELECT *, CASE WHEN "end" = '' THEN chr(1114111) ELSE "end" END AS e FROM ({fx.damaged_sql()})),
b AS (SELECT *, coalesce(max(e) OVER (ORDER BY "start", e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p FROM r)
SELECT name, "start", "end", CASE WHEN "start" >= e THEN 'invalid' WHEN e <= p THEN 'covered' WHEN "start" < p THEN 'overlap' WHEN "start" > p THEN 'miss' ELSE 'ok' END AS state FROM b""")
def range_health(spark, d):
    return shard.range_health(fx.damaged_tablets(spark))


@query(f"""WITH c AS ({SQL['range_cover']}), i AS (SELECT coalesce(lag("end") OVER (ORDER BY "start"), '') AS "start", "start" AS "end" FROM c)
SELECT * FROM i WHERE "start" < "end" UNION ALL SELECT x AS "start", '' AS "end" FROM (SELECT arg_max("end", "start") AS x FROM c) WHERE x <> ''""")
def range_gap_fill(spark, d):
    return shard.gap_fillers(fx.damaged_tablets(spark))


@query(f"""WITH n AS (SELECT *, lead(name) OVER w AS nn, lead("start") OVER w AS ns, lag(name) OVER w AS pn, lag("end") OVER w AS pe FROM ({fx.damaged_sql()}) WINDOW w AS (ORDER BY "start", "end", name))
SELECT name, "start", "end" FROM n WHERE NOT coalesce(((ns < "end") OR ("end" = '' AND ns IS NOT NULL)) AND nn > name, false) AND NOT coalesce((pe > "start" OR pe = '') AND pn > name, false)""")
def range_overlap_repair(spark, d):
    return shard.without_overlaps(fx.damaged_tablets(spark))


@query(f"""SELECT a.name AS path, CASE WHEN b.name IS NULL THEN 'missing' WHEN a."start" <> b."start" OR a."end" <> b."end" THEN 'differs' ELSE 'same' END AS state FROM ({fx.tablets_sql(30, 10)}) a LEFT JOIN ({fx.damaged_sql()}) b USING (name)""")
def backup_diff(spark, d):
    path = {"name": "path"}
    return tools.backup_diff(fx.tablets(spark, 30, 10).withColumnsRenamed(path), fx.damaged_tablets(spark).withColumnsRenamed(path))


@query(f"""SELECT "table", count(*) AS n_tablets, CAST(sum(n_cells) AS BIGINT) AS n_cells, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS max_bytes FROM (SELECT CASE WHEN name < 't005' THEN 'a' ELSE 'b' END AS "table", * FROM ({_LOADS})) GROUP BY ROLLUP ("table")""")
def table_stats(spark, d):
    loads = shard.tablet_loads(scan(fx.cells_events(spark, d), ev()), fx.tablets(spark))
    return tools.table_counters(loads.withColumn("table", F.when(F.col("name") < "t005", "a").otherwise("b")))


# --- tools -----------------------------------------------------------------------


def _dest(spark, d):
    src = fx.cells_events(spark, d)
    kept = src.where("seq % 29 <> 0").withColumn("value", F.when(F.col("seq") % 31 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return kept.unionByName(src.where("seq % 37 = 0").withColumn("row", F.concat(F.lit("x"), "row")))


_DEST = f"""SELECT "row", cf, qual, ts, type, CASE WHEN seq % 31 = 0 THEN value + 1 ELSE value END AS value, seq FROM ({fx.CELLS}) WHERE seq % 29 <> 0 UNION ALL SELECT 'x' || "row", cf, qual, ts, type, value, seq FROM ({fx.CELLS}) WHERE seq % 37 = 0"""
_DIFF = """WITH a AS ({src}), b AS ({dest}) SELECT coalesce(a."row", b."row") AS "row", coalesce(a.cf, b.cf) AS cf, coalesce(a.qual, b.qual) AS qual, {at} AS at, a.value AS src_value, b.value AS dest_value,
CASE WHEN b."row" IS NULL THEN 'only_in_src' WHEN a."row" IS NULL THEN 'only_in_dest' WHEN a.value = b.value THEN 'both_same' ELSE 'both_but_diff' END AS state FROM a FULL JOIN b ON a."row" = b."row" AND a.cf = b.cf AND a.qual = b.qual {on}"""


@query(_DIFF.format(src=_newest(3), dest=_newest(3, _DEST), at="coalesce(a.ts, b.ts)", on="AND a.ts = b.ts"))
def table_diff(spark, d):
    three = ScanDescriptor(max_versions=3)
    return tools.diff(scan(fx.cells_events(spark, d), ev(3), three), scan(_dest(spark, d), ev(3), three), ["ev"])


@query(f"SELECT state, count(*) AS n FROM ({_DIFF.format(src=_newest(), dest=_newest(1, _DEST), at='CAST(0 AS BIGINT)', on='')}) GROUP BY state")
def table_diff_counts(spark, d):
    return tools.diff_counts(tools.diff(scan(fx.cells_events(spark, d), ev()), scan(_dest(spark, d), ev())))


@query(f"""SELECT a.* FROM ({_newest()}) a ANTI JOIN ({_newest(1, _DEST)}) b ON a."row" = b."row" AND a.cf = b.cf AND a.qual = b.qual""")
def table_diff_repair(spark, d):
    return tools.repair(scan(fx.cells_events(spark, d), ev()), scan(_dest(spark, d), ev()))


@query(f"""SELECT "row", 'copy' AS cf, qual, ts, value FROM ({fx.CELLS}) WHERE ts BETWEEN {T1} AND {T2}""")
def dump_window(spark, d):
    cells = scan(fx.cells_events(spark, d), ev(1 << 30), ScanDescriptor(max_versions=1 << 30))
    return tools.dump(cells, (T1, T2), {"ev": "copy"})


_HOURS = "SELECT user_id AS server, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS ts, max(value) AS value FROM events GROUP BY 1, 2"
_FILLED = f"""WITH p AS ({_HOURS}), n AS (SELECT *, lead(ts) OVER (PARTITION BY server ORDER BY ts) AS nx FROM p)
SELECT server, ts, value, true AS real FROM p UNION ALL SELECT server, unnest(range(ts + 3600, nx, 3600)) AS ts, NULL AS value, false AS real FROM n WHERE nx - ts > 5400"""


def _filled(spark, d):
    e = table(spark, d, "events")
    hour = (F.floor(fx.micros(e, "ts") / 3_600_000_000) * 3600).cast("bigint")
    return tools.fill_series(e.groupBy(F.col("user_id").alias("server"), hour.alias("ts")).agg(F.max("value").alias("value")), 3600)


@query(_FILLED)
def series_gap_fill(spark, d):
    return _filled(spark, d)


@query(f"SELECT server, CAST(floor(count(*) FILTER (real) * 1000000 / count(*)) AS BIGINT) AS av_ratio FROM ({_FILLED}) GROUP BY server")
def series_real_share(spark, d):
    return tools.real_share(_filled(spark, d))


@query(f"""WITH s AS (SELECT user_id, arg_max(event_type, event_id) <> 'error' AS ready, max(epoch_us(ts)) // 1000000 AS since FROM events GROUP BY user_id)
SELECT CAST(user_id % 10 AS VARCHAR) AS "table", count(*) AS n_tablets, count(*) FILTER (NOT ready AND age >= 259200) AS fatal, count(*) FILTER (NOT ready AND age >= 86400 AND age < 259200) AS error, count(*) FILTER (NOT ready AND age >= 3600 AND age < 86400) AS warning,
count(*) FILTER (ready) AS n_ready, round(count(*) FILTER (ready) / count(*), 6) AS ready_share FROM (SELECT *, {NOW // 1_000_000} - since AS age FROM s) GROUP BY 1""")
def availability_ratio(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg((F.max_by("event_type", "event_id") != "error").alias("ready"), F.floor(F.max(fx.micros(e, "ts")) / 1_000_000).alias("since"))
    return tools.availability(s.select((F.col("user_id") % 10).cast("string").alias("table"), "ready", "since"), NOW // 1_000_000, (3600, 86400, 259200))


@query("SELECT round(100.0 * (1 - sum(value) / (2592000.0 * 150)), 6) AS ready_percent FROM events WHERE event_type = 'error'")
def ready_time(spark, d):
    spells = table(spark, d, "events").where("event_type = 'error'").select(F.col("value").alias("seconds"))
    return tools.ready_time(spells, 2_592_000, 150).select(F.round("ready_percent", 6).alias("ready_percent"))


@query("""SELECT event_type AS name, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, arg_max(value, ts) AS latest, max(value) AS max, min(value) AS min, round(sum(value), 4) AS sum, count(*) / 86400 AS qps FROM events GROUP BY 1, 2""")
def metrics_window(spark, d):
    out = tools.metric_windows(table(spark, d, "events").select(F.col("event_type").alias("name"), "ts", "value"), 86400)
    return out.select("name", F.date_format("start", "yyyy-MM-dd").alias("start"), "latest", "max", "min", F.round("sum", 4).alias("sum"), "qps")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile(spark, d):
    out = tools.percentiles(table(spark, d, "events"), "event_type", "value", [0.5, 0.9, 0.99])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")))


@query("""SELECT u AS "table", event_type AS op, w AS "window", used, m >= 0 AND used > m AS over FROM (SELECT CAST(user_id % 5 AS VARCHAR) AS u, event_type, epoch_us(ts) // 1000000 // 86400 * 86400 AS w, count(*) AS used, CASE event_type WHEN 'click' THEN 14 WHEN 'view' THEN 10 ELSE -1 END AS m FROM events GROUP BY ALL)""")
def quota(spark, d):
    e = table(spark, d, "events")
    requests = e.select((F.col("user_id") % 5).cast("string").alias("table"), F.col("event_type").alias("op"), F.floor(fx.micros(e, "ts") / 1_000_000).alias("ts"), F.lit(1).cast("bigint").alias("amount"))
    kinds = [("click", 14), ("view", 10), ("purchase", -1), ("signup", -1), ("error", -1)]
    limits = spark.createDataFrame([(str(t), k, n) for t in range(5) for k, n in kinds], "table string, op string, most int")
    return tools.over_quota(requests, limits, 86400)


@query("""SELECT event_id, (user_id % 4 = 0) OR (user_id % 4 = 1 AND event_type = 'view') OR (user_id % 4 = 2 AND event_type IN ('click', 'view') AND event_id % 2 = 0) AS ok FROM events""")
def permissions(spark, d):
    e = table(spark, d, "events")
    roles = F.when(F.col("user_id") % 4 == 0, F.array(F.lit("root"), F.lit("none"))).when(F.col("user_id") % 4 == 1, F.array(F.lit("viewer"))).when(F.col("user_id") % 4 == 2, F.array(F.lit("clerk"))).otherwise(F.array().cast("array<string>"))
    asks = e.select("event_id", roles.alias("roles"), F.lit("ns:t").alias("table"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("cf"), F.col("event_type").alias("qual"), F.when(F.col("event_type") == "view", "read").otherwise("write").alias("action"))
    p = [("root", "global", "", "", "", "", "read"), ("root", "global", "", "", "", "", "write"), ("viewer", "namespace", "ns", "", "", "", "read"), ("clerk", "column", "ns", "ns:t", "even", "click", "write"), ("clerk", "family", "ns", "ns:t", "even", "", "read")]
    return tools.allowed(asks, spark.createDataFrame(p, "role string, scope string, namespace string, table string, cf string, qual string, action string")).select("event_id", "ok")


@query("""WITH s AS (SELECT CAST(user_id % 6 AS INTEGER) AS node, count(*) AS n_tablets, CAST(sum(event_id) AS BIGINT) AS bytes, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS writes, count(*) FILTER (event_type = 'purchase') AS scans FROM events GROUP BY 1)
SELECT *, """ + ", ".join(f"round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END, 6) AS {c}_cost" for c in ("n_tablets", "bytes", "reads", "writes", "scans")) + " FROM s")
def node_costs(spark, d):
    is_ = lambda k: (F.col("event_type") == k).cast("bigint")
    return tools.node_costs(table(spark, d, "events").select((F.col("user_id") % 6).cast("int").alias("node"), F.col("event_id").alias("bytes"), is_("view").alias("reads"), is_("click").alias("writes"), is_("purchase").alias("scans")))


@query(f"""SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS tablet, 'events' AS "table", event_type AS phase, epoch_us(ts) AS ts, props AS message FROM events WHERE event_type = 'error' AND epoch_us(ts) BETWEEN {T1} AND {T2}""")
def corruption_select(spark, d):
    e = table(spark, d, "events")
    log = e.select(fx.user_row().alias("tablet"), F.lit("events").alias("table"), F.col("event_type").alias("phase"), fx.micros(e, "ts").alias("ts"), F.col("props").alias("message"))
    return tools.corruption_messages(log, phase="error", table="events", window=(T1, T2))


@query(f"""SELECT "row", cf, qual, ts, CAST(floor(value) AS BIGINT) - 20 AS value FROM ({_newest()}) WHERE "row" IN (SELECT "row" FROM ({_newest()}) WHERE qual = 'click' AND CAST(floor(value) AS BIGINT) - 20 < 3)""")
def filter_stored_int16(spark, d):
    """Values stored as two bytes each, compared as the numbers they are."""
    log = fx.cells_events(spark, d).withColumn("value", codecs.integer_bytes("int16", F.floor("value") - 20))
    kept = scan(log, ev(), ScanDescriptor(filter=ValueFilter("ev", "click", "<", 3, "int16", if_missing_drop=True, stored=True)))
    return kept.withColumn("value", codecs.integer_of("int16", F.col("value")))


@query(f"""SELECT "row", cf, qual, ts, value FROM ({_newest()}) WHERE "row" IN (SELECT "row" FROM ({_newest()}) WHERE qual LIKE 'p%' AND value > 30)""")
def filter_column(spark, d):
    """A filter that is any condition on a cell."""
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(filter=ColumnFilter(F.col("qual").startswith("p") & (F.col("value") > 30), ("ev",))))


@query(f"""SELECT "row", cf, qual, ts, value FROM ({_newest()}) WHERE "row" IN (SELECT "row" FROM ({_newest()}) WHERE qual >= 'purchase' AND qual <= 'view')""")
def filter_qualifier_range(spark, d):
    return scan(fx.cells_events(spark, d), ev(), ScanDescriptor(filter=ColumnFilter(F.col("qual").between("purchase", "view"), ("ev",))))


@query(f"""SELECT "row", cf, qual, ts, qual AS value FROM ({_newest()}) WHERE "row" NOT IN (SELECT "row" FROM ({_newest()}) WHERE qual = 'view') OR "row" IN (SELECT "row" FROM ({_newest()}) WHERE qual = 'click')""")
def filter_bytes(spark, d):
    """Text values compared byte by byte: a row with a view (which is above `purchase`) needs a click (which is below)."""
    log = fx.cells_events(spark, d).withColumn("value", F.col("qual"))
    view = ValueFilter("ev", "view", "<=", "purchase", "bytes")
    click = ValueFilter("ev", "click", "<", "purchase", "bytes", if_missing_drop=True)
    return scan(log, ev(), ScanDescriptor(filter=FilterList("or", (view, click))))


# --- transactions ------------------------------------------------------------------


_DATA = """SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, event_type AS qual, event_id AS ts, value FROM events WHERE event_id % 4 <> 0"""
_WRITES = """SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, event_type AS qual, event_id + 1 AS commit_ts, CASE WHEN event_id % 13 = 0 THEN 'delete' ELSE 'put' END AS kind, event_id AS data_ts FROM events WHERE event_id % 4 <> 0"""
_LOCKS = """SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, event_type AS qual, event_id AS ts FROM events WHERE event_id % 97 = 0"""


def _gtxn(spark, d):
    e = table(spark, d, "events").select(fx.user_row().alias("row"), F.lit("ev").alias("cf"), F.col("event_type").alias("qual"), "event_id", "value")
    kept = e.where("event_id % 4 <> 0")
    writes = kept.select("row", "cf", "qual", (F.col("event_id") + 1).alias("commit_ts"), F.when(F.col("event_id") % 13 == 0, "delete").otherwise("put").alias("kind"), F.col("event_id").alias("data_ts"))
    return kept.select("row", "cf", "qual", F.col("event_id").alias("ts"), "value"), writes, e.where("event_id % 97 = 0").select("row", "cf", "qual", F.col("event_id").alias("ts"))


@query(f"""WITH w AS (SELECT "row", cf, qual, arg_max(kind, commit_ts) AS kind, arg_max(data_ts, commit_ts) AS data_ts FROM ({_WRITES}) WHERE commit_ts <= (SELECT max(event_id) * 7 // 10 FROM events) GROUP BY ALL),
l AS (SELECT DISTINCT "row", qual FROM ({_LOCKS}) WHERE ts < (SELECT max(event_id) * 7 // 10 FROM events))
SELECT w."row" AS "row", w.cf AS cf, w.qual AS qual, CASE WHEN l."row" IS NULL THEN v.value END AS value, data_ts, CASE WHEN l."row" IS NULL THEN 'ok' ELSE 'locked' END AS status FROM w JOIN ({_DATA}) v ON v."row" = w."row" AND v.qual = w.qual AND v.ts = w.data_ts LEFT JOIN l ON l."row" = w."row" AND l.qual = w.qual WHERE kind = 'put'""")
def txn_snapshot_read(spark, d):
    data, writes, locks = _gtxn(spark, d)
    return txn.snapshot_read(writes, data, locks, _share(spark, d, 7))


def _share(spark, d, tenths: int) -> int:
    """So many tenths of the greatest event number: a snapshot that grows with the log."""
    return table(spark, d, "events").agg(F.max("event_id")).first()[0] * tenths // 10


_ASKS = """SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, event_type AS qual, event_id * 2 AS start_ts, event_id AS txn, value FROM events"""


def _asks(spark, d):
    return table(spark, d, "events").select(fx.user_row().alias("row"), F.lit("ev").alias("cf"), F.col("event_type").alias("qual"), (F.col("event_id") * 2).alias("start_ts"), F.col("event_id").alias("txn"), "value")


_CONFLICTS = f"""WITH w AS (SELECT "row", qual, max(commit_ts) AS w FROM ({_WRITES}) GROUP BY ALL), l AS (SELECT "row", qual, max(ts) AS l FROM ({_LOCKS}) GROUP BY ALL)
SELECT a.*, CASE WHEN w >= start_ts THEN 'write_conflict' WHEN l IS NOT NULL THEN 'lock_conflict' ELSE 'ok' END AS status FROM ({_ASKS}) a LEFT JOIN w USING ("row", qual) LEFT JOIN l USING ("row", qual)"""


@query(_CONFLICTS)
def txn_conflicts(spark, d):
    _, writes, locks = _gtxn(spark, d)
    return txn.conflicts(_asks(spark, d), writes, locks)


@query(f"""WITH RECURSIVE s AS (SELECT txn // 2 AS txn, coalesce(min(CASE WHEN status <> 'ok' THEN status END), 'ok') AS status FROM ({_CONFLICTS}) GROUP BY 1),
t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.txn // 2) AS n, a.txn // 2 AS txn, list("row" || '/' || qual) AS cells FROM ({_ASKS}) a JOIN s ON s.txn = a.txn // 2 AND s.status = 'ok' GROUP BY 2),
walk(n, taken, won) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
UNION ALL SELECT t.n, CASE WHEN list_has_any(taken, cells) THEN taken ELSE list_concat(taken, cells) END, NOT list_has_any(taken, cells) FROM walk JOIN t ON t.n = walk.n + 1)
SELECT s.txn AS txn, CASE WHEN s.status = 'ok' AND NOT coalesce(won, false) THEN 'write_conflict' ELSE s.status END AS status FROM s LEFT JOIN t ON s.txn = t.txn LEFT JOIN walk ON walk.n = t.n""")
def txn_commit_batch(spark, d):
    """Two events make a transaction; SQL walks through the transactions one by one."""
    _, writes, locks = _gtxn(spark, d)
    asks = _asks(spark, d).withColumn("txn", F.floor(F.col("txn") / 2))
    return txn.commit_batch(asks, writes, locks, txn.TimeOracle(1_000_000))[0]


@query(f"""SELECT txn, CASE WHEN status = 'ok' AND txn > f THEN 'write_conflict' ELSE status END AS status FROM (SELECT *, min(CASE WHEN status = 'ok' THEN txn END) OVER (PARTITION BY "row", qual) AS f FROM ({_CONFLICTS}))""")
def txn_single_cell(spark, d):
    """Each event is a transaction of one cell: the first without a stored conflict has it."""
    _, writes, locks = _gtxn(spark, d)
    return txn.commit_batch(_asks(spark, d), writes, locks, txn.TimeOracle(1_000_000))[0]


@query("""SELECT lpad(CAST(l.user_id AS VARCHAR), 8, '0') AS "row", 'ev' AS cf, l.event_type AS qual, l.event_id AS ts, CASE WHEN p.event_id IS NOT NULL THEN 'roll_forward' ELSE 'clean' END AS action, p.event_id + 2 AS commit_ts
FROM (SELECT * FROM events WHERE event_id % 97 = 0) l LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 0) p ON p.event_id = l.event_id""")
def txn_settle_locks(spark, d):
    e = table(spark, d, "events").select(fx.user_row().alias("row"), F.lit("ev").alias("cf"), F.col("event_type").alias("qual"), "event_id")
    locks = e.where("event_id % 97 = 0").select("row", "cf", "qual", F.col("event_id").alias("ts"), F.struct("row", "cf", "qual").alias("primary"))
    return txn.settle_locks(locks, e.where("event_id % 3 = 0").select("row", "cf", "qual", (F.col("event_id") + 2).alias("commit_ts"), F.col("event_id").alias("data_ts")))


@query(f"""WITH n AS ({_newest()}) SELECT a."row" AS "row", 'ev' AS cf, a.qual AS qual, a.expected AS expected, a.value AS value, CASE WHEN n.value IS NULL THEN 'not_found' WHEN n.value = expected THEN 'ok' ELSE 'not_equal' END AS status
FROM (SELECT lpad(CAST(user_id + CASE WHEN event_id % 20 = 0 THEN 1000000 ELSE 0 END AS VARCHAR), 8, '0') AS "row", event_type AS qual, value AS expected, value + 1 AS value FROM events) a LEFT JOIN n USING ("row", qual)""")
def cas(spark, d):
    e = table(spark, d, "events")
    user = F.col("user_id") + F.when(F.col("event_id") % 20 == 0, 1_000_000).otherwise(0)
    asks = e.select(F.lpad(user.cast("string"), 8, "0").alias("row"), F.lit("ev").alias("cf"), F.col("event_type").alias("qual"), F.col("value").alias("expected"), (F.col("value") + 1).alias("value"))
    return txn.compare_and_set(scan(fx.cells_events(spark, d), ev()), asks)


def _reads(where: str) -> str:
    early = _newest(1, f"SELECT * FROM ({fx.CELLS}) WHERE {where} AND seq <= (SELECT max(event_id) * 8 // 10 FROM events)")
    late = _newest(1, f"SELECT * FROM ({fx.CELLS}) WHERE {where}")
    cells = "string_agg(qual || ':' || ts || ':' || value, ',' ORDER BY qual)"
    return f"""WITH x AS (SELECT "row", {cells} AS g FROM ({early}) GROUP BY "row"), y AS (SELECT "row", {cells} AS h FROM ({late}) GROUP BY "row")
SELECT u."row" AS "row", coalesce(g = h, g IS NULL AND h IS NULL) AS ok FROM (SELECT DISTINCT "row" FROM ({fx.CELLS})) u LEFT JOIN x USING ("row") LEFT JOIN y USING ("row")"""


@query(_reads("true"))
def txn_validate_reads(spark, d):
    """All rows, read at four fifths of the log and again at its end."""
    log = fx.cells_events(spark, d)
    return txn.validate_reads(scan(log, ev(), ScanDescriptor(snapshot=_share(spark, d, 8))), scan(log, ev()), log.select("row"))


@query(_reads("qual = 'error' AND value > 40"))
def txn_phantom(spark, d):
    """Reads that find nothing in many rows: an entry that comes later makes them fail too."""
    log = fx.cells_events(spark, d)
    seen = log.where("qual = 'error' and value > 40")
    return txn.validate_reads(scan(seen, ev(), ScanDescriptor(snapshot=_share(spark, d, 8))), scan(seen, ev()), log.select("row"))


@query("""SELECT event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS ok FROM events""")
def txn_first_of_batch(spark, d):
    return txn.first_of_batch(fx.cells_events(spark, d).select("row", "seq")).select("seq", "ok")


# --- stored tables -----------------------------------------------------------------


def _client(spark) -> Client:
    return Client(spark, f"{scratch(spark)}/stored")


def _nations(spark, d):
    """25 rows, which the driver holds as any caller of apply() does."""
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()


def _written(spark, d):
    """A table of nations, after a first batch of mutations; and the second batch."""
    rows = _nations(spark, d)
    t = _client(spark).create_table("t{lg0{a<maxversions=2>},lg1{n,s}}", ["n10"])
    key = lambda r: f"n{r.n_nationkey:02d}"
    t.apply([RowMutation(key(r)).put("a", "name", r.n_name).add_int64("n", "hits", 3 * r.n_nationkey).append("s", "log", "x").put_if_absent("a", "first", r.n_nationkey) for r in rows], 1_000_000)
    batch = []
    for r in rows:
        m, k = RowMutation(key(r)), r.n_nationkey
        if k % 2 == 0:
            m.put("a", "name", f"{r.n_name}!").add_int64("n", "hits", 5).append("s", "log", "y").put_if_absent("a", "first", 99)
        if k % 5 == 0:
            m.delete_columns("a", "name")
        if k % 3 == 1:
            m.delete_family("s")
        if k % 8 == 6:
            m.delete_column("a", "name")
        if k % 7 == 0:
            m.delete_row()
        batch.append(m)
    return t, batch


_NATION_CELLS = """SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS "row", n_nationkey AS k, n_name FROM nation"""


@query(f"""WITH b AS ({_NATION_CELLS})
SELECT "row", 'a' AS cf, 'name' AS qual, n_name || CASE WHEN k % 2 = 0 AND k % 8 <> 6 THEN '!' ELSE '' END AS value FROM b WHERE k % 5 <> 0 AND k % 7 <> 0
UNION ALL SELECT "row", 'n', 'hits', CAST(3 * k + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END AS VARCHAR) FROM b WHERE k % 7 <> 0
UNION ALL SELECT "row", 's', 'log', 'x' || CASE WHEN k % 2 = 0 THEN 'y' ELSE '' END FROM b WHERE k % 3 <> 1 AND k % 7 <> 0
UNION ALL SELECT "row", 'a', 'first', CAST(k AS VARCHAR) FROM b WHERE k % 7 <> 0""")
def mutate_then_scan(spark, d):
    """Every kind of mutation, applied in two batches and read back."""
    t, batch = _written(spark, d)
    t.apply(batch, 2_000_000)
    return t.scan().select("row", "cf", "qual", "value")


@query(f"""WITH b AS (SELECT * FROM ({_NATION_CELLS}) WHERE k % 2 = 0)
SELECT "row", 'a' AS cf, 'name' AS qual, n_name AS value FROM b UNION ALL SELECT "row", 'n', 'hits', CAST(3 * k AS VARCHAR) FROM b UNION ALL SELECT "row", 's', 'log', 'x' FROM b UNION ALL SELECT "row", 'a', 'first', CAST(k AS VARCHAR) FROM b""")
def rollback_get(spark, d):
    """A batch get after a rollback to a snapshot."""
    t, batch = _written(spark, d)
    snapshot = t.snapshot()
    t.apply(batch, 2_000_000)
    t.rollback(snapshot)
    keys = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.format_string("n%02d", F.col("n_nationkey").cast("int")).alias("row"))
    return t.batch_get(keys).select("row", "cf", "qual", "value")


@query("""SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS "row", CASE WHEN n_nationkey % 6 = 0 THEN 'again' ELSE n_name END AS value FROM nation WHERE (n_nationkey % 6 = 0 OR n_nationkey % 4 <> 0) AND (n_nationkey % 6 = 0 OR n_nationkey > 10)""")
def kv_put_ttl(spark, d):
    """Values of a key-value table that were put with a time to live of as many seconds as their number, deleted, and put again, read ten seconds later."""
    t = _client(spark).create_table("k<rawkey=ttlkv>")
    key = lambda r: f"n{r.n_nationkey:02d}"
    rows = _nations(spark, d)
    t.apply([RowMutation(key(r)).put_kv(r.n_name, r.n_nationkey) for r in rows], 10_000_000)
    t.apply([RowMutation(key(r)).delete_kv() for r in rows if r.n_nationkey % 4 == 0], 11_000_000)
    t.apply([RowMutation(key(r)).put_kv("again") for r in rows if r.n_nationkey % 6 == 0], 12_000_000)
    return t.scan(now_us=20_000_000)


@query(f"""SELECT "row", cf, qual, ts, value FROM ({_newest()}) WHERE "row" || ' ' || qual > '00000040 click' ORDER BY 1, 3""")
def scan_resume(spark, d):
    """A scan that goes on after a cell in the middle of a row."""
    return scans.resume_after(scan(fx.cells_events(spark, d), ev()), ("00000040", "ev", "click", 0)).orderBy("row", "cf", "qual")


@query(f"""SELECT "row", qual, value FROM ({_newest()}) ORDER BY value DESC, "row", qual LIMIT 10""")
def view_top(spark, d):
    return scan(fx.cells_events(spark, d), ev()).select("row", "qual", "value").orderBy(F.desc("value"), "row", "qual").limit(10)


# --- observers ---------------------------------------------------------------------


def _calls(spark, d):
    log = fx.cells_events(spark, d)
    noted = observe.notifications(observe.notify(log, [("ev", "purchase"), ("ev", "error"), ("ev", "view")]))
    seen = observe.observer_table(spark, [observe.Observer("bill", "events", "ev", "purchase"), observe.Observer("alarm", "events", "ev", "error"), observe.Observer("audit", "events", "ev", "purchase")])
    return noted, seen, scan(log, ev())


_CALLS = f"""SELECT "row", cf, qual, ts, value, observer FROM ({_newest()}) JOIN (VALUES ('bill', 'purchase'), ('alarm', 'error'), ('audit', 'purchase')) o(observer, q) ON q = qual"""


@query(_CALLS)
def notify_dispatch(spark, d):
    return observe.dispatch(*_calls(spark, d))


@query(f"""WITH a AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS "row", event_type AS qual, 'bill' AS observer, max(epoch_us(ts)) AS ack FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT c.* FROM ({_CALLS}) c LEFT JOIN a USING ("row", qual, observer) WHERE NOT coalesce(ack >= ts AND {NOW} - ack < 1000000 * CAST(432000 AS BIGINT), false)""")
def ack_suppress(spark, d):
    noted, seen, cells = _calls(spark, d)
    acks = fx.cells_events(spark, d).where("seq % 3 = 0").select("row", "cf", "qual", F.lit("bill").alias("observer"), F.col("ts").alias("ack_ts"))
    return observe.dispatch(noted, seen, cells, acks, NOW, 432_000)


# --- workloads ---------------------------------------------------------------------


@query("""WITH o AS (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC) AS i FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, count(*) FILTER (p_size < 10) AS low_stock, count(*) AS n_lines FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE i <= 20 GROUP BY c_nationkey""")
def stock_level(spark, d):
    return workloads.stock_level(spark, d)


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_name, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer),
o AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1), l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
SELECT c_mktsegment, c_nationkey, c_custkey, o_orderkey, coalesce(n_lines, 0) AS n_lines, quantity FROM m LEFT JOIN o USING (c_custkey) LEFT JOIN l USING (o_orderkey) WHERE i = (n + 1) // 2""")
def order_status(spark, d):
    return workloads.order_status(spark, d)


@query("""WITH f AS (SELECT c_nationkey, min(o_orderkey) AS o_orderkey, arg_min(c_custkey, o_orderkey) AS c_custkey, arg_min(c_acctbal, o_orderkey) AS bal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1),
l AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1)
SELECT c_nationkey, o_orderkey, c_custkey, round(coalesce(a, 0), 2) AS amount, round(bal + coalesce(a, 0), 2) AS c_balance, CAST(1 AS BIGINT) AS c_delivery_cnt FROM f LEFT JOIN l USING (o_orderkey)""")
def delivery(spark, d):
    return workloads.delivery(spark, d)


_PAY = """SELECT c_custkey, c_nationkey, round(c_acctbal - p, 2) AS c_balance, round(p, 2) AS c_ytd_payment, n AS c_payment_cnt FROM customer JOIN (SELECT user_id AS c_custkey, sum(value) AS p, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (c_custkey)"""


@query(_PAY)
def payment(spark, d):
    return workloads.payment(spark, d)


@query(f"SELECT n_regionkey, n_nationkey, round(sum(c_ytd_payment), 2) AS ytd, CAST(sum(c_payment_cnt) AS BIGINT) AS n_payments FROM ({_PAY}) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def payment_totals(spark, d):
    return workloads.payment_totals(spark, d)


@query("""SELECT l_orderkey, round(sum(l_quantity * p_retailprice) * (1 - 0.05) * (1 + 0.1), 6) AS total, round(sum(CASE WHEN p_size > l_quantity + 10 THEN p_size - l_quantity ELSE p_size - l_quantity + 91 END), 2) AS stock_left, count(*) FILTER (contains(p_name, 'widget')) AS n_generic FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def new_order(spark, d):
    return workloads.new_order(spark, d)


@query("""SELECT event_id, CASE WHEN event_id % 100 < 4 THEN 'stock_level' WHEN event_id % 100 < 8 THEN 'order_status' WHEN event_id % 100 < 12 THEN 'delivery' WHEN event_id % 100 < 55 THEN 'payment' ELSE 'new_order' END AS txn FROM events""")
def workload_mix(spark, d):
    return workloads.mix(table(spark, d, "events").select("event_id"))


@query("""SELECT 'GET' || chr(9) || 'u' || user_id || chr(9) || 'cf0:' AS value FROM events WHERE event_type = 'view'
UNION ALL SELECT 'PUT' || chr(9) || 'u' || user_id || chr(9) || v || chr(9) || 'cf0:' || f || chr(9) || event_id FROM (SELECT *, unnest(['field0', 'field1']) AS f, unnest([event_type, 'n' || event_id]) AS v FROM events WHERE event_type IN ('click', 'purchase'))""")
def workload_lines_of_events(spark, d):
    """Views are reads, clicks inserts, purchases updates of two fields; errors and others are scans, which have no lines."""
    op = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "insert").when(F.col("event_type") == "purchase", "update").otherwise("scan")
    fields = F.create_map(F.lit("field0"), F.col("event_type"), F.lit("field1"), F.concat(F.lit("n"), "event_id"))
    return workload_lines(table(spark, d, "events").select(op.alias("op"), F.concat(F.lit("u"), "user_id").alias("row"), fields.alias("fields"), F.col("event_id").alias("ts")))


@query("""SELECT event_id, md5(props) AS digest, event_id % 7 <> 0 AS verified FROM events""")
def mark_checksum(spark, d):
    """Payloads stored with their checksum, every seventh of them damaged since."""
    e = table(spark, d, "events").select("event_id", "props", F.md5("props").alias("digest"))
    stored = e.withColumn("props", F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("?"))).otherwise(F.col("props")))
    return stored.select("event_id", "digest", (F.md5("props") == F.col("digest")).alias("verified"))


# --- functions and text sources ------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderkey - 7 AS BIGINT) AS n FROM orders")
def counter_codec(spark, d):
    """A counter goes through its eight bytes and comes back."""
    return table(spark, d, "orders").select("o_orderkey", codecs.decode_counter(codecs.encode_counter(F.col("o_orderkey") - 7)).alias("n"))


@query("""SELECT "row", cf, qual, value FROM (SELECT 'u' || user_id AS "row", 'ev' AS cf, event_type || CASE WHEN event_id % 2 = 0 THEN ':x' ELSE '' END AS qual, 'v ' || event_id AS value FROM events)""")
def text_source(spark, d):
    line = F.concat(F.lit("u"), "user_id", F.lit(" ev:"), "event_type", F.when(F.col("event_id") % 2 == 0, ":x").otherwise(""), F.lit(" v "), "event_id")
    return parse_put_lines(table(spark, d, "events").select(line.alias("value")))


@query("""SELECT 'PUT' AS op, 'u' || user_id AS "row", cf, qual, event_id AS ts, CAST(event_id AS VARCHAR) AS value FROM events, (VALUES ('a', 'x'), ('a', 'y'), ('b', 'z')) c(cf, qual)""")
def tab_source(spark, d):
    return parse_mark_lines(table(spark, d, "events").select(F.concat_ws("\t", F.concat(F.lit("u"), "user_id"), "event_id", F.lit("a:x,y;b:z"), "event_id").alias("value")))


@query("""SELECT p_partkey, levenshtein(p_name, p_type) AS distance, regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_.-]{0,511}$') AS named, round(p_retailprice, 1) AS rounded FROM part""")
def string_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"), codecs.valid_name(F.col("p_brand")).alias("named"), F.round("p_retailprice", 1).alias("rounded"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d-%H:%M:%S') AS stamp, epoch_us(ts) // 1000000 * 1000000 AS back FROM events""")
def time_functions(spark, d):
    stamp = codecs.time_text(fx.micros(table(spark, d, "events"), "ts"))
    return table(spark, d, "events").select("event_id", stamp.alias("stamp"), codecs.time_of(stamp).alias("back"))


@query()
def murmur_hash_keys(spark, d):
    """Stored keys of a hashed table. SQL has no such hash; golden pairs are in the tests."""
    return table(spark, d, "customer").select("c_custkey", codecs.hash_key(F.col("c_custkey").cast("string")).alias("stored_key"))


# --- what Spark adds over resolved tables: joins, sets, cubes, windows, as-of -----------


def _view(spark, d):
    return scan(fx.cells_events(spark, d), ev(3), ScanDescriptor(max_versions=3))


@query(f"""SELECT c_mktsegment, qual, count(*) AS n, round(sum(value), 2) AS total FROM ({_newest(3)}) JOIN customer ON "row" = lpad(CAST(c_custkey AS VARCHAR), 8, '0') GROUP BY CUBE (c_mktsegment, qual)""")
def view_join_cube(spark, d):
    c = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("row"), "c_mktsegment")
    return _view(spark, d).join(c, "row").cube("c_mktsegment", "qual").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""SELECT "row", qual, ts, value, rank() OVER w AS place, round(value - coalesce(lag(value) OVER w, 0), 6) AS step FROM ({_newest(3)}) WINDOW w AS (PARTITION BY "row" ORDER BY ts)""")
def view_windows(spark, d):
    w = Window.partitionBy("row").orderBy("ts")
    return _view(spark, d).select("row", "qual", "ts", "value", F.rank().over(w).cast("bigint").alias("place"), F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), 6).alias("step"))


@query(f"""SELECT DISTINCT "row" FROM ({_newest()}) WHERE qual = 'click' INTERSECT SELECT "row" FROM ({_newest()}) WHERE qual = 'purchase' EXCEPT SELECT "row" FROM ({_newest()}) WHERE qual = 'error' AND value > 20""")
def view_sets(spark, d):
    v = scan(fx.cells_events(spark, d), ev())
    rows = lambda c: v.where(c).select("row")
    return rows("qual = 'click'").intersect(rows("qual = 'purchase'")).exceptAll(rows("qual = 'error' and value > 20").distinct())


@query("""SELECT p.event_id AS event_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.event_id < p.event_id) AS last_click FROM events p WHERE p.event_type = 'purchase'""")
def as_of_join(spark, d):
    """Each purchase with the user's last click before it, as one window over the union of both."""
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w)).where("event_type = 'purchase'").select("event_id", "last_click")
