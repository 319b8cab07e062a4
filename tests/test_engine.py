import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarium.functions import codecs
from cellarium.operators import shard, tools, txn
from cellarium.operators.resolve import log_schema
from cellarium.operators.scan import RowReader, ScanDescriptor, observed, resume_after, round_down, scan
from cellarium.schema import SchemaError, format_schema, parse_schema, update_schema, with_notify_group
from cellarium.sources.cell_log import append, read
from cellarium.sources.store import Client, RowMutation, StoreError
from cellarium.streaming import observe


@pytest.mark.parametrize("text", ["root", "root<splitsize=9>", "root{child1}", "root{a,b,}", "t<txn=on>{lg0<storage=flash>{cf0<maxversions=3,gtxn=on>,cf1},lg1{x<ttl=9>}}", "t # a table\n{a<ttl=5>}"])
def test_schema_text(text):
    s = parse_schema(text)
    assert parse_schema(format_schema(s)) == s


@pytest.mark.parametrize("text", ["root{", "root{}", "root:x{a}", "root{a,b{c}}", "root<p=v>", "a{b}}", "", "t<splitsize=10,mergesize=5>{a}", "t{a<gtxn=on>}", "t<txn=on>", "t{a,a}", "a{b{c{d}}}"])
def test_bad_schema_text(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


def test_schema_change():
    s = parse_schema("t<txn=on>{lg0{a<maxversions=2>,b<notify=on>}}")
    new = update_schema(s, "a:maxversions=5,c:op=add,b:op=del,lg0:storage=memory,t:splitsize=9")
    assert (new.names, new.family("a").maxversions, new.groups[0].storage, new.splitsize, new.version) == (["a", "c"], 5, "memory", 9, 1)
    assert with_notify_group(s).names == ["a", "b", "_N_"]
    for bad in ("z:op=del", "a:op=add", "a:colour=1", "t:hash=on", "nonsense"):
        with pytest.raises(SchemaError):
            update_schema(s, bad)


def test_hash_keys(spark):
    assert f"{codecs.murmur64(b'2UhGxUShBZr1ZBIJqz8g'):016x}" == "91e5c5cc21866b18"
    keys = [b"x" * i + bytes([i]) for i in range(40)]
    assert codecs.murmur_many(keys).tolist() == [codecs.murmur64(k) for k in keys]
    df = spark.createDataFrame([("2UhGxUShBZr1ZBIJqz8g",), (None,)], "k string")
    assert [r[0] for r in df.select(codecs.hash_key("k")).collect()] == ["91e5c5cc21866b182UhGxUShBZr1ZBIJqz8g", None]
    assert shard.hash_delimiters(2) == ["7fffffffffffffff"]
    assert shard.hash_delimiters(1) == shard.hash_delimiters(-3) == []
    many = shard.hash_delimiters(32)
    assert len(many) == 31 and many == sorted(many)


@pytest.mark.parametrize("start, end, mid", [(b"helloa", b"hellob", b"helloa\x80"), (b"a", b"b", b"a\x80"), (b"", b"", b"\x7f"), (b"", b"\x01", b"\x00"), (b"", b"\x00", None), (b"a", b"a\x00", None)])
def test_average_key(start, end, mid):
    assert shard.average_key(start, end) == mid


def test_buckets():
    got = [shard.bucket_of(i, 11, 4) for i in range(11)]
    assert got == sorted(got) and [got.count(b) for b in range(4)] == [3, 3, 3, 2]


def test_touching_ranges_merge(spark):
    parts = [("", "g"), ("k", "p"), ("t", "x"), ("q", "s"), ("y", ""), ("p", "q"), ("s", "t"), ("g", "k"), ("x", "y")]
    assert [tuple(r) for r in shard.coverage(spark.createDataFrame(parts, "start string, end string")).collect()] == [("", "")]
    holes = spark.createDataFrame([("b", "c"), ("d", "e")], "start string, end string")
    assert sorted(map(tuple, shard.gap_fillers(holes).collect())) == [("", "b"), ("c", "d"), ("e", "")]


def test_codecs(spark):
    df = spark.createDataFrame([(5,), (-3,), (0,), ((1 << 63) - 1,), (-(1 << 63),)], "n bigint")
    assert all(r[0] == r[1] for r in df.select("n", codecs.decode_counter(codecs.encode_counter(df.n))).collect())
    assert codecs.unescape(codecs.escape(bytes(range(256)))) == bytes(range(256))
    for kind, v in (("int8", -5), ("uint16", 60000), ("int64", -(1 << 60)), ("uint64", (1 << 64) - 1)):
        assert codecs.decode_integer(kind, codecs.encode_integer(kind, v)) == v
    assert codecs.decode_decimal(codecs.encode_decimal(123.456)) == 123.456


def test_global_transactions(spark):
    cell = "row string, cf string, qual string"
    data = spark.createDataFrame([("r", "c", "q", 9, "v1"), ("r", "c", "q", 13, "v2")], f"{cell}, ts long, value string")
    writes = spark.createDataFrame([("r", "c", "q", 12, "put", 9), ("r", "c", "q", 15, "put", 13)], f"{cell}, commit_ts long, kind string, data_ts long")
    none = spark.createDataFrame([], f"{cell}, ts long")
    got = txn.snapshot_read(writes, data, none, 14).first()
    assert (got.value, got.data_ts) == ("v1", 9)
    lock = spark.createDataFrame([("r", "c", "q", 13)], f"{cell}, ts long")
    assert txn.snapshot_read(writes, data, lock, 14).first().status == "locked"
    ask = spark.createDataFrame([("r", "c", "q", 100, 1, "x")], f"{cell}, start_ts long, txn long, value string")
    at = lambda t: spark.createDataFrame([("r", "c", "q", t, "put", 1)], f"{cell}, commit_ts long, kind string, data_ts long")
    assert txn.conflicts(ask, at(120), none).first().status == "write_conflict"
    assert txn.conflicts(ask, at(20), none).first().status == "ok"
    assert txn.conflicts(ask, at(20), spark.createDataFrame([("r", "c", "q", 20)], f"{cell}, ts long")).first().status == "lock_conflict"
    assert txn.parse_script("BEGIN\nPUT t r cf:q v w\nGET t r cf:q\nCOMMIT")[1] == ("put", "t", "r", "cf:q", "v w")
    with pytest.raises(ValueError):
        txn.parse_script("PUT t r cf:q v")


def test_notification_names(spark):
    rows = [("r", "_N_", q, 1, 5, None, 1) for q in ("C:url", "cf::::::", "Curl", "C_url", "++page", ":x", "x:")]
    got = {(r.cf, r.qual) for r in observe.notifications(spark.createDataFrame(rows, log_schema())).collect()}
    assert got == {("C", "url"), ("cf", ":::::")}
    assert observe.legal(observe.Observer("o", "t", "c", "q", "none"), "row")
    assert not observe.legal(observe.Observer("o", "t", "c", "q", "global"), "row")


def test_stream_calls_observers(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"r{i}", "cf", q, i, 5, f"{q}{i}", i) for i in range(1, 6) for q in ("page", "other")]
    spark.createDataFrame(rows, log_schema()).write.parquet(path)
    seen, rounds = [], []
    observers = {observe.Observer("o", "t", "cf", "page"): lambda df: seen.extend(map(tuple, df.select("row", "value").collect()))}
    changes = spark.readStream.schema(log_schema()).parquet(path)
    for more in ([], [("r1", "cf", "page", 9, 5, "new", 99)]):
        if more:
            spark.createDataFrame(more, log_schema()).write.mode("append").parquet(path)
        observe.run(changes, observers, str(tmp_path / "check"), after=rounds.append).awaitTermination()
    assert sorted(seen) == sorted([(f"r{i}", f"page{i}") for i in range(1, 6)] + [("r1", "new")])
    assert rounds == [0, 1]


def test_store(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/db")
    t = c.create_table("t{lg0{a<maxversions=2>},lg1{n}}", ["m"])
    with pytest.raises(StoreError):
        c.create_table("t{a}")
    bad = t.apply([RowMutation("r1").put("a", "x", "1").add("n", "c", 5), RowMutation("r2").put("zz", "x", "1")], 1000)
    assert [r.reason for r in bad.collect()] == ["unknown family"]
    snap = t.snapshot()
    t.apply([RowMutation("r1").put("a", "x", "2").add("n", "c", 3), RowMutation("z").put("a", "y", "9")], 2000)
    cells = lambda d=None: [(r.row, r.cf, r.qual, r.value) for r in t.scan(d).collect()]
    assert cells() == [("r1", "a", "x", "2"), ("r1", "n", "c", "8"), ("z", "a", "y", "9")]
    assert cells(ScanDescriptor(snapshot=snap)) == [("r1", "a", "x", "1"), ("r1", "n", "c", "5")]
    with pytest.raises(StoreError):
        t.scan(ScanDescriptor(snapshot=77))
    assert [r.name for r in shard.locate(t.scan().select("row").distinct(), c.tablets("t")).orderBy("row").collect()] == ["t/tablet00000002"] * 2  # both rows are above "m"
    before = cells()
    t.compact()
    assert cells() == before
    s2 = t.snapshot()
    t.apply([RowMutation("r1").delete_row()], 3000)
    assert cells() == [("z", "a", "y", "9")]
    t.rollback(s2)
    assert cells() == before
    t.apply([RowMutation("r1").delete_column("a", "x")], 4000)
    t.as_view("cells_now")
    assert spark.sql("SELECT count(*) FROM cells_now WHERE row = 'r1'").first()[0] >= 1
    c.update_table("t", "n:op=del")
    assert all(r.cf == "a" for r in t.scan().collect())
    with pytest.raises(StoreError):
        c.drop_table("t")
    c.disable_table("t")
    with pytest.raises(StoreError):
        t.apply([RowMutation("q").put("a", "x", "1")], 1)
    c.drop_table("t")
    assert not c.is_table_exist("t") and c.list_tables().count() == 0


def test_log_files_prune_groups(spark, tmp_path):
    schema = parse_schema("t{lg0{a},lg1{b}}")
    rows = [("r", "a", "q", 1, 5, "1", 1), ("r", "b", "q", 1, 5, "2", 2), ("r", "", "", 1, 1, None, 3)]
    append(spark.createDataFrame(rows, log_schema()), schema, str(tmp_path / "log"))
    got = read(spark, schema, str(tmp_path / "log"), {"a"})
    assert sorted(r.seq for r in got.collect()) == [1, 3]
    assert "PartitionFilters: [lg" in got._jdf.queryExecution().executedPlan().toString()


def test_reads_after_rollback_and_compaction(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/db")
    t = c.create_table("t{lg0{a<maxversions=2>},lg1{n}}")
    t.apply([RowMutation("r").put("a", "x", "1").put("n", "y", "0")], 1000)
    first = t.snapshot()
    t.apply([RowMutation("r").put("a", "x", "2")], 2000)
    second = t.snapshot()
    keys = spark.createDataFrame([("r",), ("none",)], "row string")
    get = lambda **how: [r.value for r in t.get(RowReader("r", families={"a"}, **how)).collect()]
    columns = lambda **how: [r.value for r in t.get(RowReader("r", columns={("a", "x")}, **how)).collect()]
    many = lambda **how: sorted(r.value for r in t.batch_get(keys, **how).collect())
    assert (get(), columns(), many()) == (["2"], ["2"], ["0", "2"])
    assert (get(snapshot=first), columns(snapshot=first), many(snapshot=first)) == (["1"], ["1"], ["0", "1"])
    t.rollback(first)
    assert (get(), columns(), many()) == (["1"], ["1"], ["0", "1"])
    for bad in (lambda: t.get(RowReader("r", snapshot=77)), lambda: t.batch_get(keys, snapshot=77), lambda: t.drop_snapshot(77)):
        with pytest.raises(StoreError):
            bad()
    t.apply([RowMutation("r").delete_row()], 3000)
    t.compact()
    assert (many(), many(snapshot=first)) == ([], ["0", "1"])  # the snapshots are still there
    t.drop_snapshot(first)
    t.drop_snapshot(second)
    t.compact()
    assert t.log().count() == 0


def test_table_reads_only_its_families_files(spark, tmp_path):
    t = Client(spark, f"file://{tmp_path}/db").create_table("t{lg0{a},lg1{n}}")
    t.apply([RowMutation("r").put("a", "x", "1").put("n", "y", "0")], 1000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (t.scan(ScanDescriptor(families={"a"})), t.get(RowReader("r", columns={("a", "x")}))):
        assert "PartitionFilters: [lg" in plan(df) and [r.value for r in df.collect()] == ["1"]
    one = plan(t.get(RowReader("r")))
    assert "EqualTo(row,r)" in one or "GreaterThanOrEqual(row,r)" in one


def test_key_value_table(spark, tmp_path):
    t = Client(spark, f"file://{tmp_path}/db").create_table("k<rawkey=ttlkv>")
    with pytest.raises(StoreError):
        t.apply([RowMutation("r").put("a", "x", "1")], 1)
    bad = t.apply([RowMutation("a").put_kv("1", 5), RowMutation("b").put_kv("2"), RowMutation("c").put_kv(None), RowMutation("x" * 70_000).put_kv("3")], 10_000_000)
    assert [r.reason for r in bad.collect()] == ["row too large"]
    at = lambda s: {r.row: r.value for r in t.scan(now_us=s * 1_000_000).collect()}
    assert at(14) == {"a": "1", "b": "2", "c": None} and at(15) == {"b": "2", "c": None}
    snap = t.snapshot()
    t.apply([RowMutation("b").delete_kv(), RowMutation("c").put_kv("9")], 16_000_000)
    assert at(16) == {"c": "9"} and t.get(RowReader("b")).count() == 0 and t.get(RowReader("b", snapshot=snap)).first().value == "2"
    assert t.batch_get(spark.createDataFrame([("c",), ("d",)], "row string")).count() == 1
    t.rollback(snap)
    assert at(16) == {"b": "2", "c": None}
    t.drop_snapshot(snap)
    t.compact()
    assert at(16) == {"b": "2", "c": None} and t.log().count() == 3
    assert {r.row for r in t.scan(ScanDescriptor("b", "c")).collect()} == {"b"}


def test_split_and_merge(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/db")
    t = c.create_table("t{a}", ["m"])
    t.apply([RowMutation(f"r{i}").put("a", "x", i) for i in range(9)], 1)
    key = t.split()
    assert "r0" < key < "r8" and [r.start for r in c.tablets("t").collect()] == ["", "m", key]
    assert sorted(r.n_rows for r in shard.tablet_loads(t.scan(), c.tablets("t")).collect()) == [4, 5]
    t.split("c")
    t.merge("m")
    assert [r.end for r in c.tablets("t").collect()] == ["c", key, ""]
    for bad in (lambda: t.split("c"), lambda: t.merge("m")):
        with pytest.raises(StoreError):
            bad()


def test_winners_of_a_batch(spark):
    asks = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "C"), (3, "C"), (3, "C"), (4, "D"), (5, "D"), (5, "E"), (6, "E")], "txn long, row string")
    asks = asks.selectExpr("txn", "row", "'c' AS cf", "'q' AS qual", "100L AS start_ts", "CAST(txn AS string) AS value")
    none = spark.createDataFrame([], "row string, cf string, qual string, ts long")
    writes = spark.createDataFrame([("F", "c", "q", 500, "put", 1)], "row string, cf string, qual string, commit_ts long, kind string, data_ts long")
    said = lambda **how: {r.txn: r.status for r in txn.commit_batch(asks, writes, none, txn.TimeOracle(), **how)[0].collect()}
    won = lambda s: sorted(k for k, v in s.items() if v == "ok")
    assert won(said()) == [1, 3, 4, 6]  # 2 lost to 1, so that 3 has C; 5 lost to 4, so that 6 has E
    reads = spark.createDataFrame([(6, "F", "c", "q", 100), (3, "Z", "c", "q", 100)], "txn long, row string, cf string, qual string, start_ts long")
    assert won(said(isolation="serializable", reads=reads)) == [1, 3, 4]
    _, new, data = txn.commit_batch(asks, writes, none, txn.TimeOracle(), isolation="read_committed")
    assert {r.row: r.value for r in data.collect()} == {"A": "1", "B": "2", "C": "3", "D": "5", "E": "6"} and new.count() >= 5
    with pytest.raises(ValueError):
        txn.commit_batch(asks, writes, none, txn.TimeOracle(), isolation="none")
    assert txn.winners(asks.limit(0)).count() == 0


def test_reads_of_nothing_are_validated(spark):
    cells = lambda *rows: spark.createDataFrame([(r, "c", "q", 1, v) for r, v in rows], "row string, cf string, qual string, ts long, value string")
    asked = spark.createDataFrame([("a",), ("b",), ("d",)], "row string")
    got = lambda *a: {r.row: r.ok for r in txn.validate_reads(*a).collect()}
    before, after = cells(("a", "1"), ("e", "1")), cells(("a", "1"), ("b", "2"), ("e", "1"))
    assert got(before, after, asked) == {"a": True, "b": False, "d": True}
    assert got(before, after) == {"a": True, "b": False, "e": True} and got(after, before)["b"] is False


def test_scripts_are_executed(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/db")
    t, u = c.create_table("t{a,b}"), c.create_table("u{a}")
    t.apply([RowMutation("r").put("a", "x", "old").put("b", "y", "gone")], 1)
    tables, oracle = {"t": t, "u": u}, txn.TimeOracle()
    reads, bad = txn.run_script("BEGIN\nGET t r a:x\nPUT t r a:x new one\nGET t r a:x\nDEL t r b:y\nPUT u s a:z 5\nGET u s a:none\nCOMMIT", tables, oracle, 1000)
    assert [r[-1] for r in reads] == ["old", "new one", None] and bad.count() == 0
    assert [(r.row, r.value) for r in t.scan().collect()] == [("r", "new one")] and u.scan().first().value == "5"
    for text, code in (("BEGIN\nPUT t r zz:x 1\nCOMMIT", "BAD_COLUMN"), ("BEGIN\nPUT t r a:!x 1\nCOMMIT", "BAD_COLUMN"), ("BEGIN\nGET v r a:x\nCOMMIT", "NOT_FOUND"), (f"BEGIN\nPUT t r a:x {'v' * 10_001}\nCOMMIT", "DATA_TOO_LARGE")):
        with pytest.raises(txn.TxnFailed) as failed:
            txn.run_script(text, tables, oracle, 2000)
        assert failed.value.code.name == code

    class Meddling:  # another writer comes between the first read and the commit
        schema, name = t.schema, "t"

        def get(self, r, now_us):
            out = t.get(r, now_us)
            rows = out.collect()
            t.apply([RowMutation("r").put("a", "x", "theirs")], 3000)
            return type("Rows", (), {"collect": lambda self: rows})()

        def apply(self, *a):
            raise AssertionError("nothing may be written")

    with pytest.raises(txn.TxnFailed) as failed:
        txn.run_script("BEGIN\nGET t r a:x\nPUT t r a:x mine\nCOMMIT", {"t": Meddling()}, oracle, 2000)
    assert failed.value.code is txn.TxnError.WRITE_CONFLICT


def test_resume_and_observe(spark, tmp_path):
    t = Client(spark, f"file://{tmp_path}/db").create_table("t{a<maxversions=3>}")
    t.apply([RowMutation(r).put("a", q, f"{q}{i}") for i in range(3) for q in ("x", "y") for r in ("r", "s")], 100)
    cells = t.scan(ScanDescriptor(max_versions=3))
    every = [tuple(r) for r in cells.collect()]
    for at in (0, 3, 7, len(every) - 1):
        assert sorted(map(tuple, resume_after(cells, every[at][:4]).collect())) == sorted(every[at + 1 :])
    seen, counts = observed(cells, "scan")
    seen.collect()
    assert counts.get["n_cells"] == 12 and counts.get["n_rows"] == 2 and counts.get["bytes"] == 12 * 5


def test_round_down_past_deleted_rows(spark):
    rows = [(f"r{i:03d}", "a", "q", 1, 5, "v", i) for i in range(200)] + [(f"r{i:03d}", "", "", 9, 1, None, 500 + i) for i in range(20, 200)]
    log = spark.createDataFrame(rows, log_schema())
    assert [r.row for r in round_down(log, parse_schema("t{a}"), "r150x").collect()] == ["r019"]
    assert round_down(log, parse_schema("t{a}"), "a").count() == 0
    assert round_down(log.limit(0), parse_schema("t{a}"), "z").count() == 0


def test_integer_columns(spark):
    for kind, values in {"int8": (-128, -1, 0, 127), "uint8": (0, 255), "int16": (-32768, 5), "uint16": (65535,), "int32": (-(1 << 31), 1 << 30), "uint32": ((1 << 32) - 1,), "int64": (-(1 << 63), -1, (1 << 63) - 1), "uint64": (0, 1 << 63, (1 << 64) - 1)}.items():
        df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, n string").selectExpr("i", "CAST(n AS decimal(20,0)) AS n")
        for r in df.select("i", codecs.integer_bytes(kind, df.n).alias("raw")).withColumn("back", codecs.integer_of(kind, F.col("raw"))).collect():
            assert (bytes(r.raw), int(r.back)) == (codecs.encode_integer(kind, values[r.i]), values[r.i])
    none = spark.createDataFrame([(None,), (b"\x01",)], "raw binary")
    assert [r[0] for r in none.select(codecs.integer_of("int16", none.raw)).collect()] == [None, None]


def test_dump_and_load(spark, tmp_path):
    cells = spark.createDataFrame([("r", "a", "x", 5, "1"), ("r", "b", "y", 6, "2"), ("s", "c", "z", 7, "3"), ("s", "a", "x", 99, "late")], "row string, cf string, qual string, ts long, value string")
    tools.dump_to(cells, f"{tmp_path}/dump", (1, 50), {"a": "new", "b": "b", "c": "c"})
    logs = tools.load_from(spark, f"{tmp_path}/dump", {"one": {"new"}, "two": {"b"}}, f"{tmp_path}/failed", first_seq=10)
    assert [(r.row, r.cf, r.value, r.type) for r in logs["one"].collect()] == [("r", "new", "1", 5)] and logs["two"].first().value == "2" and logs["two"].first().seq >= 10
    assert [(r.cf, r.reason) for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == [("c", "unknown family")]


def test_corruption_records(spark):
    one = tools.stat_records(spark.createDataFrame([("t1", "bad block"), ("t2", "no file")], "tablet string, what string"), 10)
    two = tools.stat_records(spark.createDataFrame([("t1", None), ("t3", "bad block")], "tablet string, what string"), 20)
    cells = scan(one.unionByName(two), parse_schema("stat{corruption}"))
    assert sorted((r.row, r.value) for r in cells.collect()) == [("!t2", "no file"), ("!t3", "bad block")]


def test_stored_bytes_are_merged(spark):
    count = lambda n: n.to_bytes(8, "big", signed=True)
    rows = [("r", "a", "n", 1, 5, count(40), 1), ("r", "a", "n", 2, 10, count(-5), 2), ("r", "a", "n", 3, 10, count(7), 3), ("r", "a", "s", 1, 9, b"x\xff", 4), ("r", "a", "s", 2, 9, b"\x00y", 5), ("r", "a", "v", 1, 5, b"\x80", 6)]
    cells = scan(spark.createDataFrame(rows, log_schema(T.BinaryType())), parse_schema("t{a}"))
    assert {r.qual: bytes(r.value) for r in cells.collect()} == {"n": count(42), "s": b"x\xff\x00y", "v": b"\x80"}
