import random
from collections import defaultdict

import pytest

from cellarium.operators.filters import FilterList, ValueFilter
from cellarium.operators.resolve import log_schema, resolve
from cellarium.operators.scan import RowReader, ScanDescriptor, get, prefix_range, scan
from cellarium.schema import Family, TableSchema

THREE = TableSchema("t", (Family("column", maxversions=3),))


def log(spark, rows, value=None):
    return spark.createDataFrame([(r, c, q, t, k, v, i) for i, (r, c, q, t, k, v) in enumerate(rows, 1)], log_schema(value))


def fold(rows, limits, ttl=None, now=0):
    """The rules as one pass in key order."""
    newest = {}
    for i, (r, c, q, t, k, v) in enumerate(rows):
        if k >= 5 and ttl and t + ttl * 1_000_000 <= now:
            continue
        newest[r, c, q, t, k] = (i, v)
    drow, dfam, dcol = (defaultdict(lambda: -1) for _ in range(3))
    for (r, c, q, t, k), _ in newest.items():
        for kind, d, key in ((1, drow, r), (2, dfam, (r, c)), (3, dcol, (r, c, q))):
            if k == kind:
                d[key] = max(d[key], t)
    out, cells = [], defaultdict(list)
    for (r, c, q, t, k), (_, v) in newest.items():
        if k >= 4 and t > max(drow[r], dfam[r, c], dcol[r, c, q]):
            cells[r, c, q].append((-t, k, v))
    for (r, c, q), es in cells.items():
        es.sort(key=lambda e: e[:2])
        shown, puts, versions, dels, before = [], 0, 0, 0, None
        for age, k, v in es:
            hit = before == 4
            before = k
            if k == 5:
                versions += 1
            if k == 4:
                dels += 1
                continue
            if not hit and ((k == 5 and versions <= limits[c]) or (k > 5 and puts == 0)):
                shown.append((-age, k, v, puts, dels))
            if k == 5 and not hit:
                puts += 1
        if shown and shown[0][1] > 5:
            t0, k0, _, _, d0 = shown[0]
            chain = [e for e in shown if e[3] == 0 and e[4] == d0]
            rest = [e for e in shown if e not in chain]
            used, stamps = [], set()
            for i, e in enumerate(chain):
                before_t = shown[shown.index(e) - 1][0] if shown.index(e) else None
                if e[1] in (5, k0) and e[0] != before_t:
                    used.append(e[2])
            v = str(sum(map(int, used))) if k0 in (7, 10) else used[-1] if k0 == 8 else "".join(reversed(used))
            out.append((r, c, q, t0, v))
            shown = rest
        out += [(r, c, q, e[0], e[2]) for e in shown]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_against_the_fold(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(rnd.randint(5, 500)):
        k = rnd.choice([1, 2, 3, 4, 5, 5, 5, 5, 7, 9, 10] if seed % 2 else [3, 4, 5, 5, 5, 8])
        c = "" if k == 1 else rnd.choice("ab")
        q = "" if k <= 2 else rnd.choice("xyz")
        rows.append((f"r{rnd.randint(0, 9)}", c, q, rnd.randint(1, 40) * 1_000_000, k, None if k < 5 else str(i)))
    limits = {"a": 1 + seed % 3, "b": 2}
    ttl = 12 if seed % 4 == 3 else 0
    schema = TableSchema("t", tuple(Family(f, maxversions=n, ttl=ttl) for f, n in limits.items()))
    got = resolve(log(spark, rows), schema, now_us=40_000_000).drop("version").collect()
    assert sorted(map(tuple, got)) == fold(rows, limits, ttl, 40_000_000)


def test_rows_of_the_store_tests(spark):
    puts = [("row", "column", "1a", t, 5, f"v{t}") for t in range(1, 6)]
    assert scan(log(spark, puts), THREE, ScanDescriptor(max_versions=9)).count() == 3
    assert scan(log(spark, puts), THREE, ScanDescriptor(max_versions=2)).count() == 2
    one = lambda a, b: get(log(spark, puts), THREE, RowReader("row", columns={("column", "1a")}, time_range=(a, b), max_versions=4)).count()
    assert one(2, 4) == 2  # of the newest three, 3 to 5, two lie within
    assert one(2, 2) == 0
    assert one(4, 4) == 1
    both = [("row2", "column", "Lqu0", 10, 3, None), ("row2", "column", "Lqu0", 10, 5, "v")]
    assert scan(log(spark, both), THREE).count() == 0  # at equal timestamps the delete wins
    gone = [("row", "column", "q", 5, 5, "v"), ("row", "", "", 6, 1, None)]
    assert scan(log(spark, gone), THREE).count() == 0
    assert scan(log(spark, [*gone, ("row", "column", "2a", 7, 5, "w")]), THREE).count() == 1
    more = [*puts, ("row1", "column", "1a", 3, 5, "x"), ("row1", "column", "2b", 3, 5, "y"), ("row2", "column", "2b", 3, 5, "y")]
    assert scan(log(spark, more), THREE, ScanDescriptor("row", "row1\0", max_versions=9)).count() == 5


def test_strict_version_delete(spark):
    rows = [("r", "column", "q", 5, 4, None), ("r", "column", "q", 4, 5, "v")]
    assert resolve(log(spark, rows), THREE).count() == 0
    assert resolve(log(spark, rows), THREE, strict=True).count() == 1


def test_empty_log(spark):
    assert scan(log(spark, []), THREE).collect() == []


FIXTURE = [("r", "cf1", "", 1, 5, 12.0), ("r", "cf1", "qu0", 1, 5, 11.0), ("r", "cf1", "qu1", 1, 5, 9.0), ("r", "cf2", "qu2", 1, 5, 123.455)]


@pytest.mark.parametrize("f, kept", [
    (ValueFilter("cf1", "qu1", "<", 10, "int64", True), True), (ValueFilter("cf2", "qu2", ">=", 123.456), False), (ValueFilter("cf4", "qu4", "<", 10, "int64", True), False),
    (ValueFilter("cf5", "qu5", ">=", 123.456), True), (ValueFilter("cf1", "", ">", 11, "int64"), False), (ValueFilter("cf1", "", "<", 13, "int64"), True),
])
def test_filters(spark, f, kept):
    from pyspark.sql.types import DoubleType

    schema = TableSchema("t", tuple(Family(f"cf{i}") for i in range(1, 6)))
    assert (scan(log(spark, FIXTURE, DoubleType()), schema, ScanDescriptor(filter=f)).count() > 0) is kept


def test_nested_filter_of_bytes(spark):
    at = lambda op, ref: ValueFilter("cf5", "qu5", op, ref, "bytes", True)
    f = FilterList("or", (FilterList("and", (at(">=", "d"), at("<", "m"))), at(">", "v")))
    rows = [(v, "cf5", "qu5", 1, 5, v) for v in "admvx"]
    assert sorted(r.row for r in scan(log(spark, rows), TableSchema("t", (Family("cf5"),)), ScanDescriptor(filter=f)).collect()) == ["d", "x"]


def test_filter_needs_one_version():
    with pytest.raises(ValueError):
        scan(None, THREE, ScanDescriptor(max_versions=2, filter=ValueFilter("a", "b", "<", 1)))


def test_prefix_range():
    assert prefix_range("ab") == ("ab", "ac")
    assert prefix_range("a\U0010ffff") == ("a\U0010ffff", "b")
