"""Transactions evaluated as joins: single-row validation, compare-and-set, snapshot reads and conflicts of global ones.

Commits are batches: one driver decides all winners of a batch and appends their writes. Concurrent drivers are out of
scope.
"""

from __future__ import annotations

import functools
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.resolve import CELL
from cellarium.session import cut


class TxnError(IntEnum):
    OK = 0
    TXN_FAIL = 101
    NOT_FOUND = 102
    NOT_EQUAL = 103
    WRITE_CONFLICT = 104
    LOCK_CONFLICT = 105
    DATA_TOO_LARGE = 106
    BAD_COLUMN = 107


class TxnFailed(RuntimeError):
    """A transaction that was not committed, with its code."""

    def __init__(self, code: TxnError, text: str):
        super().__init__(f"{code.name.lower()}: {text}")
        self.code = code


MAX_TXN_BYTES = 10_000
ISOLATION = ("snapshot", "serializable", "read_committed")


class TimeOracle:
    """Strictly rising timestamps, handed out in runs; 0 means failure."""

    def __init__(self, start: int = 1):
        self._next = max(1, start)

    def take(self, n: int = 1) -> int:
        if n < 1:
            return 0
        first, self._next = self._next, self._next + n
        return first


def read_set_digest(cells: DataFrame) -> DataFrame:
    """(row, digest): what a read of each row returned; a new, changed or lost cell changes it."""
    one = F.xxhash64("cf", "qual", "ts", F.col("value").cast("string"))
    return cells.groupBy("row").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)"))).alias("digest"))


def validate_reads(read: DataFrame, now: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(row, ok) for each row asked for: whether the same read gives the same cells now. A read of nothing fails once there is something.

    asked (row): the rows that were read, found or not; by default those with a cell in either read.
    """
    before, after = read_set_digest(read), read_set_digest(now).withColumnRenamed("digest", "_now")
    both = before.join(after, "row", "full")
    if asked is not None:
        both = asked.select("row").distinct().join(both, "row", "left")
    return both.select("row", F.col("digest").eqNullSafe(F.col("_now")).alias("ok"))


def first_of_batch(mutations: DataFrame, order: str = "seq") -> DataFrame:
    """mutations with ok: within one batch, a row's first transaction wins."""
    return mutations.withColumn("ok", F.row_number().over(Window.partitionBy("row").orderBy(order)) == 1)


def compare_and_set(cells: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (row, cf, qual, expected, value) with status: ok, not_equal or not_found."""
    now = cells.select(*CELL, F.col("value").alias("_now"))
    status = F.when(F.col("_now").isNull(), "not_found").when(F.col("_now") == F.col("expected"), "ok").otherwise("not_equal")
    return asks.join(now, CELL, "left").withColumn("status", status).drop("_now")


def snapshot_read(writes: DataFrame, data: DataFrame, locks: DataFrame, start_ts: int) -> DataFrame:
    """Cells as of start_ts: row, cf, qual, value, data_ts, status.

    writes: row, cf, qual, commit_ts, kind, data_ts. data: row, cf, qual, ts, value. locks: row, cf, qual, ts. The
    newest write up to start_ts decides; a lock before start_ts hides the cell until it is cleaned.
    """
    last = writes.where(F.col("commit_ts") <= start_ts).groupBy(*CELL).agg(F.max_by(F.struct("kind", "data_ts"), "commit_ts").alias("x")).select(*CELL, "x.*").where("kind = 'put'")
    seen = last.join(data.withColumnRenamed("ts", "data_ts"), [*CELL, "data_ts"])
    held = locks.where(F.col("ts") < start_ts).select(*CELL).distinct().withColumn("_held", F.lit(True))
    out = seen.join(held, CELL, "left")
    return out.select(*CELL, F.when(F.col("_held"), None).otherwise(F.col("value")).alias("value"), "data_ts", F.when(F.col("_held"), "locked").otherwise("ok").alias("status"))


def conflicts(asks: DataFrame, writes: DataFrame, locks: DataFrame) -> DataFrame:
    """asks (row, cf, qual, start_ts) with status: write_conflict for a write at or after start_ts, lock_conflict for any lock, else ok."""
    newest = writes.groupBy(*CELL).agg(F.max("commit_ts").alias("_w"))
    held = locks.groupBy(*CELL).agg(F.max("ts").alias("_l"))
    status = F.when(F.col("_w") >= F.col("start_ts"), "write_conflict").when(F.col("_l").isNotNull(), "lock_conflict").otherwise("ok")
    return asks.join(newest, CELL, "left").join(held, CELL, "left").withColumn("status", status).drop("_w", "_l")


def settle_locks(locks: DataFrame, writes: DataFrame) -> DataFrame:
    """locks (row, cf, qual, ts, primary: struct row, cf, qual) with what to do: roll_forward if the primary's write of that data is there, else clean."""
    done = writes.select(F.struct(*CELL).alias("primary"), F.col("data_ts").alias("ts"), "commit_ts").distinct()
    out = locks.join(done, ["primary", "ts"], "left")
    return out.select(*CELL, "ts", F.when(F.col("commit_ts").isNotNull(), "roll_forward").otherwise("clean").alias("action"), "commit_ts")


def winners(asks: DataFrame) -> DataFrame:
    """(txn) of those that win when transactions (txn, row, cf, qual) come one after another by number, and one that shares a cell with an earlier winner loses.

    In each round every undecided transaction that is first in all its cells wins, and those that share a cell with it
    lose: as many rounds as the longest chain of transactions that decide each other.
    """
    left = cut(asks.select("txn", *CELL).distinct())
    won = []
    while not left.isEmpty():
        first = left.groupBy(*CELL).agg(F.min("txn").alias("_first"))
        judged = left.join(first, CELL).groupBy("txn").agg(F.bool_and(F.col("_first") == F.col("txn")).alias("_wins"))
        now = cut(judged.where("_wins").select("txn"))
        won.append(now)
        taken = left.join(now, "txn", "left_semi").select(*CELL).distinct()
        lost = left.join(taken, CELL, "left_semi").select("txn").distinct()
        left = cut(left.join(lost, "txn", "left_anti"))
    return functools.reduce(DataFrame.unionByName, won) if won else asks.select("txn").limit(0)


def commit_batch(asks: DataFrame, writes: DataFrame, locks: DataFrame, oracle: TimeOracle, isolation: str = "snapshot", reads: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commit transactions (txn, row, cf, qual, start_ts, value), lower numbers first. Returns (statuses, new writes, new data).

    A transaction fails if any of its cells conflicts with what is stored, or with an earlier winner of the batch.
    isolation: `snapshot` checks written cells only; `serializable` also fails a transaction one of whose reads (txn, row,
    cf, qual, start_ts) was written or locked since, in the store or by an earlier winner; `read_committed` checks locks
    only, so that the last writer wins.
    """
    if isolation not in ISOLATION:
        raise ValueError(f"isolation is one of {', '.join(ISOLATION)}")
    judged = conflicts(asks, writes, locks).select("txn", "status")
    if isolation == "serializable" and reads is not None:
        judged = judged.unionByName(conflicts(reads, writes, locks).select("txn", "status"))
    if isolation == "read_committed":
        judged = judged.withColumn("status", F.when(F.col("status") == "lock_conflict", "lock_conflict").otherwise("ok"))
    stored = judged.groupBy("txn").agg(F.coalesce(F.min(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status"))
    clean = stored.where("status = 'ok'").select("txn")
    if isolation == "read_committed":
        statuses = stored
    else:
        touched = asks.select("txn", *CELL)
        if isolation == "serializable" and reads is not None:
            touched = touched.unionByName(reads.select("txn", *CELL))
        won = winners(touched.join(clean, "txn", "left_semi")).withColumn("_won", F.lit(True))
        status = F.when((F.col("status") == "ok") & F.col("_won").isNull(), "write_conflict").otherwise(F.col("status"))
        statuses = stored.join(won, "txn", "left").select("txn", status.alias("status"))
    good = asks.join(statuses.where("status = 'ok'").select("txn"), "txn", "left_semi")
    if isolation == "read_committed":
        good = good.join(good.groupBy(*CELL).agg(F.max("txn").alias("txn")), [*CELL, "txn"], "left_semi")
    commit_ts = oracle.take()
    new_writes = good.select(*CELL, F.lit(commit_ts).cast("long").alias("commit_ts"), F.when(F.col("value").isNull(), "delete").otherwise("put").alias("kind"), F.col("start_ts").alias("data_ts"))
    return statuses, new_writes, good.where("value is not null").select(*CELL, F.col("start_ts").alias("ts"), "value")


def check_columns(asks: DataFrame, gtxn_families: list[str]) -> Column:
    """Why a write can't be part of a global transaction; null if it can."""
    return F.when(~F.col("cf").isin(gtxn_families), "family isn't transactional").when(F.col("qual").startswith("!"), "qualifier is reserved").when(F.length("row") + F.length("qual") + F.length(F.coalesce(F.col("value").cast("string"), F.lit(""))) > MAX_TXN_BYTES, "too large")


def parse_script(text: str) -> list[tuple]:
    """A transaction script's steps: ("begin",), ("get", table, row, column), ("put", ..., value), ("del", ...), ("commit",)."""
    sizes = {"begin": 0, "commit": 0, "get": 3, "del": 3, "put": 4}
    out: list[tuple] = []
    for n, line in enumerate(text.splitlines(), 1):
        words = line.split(None, 4)
        if not words:
            continue
        verb = words[0].lower()
        if sizes.get(verb) != len(words) - 1:
            raise ValueError(f"line {n}: {line!r}")
        out.append((verb, *words[1:]))
    if [s[0] for s in out[:1]] != ["begin"] or out[-1][0] != "commit":
        raise ValueError("a script begins with BEGIN and ends with COMMIT")
    return out


def run_script(text: str, tables: dict, oracle: TimeOracle, now_us: int) -> tuple[list, DataFrame | None]:
    """Execute a script over stored tables (name -> Table): what its reads gave, and what was refused, if anything.

    All reads are of the state at BEGIN, and also see the script's own writes. Its writes are applied at COMMIT, one batch
    for each table, unless a cell that it read or wrote has changed since BEGIN: then TxnFailed is raised and nothing is.
    """
    from cellarium.operators.scan import RowReader
    from cellarium.sources.store import RowMutation

    own: dict[tuple, str | None] = {}
    began: dict[tuple, list] = {}
    out, start = [], oracle.take()

    def stored(name: str, row: str, cf: str, qual: str) -> list:
        return sorted((r.ts, r.value) for r in tables[name].get(RowReader(row, columns={(cf, qual)}), now_us).collect())

    for verb, *rest in parse_script(text):
        if verb in ("begin", "commit"):
            continue
        name, row, column = rest[:3]
        if name not in tables:
            raise TxnFailed(TxnError.NOT_FOUND, f"no table {name}")
        cf, _, qual = column.partition(":")
        if qual.startswith("!") or cf not in tables[name].schema.names:
            raise TxnFailed(TxnError.BAD_COLUMN, column)
        cell = (name, row, cf, qual)
        if cell not in began:
            began[cell] = stored(*cell)
        if verb == "get":
            seen = own[cell] if cell in own else next((v for _, v in reversed(began[cell])), None)
            out.append((*cell, seen))
        else:
            own[cell] = rest[3] if verb == "put" else None
    if sum(len(row) + len(qual) + len(v or "") for (_, row, _, qual), v in own.items()) > MAX_TXN_BYTES:
        raise TxnFailed(TxnError.DATA_TOO_LARGE, "the script writes too much")
    for cell, before in began.items():
        if stored(*cell) != before:
            raise TxnFailed(TxnError.WRITE_CONFLICT, f"{cell} changed since {start}")
    refused = None
    for name in dict.fromkeys(c[0] for c in own):
        rows: dict[str, RowMutation] = {}
        for (of, row, cf, qual), value in own.items():
            if of == name:
                m = rows.setdefault(row, RowMutation(row))
                m.put(cf, qual, value) if value is not None else m.delete_columns(cf, qual)
        bad = tables[name].apply(list(rows.values()), now_us)
        refused = bad if refused is None else refused.unionByName(bad)
    return out, refused
