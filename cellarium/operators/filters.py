"""Typed value filters and nested filter lists, as one boolean per row key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.codecs import integer_of

OPS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
}
#: Types a value can be compared as; the unsigned long needs a decimal.
INTEGERS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}
EPSILON = 1e-10


@dataclass(frozen=True)
class ValueFilter:
    """Keeps rows whose cell (cf, qual) compares as asked; with an empty qual every cell of cf has to.

    A row without such a cell is kept unless if_missing_drop.
    """

    cf: str
    qual: str
    op: str
    ref: object
    comparator: str = "decimal"  # or an integer type, or bytes
    if_missing_drop: bool = False
    stored: bool = False  # values are an integer comparator's bytes, not numbers

    def __post_init__(self):
        if self.op not in OPS or self.comparator not in (*INTEGERS, "decimal", "bytes"):
            raise ValueError(f"unknown comparison {self.op} of {self.comparator}")

    def _test(self) -> Column:
        value = F.col("value")
        if self.comparator == "decimal":
            d = value.cast("double") - F.lit(float(self.ref))
            sign = F.when(F.abs(d) < EPSILON, 0).when(d < 0, -1).otherwise(1)
            return OPS[self.op](sign, F.lit(0))
        if self.comparator == "bytes":
            return OPS[self.op](value, F.lit(self.ref))
        kind = INTEGERS[self.comparator]
        if self.stored:
            return OPS[self.op](integer_of(self.comparator, value), F.lit(self.ref).cast("decimal(20,0)"))
        return OPS[self.op](value.cast(kind), F.lit(self.ref).cast(kind))

    def keeps(self) -> Column:
        mine = F.col("cf") == self.cf
        if self.qual:
            mine &= F.col("qual") == self.qual
        return F.coalesce(F.min(F.when(mine, self._test())).over(Window.partitionBy("row")), F.lit(not self.if_missing_drop))

    def families(self) -> set[str]:
        return {self.cf}


@dataclass(frozen=True)
class ColumnFilter:
    """Keeps rows of which some cell (or `every` cell) of the families makes a condition true: any filter of a user's own."""

    condition: Column
    of: tuple[str, ...]
    every: bool = False

    def keeps(self) -> Column:
        mine = F.when(F.col("cf").isin(list(self.of)), self.condition)
        over = Window.partitionBy("row")
        return F.coalesce((F.min(mine) if self.every else F.max(mine)).over(over), F.lit(self.every))

    def families(self) -> set[str]:
        return set(self.of)


@dataclass(frozen=True)
class FilterList:
    """All (`and`) or any (`or`) of its parts must keep a row; an empty list keeps it."""

    how: str = "and"
    parts: tuple[ValueFilter | ColumnFilter | FilterList, ...] = field(default_factory=tuple)

    def keeps(self) -> Column:
        if not self.parts:
            return F.lit(True)
        out = self.parts[0].keeps()
        for p in self.parts[1:]:
            out = out & p.keeps() if self.how == "and" else out | p.keeps()
        return out

    def families(self) -> set[str]:
        return set().union(*(p.families() for p in self.parts))
