"""Figures of a report, declared as selections of result tables and computed in one pass a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("count", "n_unique", "mean", "sum_ratio", "value")


@dataclass(frozen=True)
class Selection:
    """One figure: a statistic of the rows of ``table`` whose columns, as text, equal those of ``where``.

    ``count`` (rows), ``n_unique`` (distinct values of ``column``, null as one of them), ``mean``, ``sum_ratio`` (sum of
    ``column`` over that of ``denominator``), ``value`` (of the only row; none or several are an error).
    """

    name: str
    table: str
    statistic: str = "value"
    column: str | None = None
    denominator: str | None = None
    where: Mapping[str, object] = field(default_factory=dict)

    def check(self, columns: list[str]) -> None:
        if self.statistic not in STATISTICS:
            raise ValueError(f"{self.name}: unknown statistic {self.statistic}")
        if self.statistic != "count" and self.column is None:
            raise ValueError(f"{self.name}: a column is needed")
        if self.statistic == "sum_ratio" and self.denominator is None:
            raise ValueError(f"{self.name}: a denominator is needed")
        unknown = {c for c in (self.column, self.denominator, *self.where) if c} - set(columns)
        if unknown:
            raise ValueError(f"{self.name}: {self.table} lacks " + ", ".join(sorted(unknown)))

    def _test(self) -> Column:
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        each = [F.coalesce(F.col(c).cast("string") == text(v), F.lit(False)) for c, v in self.where.items()]
        return reduce(lambda a, b: a & b, each, F.lit(True))

    def column_of(self) -> Column:
        """The figure as one conditional aggregate; sums in the order-free form of decimals where they are ratios."""
        mine = self._test()
        got = F.when(mine, F.col(self.column)) if self.column else None
        rows = F.count_if(mine)
        if self.statistic == "count":
            return rows.cast("double")
        if self.statistic == "n_unique":
            return (F.countDistinct(got) + F.max(F.when(mine & F.col(self.column).isNull(), 1).otherwise(0))).cast("double")
        if self.statistic == "mean":
            return F.avg(got).cast("double")
        if self.statistic == "sum_ratio":
            return F.try_divide(F.sum(got).cast("double"), F.sum(F.when(mine, F.col(self.denominator))).cast("double"))
        many = F.concat(F.lit(f"{self.name}: expected exactly one row of {self.table}, found "), rows.cast("string"))
        return F.when(rows == 1, F.max(got).cast("double")).otherwise(F.raise_error(many).cast("double"))


def resolve(tables: Mapping[str, DataFrame], selections: Iterable[Selection]) -> DataFrame:
    """name, value of every selection; a repeated name, an unknown table or a malformed selection raises ValueError.

    All selections of a table are one aggregation over one scan of it; a ``value`` without exactly
    one row raises when computed.
    """
    by_table: dict[str, list[Selection]] = {}
    seen: set[str] = set()
    for s in selections:
        if s.name in seen:
            raise ValueError(f"a selection is declared twice: {s.name}")
        if s.table not in tables:
            raise ValueError(f"{s.name}: unknown table {s.table}")
        s.check(tables[s.table].columns)
        seen.add(s.name)
        by_table.setdefault(s.table, []).append(s)
    if not by_table:
        raise ValueError("no selections")
    parts = []
    for name, own in by_table.items():
        wide = tables[name].agg(*[s.column_of().alias(f"v{i}") for i, s in enumerate(own)])
        parts.append(wide.select(F.explode(F.array(*[F.struct(F.lit(s.name).alias("name"), F.col(f"v{i}").alias("value")) for i, s in enumerate(own)])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)
