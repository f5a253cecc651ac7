"""Null, NaN, tie and window rules as column expressions.

Spark treats NaN as larger than any number and raises on division by zero in ANSI mode,
so validity is always tested explicitly and divisions go through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def positive(c: str | Column) -> Column:
    return finite(c) & F.coalesce(col(c) > 0, F.lit(False))


def when_finite(c: str | Column) -> Column:
    return F.when(finite(c), col(c))


def valid_trade() -> Column:
    """close_adj, volume and amount are finite and positive."""
    return positive("close_adj") & positive("volume") & positive("amount")


def valid_raw_prices() -> Column:
    return positive("open_raw") & positive("high_raw") & positive("low_raw") & positive("close_raw")


def invalid_ohlc() -> Column:
    """A price is not positive, or high and low do not enclose open and close (raw or adjusted); null counts as valid."""
    bad = F.lit(False)
    for kind in ("raw", "adj"):
        o, h, lo, c = (F.col(f"{x}_{kind}") for x in ("open", "high", "low", "close"))
        for test in ((o <= 0), (h <= 0), (lo <= 0), (c <= 0), h < F.greatest(o, c), lo > F.least(o, c)):
            bad = bad | F.coalesce(test, F.lit(False))
    return bad


def safe_return(current: str | Column, previous: str | Column) -> Column:
    r = F.try_divide(col(current), col(previous)) - 1.0
    return F.when(positive(current) & positive(previous) & finite(r), r)


def safe_reciprocal(c: str | Column) -> Column:
    r = F.try_divide(F.lit(1.0), col(c))
    return F.when(positive(c) & finite(r), r)


def safe_log(c: str | Column) -> Column:
    return F.when(positive(c), F.ln(F.when(positive(c), col(c))))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def complete(agg, c: str | Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over the last n rows, null unless all n values are there."""
    over = trailing(w, n)
    return F.when(F.count(col(c)).over(over) == n, agg(col(c)).over(over))


def downside(c: str | Column, w: WindowSpec, n: int) -> Column:
    return F.sqrt(complete(F.avg, F.pow(F.when(col(c).isNotNull(), F.least(col(c), F.lit(0.0))), F.lit(2.0)), w, n))


def average_rank(c: str | Column, keys: list[str]) -> Column:
    """Rank with ties at their mean position, within ``keys``."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, col(c)))
    return F.rank().over(Window.partitionBy(*keys).orderBy(col(c))) + (ties - 1) / F.lit(2.0)


def equal_bucket(position: Column, count: Column, buckets: int) -> Column:
    """Bucket 1..buckets of the 1-based ``position`` among ``count`` rows."""
    return (F.floor((position - 1) * buckets / count) + 1).cast("int")


def zscore(c: str | Column, keys: list[str]) -> Column:
    """(x - mean) / population deviation within ``keys``; 0 where the deviation is 0."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.try_divide(col(c) - F.avg(col(c)).over(w), F.stddev_pop(col(c)).over(w)), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    x, y = col(x), col(y)
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def market(symbol: str | Column) -> Column:
    """Exchange of a six-digit symbol, null for other symbols."""
    s = col(symbol).cast("string")
    first = F.substring(s, 1, 1)
    return F.when(
        s.rlike("^[0-9]{6}$"),
        F.when(s.startswith("92") | first.isin("4", "8"), "bj").when(first.isin("5", "6", "9"), "sh").when(first.isin("0", "1", "2", "3"), "sz"),
    )


def padded_symbol(c: str | Column) -> Column:
    """One to six digits, zero-padded; null for anything else."""
    s = col(c).cast("string")
    return F.when(s.rlike("^[0-9]{1,6}$"), F.lpad(s, 6, "0"))


def ticks(c: str | Column) -> Column:
    """A price rounded half up to 0.01 in decimal arithmetic on its shortest text."""
    return F.round(col(c).cast("string").cast("decimal(30,12)"), 2).cast("double")


def chained(c: str | Column, w: WindowSpec) -> Column:
    """Running product of positive growth numbers."""
    return F.exp(F.sum(F.ln(col(c))).over(w))


def require_unique(df: DataFrame, keys: list[str], what: str = "frame") -> DataFrame:
    """``df`` itself; raises ValueError if a key occurs twice (one aggregation, at most one row to the driver)."""
    found = df.groupBy(*keys).count().filter("count > 1").head(1)
    if found:
        raise ValueError(f"{what} has a duplicate key: {found[0].asDict()}")
    return df


def require_none(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """``df`` itself; raises ValueError if any row meets ``bad``."""
    if df.filter(bad).head(1):
        raise ValueError(what)
    return df
