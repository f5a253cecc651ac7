"""Rank correlation, Newey-West and false-discovery tests over grouped frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import average_rank, correlation, finite

MINIMUM = 20


def spearman(
    df: DataFrame,
    keys: list[str],
    x: str,
    y: str,
    minimum: int = MINIMUM,
    names: tuple[str, str, str] = ("insufficient_observations", "constant_score", "constant_forward_return"),
    all_groups: bool = True,
) -> DataFrame:
    """keys, n_obs, rank_ic, reason: rank correlation of the finite pairs of each group.

    Groups without a finite pair are kept (n_obs 0) if ``all_groups``; the first of
    ``names`` that applies is the reason of a null.
    """
    pairs = df.filter(finite(x) & finite(y)).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = pairs.select(*keys, "__x", "__y", average_rank("__x", keys).alias("__rx"), average_rank("__y", keys).alias("__ry"))
    got = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        correlation("__rx", "__ry").alias("__r"),
        (F.max("__x") == F.min("__x")).alias("__cx"),
        (F.max("__y") == F.min("__y")).alias("__cy"),
    )
    if all_groups:
        got = df.select(*keys).distinct().join(got, keys, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long")))
    reason = (
        F.when(F.col("n_obs") < minimum, names[0])
        .when(F.col("__cx"), names[1])
        .when(F.col("__cy"), names[2])
        .when(F.col("__r").isNull(), "undefined_rank_correlation")
    )
    return got.select(*keys, "n_obs", F.when(reason.isNull(), F.col("__r")).alias("rank_ic"), reason.alias("reason"))


def published_lag(horizon: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(horizon / F.lit(21.0)).cast("int") - 1)


def automatic_lag(n: Column) -> Column:
    return F.floor(4.0 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


#: Where erfc goes over from its series to its continued fraction, and the terms of both: errors stay below 1e-14.
ERFC_EDGE, SERIES, LEVELS = 2.5, 48, 60


def erfc(x: str | Column) -> Column:
    """The complementary error function of a non-negative column, by arithmetic alone.

    Below ERFC_EDGE one minus the series 2 x exp(-x^2) / sqrt(pi) * (1 + 2x^2/3 (1 + 2x^2/5 (...))),
    whose terms are all positive; from there on the continued fraction
    exp(-x^2) / sqrt(pi) / (x + 1/2 / (x + 1 / (x + 3/2 / (...)))).
    """
    x = F.col(x) if isinstance(x, str) else x
    square, root = 2.0 * x * x, math.sqrt(math.pi)
    inner = F.lit(1.0)
    for k in range(SERIES, 0, -1):
        inner = 1.0 + square / F.lit(2.0 * k + 1) * inner
    far = F.greatest(x, F.lit(ERFC_EDGE))
    tail = far
    for k in range(LEVELS, 0, -1):
        tail = far + F.lit(k / 2.0) / tail
    return F.when(x < ERFC_EDGE, 1.0 - 2.0 / root * x * F.exp(-x * x) * inner).when(x >= ERFC_EDGE, F.exp(-far * far) / root / tail)


def two_sided_p(t: str) -> Column:
    """Two-sided p-value of a standard normal statistic; null for null and NaN."""
    return F.when(F.col(t).isNotNull() & ~F.isnan(t), erfc(F.abs(t) / F.lit(math.sqrt(2.0))))


def newey_west(df: DataFrame, keys: list[str], order: str, value: str, lag: Column, with_p: bool = True) -> DataFrame:
    """keys, n, mean, std, lag, se, t (and p), reason: Bartlett-kernel test of the mean of each series.

    ``lag`` may use the keys and ``n``.  A series is one array a group, as long as it has
    periods; null and non-finite values are left out.
    """
    series = (
        df.filter(finite(value))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("s"), F.stddev_samp(value).alias("std"))
        .withColumn("v", F.transform("s", lambda s: s["v"]))
        .withColumn("n", F.size("v"))
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    series = series.withColumn("mean", total(F.col("v")) / F.col("n")).withColumn("lag", lag.cast("int"))
    series = series.withColumn("e", F.transform("v", lambda x: x - F.col("mean")))
    dot = lambda k: total(
        F.zip_with(F.slice("e", k + 1, F.col("n") - k), F.slice("e", F.lit(1), F.col("n") - k), lambda a, b: a * b)
    ) / F.col("n")
    top = F.least("lag", F.col("n") - 1)
    steps = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    weighted = F.transform(steps, lambda k: 2.0 * (1.0 - k / (F.col("lag") + 1.0)) * dot(k))
    series = series.withColumn("lrv", dot(F.lit(0)) + total(weighted))
    reason = F.when(F.col("n") == 1, "insufficient_observations").when(~(F.col("lrv") > 0), "non_positive_long_run_variance")
    series = series.withColumn("reason", reason)
    se = F.when(F.col("reason").isNull(), F.sqrt(F.when(F.col("lrv") > 0, F.col("lrv")) / F.col("n")))
    out = series.withColumn("se", se).withColumn("t", F.try_divide("mean", "se"))
    if with_p:
        out = out.withColumn("p", two_sided_p("t"))
    return out.select(*keys, "n", "mean", "std", "lag", "se", "t", *["p"] * with_p, "reason")


def benjamini_hochberg(df: DataFrame, p: str, order: list[str], within: list[str] | None = None, name: str = "q") -> DataFrame:
    """Adds the step-up q-value of column ``p`` (null or outside [0, 1] stays null).

    ``within`` are the families of tests; ``order`` breaks ties.  A family is a handful of
    tests, one for each factor.
    """
    keys = within or []
    ok = finite(p) & F.col(p).between(0.0, 1.0)
    part = Window.partitionBy(*keys, ok)
    rank = F.row_number().over(part.orderBy(F.col(p), *order))
    out = df.withColumn("__ok", ok).withColumn("__raw", F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(part) / rank)).withColumn("__rank", rank)
    upward = Window.partitionBy(*keys, "__ok").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.when(F.col("__ok"), F.min("__raw").over(upward))).drop("__ok", "__raw", "__rank")
