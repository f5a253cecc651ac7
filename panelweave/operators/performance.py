"""Benchmarks, relative performance, regimes, segments, cross-sectional regressions and bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chained, complete, finite, positive, trailing
from ..functions.statistics import automatic_lag, newey_west

DAYS = 252


def carried_prices(prices: DataFrame, wanted: DataFrame, price: str = "close_adj") -> DataFrame:
    """Adds to ``wanted`` (date, symbol, ...) the last positive price up to its date: a backward as-of join.

    Both sides meet in one sorted pass over a symbol's rows; nothing is filled in.
    """
    marks = prices.filter(positive(price)).select("symbol", "date", F.col(price).alias("__p"), F.lit(0).alias("__kind"))
    asked = wanted.select("symbol", "date").distinct().withColumn("__p", F.lit(None).cast("double")).withColumn("__kind", F.lit(1))
    upto = Window.partitionBy("symbol").orderBy("date", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    known = marks.unionByName(asked).withColumn("price", F.last("__p", ignorenulls=True).over(upto)).filter("__kind = 1").select("symbol", "date", "price")
    return wanted.join(known, ["symbol", "date"])


def universe_benchmark(prices: DataFrame, members: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, equal_weight, cap_weight, member_count: buy-and-hold portfolios formed at each signal close, chained.

    ``members``: date, symbol, market_cap; a date belongs to the window opened by the last
    signal strictly before it; a member without a later price is carried at its last one.
    """
    signals = members.select(F.col("date").alias("start")).distinct()
    days = calendar.select("date").distinct()
    marks = days.join(F.broadcast(signals.withColumn("date", F.col("start"))), "date", "left")
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    windows = marks.withColumn("start", F.last("start", ignorenulls=True).over(before))  # a calendar: one row a date
    base = members.select(F.col("date").alias("start"), "symbol", "market_cap").join(
        prices.filter(positive("close_adj")).select(F.col("date").alias("start"), "symbol", F.col("close_adj").alias("base")), ["start", "symbol"]
    )
    in_window = Window.partitionBy("start")
    base = base.withColumn("we", 1.0 / F.count(F.lit(1)).over(in_window)).withColumn("wc", F.col("market_cap") / F.sum("market_cap").over(in_window))
    held = carried_prices(prices, windows.filter("start IS NOT NULL").join(base, "start"))
    growth = held.groupBy("start", "date").agg(
        F.sum(F.col("we") * F.col("price") / F.col("base")).alias("e"), F.sum(F.col("wc") * F.col("price") / F.col("base")).alias("c"), F.count(F.lit(1)).alias("member_count")
    )
    ends = growth.groupBy("start").agg(F.max_by("e", "date").alias("e"), F.max_by("c", "date").alias("c"))
    earlier = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("start", F.coalesce(chained("e", earlier), F.lit(1.0)).alias("be"), F.coalesce(chained("c", earlier), F.lit(1.0)).alias("bc"))
    out = windows.join(growth, ["start", "date"], "left").join(ends, "start", "left")
    return out.select(
        "date", F.coalesce(F.col("be") * F.col("e"), F.lit(1.0)).alias("equal_weight"), F.coalesce(F.col("bc") * F.col("c"), F.lit(1.0)).alias("cap_weight"),
        F.coalesce("member_count", F.lit(0)).alias("member_count"),
    )


def returns(levels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One-period returns of level columns; the first row of each path is left out."""
    w = Window.partitionBy(*keys).orderBy("date")
    out = levels.select(*keys, "date", *[(F.try_divide(F.col(c), F.lag(c).over(w)) - 1.0).alias(c) for c in columns], F.row_number().over(w).alias("__i"))
    return out.filter("__i > 1").drop("__i")


def relative_performance(levels: DataFrame, keys: list[str], years: float, strategy: str = "strategy", benchmark: str = "benchmark") -> DataFrame:
    """Annual and relative return, tracking error, information ratio, beta and correlation of two level paths."""
    ends = levels.groupBy(*keys).agg(
        F.try_divide(F.max_by(strategy, "date"), F.min_by(strategy, "date")).alias("s"), F.try_divide(F.max_by(benchmark, "date"), F.min_by(benchmark, "date")).alias("b")
    )
    r = returns(levels, keys, [strategy, benchmark]).withColumn("a", F.col(strategy) - F.col(benchmark))
    stats = r.groupBy(*keys).agg(
        F.stddev_samp("a").alias("sa"), F.avg("a").alias("ma"), F.var_samp(benchmark).alias("vb"), F.covar_samp(strategy, benchmark).alias("cov"), F.stddev_samp(strategy).alias("ss"), F.stddev_samp(benchmark).alias("sb")
    )
    annual = lambda g: F.pow(g, F.lit(1.0 / years)) - 1.0
    te = F.col("sa") * math.sqrt(DAYS)
    rows = ends.join(stats, keys) if keys else ends.crossJoin(stats)  # one row each
    return rows.select(
        *keys, annual(F.col("s")).alias("strategy_annual_return"), annual(F.col("b")).alias("benchmark_annual_return"), annual(F.try_divide("s", "b")).alias("annual_relative_return"),
        te.alias("tracking_error"), F.try_divide(F.col("ma") * DAYS, te).alias("information_ratio"), F.try_divide("cov", "vb").alias("beta"), F.try_divide(F.col("cov"), F.col("ss") * F.col("sb")).alias("correlation"),
    )


def market_return(panel: DataFrame) -> DataFrame:
    """date, market_return: equal mean of one-period adjusted returns."""
    r = F.try_divide("close_adj", "prev_close_adj") - 1.0
    return panel.select("date", r.alias("r")).filter(finite("r")).groupBy("date").agg(F.avg("r").alias("market_return"))


def market_regimes(market: DataFrame, trend_window: int = 60, volatility_window: int = 20) -> DataFrame:
    """Trend from the trailing compound return, volatility against the median of earlier volatilities.

    The input has one row a date, so its windows run over a calendar.
    """
    w = Window.orderBy("date")
    df = market.withColumn("__r", F.when(finite("market_return"), F.col("market_return")))
    full = F.count("__r").over(trailing(w, trend_window)) == trend_window
    trend = F.when(full, chained(1.0 + F.col("__r"), trailing(w, trend_window)) - 1.0)
    volatility = complete(F.stddev_samp, "__r", w, volatility_window) * math.sqrt(252.0)
    df = df.withColumn("trailing_market_return", trend).withColumn("market_volatility", volatility)
    threshold = F.percentile("market_volatility", F.lit(0.5)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__t", threshold)
    t, v = F.col("trailing_market_return"), F.col("market_volatility")
    return df.select(
        "date", "market_return", t, v, F.when(t.isNull(), "insufficient_history").when(t >= 0, "up").otherwise("down").alias("market_trend"),
        F.when(v.isNull() | F.col("__t").isNull(), "insufficient_history").when(v > F.col("__t"), "high").otherwise("low").alias("volatility_regime"),
    )


def time_segments(df: DataFrame, split: str, names: tuple[str, str]) -> DataFrame:
    return df.withColumn("segment_type", F.lit("time_period")).withColumn("segment", F.when(F.col("date") <= F.lit(split).cast("date"), names[0]).otherwise(names[1]))


def size_segments(long_panel: DataFrame, labels: DataFrame, horizon: int = 20) -> DataFrame:
    """date, return, segment_type, segment: mean forward return below and above the median size of a date."""
    rows = long_panel.filter("factor_name = 'log_market_cap'").join(labels.select("date", "symbol", F.col(f"forward_return_{horizon}").alias("return")), ["date", "symbol"], "left")
    median = F.percentile("raw_value", F.lit(0.5)).over(Window.partitionBy("date"))
    rows = rows.withColumn("segment", F.when(F.col("raw_value") <= median, "small").otherwise("large"))
    return rows.groupBy("date", "segment").agg(F.avg("return").alias("return")).withColumn("segment_type", F.lit("market_size"))


def segment_summary(rows: DataFrame, periods: dict[str, int] | None = None, default: int = 252) -> DataFrame:
    """observations, dates, mean, annualized figures and a 95 % interval of each segment."""
    k = F.lit(default)
    for name, n in (periods or {}).items():
        k = F.when(F.col("segment_type") == name, n).otherwise(k)
    r = F.when(finite("return"), F.col("return"))
    out = rows.groupBy("segment_type", "segment").agg(
        F.count(r).alias("observations"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.avg(r).alias("mean_period_return"), F.stddev_samp(r).alias("__s")
    )
    m, s = F.col("mean_period_return"), F.when(F.col("observations") > 1, F.col("__s"))
    out = out.withColumn("annualized_return", m * k).withColumn("annualized_volatility", s * F.sqrt(k)).withColumn("standard_error", s / F.sqrt("observations"))
    return out.withColumn("ci95_low", m - 1.96 * F.col("standard_error")).withColumn("ci95_high", m + 1.96 * F.col("standard_error")).drop("__s")


def monthly_regressions(frame: DataFrame, factors: list[str], label: str, minimum: int) -> DataFrame:
    """date, factor_name, coefficient, n_obs, r_squared: one least-squares fit a date on standardized factors.

    The normal equations are sums, so a date's cross-section is aggregated where it lies;
    only the small matrices are solved in Python.
    """
    if label in factors or len(set(factors)) != len(factors):
        raise ValueError("regressors must be distinct and must not be the label")
    names = [*factors, label]
    ok = F.lit(True)
    for c in names:
        ok = ok & finite(c)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = frame.filter(ok).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.stddev_samp(c) for c in factors]).alias("spread"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("cov"),
        F.array(*[F.max(c) - F.min(c) for c in factors]).alias("range"),
    ).filter(F.col("n") >= max(minimum, len(factors) + 2))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if not all(x > 0 for x in r.range):
                    continue
                c = np.zeros((k, k))
                for (i, j), v in zip(pairs, r.cov, strict=True):
                    c[i, j] = c[j, i] = v
                scale = np.asarray(r.spread)
                xx, xy, yy = c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale, c[-1, -1]
                beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
                fit = float(beta @ xy) / yy if yy > 0 else math.nan
                out += [(r.date, f, float(b), r.n, fit) for f, b in zip(factors, beta, strict=True)]
            yield pd.DataFrame(out, columns=["date", "factor_name", "coefficient", "n_obs", "r_squared"])

    return sums.mapInPandas(solve, "date date, factor_name string, coefficient double, n_obs long, r_squared double")


def regression_summary(monthly: DataFrame, lag: int) -> DataFrame:
    """Mean premium of each factor with t values at a given and at the automatic lag."""
    a = newey_west(monthly, ["factor_name"], "date", "coefficient", F.lit(lag), with_p=False)
    b = newey_west(monthly, ["factor_name"], "date", "coefficient", automatic_lag(F.col("n")), with_p=False)
    size = monthly.groupBy("factor_name").agg(F.avg("n_obs").alias("mean_n_obs"), F.avg("r_squared").alias("mean_r_squared"))
    a = a.select("factor_name", F.col("n").alias("months"), F.col("mean").alias("mean_coefficient"), F.col("lag").alias("published_lag"), F.col("t").alias("t_published_lag"))
    b = b.select("factor_name", F.col("lag").alias("automatic_lag"), F.col("t").alias("t_automatic_lag"))
    return a.join(b, "factor_name").join(size, "factor_name")


def block_bootstrap(pairs: DataFrame, keys: list[str], *, years: float, block: int, replications: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile intervals of annual return, annual relative return and Sharpe ratio from paired circular blocks.

    ``pairs``: keys, date, strategy, benchmark (one-period returns above -1).  The start of a
    block is a hash of (seed, replication, block number), so any run, in any engine, draws the same
    blocks.  What a block adds to each figure is computed once for each place where it may start; a
    replication is then a sum of such rows, and replications are spread over the tasks by
    a join.  Sums are taken of 18 decimal places, so they do not depend on their order.  A block longer than a series counts as long as the series; a return of -100 % or
    worse, or one that is not finite, raises when computed.
    """
    if block < 1 or replications < 1 or years <= 0 or not 0 < level < 1:
        raise ValueError("block, replications, years and level must be positive, level below 1")
    sound = lambda c: F.when(finite(c) & (F.col(c) > -1), F.col(c)).otherwise(F.raise_error(F.lit("a return cannot be compounded")).cast("double"))
    rows = pairs.select(*keys, "date", sound("strategy").alias("s"), sound("benchmark").alias("b"))
    series = Window.partitionBy(*keys)
    rows = rows.withColumn("i", F.row_number().over(series.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(series))
    places = {"s": F.col("s"), "q": F.col("s") * F.col("s"), "l": F.log1p("s"), "d": F.log1p("s") - F.log1p("b")}
    rows = rows.select(*keys, "i", "n", *[x.cast("decimal(28,18)").alias(c) for c, x in places.items()])
    long = F.least(F.lit(block).cast("long"), F.col("n"))
    again = rows.filter(F.col("i") < F.lit(block)).withColumn("i", F.col("i") + F.col("n"))
    ring = rows.withColumn("i", F.col("i").cast("long")).unionByName(again.withColumn("i", F.col("i").cast("long")))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sums = ring.select(*keys, "i", "n", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("decimal(38,18)").alias(c) for c in "sqld"])
    # Differences of running sums: a block from i of ``size`` places.
    count = F.ceil(F.col("n") / long)
    last = F.col("n") - (count - 1) * long
    ends = sums.unionByName(ring.groupBy(*keys).agg((F.max("i") + 1).alias("i"), F.max("n").alias("n"), *[F.sum(c).cast("decimal(38,18)").alias(c) for c in "sqld"]))
    starts = sums.filter(F.col("i") < F.col("n")).withColumn("count", count).withColumn("size", F.explode(F.array_distinct(F.array(long, last))))
    e = ends.select(*keys, F.col("i").alias("stop"), *[F.col(c).alias(f"{c}_") for c in "sqld"])
    pieces = starts.withColumn("stop", F.col("i") + F.col("size")).join(e, [*keys, "stop"]).select(*keys, "i", "size", *[(F.col(f"{c}_") - F.col(c)).cast("decimal(38,18)").alias(c) for c in "sqld"])
    whole = rows.groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in "sqld"]).withColumn("count", count)
    drawn = whole.select(*keys, "n", "count", long.alias("block"), last.alias("last"), F.explode(F.sequence(F.lit(0), F.lit(replications - 1))).alias("replication"))
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replication").cast("string"), F.col("j").cast("string")))
    drawn = drawn.withColumn("i", F.conv(F.substring(mark, 1, 12), 16, 10).cast("long") % F.col("n"))
    drawn = drawn.withColumn("size", F.when(F.col("j") == F.col("count") - 1, F.col("last")).otherwise(F.col("block")))
    got = drawn.join(pieces, [*keys, "i", "size"]).groupBy(*keys, "replication", "n").agg(*[F.sum(c).alias(c) for c in "sqld"])

    def figures(df: DataFrame, *own: str) -> DataFrame:
        n = F.col("n")
        df = df.withColumns({c: F.col(c).cast("double") for c in "sqld"})
        variance = F.try_divide(F.col("q") - F.col("s") * F.col("s") / n, n - 1)
        sharpe = F.when(variance > 1e-18, F.col("s") / n / F.sqrt(variance) * math.sqrt(DAYS))
        return df.select(*keys, *own, F.expm1(F.col("l") / years).alias("annual_return"), F.expm1(F.col("d") / years).alias("annual_relative_return"), sharpe.alias("sharpe"))

    names = ["annual_return", "annual_relative_return", "sharpe"]
    tail = (1 - level) / 2
    aggs: list[Column] = []
    for n in names:
        aggs += [F.percentile(n, F.lit(tail)).alias(f"{n}_low"), F.percentile(n, F.lit(1 - tail)).alias(f"{n}_high")]
    aggs.append(F.avg((F.col("annual_relative_return") <= 1e-15).cast("double")).alias("relative_non_positive_share"))
    return figures(whole).join(figures(got, "replication").groupBy(*keys).agg(*aggs), keys)


def path_summary(levels: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """start, end, total and annual return, volatility, Sharpe ratio, largest drawdown, monthly win rate of level paths."""
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    fall = levels.select(*keys, (F.try_divide(F.col(value), F.max(value).over(upto)) - 1.0).alias("d")).groupBy(*keys).agg(F.min("d").alias("maximum_drawdown"))
    r = returns(levels, keys, [value]).groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    ends = levels.groupBy(*keys).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min_by(value, "date").alias("start_nav"), F.max_by(value, "date").alias("end_nav"), F.count(F.lit(1)).alias("observations"))
    month = levels.groupBy(*keys, F.trunc("date", "month").alias("m")).agg(F.max_by(value, "date").alias("v"))
    won = month.withColumn("r", F.try_divide(F.col("v"), F.lag("v").over(Window.partitionBy(*keys).orderBy("m"))) - 1.0).groupBy(*keys).agg(F.avg((F.col("r") > 0).cast("int")).alias("monthly_win_rate"))
    out = ends.join(r, keys).join(fall, keys).join(won, keys)
    years = F.greatest(F.datediff("end_date", "start_date") / 365.25, F.lit(1 / 252))
    growth = F.try_divide("end_nav", "start_nav")
    return out.select(
        *keys, "start_date", "end_date", "observations", (growth - 1).alias("total_return"), (F.pow(growth, 1 / years) - 1).alias("annual_return"), (F.col("__s") * math.sqrt(252)).alias("annual_volatility"),
        F.coalesce(F.try_divide("__m", "__s") * math.sqrt(252), F.lit(0.0)).alias("sharpe_zero_rate"), "maximum_drawdown", "monthly_win_rate",
    )


def calendar_year_returns(levels: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    """keys, year, annual_return: last level of a year over that of the year before (1.0 before the first)."""
    ends = levels.groupBy(*keys, F.year("date").alias("year")).agg(F.max_by(value, "date").alias("v"))
    before = F.lag("v", 1, 1.0).over(Window.partitionBy(*keys).orderBy("year"))
    return ends.withColumn("annual_return", F.try_divide(F.col("v"), before) - 1.0).drop("v")
