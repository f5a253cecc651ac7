"""Point-in-time universes, forward labels and month-end signals.

Windows run over a symbol's rows in date order; "valid" windows are partitioned by
validity too, so lagged and rolling values skip invalid rows without a self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import complete, finite, positive, safe_return, valid_raw_prices, valid_trade, when_finite


def past() -> WindowSpec:
    """A symbol's rows in date order."""
    return Window.partitionBy("symbol").orderBy("date")


def simple_universe(panel: DataFrame, *, minimum_history: int = 252, lookback: int = 20, size: int = 1000, dates: DataFrame | None = None) -> DataFrame:
    """Adds history_observations, amount_mean, liquidity_rank (over all symbols of a date) and is_eligible.

    Only rows on the dates of ``dates`` (a calendar), if given, are ranked and returned.
    """
    df = panel.withColumn("__amount", when_finite("amount")).withColumn("history_observations", F.count("date").over(past().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("amount_mean", complete(F.avg, "__amount", past(), lookback)).drop("__amount")
    if dates is not None:
        df = df.join(F.broadcast(dates), "date", "left_semi")
    ranked = Window.partitionBy("date").orderBy(F.col("amount_mean").desc_nulls_last(), "symbol")
    df = df.withColumn("liquidity_rank", F.when(F.col("amount_mean").isNotNull(), F.row_number().over(ranked)))
    ok = (
        (F.col("history_observations") >= minimum_history)
        & ~F.col("is_st")
        & valid_raw_prices()
        & positive("amount_mean")
        & (F.col("liquidity_rank") <= size)
    )
    return df.withColumn("is_eligible", F.coalesce(ok, F.lit(False)))


def research_universe(panel: DataFrame, *, minimum_history: int = 252, lookback: int = 20, size: int = 1000) -> DataFrame:
    """As :func:`simple_universe`, counting and averaging valid rows alone and ranking only symbols that pass the filters."""
    df = panel.withColumn("is_valid", valid_trade())
    df = df.withColumn("history_observations", F.sum(F.col("is_valid").cast("long")).over(past().rowsBetween(Window.unboundedPreceding, 0)))
    valid = Window.partitionBy("symbol", "is_valid").orderBy("date")
    df = df.withColumn("amount_mean", F.when(F.col("is_valid"), complete(F.avg, "amount", valid, lookback)))
    passes = F.coalesce(
        F.col("is_valid") & (F.col("history_observations") >= minimum_history) & ~F.col("is_st") & valid_raw_prices() & positive("amount_mean"),
        F.lit(False),
    )
    df = df.withColumn("__passes", passes)
    ranked = Window.partitionBy("date", "__passes").orderBy(F.col("amount_mean").desc_nulls_last(), "symbol")
    df = df.withColumn("liquidity_rank", F.when(F.col("__passes"), F.row_number().over(ranked)))
    return df.withColumn("is_eligible", F.coalesce(F.col("__passes") & (F.col("liquidity_rank") <= size), F.lit(False))).drop("__passes")


def forward_labels(panel: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Adds forward_return_h, forward_calendar_days_h and forward_skipped_observations_h over valid rows."""
    df = panel.withColumn("__valid", valid_trade()).withColumn("__i", F.row_number().over(past()))
    ahead = Window.partitionBy("symbol", "__valid").orderBy("date")
    for h in horizons:
        close, day, i = (F.lead(c, h).over(ahead) for c in ("close_adj", "date", "__i"))
        there = F.col("__valid") & close.isNotNull()
        r = F.try_divide(close, F.col("close_adj")) - 1.0
        df = (
            df.withColumn(f"forward_return_{h}", F.when(there & finite(r), r))
            .withColumn(f"forward_calendar_days_{h}", F.when(there, F.datediff(day, "date")))
            .withColumn(f"forward_skipped_observations_{h}", F.when(there, i - F.col("__i") - h))
        )
    return df.drop("__valid", "__i")


def momentum_returns(panel: DataFrame, *, lookback: int = 60, horizon: int = 20) -> DataFrame:
    """Adds momentum and forward_return over a symbol's rows."""
    df = panel.withColumn("__c", F.when(positive("close_adj"), F.col("close_adj")))
    df = df.withColumn("momentum", safe_return("__c", F.lag("__c", lookback).over(past())))
    return df.withColumn("forward_return", safe_return(F.lead("__c", horizon).over(past()), F.col("__c"))).drop("__c")


def momentum_signal(universe: DataFrame, *, lookback: int = 60, horizon: int = 20) -> DataFrame:
    """Adds momentum, forward_return and momentum_z, standardized over the eligible symbols of a date (ddof 1)."""
    return standardized_momentum(momentum_returns(universe, lookback=lookback, horizon=horizon))


def standardized_momentum(df: DataFrame) -> DataFrame:
    """Adds momentum_z to rows that have momentum and is_eligible; needs all eligible rows of a date."""
    day = Window.partitionBy("date")
    own = F.when(F.col("is_eligible"), F.col("momentum"))
    mean, std = F.avg(own).over(day), F.stddev_samp(own).over(day)
    z = F.try_divide(F.col("momentum") - mean, F.when(std > 0, std))
    return df.withColumn("momentum_z", F.when(F.col("is_eligible") & finite(z), z))


def month_ends(panel: DataFrame) -> DataFrame:
    """Rows on the last date of each month that occurs in the whole panel.

    The dates are found by an aggregation (one row a month), not by a window over all
    rows of a month.
    """
    return panel.join(F.broadcast(signal_dates(panel)), "date", "left_semi")


def signal_dates(panel: DataFrame) -> DataFrame:
    """date: the last of each month."""
    return panel.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")


def next_dates(panel: DataFrame) -> DataFrame:
    """date, next_date over the distinct dates of the panel (a calendar: one row a date)."""
    return panel.select("date").distinct().withColumn("next_date", F.lead("date").over(Window.orderBy("date")))


def executable_labels(panel: DataFrame, signals: DataFrame, horizons: tuple[int, ...], cutoff: str) -> DataFrame:
    """Open-to-open returns entered on the market's next date, left h valid observations later.

    Null where the symbol has no valid row on the entry date or the exit falls after
    ``cutoff``.
    """
    rows = panel.filter(valid_trade() & positive("open_adj"))
    for h in horizons:
        rows = rows.withColumn(f"__open_{h}", F.lead("open_adj", h).over(past())).withColumn(f"__date_{h}", F.lead("date", h).over(past()))
    entry = rows.select(F.col("symbol"), F.col("date").alias("next_date"), F.col("open_adj").alias("__entry"), *[f"__{x}_{h}" for h in horizons for x in ("open", "date")])
    out = signals.select("date", "symbol").join(F.broadcast(next_dates(panel)), "date", "left")
    entry = entry.join(F.broadcast(out.select("next_date").distinct()), "next_date", "left_semi")  # one row a signal date
    out = out.join(entry, ["symbol", "next_date"], "left")
    for h in horizons:
        r = F.try_divide(f"__open_{h}", "__entry") - 1.0
        out = out.withColumn(f"executable_return_{h}", F.when(F.col(f"__date_{h}") <= F.lit(cutoff).cast("date"), r))
    return out.select("date", "symbol", *[f"executable_return_{h}" for h in horizons])


def signal_liquidity(panel: DataFrame, lookback: int = 20) -> DataFrame:
    """date, symbol, amount_mean over complete windows of all rows, on signal dates."""
    df = panel.select("date", "symbol", complete(F.avg, "amount", past(), lookback).alias("amount_mean"))
    return df.join(F.broadcast(signal_dates(panel)), "date", "left_semi")


def execution_panel(panel: DataFrame, lookback: int = 20, calendar: DataFrame | None = None) -> DataFrame:
    """Adds adv (mean amount of the ``lookback`` market dates before), limit_rate and is_suspended.

    A symbol's market dates include those on which it has no row; they are counted by the
    date's number in the calendar (of the panel, if None) and a range window, instead of filling in the rows.
    """
    calendar = (panel if calendar is None else calendar).select("date").distinct().withColumn("__day", F.row_number().over(Window.orderBy("date")))
    df = panel.join(F.broadcast(calendar), "date")
    before = Window.partitionBy("symbol").orderBy("__day").rangeBetween(-lookback, -1)
    return df.select(
        *panel.columns,
        F.avg("amount").over(before).alias("adv"),
        F.when(F.col("is_st"), 0.05).otherwise(0.10).alias("limit_rate"),
        (~positive("open_raw")).alias("is_suspended"),
    )


def rolling_mean(series: DataFrame, keys: list[str], order: str, value: str, window: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn(name, complete(F.avg, value, w, window))


def drawdown(levels: DataFrame, keys: list[str], order: str, value: str, name: str = "drawdown") -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn(name, F.try_divide(F.col(value), F.max(value).over(upto)) - 1.0)


