"""Corporate actions, holdings audits, robustness verdicts and candidate selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, padded_symbol, positive, require_none, require_unique

ACTION = ["symbol", "ex_date", "effective_date", "cash_per_share", "share_ratio", "source"]


def normalize_actions(actions: DataFrame, start: str, end: str) -> DataFrame:
    """Typed actions with a stable id; rows outside the dates, without effect or with negative amounts are refused by :func:`invalid_actions`."""
    ex = F.coalesce(F.col("ex_date"), F.col("effective_date")) if "ex_date" in actions.columns else F.col("effective_date")
    df = actions.select(
        ex.cast("date").alias("ex_date"), F.col("effective_date").cast("date").alias("effective_date"), padded_symbol("symbol").alias("symbol"),
        F.coalesce(F.col("cash_per_share").cast("double"), F.lit(0.0)).alias("cash_per_share"), F.coalesce(F.col("share_ratio").cast("double"), F.lit(0.0)).alias("share_ratio"), F.col("source").cast("string").alias("source"),
    )
    inside = F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("ex_date", "effective_date", "symbol", "cash_per_share", "share_ratio", "source")])
    return df.filter(inside).withColumn("action_id", F.substring(F.sha2(text, 256), 1, 24))


def invalid_actions(actions: DataFrame) -> DataFrame:
    bad = F.col("symbol").isNull() | ~finite("cash_per_share") | ~finite("share_ratio") | (F.col("cash_per_share") < 0) | (F.col("share_ratio") < 0) | ((F.col("cash_per_share") == 0) & (F.col("share_ratio") == 0))
    return actions.filter(F.coalesce(bad, F.lit(True)))


def merge_actions(primary: DataFrame, *more: DataFrame) -> DataFrame:
    """Actions of all sources; a later source only adds (symbol, effective_date) pairs that no earlier one has."""
    out = primary.select(*ACTION)
    for extra in more:
        out = out.unionByName(extra.select(*ACTION).join(out.select("symbol", "effective_date").distinct(), ["symbol", "effective_date"], "left_anti"))
    return out


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (a deterministic keep-first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")


def overridden(df: DataFrame, overrides: DataFrame, keys: list[str], column: str, *, replace: bool = True) -> DataFrame:
    """``column`` replaced where ``overrides`` has a value for the key.

    Raises ValueError if a key of ``overrides`` repeats or matches no row, or, unless values may
    be replaced, if it differs from a value that is there.
    """
    require_unique(overrides, keys, "overrides")
    require_none(unmatched(overrides, df, keys), F.lit(True), "an override matches no row")
    new = overrides.select(*keys, F.col(column).alias("__new"))
    if not replace:
        require_none(df.join(new, keys), F.col(column) != F.col("__new"), f"an override conflicts with {column}")
    return df.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def unmatched(overrides: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    return overrides.join(df.select(*keys).distinct(), keys, "left_anti")


def apply_actions(positions: DataFrame, actions: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """symbol, shares, cash after the actions of one effective date; shares round half to even.

    ``positions``: symbol, shares (long); ``actions``: action_id, symbol, cash_per_share,
    share_ratio.  An id that repeats or is among ``applied`` (action_id) raises ValueError.
    Several actions of a symbol pay on the shares held before and multiply one another.
    """
    require_unique(actions, ["action_id"], "actions")
    if applied is not None:
        require_none(actions.join(applied.select("action_id"), "action_id", "left_semi"), F.lit(True), "a corporate action is already applied")
    each = actions.groupBy("symbol").agg(F.sum("cash_per_share").alias("__cash"), F.product(1.0 + F.col("share_ratio")).alias("__ratio"))
    rows = positions.join(each, "symbol", "left")
    shares = F.bround(F.col("shares") * F.coalesce("__ratio", F.lit(1.0))).cast("long")
    return rows.select("symbol", shares.alias("shares"), (F.col("shares") * F.coalesce("__cash", F.lit(0.0))).alias("cash"))


def first_on_or_after(events: DataFrame, observed: DataFrame, date: str) -> DataFrame:
    """Adds ``date`` of the symbol's first observed row on or after the event's date: a forward as-of join in one sorted pass."""
    seen = observed.select("symbol", F.col("date").alias("__d"), F.lit(1).alias("__kind"), F.col("date").alias("__seen")).distinct()
    tagged = events.select("symbol", F.col(date).alias("__d")).distinct().withColumn("__kind", F.lit(0)).withColumn("__seen", F.lit(None).cast("date"))
    after = Window.partitionBy("symbol").orderBy("__d", "__kind").rowsBetween(0, Window.unboundedFollowing)
    known = seen.unionByName(tagged).withColumn("date", F.first("__seen", ignorenulls=True).over(after)).filter("__kind = 0").select("symbol", F.col("__d").alias(date), "date")
    return events.join(known, ["symbol", date]).filter("date IS NOT NULL")


def shadow_audit(panel: DataFrame, actions: DataFrame, positions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Raw economic against adjusted return of what was held the date before, by date."""
    past = Window.partitionBy("symbol").orderBy("date")
    effect = first_on_or_after(actions, panel, "ex_date").groupBy("date", "symbol").agg(F.sum("cash_per_share").alias("cash"), F.product(F.col("share_ratio") + 1.0).alias("shares"))
    r = panel.select("date", "symbol", "close_raw", "close_adj", F.lag("close_raw").over(past).alias("lr"), F.lag("close_adj").over(past).alias("la")).join(effect, ["date", "symbol"], "left")
    raw = F.try_divide(F.col("close_raw") * F.coalesce("shares", F.lit(1.0)) + F.coalesce("cash", F.lit(0.0)), F.col("lr"))
    r = r.select("date", "symbol", (F.try_divide("close_adj", "la") - raw).alias("difference")).filter(finite("difference"))
    held = positions.join(F.broadcast(calendar), "date").select(F.col("next_date").alias("date"), "symbol", "market_value")
    d, v = F.col("difference"), F.col("market_value")
    return r.join(held, ["date", "symbol"]).groupBy("date").agg(
        F.try_divide(F.sum(d * v), F.sum(v)).alias("portfolio_return_difference"), F.try_divide(F.sum(F.abs(d) * v), F.sum(v)).alias("portfolio_absolute_difference"),
        F.sum(v).alias("holdings_value"), F.count(F.lit(1)).alias("held_observations"),
    )


def stale_intervals(positions: DataFrame, panel: DataFrame, events: DataFrame, evidence: DataFrame, review_days: int) -> DataFrame:
    """Symbols held at prices older than ``review_days``, with what explains each."""
    old = positions.filter(F.col("is_stale") & (F.col("stale_days") > review_days))
    rows = old.groupBy("symbol").agg(
        F.min("date").alias("first_stale_date"), F.max("date").alias("last_stale_date"), F.max("stale_days").alias("maximum_stale_days"), F.max("asset_weight").alias("maximum_asset_weight")
    )
    last = panel.filter(positive("open_raw")).groupBy("symbol").agg(F.max("date").alias("__last"))
    mark = lambda df, c, n: df.select(F.col(c).alias("symbol")).distinct().withColumn(n, F.lit(True))
    rows = rows.join(last, "symbol", "left").join(mark(events, "source_symbol", "__event"), "symbol", "left").join(mark(evidence, "symbol", "__proof"), "symbol", "left")
    label = F.when(F.col("__last") > F.col("last_stale_date"), "explained_resumption").when(F.col("__event"), "explained_security_event").when(F.col("__proof"), "explained_public_evidence").otherwise("unexplained")
    return rows.withColumn("classification", label).drop("__last", "__event", "__proof")


def marked_positions(targets: DataFrame, panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily positions of target weights held until the next target, the last one to the end of the calendar: price as of the date, its age in days, and weight.

    date, portfolio_name, symbol, close_price, market_value (per unit of capital), is_stale, stale_days, asset_weight.
    """
    days = calendar.select("date").distinct()
    # The number of calendar dates before each date that occurs, so that a span of dates is a sequence of numbers.
    every = days.withColumn("__day", F.lit(1)).unionByName(targets.select("date").distinct().withColumn("__day", F.lit(0))).groupBy("date").agg(F.max("__day").alias("__day"))
    every = every.withColumn("n", F.coalesce(F.sum("__day").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = every.filter("__day = 1").select("date", "n")
    dates = targets.select("portfolio_name", "date").distinct().join(F.broadcast(every.select("date", "n")), "date")
    dates = dates.crossJoin(F.broadcast(numbered.agg(F.count(F.lit(1)).alias("days"))))  # one row
    dates = dates.withColumn("until", F.coalesce(F.lead("n").over(Window.partitionBy("portfolio_name").orderBy("date")), F.col("days")))
    spans = targets.join(dates.filter("until > n"), ["portfolio_name", "date"])
    spans = spans.select("portfolio_name", "symbol", F.col("date").alias("since"), "target_weight", F.explode(F.sequence("n", F.col("until") - 1)).alias("n"))
    held = spans.join(F.broadcast(numbered), "n").drop("n")
    marks = panel.filter(positive("close_raw")).select("symbol", "date", F.struct(F.col("date").alias("d"), F.col("close_raw").alias("c")).alias("__m"), F.lit(0).alias("__kind"))
    asked = held.select("symbol", "date").distinct().withColumn("__m", F.lit(None).cast("struct<d:date,c:double>")).withColumn("__kind", F.lit(1))
    upto = Window.partitionBy("symbol").orderBy("date", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    known = marks.unionByName(asked).withColumn("m", F.last("__m", ignorenulls=True).over(upto)).filter("__kind = 1").select("symbol", "date", "m")
    at_start = known.select("symbol", F.col("date").alias("since"), F.col("m.c").alias("base"))
    rows = held.join(known, ["symbol", "date"]).join(at_start, ["symbol", "since"]).filter("m IS NOT NULL")
    value = F.col("target_weight") * F.col("m.c") / F.col("base")
    total = F.sum("market_value").over(Window.partitionBy("portfolio_name", "date"))
    rows = rows.withColumn("market_value", value).withColumn("stale_days", F.datediff("date", F.col("m.d")))
    return rows.select("portfolio_name", "date", "symbol", F.col("m.c").alias("close_price"), "market_value", (F.col("stale_days") > 0).alias("is_stale"), "stale_days", (F.col("market_value") / total).alias("asset_weight"))


def verdicts(results: DataFrame, registry: DataFrame, *, annual_return: float = 0.02, maximum_drawdown: float = 0.05, turnover: float = 0.5) -> DataFrame:
    """Every registered experiment and metric with its baseline, delta and verdict.

    ``registry``: experiment_id, category; ``results``: experiment_id, status, metric,
    value.  Experiments without a result appear as not run.
    """
    rows = registry.join(results, "experiment_id", "left").withColumn("status", F.coalesce("status", F.lit("not_run")))
    baseline = F.when(F.col("category") == "execution", "execution_full_cost").when(F.col("category").isin("portfolio", "factor_ablation", "rolling_window"), "portfolio_baseline")
    base = results.filter(F.col("experiment_id").isin("execution_full_cost", "portfolio_baseline") & F.col("value").isNotNull()).select(
        F.col("experiment_id").alias("baseline_experiment_id"), "metric", F.col("value").alias("baseline_value")
    )
    rows = rows.withColumn("baseline_experiment_id", baseline).join(base, ["baseline_experiment_id", "metric"], "left").withColumn("baseline_delta", F.col("value") - F.col("baseline_value"))
    d, m = F.col("baseline_delta"), F.col("metric")
    stable = F.when(m == "maximum_drawdown", d >= -maximum_drawdown).when(m == "annual_return", F.abs(d) <= annual_return).when(m == "turnover", F.abs(d) <= turnover)
    verdict = F.when(F.col("status") != "ready", "failed").when(stable, "stable").when(~stable, "sensitive").otherwise("reported")
    return rows.withColumn("interpretation", verdict)


def protocol_gate(table: DataFrame, fatal: tuple[str, ...] = ("fatal",)) -> DataFrame:
    """status: fatal_defect, incomplete or ready_to_seal, and the number of experiments not run."""
    counts = table.agg(F.count_if(F.col("status").isin(*fatal)).alias("fatal_rows"), F.countDistinct(F.when(F.col("status") == "not_run", F.col("experiment_id"))).alias("missing_experiments"))
    return counts.withColumn("status", F.when(F.col("fatal_rows") > 0, "fatal_defect").when(F.col("missing_experiments") > 0, "incomplete").otherwise("ready_to_seal"))


def select_candidate(metrics: DataFrame, default: str, *, improvement: float, deterioration: float, turnover_increase: float) -> DataFrame:
    """candidate, failed_rules, passed, selected: the best passing candidate by return, else the default."""
    base = metrics.filter(F.col("candidate") == default).select(F.col("net_annual_return").alias("r0"), F.col("maximum_drawdown").alias("d0"), F.col("turnover").alias("t0"))
    rows = metrics.crossJoin(F.broadcast(base))  # one row
    other = F.col("candidate") != default
    failed = F.concat_ws(
        ";",
        F.when(other & (F.col("net_annual_return") < F.col("r0") + improvement), F.lit("minimum_return_improvement")),
        F.when(other & (F.col("maximum_drawdown") < F.col("d0") - deterioration), F.lit("maximum_drawdown_deterioration")),
        F.when(other & (F.col("turnover") > F.col("t0") + turnover_increase), F.lit("maximum_turnover_increase")),
    )
    rows = rows.withColumn("failed_rules", failed).withColumn("passed", F.col("failed_rules") == "")
    eligible = F.when(F.col("passed") & other, F.struct("net_annual_return", "candidate"))
    best = F.max(eligible).over(Window.partitionBy())["candidate"]
    return rows.select("candidate", "net_annual_return", "maximum_drawdown", "turnover", "failed_rules", "passed", (F.col("candidate") == F.coalesce(best, F.lit(default))).alias("selected"))
