"""Tables by period and object on top of the evaluation: executable labels, lags, slices, indices, audits, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, positive, require_none, require_unique
from ..functions.statistics import MINIMUM, automatic_lag, benjamini_hochberg, newey_west, published_lag, spearman, two_sided_p
from .combination import CANDIDATES
from .factors import FACTORS
from .performance import DAYS, relative_performance

Period = tuple[str, str, str]


def tagged(df: DataFrame, periods: list[Period]) -> DataFrame:
    """Rows with the name of each period (first day, last day) that holds their date."""
    grid = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in periods])
    return df.withColumn("__p", F.explode(grid)).filter("date BETWEEN __p.a AND __p.b").withColumn("period", F.col("__p.period")).drop("__p")


def executable_ic(rows: DataFrame, horizons: tuple[int, ...], minimum: dict[str, int] | None = None) -> DataFrame:
    """Rank IC against close-to-close and against executable returns, over the pairs that have both.

    ``rows``: object_type, object_name, date, symbol, value, forward_return_h and
    executable_return_h.  One row for each object and horizon; ``label_coverage`` is the share
    of rows with a close label that have an executable one too.
    """
    minimum = minimum or {"factor": MINIMUM, "composite": 3}
    keys = ["object_type", "object_name", "horizon"]
    pair = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}").alias("close"), F.col(f"executable_return_{h}").alias("open")) for h in horizons])
    long = rows.select("object_type", "object_name", "date", "symbol", "value", F.explode(pair).alias("p")).select("*", "p.*").drop("p")
    known = finite("close")
    coverage = long.groupBy(*keys).agg(F.try_divide(F.count_if(known & finite("open")), F.count_if(known)).alias("label_coverage"))
    common = long.filter(known & finite("open"))
    sides = F.array(F.struct(F.lit("close").alias("label"), F.col("close").alias("y")), F.struct(F.lit("open").alias("label"), F.col("open").alias("y")))
    common = common.select(*keys, "date", "value", F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    monthly = None
    for kind, least in minimum.items():
        part = spearman(common.filter(F.col("object_type") == kind), [*keys, "label", "date"], "value", "y", least)
        monthly = part if monthly is None else monthly.unionByName(part)
    test = newey_west(monthly, [*keys, "label"], "date", "rank_ic", published_lag(F.col("horizon")), with_p=False)
    pick = lambda side, c: F.max(F.when(F.col("label") == side, F.col(c)))
    test = test.withColumn("icir", F.when(F.col("std") > 0, F.try_divide("mean", "std") * math.sqrt(12.0)))
    wide = test.groupBy(*keys).agg(
        pick("open", "n").cast("long").alias("months"),
        *[pick(s, c).alias(f"{s}_{n}") for s in ("close", "open") for c, n in (("mean", "mean_ic"), ("icir", "icir"), ("t", "t"))],
    )
    change = F.col("open_mean_ic") - F.col("close_mean_ic")
    return coverage.join(wide, keys, "left").withColumn("mean_ic_change", change).withColumn("mean_ic_retained", F.try_divide("open_mean_ic", "close_mean_ic"))


def lag_table(series: DataFrame, periods: list[Period], horizon: int = 20, fdr: float = 0.05) -> DataFrame:
    """t values of monthly rank ICs at the published and the automatic lag, and false-discovery tests of the factors at both.

    ``series``: object_type, object_name, date, rank_ic.
    """
    keys = ["period", "object_type", "object_name"]
    rows = tagged(series, periods)
    lags = {"published_lag": published_lag(F.lit(horizon)), "automatic_lag": automatic_lag(F.col("n"))}
    out = None
    for name, lag in lags.items():
        test = newey_west(rows, keys, "date", "rank_ic", lag)
        factor = F.when(F.col("object_type") == "factor", F.col("p"))
        test = benjamini_hochberg(test.withColumn("__p", factor), "__p", ["object_name"], ["period", "object_type"], "q")
        part = test.select(*keys, *([F.col("n").cast("long").alias("months"), F.col("mean").alias("mean_ic")] if out is None else []), F.col("lag").alias(name), F.col("t").alias(f"t_{name}"), F.col("q").alias(f"q_{name}"), (F.col("q") <= fdr).alias(f"fdr_pass_{name}"))
        out = part if out is None else out.join(part, keys)
    return out


def with_boundary(levels: DataFrame, periods: list[Period]) -> DataFrame:
    """Rows of each period, led by the last row before it: a period's first return starts from there."""
    parts = None
    for name, a, b in periods:
        inside = F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
        before = levels.filter(F.col("date") < F.lit(a).cast("date")).agg(F.max("date").alias("__d"))
        rows = levels.crossJoin(F.broadcast(before)).filter(inside | F.coalesce(F.col("date") == F.col("__d"), F.lit(False))).drop("__d")  # one row
        rows = rows.withColumn("period", F.lit(name)).withColumn("years", F.datediff(F.lit(b).cast("date"), F.lit(a).cast("date")) / 365.25)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def relative_by_period(levels: DataFrame, periods: list[Period], keys: list[str], strategy: str = "strategy", benchmark: str = "benchmark") -> DataFrame:
    """:func:`relative_performance` of each period and key, over the years of the period."""
    rows = with_boundary(levels, periods)
    out = None
    for name, a, b in periods:
        years = _years(a, b)
        part = relative_performance(rows.filter(F.col("period") == name), ["period", *keys], years, strategy, benchmark).withColumn("years", F.lit(years))
        out = part if out is None else out.unionByName(part)
    return out


def _years(start: str, end: str) -> float:
    import datetime as dt

    return (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days / 365.25


def slice_metrics(nav: DataFrame, trades: DataFrame, keys: list[str], *, boundary: str, start: str, end: str) -> DataFrame:
    """Return, cost erosion, volatility, drawdown and turnover of NAV paths from a boundary date to ``end``.

    ``nav``: keys, date, nav, zero_cost_nav; ``trades``: keys, date, amount.  A path without a
    row on the boundary, with fewer than three rows from there on, or with rows after ``end``
    raises ValueError.
    """
    day = lambda x: F.lit(x).cast("date")
    require_none(nav, F.col("date") > day(end), "a NAV path crosses the end")
    path = nav.filter(F.col("date") >= day(boundary))
    bounds = nav.select(*keys).distinct().join(path.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first")), keys, "left")
    require_none(bounds, F.coalesce((F.col("n") < 3) | (F.col("first") != day(boundary)), F.lit(True)), "a NAV path has no row on the boundary")
    w = Window.partitionBy(*keys).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = path.withColumn("__r", F.try_divide("nav", F.lag("nav").over(w)) - 1.0).withColumn("__d", F.try_divide("nav", F.max("nav").over(upto)) - 1.0)
    stats = rows.groupBy(*keys).agg(
        F.max("date").alias("end_date"), F.try_divide(F.max_by("nav", "date"), F.min_by("nav", "date")).alias("__g"), F.try_divide(F.max_by("zero_cost_nav", "date"), F.min_by("zero_cost_nav", "date")).alias("__z"),
        F.stddev_samp("__r").alias("__s"), F.min("__d").alias("maximum_drawdown"), F.avg("nav").alias("__m"),
    )
    traded = trades.filter(F.col("date") > day(boundary)).groupBy(*keys).agg(F.sum("amount").alias("__t"))
    years = _years(start, end)
    annual = lambda c: F.pow(F.col(c), F.lit(1.0 / years)) - 1.0
    out = stats.join(traded, keys, "left").withColumn("annual_return", annual("__g")).withColumn("zero_cost_annual_return", annual("__z"))
    return out.select(
        *keys, day(boundary).alias("start_date"), "end_date", F.lit(years).alias("years"), "annual_return", "zero_cost_annual_return", (F.col("zero_cost_annual_return") - F.col("annual_return")).alias("cost_erosion"),
        (F.col("__s") * math.sqrt(DAYS)).alias("annual_volatility"), "maximum_drawdown", F.try_divide(F.coalesce("__t", F.lit(0.0)), F.col("__m") * (2.0 * years)).alias("turnover"),
    )


def validation_metrics(nav: DataFrame, targets: DataFrame, executions: DataFrame, reconciliation: DataFrame, *, start: str, end: str) -> DataFrame:
    """One row a candidate: returns from the last NAV before ``start``, drawdown, turnover, cash, deviation and reconciliation.

    ``nav``: candidate, date, nav, zero_cost_nav, cash; ``targets``: candidate, date,
    one_way_turnover; ``executions``: candidate, date, target_deviation_l1;
    ``reconciliation``: candidate, date, difference.  A candidate without a row on either side
    of ``start`` raises ValueError.
    """
    day = lambda x: F.lit(x).cast("date")
    inside = F.col("date").between(day(start), day(end))
    last = nav.filter(F.col("date") < day(start)).groupBy("candidate").agg(F.max("date").alias("__b"))
    sides = nav.groupBy("candidate").agg(F.count_if(inside).alias("i"), F.count_if(F.col("date") < day(start)).alias("b"))
    require_none(sides, (F.col("i") == 0) | (F.col("b") == 0), "a validation path needs a row before its start")
    path = nav.join(last, "candidate").filter(inside | (F.col("date") == F.col("__b")))
    w = Window.partitionBy("candidate").orderBy("date")
    rows = path.withColumn("__r", F.try_divide("nav", F.lag("nav").over(w)) - 1.0)
    rows = rows.withColumn("__d", F.try_divide("nav", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1.0)
    years = _years(start, end)
    growth = lambda c: F.pow(F.try_divide(F.max_by(c, "date"), F.min_by(c, "date")), F.lit(1.0 / years)) - 1.0
    out = rows.groupBy("candidate").agg(
        growth("nav").alias("net_annual_return"), growth("zero_cost_nav").alias("__z"), (F.stddev_samp("__r") * math.sqrt(DAYS)).alias("annual_volatility"), F.min("__d").alias("maximum_drawdown"),
        F.avg(F.when(inside, F.try_divide("cash", "nav"))).alias("average_cash_weight"),
    )
    means = ((targets, F.avg("one_way_turnover"), "turnover"), (executions, F.avg("target_deviation_l1"), "average_target_deviation"), (reconciliation, F.max(F.abs("difference")), "maximum_reconciliation_difference"))
    for df, value, name in means:
        out = out.join(df.filter(inside).groupBy("candidate").agg(value.alias(name)), "candidate", "left")
    return out.withColumn("cost_erosion", F.col("__z") - F.col("net_annual_return")).drop("__z")


def judged(metrics: DataFrame, baseline: str, tolerances: dict[str, float], name: str = "experiment_id") -> DataFrame:
    """experiment, metric, value, delta, verdict against the baseline's row: sensitive where a drawdown deepens or another metric moves beyond its tolerance."""
    long = metrics.unpivot([name], list(tolerances), "metric", "value")
    base = long.filter(F.col(name) == baseline).select("metric", F.col("value").alias("__b"))
    require_unique(base, ["metric"], "baseline")
    limit = F.create_map(*[x for m, t in tolerances.items() for x in (F.lit(m), F.lit(float(t)))])[F.col("metric")]
    rows = long.filter(F.col(name) != baseline).join(F.broadcast(base), "metric").withColumn("delta", F.col("value") - F.col("__b"))  # one row a metric
    stable = F.when(F.col("metric") == "maximum_drawdown", F.col("delta") >= -limit).otherwise(F.abs("delta") <= limit)
    return rows.select(name, "metric", "value", "delta", F.when(stable, "stable").otherwise("sensitive").alias("verdict"))


def index_violations(index: DataFrame, calendar: DataFrame, *, start: str, end: str, tolerance: float = 1e-6) -> DataFrame:
    """index, rule, violations of published index rows (index, date, close, preclose) against the calendar's dates.

    Rules: outside_range, duplicate_date, invalid_level, broken_chain (the previous close is
    not that of the row before), missing_date and unknown_date.
    """
    w = Window.partitionBy("index").orderBy("date")
    day = lambda x: F.lit(x).cast("date")
    rows = index.withColumn("__last", F.lag("close").over(w)).withColumn("__same", F.lag("date").over(w) == F.col("date"))
    tests = {
        "outside_range": ~F.col("date").between(day(start), day(end)),
        "duplicate_date": F.col("__same"),
        "invalid_level": ~(positive("close") & positive("preclose")),
        "broken_chain": F.abs(F.col("preclose") - F.col("__last")) > tolerance,
    }
    counts = rows.groupBy("index").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()], F.min("date").alias("a"), F.max("date").alias("b"))
    days = calendar.select("date").distinct()
    want = days.join(F.broadcast(counts.select("index", "a", "b")), F.col("date").between(F.col("a"), F.col("b"))).select("index", "date", F.lit(1).alias("w"))  # a calendar by a handful of indices
    have = index.select("index", "date").distinct().withColumn("h", F.lit(1))
    gaps = want.join(have, ["index", "date"], "full_outer").groupBy("index").agg(F.count_if(F.col("h").isNull()).alias("missing_date"), F.count_if(F.col("w").isNull()).alias("unknown_date"))
    wide = counts.drop("a", "b").join(gaps, "index")
    return wide.unpivot(["index"], [*tests, "missing_date", "unknown_date"], "rule", "violations")


def index_levels(index: DataFrame, calendar: DataFrame, names: list[str]) -> DataFrame:
    """date and one column an index, led by the last calendar date before the first row with its previous close.

    An index whose dates are not those of the calendar from its first row to the end of all
    rows raises ValueError.
    """
    days = calendar.select("date").distinct()
    w = Window.partitionBy("index").orderBy("date")
    first = index.withColumn("__i", F.row_number().over(w)).filter("__i = 1").select("index", F.col("date").alias("__first"), "preclose")
    before = days.join(F.broadcast(first), F.col("date") < F.col("__first")).groupBy("index").agg(F.max("date").alias("date"))
    lead = before.join(first, "index").select("index", "date", F.col("preclose").alias("level"))
    rows = index.select("index", "date", F.col("close").alias("level")).unionByName(lead)
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    want = days.join(F.broadcast(span), F.col("date").between(F.col("a"), F.col("b"))).select("date")
    wide = want.join(rows.groupBy("date").pivot("index", names).agg(F.first("level")), "date", "full_outer")
    odd = F.lit(False)
    for n in names:
        odd = odd | F.col(f"`{n}`").isNull()
    require_none(wide, odd, "index dates differ from the calendar")
    return wide


def combination_audit(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """date, method, scored_securities, minimum_family_count, fallback_factor_count, minimum_history_months."""
    size = scores.groupBy("date", "method").agg(F.count(F.lit(1)).alias("scored_securities"), F.min("family_count").alias("minimum_family_count"))
    used = weights.groupBy("date").agg(F.count_if("fallback_equal").alias("fallback_factor_count"), F.min("history_months").alias("minimum_history_months"))
    return size.join(F.broadcast(used), "date", "left")  # one row a date


def panel_coverage(scored: DataFrame) -> DataFrame:
    """factor_name, family, point_in_time_status, rows, finite_scores, missing_scores, coverage of the size-neutral score."""
    out = scored.groupBy("factor_name", "family", "point_in_time_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(finite("score_size_neutral")).alias("finite_scores"), F.count_if(F.col("score_size_neutral").isNull()).alias("missing_scores")
    )
    return out.withColumn("coverage", F.col("finite_scores") / F.col("rows"))


def correlation_reasons(monthly: DataFrame) -> DataFrame:
    """factor_a, factor_b, common_months, reason: why no month of a pair has a correlation, with counts; null where one has.

    ``monthly``: factor_a, factor_b, date, rank_ic, reason.
    """
    counts = monthly.groupBy("factor_a", "factor_b", "reason").agg(F.count(F.lit(1)).alias("n"), F.count("rank_ic").alias("k"))
    text = F.when(F.col("reason").isNotNull(), F.concat(F.col("reason"), F.when(F.col("n") > 1, F.concat(F.lit("="), F.col("n").cast("string"))).otherwise("")))
    out = counts.groupBy("factor_a", "factor_b").agg(F.sum("k").alias("common_months"), F.array_join(F.array_sort(F.collect_list(text)), ",").alias("__r"))
    return out.select("factor_a", "factor_b", "common_months", F.when(F.col("common_months") == 0, F.concat(F.lit("no_valid_common_months:"), F.col("__r"))).alias("reason"))


def composite_subperiods(ic: DataFrame, periods: list[Period]) -> DataFrame:
    """subperiod, method, horizon, mean_ic, valid_months."""
    return tagged(ic, periods).groupBy(F.col("period").alias("subperiod"), "method", "horizon").agg(F.avg("rank_ic").alias("mean_ic"), F.count("rank_ic").alias("valid_months"))


def cost_components(trades: DataFrame, keys: list[str], components: list[str], total: str = "total_cost") -> DataFrame:
    """keys, component, bps (of the traded amount), share (of all costs); raises if components do not add up to the total."""
    sums = trades.groupBy(*keys).agg(F.sum("amount").alias("__amount"), F.sum(total).alias("__total"), *[F.sum(c).alias(c) for c in components])
    parts = sum((F.col(c) for c in components), F.lit(0.0))
    require_none(sums, F.abs(parts - F.col("__total")) > 1e-9 * F.abs("__total") + 1e-9, "cost components do not add up to the total")
    long = sums.unpivot([*keys, "__amount", "__total"], components, "component", "cost")
    return long.select(*keys, "component", F.try_divide(F.col("cost") * 1e4, F.col("__amount")).alias("bps"), F.try_divide("cost", "__total").alias("share"))


def correlation_matrix(pairs: DataFrame, order: list[str]) -> DataFrame:
    """row, column, factor_a, factor_b, mean_correlation of the square matrix in the given order; a missing pair raises when computed."""
    place = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    names = pairs.sparkSession.createDataFrame([(a, b) for a in order for b in order], "factor_a string, factor_b string")
    both = pairs.select("factor_a", "factor_b", "mean_correlation").unionByName(pairs.select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), "mean_correlation"))
    value = both.groupBy("factor_a", "factor_b").agg(F.first("mean_correlation", ignorenulls=True).alias("mean_correlation"))
    missing = F.raise_error(F.concat(F.lit("no correlation of "), F.col("factor_a"), F.lit(" and "), F.col("factor_b"))).cast("double")
    rows = names.join(value, ["factor_a", "factor_b"], "left")
    return rows.select(place[F.col("factor_a")].alias("row"), place[F.col("factor_b")].alias("column"), "factor_a", "factor_b", F.coalesce("mean_correlation", missing).alias("mean_correlation"))


def continuous_targets(research: DataFrame, validation: DataFrame, *, start: str, end: str) -> DataFrame:
    """date, symbol, target_weight of a research deployment followed by a validation candidate.

    Raises ValueError if either is empty, research reaches ``start``, validation leaves
    [start, end], or a key repeats.
    """
    day = lambda x: F.lit(x).cast("date")
    if not research.head(1) or not validation.head(1):
        raise ValueError("continuous targets need rows of both periods")
    require_none(research, F.col("date") >= day(start), "research targets cross into validation")
    require_none(validation, ~F.col("date").between(day(start), day(end)), "validation targets leave their period")
    columns = ["date", "symbol", "target_weight"]
    return require_unique(research.select(*columns).unionByName(validation.select(*columns)), ["date", "symbol"], "continuous targets")


def _rules(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in tests])).alias("x")).select("x.*")


def panel_input_violations(panel: DataFrame, *, start: str, end: str) -> DataFrame:
    """rule, violations of a scored panel before it is evaluated: keys, period, registered factors and families, one status a factor."""
    family = F.create_map(*[x for f in FACTORS for x in (F.lit(f.name), F.lit(f.family))])[F.col("factor_name")]
    rows = _rules(
        panel,
        {
            "null_key": F.col("date").isNull() | F.col("symbol").isNull() | F.col("factor_name").isNull(),
            "blank_key": (F.trim("symbol") == "") | (F.trim("factor_name") == ""),
            "outside_period": ~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")),
            "unknown_factor": F.col("factor_name").isNotNull() & family.isNull(),
            "other_family": ~F.col("family").eqNullSafe(family) & family.isNotNull(),
        },
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    twice = panel.groupBy("date", "symbol", "factor_name").count().filter("count > 1")
    months = panel.select("factor_name", "date").distinct().groupBy("factor_name", F.trunc("date", "month")).count().filter("count > 1")
    out = rows.unionByName(count(twice, "duplicate_key")).unionByName(count(months, "several_signal_dates"))
    if "point_in_time_status" in panel.columns:
        odd = panel.groupBy("factor_name").agg(F.countDistinct("point_in_time_status").alias("n")).filter("n > 1")
        out = out.unionByName(count(odd, "several_statuses"))
    return out


def redundancy_input_violations(panel: DataFrame, *, start: str, end: str) -> DataFrame:
    """:func:`panel_input_violations` before factors are compared; a panel with labels raises ValueError."""
    labels = [c for c in panel.columns if c.startswith("forward_")]
    if labels:
        raise ValueError("factor comparison must not see labels: " + ", ".join(labels))
    return panel_input_violations(panel, start=start, end=end)


def metric_table_violations(summary: DataFrame, correlations: DataFrame, flags: DataFrame, horizons: tuple[int, ...], threshold: float) -> DataFrame:
    """rule, violations of the published metric tables: complete grids, a symmetric matrix, flags that follow from it."""
    spark = summary.sparkSession
    grid = [(f.name, v, h) for f in FACTORS for v in (("score", "score_size_neutral") if f.size_neutral else ("score",)) for h in horizons]
    keys = ["factor_name", "score_variant", "horizon"]
    want = spark.createDataFrame(grid, "factor_name string, score_variant string, horizon int")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    other = correlations.select(F.col("factor_a").alias("factor_b"), F.col("factor_b").alias("factor_a"), F.col("mean_correlation").alias("m"), F.col("common_months").alias("c"))
    both = correlations.join(other, ["factor_a", "factor_b"], "left")
    skew = both.filter(F.col("c").isNull() | ~F.col("m").eqNullSafe(F.col("mean_correlation")) | (F.col("c") != F.col("common_months")))
    place = F.create_map(*[x for i, f in enumerate(FACTORS) for x in (F.lit(f.name), F.lit(i))])
    due = correlations.filter((place[F.col("factor_a")] < place[F.col("factor_b")]) & (F.abs("mean_correlation") >= threshold)).select("factor_a", "factor_b", F.lit(1).alias("d"))
    odd = due.join(flags.select("factor_a", "factor_b", F.lit(1).alias("f")), ["factor_a", "factor_b"], "full_outer").filter("d IS NULL OR f IS NULL")
    return (
        count(want.join(summary.select(*keys), keys, "left_anti"), "missing_metric")
        .unionByName(count(summary.select(*keys).join(want, keys, "left_anti"), "unknown_metric"))
        .unionByName(count(summary.groupBy(*keys).count().filter("count > 1"), "duplicate_metric"))
        .unionByName(count(skew, "asymmetric_pair"))
        .unionByName(count(odd, "flag_mismatch"))
    )


def require_registry(classification: DataFrame) -> DataFrame:
    """``classification`` itself; raises ValueError unless its candidates are the registered ones, with their families and size-neutral scores."""
    require_unique(classification, ["factor_name"], "classification")
    want = classification.sparkSession.createDataFrame([(n, f) for f, ns in CANDIDATES.items() for n in ns], "factor_name string, want string")
    rows = classification.filter("classification = 'candidate'").join(want, "factor_name", "full_outer")
    odd = F.col("want").isNull() | ~F.col("family").eqNullSafe(F.col("want")) | ~F.col("primary_score_variant").eqNullSafe(F.lit("score_size_neutral"))
    require_none(rows, odd, "candidates are not the registered ones")
    return classification


def require_targets(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """``targets`` (signal_date, execution_date, symbol, target_weight) itself; raises ValueError where prices cannot execute them."""
    require_unique(prices, ["date", "symbol"], "prices")
    require_unique(targets, ["execution_date", "symbol"], "targets")
    require_none(targets, F.coalesce(F.col("execution_date") <= F.col("signal_date"), F.lit(True)), "execution must come after the signal")
    days = prices.select(F.col("date").alias("execution_date")).distinct()
    require_none(targets.join(days, "execution_date", "left_anti"), F.lit(True), "an execution date is missing from prices")
    each = targets.groupBy("execution_date").agg(F.countDistinct("signal_date").alias("signals"), F.sum("target_weight").alias("w"), F.count_if(~(finite("target_weight") & (F.col("target_weight") >= 0))).alias("odd"))
    require_none(each, F.col("signals") != 1, "an execution date has several signals")
    require_none(each, (F.col("odd") > 0) | (F.abs(F.col("w") - 1) > 1e-9), "weights must be finite, not negative, and sum to one")
    return targets


def ic_p_values(table: DataFrame, t: str = "t") -> DataFrame:
    """Adds the two-sided normal p-value of a column of t values."""
    return table.withColumn("p", two_sided_p(t))


def ic_summary(ic: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, months, mean_ic, ic_std, icir (a year), positive_ic_rate of monthly rank correlations; null months are left out."""
    valid = F.when(finite("rank_ic"), F.col("rank_ic"))
    out = ic.groupBy(*(keys or [])).agg(
        F.count(valid).alias("months"), F.avg(valid).alias("mean_ic"), F.stddev_samp(valid).alias("ic_std"), F.avg((valid > 0).cast("int")).alias("positive_ic_rate")
    )
    return out.withColumn("icir", F.when(F.col("ic_std") > 0, F.try_divide("mean_ic", "ic_std") * math.sqrt(12.0)))


def attach_composite_metrics(metrics: DataFrame, summary: DataFrame, methods: dict[str, str], horizon: int = 20) -> DataFrame:
    """Adds rank_ic, icir and monotonicity of the composite behind each candidate (``methods``: candidate to method)."""
    rows = summary.filter(F.col("horizon") == horizon)
    require_unique(rows, ["method"], "composite summary")
    own = rows.select(F.col("method").alias("__m"), F.col("mean_ic").alias("rank_ic"), "icir", "monotonicity")
    method = F.create_map(*[x for c, m in methods.items() for x in (F.lit(c), F.lit(m))])[F.col("candidate")]
    return metrics.withColumn("__m", method).join(F.broadcast(own), "__m", "left").drop("__m")  # one row a method


def target_violations(targets: DataFrame, keys: list[str], *, names: int, before: str | None = None, tolerance: float = 1e-10) -> DataFrame:
    """rule, violations: dates with another number of names or weights that do not sum to one; rows with bad weights or dates from ``before`` on."""
    by_date = targets.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"), F.sum("target_weight").alias("w"))
    rows = {"bad_weight": ~(finite("target_weight") & (F.col("target_weight") >= 0))}
    if before:
        rows["late_date"] = F.col("date") >= F.lit(before).cast("date")
    return _rules(by_date, {"other_count": F.col("n") != names, "other_sum": F.abs(F.col("w") - 1) > tolerance}).unionByName(_rules(targets, rows))


def sealed_dates(tables: dict[str, DataFrame], sealed: str) -> DataFrame:
    """table, column, latest, is_sealed: the last value of each date column named ``date`` or ``*_date``, and whether it stays before ``sealed``."""
    out = None
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if f.dataType.typeName() == "date" and (f.name == "date" or f.name.endswith("_date"))]
        if not columns:
            continue
        found = df.agg(*[F.max(c).alias(c) for c in columns]).unpivot([], columns, "column", "latest").select(F.lit(name).alias("table"), "column", "latest")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no table has a date column")
    return out.withColumn("is_sealed", F.coalesce(F.col("latest") < F.lit(sealed).cast("date"), F.lit(True)))


def source_coverage(expected: DataFrame, cached: DataFrame, payments: DataFrame) -> DataFrame:
    """status, expected_symbols, cached_symbols, missing_symbols, payment_dates_missing of an action cache.

    ``expected``, ``cached``: symbol; ``payments``: symbol, cash_per_share, payment_date.  The
    status is ``blocked`` if a symbol is not cached or a cash payment has no date.
    """
    want, have = expected.select("symbol").distinct(), cached.select("symbol").distinct().withColumn("__have", F.lit(1))
    symbols = want.withColumn("__want", F.lit(1)).join(have, "symbol", "full_outer").agg(
        F.count("__want").alias("expected_symbols"), F.count("__have").alias("cached_symbols"), F.count_if(F.col("__have").isNull()).alias("missing_symbols")
    )
    unpaid = payments.agg(F.count_if((F.col("cash_per_share") > 0) & F.col("payment_date").isNull()).alias("payment_dates_missing"))
    rows = symbols.crossJoin(unpaid)  # one row each
    blocked = (F.col("missing_symbols") > 0) | (F.col("payment_dates_missing") > 0)
    return rows.withColumn("status", F.when(blocked, "blocked").otherwise("ready"))


VARIANT = ("portfolio_size", "buffer_rank", "universe_size", "rebalance_months")


def variant_parameters(baseline: dict[str, int], variants: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    """All parameters of each portfolio variant; a variant that does not change just one of the baseline's raises ValueError."""
    if set(baseline) != set(VARIANT):
        raise ValueError("the baseline needs " + ", ".join(VARIANT))
    full = {}
    for name, own in variants.items():
        full[name] = baseline | own
        if set(own) - set(VARIANT) or sum(full[name][k] != baseline[k] for k in VARIANT) != 1:
            raise ValueError(f"a variant must change one assumption: {name}")
    return {"baseline": dict(baseline)} | full


def variant_targets(scores: DataFrame, sizes: DataFrame, liquidity: DataFrame, parameters: dict[str, dict[str, int]], groups: int = 5, strict: bool = True) -> DataFrame:
    """variant and the size-stratified buffered targets of each: liquid universe, schedule, groups, buffer."""
    from .portfolio import buffered_portfolio, liquid_universe, rebalance_schedule, size_groups

    ranked = None
    for name, p in parameters.items():
        if p["portfolio_size"] % groups:
            raise ValueError("the portfolio size must be a multiple of the size groups")
        rows = rebalance_schedule(liquid_universe(scores, liquidity, p["universe_size"], strict), p["rebalance_months"])
        kept = buffered_portfolio(
            size_groups(rows, sizes, groups).withColumn("variant", F.lit(name)), per_group=p["portfolio_size"] // groups, buffer_rank=p["buffer_rank"], name="size_stratified_buffered", scenario="variant"
        )
        ranked = kept if ranked is None else ranked.unionByName(kept)
    return ranked
