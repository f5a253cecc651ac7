"""Single-factor evaluation: rank IC, quantiles, turnover, subperiods, summary, classification, redundancy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, correlation, equal_bucket, finite
from ..functions.statistics import MINIMUM, benjamini_hochberg, newey_west, published_lag, spearman
from .factors import FACTORS, primary_variant

VARIANTS = ("score", "score_size_neutral")
KEYS = ["factor_name", "family", "score_variant"]


def long_scores(scored: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (date, symbol, factor, variant); the size factor has its plain score alone."""
    neutral = [f.name for f in FACTORS if f.size_neutral]
    rows = scored.unpivot(["date", "symbol", "factor_name", "family", *labels], list(VARIANTS), "score_variant", "value")
    return rows.filter((F.col("score_variant") == "score") | F.col("factor_name").isin(neutral))


def rank_ic(scored: DataFrame, horizons: tuple[int, ...], minimum: int = MINIMUM) -> DataFrame:
    labels = tuple(f"forward_return_{h}" for h in horizons)
    rows = long_scores(scored, labels)
    rows = rows.unpivot(["date", "symbol", *KEYS, "value"], list(labels), "label", "forward")
    rows = rows.withColumn("horizon", F.regexp_extract("label", r"(\d+)$", 1).cast("int"))
    return spearman(rows, ["date", *KEYS, "horizon"], "value", "forward", minimum)


def quantile_returns(scored: DataFrame, horizon: int, buckets: int = 5, minimum: int = MINIMUM) -> DataFrame:
    """date, keys, quantile, n_obs, mean_return; ties go by symbol, months under ``minimum`` are left out."""
    label = f"forward_return_{horizon}"
    rows = long_scores(scored, (label,)).filter(finite("value") & finite(label))
    cross = Window.partitionBy("date", *KEYS)
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(cross)).filter(F.col("__n") >= minimum)
    rows = rows.withColumn("quantile", equal_bucket(F.row_number().over(cross.orderBy("value", "symbol")), F.col("__n"), buckets))
    return rows.groupBy("date", *KEYS, "quantile").agg(F.count(F.lit(1)).alias("n_obs"), F.avg(label).alias("mean_return"))


def quantile_spread(quantiles: DataFrame, keys: list[str] | None = None, buckets: int = 5) -> DataFrame:
    """keys, spread (mean monthly top minus bottom), monotonicity (rank correlation of quantile and its mean return)."""
    keys = KEYS if keys is None else keys
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_return")))
    spread = quantiles.groupBy("date", *keys).agg((at(buckets) - at(1)).alias("d")).groupBy(*keys).agg(F.avg("d").alias("spread"))
    means = quantiles.groupBy(*keys, "quantile").agg(F.avg("mean_return").alias("m"))
    ranked = means.withColumn("r", average_rank("m", keys))
    mono = ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == buckets, correlation(F.col("quantile").cast("double"), F.col("r"))).alias("monotonicity")
    )
    return spread.join(mono, keys)


def top_turnover(scored: DataFrame, share: float = 0.2) -> DataFrame:
    """Membership turnover of the top share between a factor's consecutive dates (equal weights, half the L1 distance)."""
    rows = long_scores(scored)
    dates = rows.groupBy(*KEYS, "date").agg(F.count_if(finite("value")).alias("n"))
    order = Window.partitionBy(*KEYS).orderBy("date")
    dates = dates.withColumn("top_count", F.ceil(F.lit(share) * F.col("n")).cast("long"))
    dates = dates.withColumn("previous_date", F.lag("date").over(order)).withColumn("previous_top_count", F.lag("top_count").over(order))
    cross = Window.partitionBy(*KEYS, "date").orderBy(F.desc("value"), "symbol")
    top = (
        rows.filter(finite("value"))
        .withColumn("__i", F.row_number().over(cross))
        .join(dates.select(*KEYS, "date", "top_count"), [*KEYS, "date"])
        .filter(F.col("__i") <= F.col("top_count"))
        .select(*KEYS, "date", "symbol")
    )
    stay = (
        top.join(dates.select(*KEYS, "date", "previous_date"), [*KEYS, "date"])
        .join(top.withColumnRenamed("date", "previous_date"), [*KEYS, "previous_date", "symbol"])
        .groupBy(*KEYS, "date")
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    n, m, k = F.col("top_count"), F.col("previous_top_count"), F.coalesce("kept", F.lit(0))
    now, old = F.coalesce(F.try_divide(F.lit(1.0), n), F.lit(0.0)), F.coalesce(F.try_divide(F.lit(1.0), m), F.lit(0.0))
    distance = (n - k) * now + (m - k) * old + k * F.abs(now - old)
    return dates.join(stay, [*KEYS, "date"], "left").select(
        "date", *KEYS, "previous_date", "top_count", "previous_top_count",
        F.when(F.col("previous_date").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * distance))).alias("turnover"),
    )


def subperiods(ic: DataFrame, horizon: int, periods: list[tuple[str, str, str]]) -> DataFrame:
    """valid_months and mean_ic of each series in each period; periods without a month are kept."""
    rows = ic.filter((F.col("horizon") == horizon)).select(*KEYS, "date", "rank_ic")
    grid = F.array(*[F.struct(F.lit(n).alias("subperiod"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end")) for n, a, b in periods])
    rows = rows.withColumn("p", F.explode(grid)).select("*", "p.*").drop("p")
    inside = F.when(F.col("date").between(F.col("start"), F.col("end")), F.col("rank_ic"))
    return rows.groupBy(*KEYS, "subperiod", "start", "end").agg(F.count(inside).alias("valid_months"), F.avg(inside).alias("mean_ic"))


def factor_summary(scored: DataFrame, ic: DataFrame, quantiles: DataFrame, turnover: DataFrame, primary_horizon: int) -> DataFrame:
    """One row for each factor, variant and horizon."""
    coverage = long_scores(scored).groupBy(*KEYS).agg((F.count_if(finite("value")) / F.count(F.lit(1))).alias("coverage"))
    status = scored.groupBy("factor_name").agg(F.min("point_in_time_status").alias("point_in_time_status"))
    base = ic.select(*KEYS, "horizon").distinct()
    months = ic.filter("rank_ic IS NOT NULL")
    rate = months.groupBy(*KEYS, "horizon").agg(F.avg((F.col("rank_ic") > 0).cast("int")).alias("positive_ic_rate"))
    test = newey_west(months, [*KEYS, "horizon"], "date", "rank_ic", published_lag(F.col("horizon")))
    test = test.withColumnRenamed("reason", "nw_reason").withColumnRenamed("mean", "mean_ic")
    spread = quantile_spread(quantiles).withColumn("horizon", F.lit(primary_horizon))
    turn = turnover.groupBy(*KEYS).agg(F.avg("turnover").alias("avg_turnover"))
    keys = [*KEYS, "horizon"]
    out = base.join(test, keys, "left").join(rate, keys, "left").join(coverage, KEYS, "left").join(spread, keys, "left").join(turn, KEYS, "left").join(status, "factor_name", "left")
    out = out.withColumn("valid_months", F.coalesce("n", F.lit(0))).withColumn("ic_std", F.when(F.col("n") >= 2, F.col("std")))
    out = out.withColumn("icir", F.when(F.col("ic_std") > 0, F.try_divide("mean_ic", "ic_std") * math.sqrt(12.0)))
    mine = F.create_map(*[x for f in FACTORS for x in (F.lit(f.name), F.lit(primary_variant(f.name)))])[F.col("factor_name")]
    out = out.withColumn("__primary", (F.col("horizon") == primary_horizon) & (F.col("score_variant") == mine))
    out = benjamini_hochberg(out.withColumn("__p", F.when(F.col("__primary"), F.col("p"))), "__p", ["factor_name"], name="bh_q")
    reason = F.when(F.col("coverage") == 0, "no_finite_scores").when(F.col("valid_months") == 0, "no_valid_monthly_ic")
    return out.select(
        *keys, "coverage", "valid_months", "mean_ic", "ic_std", "icir", "positive_ic_rate",
        F.col("lag").alias("nw_lag"), F.col("se").alias("nw_se"), F.col("t").alias("nw_t"), F.col("p").alias("nw_p"), "bh_q",
        F.col("spread").alias("q5_q1"), "monotonicity", "avg_turnover", "point_in_time_status", "nw_reason", reason.alias("summary_reason"),
    )


def classify(summary: DataFrame, periods: DataFrame, *, primary_horizon: int, coverage: float = 0.8, months: int = 60, q: float = 0.05) -> DataFrame:
    """candidate, watch or reject for each factor, with the reasons in order (their codes are fixed values)."""
    mine = F.create_map(*[x for f in FACTORS for x in (F.lit(f.name), F.lit(primary_variant(f.name)))])[F.col("factor_name")]
    good = periods.groupBy("factor_name", "score_variant").agg(F.count_if(finite("mean_ic") & (F.col("mean_ic") > 0)).alias("positive_subperiods"))
    rows = summary.filter((F.col("horizon") == primary_horizon) & (F.col("score_variant") == mine)).join(good, ["factor_name", "score_variant"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    gates = {
        "coverage_pass": yes(finite("coverage") & (F.col("coverage") >= coverage)),
        "valid_months_pass": yes(F.col("valid_months") >= months),
        "mean_ic_positive": yes(finite("mean_ic") & (F.col("mean_ic") > 0)),
        "fdr_pass": yes(finite("bh_q") & (F.col("bh_q") <= q)),
        "q5_q1_positive": yes(finite("q5_q1") & (F.col("q5_q1") > 0)),
        "subperiod_stability_pass": yes(F.col("positive_subperiods") >= 2),
        "point_in_time_verified": yes(F.col("point_in_time_status") == "ready"),
    }
    for n, g in gates.items():
        rows = rows.withColumn(n, g)
    fail = lambda *pairs: F.concat_ws(";", *[F.when(~F.col(g), F.lit(t)) for g, t in pairs])
    core = fail(
        ("coverage_pass", "coverage_below_or_missing_threshold"), ("valid_months_pass", "insufficient_valid_months"), ("mean_ic_positive", "non_positive_or_missing_mean_ic")
    )
    watch = fail(
        ("fdr_pass", "fdr_threshold_not_met"), ("q5_q1_positive", "non_positive_or_missing_q5_q1"),
        ("subperiod_stability_pass", "subperiod_stability_not_met"), ("point_in_time_verified", "point_in_time_unverified"),
    )
    label = F.when(core != "", "reject").when(watch != "", "watch").otherwise("candidate")
    reason = F.when(core != "", F.concat(F.lit("reject:"), core)).when(watch != "", F.concat(F.lit("watch:"), watch)).otherwise("candidate:all_thresholds_passed")
    return rows.select("factor_name", "family", F.col("score_variant").alias("primary_score_variant"), F.coalesce("positive_subperiods", F.lit(0)).alias("positive_subperiods"), *gates, label.alias("classification"), reason.alias("reason"))


def primary_scores(scored: DataFrame) -> DataFrame:
    """date, symbol, factor_name, value: the score that carries a factor's headline result."""
    neutral = [f.name for f in FACTORS if f.size_neutral]
    value = F.when(F.col("factor_name").isin(neutral), F.col("score_size_neutral")).otherwise(F.col("score"))
    return scored.select("date", "symbol", "factor_name", value.alias("value"))


REASONS = ("insufficient_common_observations", "constant_score", "constant_score")


def monthly_correlations(scored: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """factor_a <= factor_b, date, n_obs, rank_ic, reason for every month in which both have rows, valid or not."""
    rows = primary_scores(scored)
    a = rows.select("date", "symbol", F.col("factor_name").alias("factor_a"), F.col("value").alias("x"))
    b = rows.select("date", "symbol", F.col("factor_name").alias("factor_b"), F.col("value").alias("y"))
    return spearman(a.join(b, ["date", "symbol"]).filter("factor_a <= factor_b"), ["date", "factor_a", "factor_b"], "x", "y", minimum, REASONS)


def redundancy(scored: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """factor_a, factor_b, mean_correlation, common_months: mean monthly rank correlation over common symbols.

    Ranks are taken within the common sample of each pair; one self-join on (date, symbol)
    makes all pairs, a fixed number for each scored row.  Both directions of a pair come from one
    row: a mean computed twice may differ in its last digit, as rows arrive in another order.
    """
    rows = primary_scores(scored).filter(finite("value"))
    a = rows.select("date", "symbol", F.col("factor_name").alias("factor_a"), F.col("value").alias("x"))
    b = rows.select("date", "symbol", F.col("factor_name").alias("factor_b"), F.col("value").alias("y"))
    pairs = a.join(b, ["date", "symbol"]).filter("factor_a <= factor_b")
    monthly = spearman(pairs, ["date", "factor_a", "factor_b"], "x", "y", minimum, REASONS)
    half = monthly.groupBy("factor_a", "factor_b").agg(F.avg("rank_ic").alias("mean_correlation"), F.count("rank_ic").alias("common_months"))
    a, b = F.col("factor_a").alias("a"), F.col("factor_b").alias("b")
    other = F.struct(F.col("factor_b").alias("a"), F.col("factor_a").alias("b"))
    sides = F.explode(F.when(F.col("factor_a") == F.col("factor_b"), F.array(F.struct(a, b))).otherwise(F.array(F.struct(a, b), other))).alias("s")
    return half.select(sides, "mean_correlation", "common_months").select(F.col("s.a").alias("factor_a"), F.col("s.b").alias("factor_b"), "mean_correlation", "common_months")


def redundancy_flags(correlations: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs in registry order whose absolute mean correlation reaches the threshold."""
    place = F.create_map(*[x for i, f in enumerate(FACTORS) for x in (F.lit(f.name), F.lit(i))])
    r = F.col("mean_correlation")
    return correlations.filter((place[F.col("factor_a")] < place[F.col("factor_b")]) & (F.abs(r) >= threshold)).select(
        "factor_a", "factor_b", "mean_correlation", F.abs(r).alias("absolute_correlation"),
        F.when(r >= 0, "positive").otherwise("negative").alias("correlation_direction"), "common_months",
    )
