"""Composite scores: static, rolling-IC weighted, with a family removed; and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complete, equal_bucket, finite, zscore
from ..functions.statistics import newey_west, published_lag, spearman

# The candidate factors of each family and the representatives.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "reversal": ("reversal_5", "reversal_20"),
    "liquidity": ("turnover_20", "amihud_20"),
    "low_volatility": ("volatility_20", "volatility_60"),
}
REPRESENTATIVES = ("reversal_20", "turnover_20", "volatility_60")
STATIC = ("candidate_equal", "family_equal", "representative_equal")
ROLLING = "rolling_ic_family"
NAMES = [f for fs in CANDIDATES.values() for f in fs]
COLUMNS = ["date", "symbol", "method", "score", "raw_score", "family_count", "factor_count"]


def _standardized(raw: DataFrame, minimum_families: int) -> DataFrame:
    kept = raw.filter(F.col("family_count") >= minimum_families)
    return kept.withColumn("score", zscore("raw_score", ["date", "method"])).select(*COLUMNS)


def static_scores(scored: DataFrame, methods: tuple[str, ...] = STATIC, minimum_families: int = 2) -> DataFrame:
    """All methods in one pass: rows are tagged with the methods that use their factor."""
    rows = scored.filter(F.col("factor_name").isin(NAMES) & finite("score_size_neutral"))
    use = F.array_compact(
        F.array(*[F.lit(m) if m != "representative_equal" else F.when(F.col("factor_name").isin(*REPRESENTATIVES), F.lit(m)) for m in methods])
    )
    family = (
        rows.withColumn("method", F.explode(use))
        .groupBy("date", "symbol", "method", "family")
        .agg(F.avg("score_size_neutral").alias("f"), F.count(F.lit(1)).alias("k"))
    )
    by_count = F.try_divide(F.sum(F.col("f") * F.col("k")), F.sum("k"))
    raw = family.groupBy("date", "symbol", "method").agg(
        F.when(F.col("method") == "candidate_equal", by_count).otherwise(F.avg("f")).alias("raw_score"),
        F.count(F.lit(1)).alias("family_count"),
        F.sum("k").alias("factor_count"),
    )
    return _standardized(raw, minimum_families)


def realization_dates(labels: DataFrame, horizon: int = 20) -> DataFrame:
    """date, realization_date: when the last label of a date is known."""
    return labels.groupBy("date").agg(F.date_add("date", F.max(f"forward_calendar_days_{horizon}")).alias("realization_date"))


def rolling_ic_weights(
    ic: DataFrame, realization: DataFrame, weight_dates: DataFrame, *, window: int = 36, minimum: int = 24, shrinkage: float = 0.5, horizon: int = 20
) -> DataFrame:
    """date, family, factor_name, factor_weight and the history that was used.

    The history of a weight date is the last ``window`` IC dates, over all factors, whose
    labels were realized strictly before it.  A family falls back to equal weights if a
    factor has fewer than ``minimum`` months or no mean is positive.
    """
    rows = ic.filter((F.col("score_variant") == "score_size_neutral") & (F.col("horizon") == horizon) & finite("rank_ic"))
    rows = rows.join(realization, "date")
    weight_dates = weight_dates.select(F.col("date").alias("weight_date")).distinct()
    dates = rows.select("date", "realization_date").distinct().join(F.broadcast(weight_dates), F.col("realization_date") < F.col("weight_date"))
    recent = Window.partitionBy("weight_date").orderBy(F.desc("date"))
    dates = dates.withColumn("__i", F.row_number().over(recent)).filter(F.col("__i") <= window).select("weight_date", "date")
    span = dates.groupBy("weight_date").agg(F.min("date").alias("history_start"), F.max("date").alias("history_end"), F.count(F.lit(1)).alias("history_months"))
    registry = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("factor_name"), F.lit(len(ns)).alias("size")) for f, ns in CANDIDATES.items() for n in ns]))
    grid = weight_dates.select("weight_date", registry.alias("r")).select("weight_date", "r.*")
    means = rows.join(dates, "date").groupBy("weight_date", "factor_name").agg(F.avg("rank_ic").alias("m"), F.count(F.lit(1)).alias("n"))
    grid = grid.join(means, ["weight_date", "factor_name"], "left").join(span, "weight_date", "left")
    family = Window.partitionBy("weight_date", "family")
    plus = F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0))
    grid = grid.withColumn("__plus", plus).withColumn("__sum", F.sum("__plus").over(family)).withColumn("__least", F.min(F.coalesce("n", F.lit(0))).over(family))
    fallback = (F.col("__least") < minimum) | (F.col("__sum") <= 0)
    equal = 1.0 / F.col("size")
    weight = F.when(fallback, equal).otherwise(shrinkage * equal + (1.0 - shrinkage) * F.try_divide(F.col("__plus"), F.col("__sum")))
    return grid.select(
        F.col("weight_date").alias("date"), "family", "factor_name", weight.alias("factor_weight"), "history_start", "history_end",
        F.coalesce("history_months", F.lit(0)).alias("history_months"), fallback.alias("fallback_equal"),
    )


def rolling_scores(scored: DataFrame, weights: DataFrame, minimum_families: int = 2) -> DataFrame:
    rows = scored.filter(F.col("factor_name").isin(NAMES) & finite("score_size_neutral"))
    rows = rows.join(weights.select("date", "factor_name", "factor_weight"), ["date", "factor_name"])
    family = rows.groupBy("date", "symbol", "family").agg(
        F.try_divide(F.sum(F.col("score_size_neutral") * F.col("factor_weight")), F.sum("factor_weight")).alias("f"), F.count(F.lit(1)).alias("k")
    )
    raw = family.groupBy("date", "symbol").agg(F.avg("f").alias("raw_score"), F.count(F.lit(1)).alias("family_count"), F.sum("k").alias("factor_count"))
    return _standardized(raw.withColumn("method", F.lit(ROLLING)), minimum_families)


def static_weights(dates: DataFrame) -> DataFrame:
    """date, method, factor_name, family, weight of the static methods."""
    table = [(m, n, f, 1.0 / 6) for f, ns in CANDIDATES.items() for n in ns for m in STATIC[:2]]
    table += [(STATIC[2], n, f, 1.0 / 3) for f, ns in CANDIDATES.items() for n in ns if n in REPRESENTATIVES]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(n).alias("factor_name"), F.lit(f).alias("family"), F.lit(w).alias("weight")) for m, n, f, w in table])
    return dates.select("date").distinct().select("date", F.explode(rows).alias("r")).select("date", "r.*")


def ablation_scores(scored: DataFrame, weights: DataFrame, removed: str) -> DataFrame:
    """Composite scores without one family, weights renormalized; securities need all other families."""
    if removed not in CANDIDATES:
        raise ValueError(f"not a candidate family: {removed}")
    rows = scored.filter(F.col("family").isin(*[f for f in CANDIDATES if f != removed]) & finite("score_size_neutral"))
    rows = rows.join(weights.filter(F.col("family") != removed).select("date", "factor_name", "factor_weight"), ["date", "factor_name"])
    raw = rows.groupBy("date", "symbol").agg(
        F.try_divide(F.sum(F.col("score_size_neutral") * F.col("factor_weight")), F.sum("factor_weight")).alias("raw_score"),
        F.countDistinct("family").alias("family_count"),
        F.count(F.lit(1)).alias("factor_count"),
    )
    return _standardized(raw.withColumn("method", F.lit(ROLLING)), len(CANDIDATES) - 1)


def composite_ic(scores: DataFrame, labels: DataFrame, horizons: tuple[int, ...], minimum: int = 3) -> DataFrame:
    names = [f"forward_return_{h}" for h in horizons]
    rows = scores.select("date", "symbol", "method", "score").join(labels.select("date", "symbol", *names), ["date", "symbol"], "left")
    rows = rows.unpivot(["date", "symbol", "method", "score"], names, "label", "forward").withColumn("horizon", F.regexp_extract("label", r"(\d+)$", 1).cast("int"))
    return spearman(rows, ["date", "method", "horizon"], "score", "forward", minimum)


def composite_quantiles(scores: DataFrame, labels: DataFrame, horizon: int, buckets: int = 5) -> DataFrame:
    label = f"forward_return_{horizon}"
    rows = scores.join(labels.select("date", "symbol", label), ["date", "symbol"]).filter(finite("score") & finite(label))
    cross = Window.partitionBy("date", "method")
    rows = rows.withColumn("quantile", equal_bucket(F.row_number().over(cross.orderBy("score", "symbol")), F.count(F.lit(1)).over(cross), buckets))
    return rows.groupBy("date", "method", "quantile").agg(F.count(F.lit(1)).alias("n_obs"), F.avg(label).alias("mean_return"))


def composite_summary(ic: DataFrame) -> DataFrame:
    """method, horizon, mean_ic, icir, nw_t, valid_months."""
    test = newey_west(ic, ["method", "horizon"], "date", "rank_ic", published_lag(F.col("horizon")), with_p=False)
    return test.select(
        "method", "horizon", F.col("mean").alias("mean_ic"), F.when(F.col("std") > 0, F.try_divide("mean", "std") * math.sqrt(12.0)).alias("icir"),
        F.col("t").alias("nw_t"), F.col("n").alias("valid_months"),
    )


def composite_correlations(scores: DataFrame, scored: DataFrame | None = None, minimum: int = 3) -> DataFrame:
    """left_name, right_name, right_type, mean_correlation, common_months, invalid_months, primary_reason."""
    a = scores.filter(F.col("score").isNotNull()).select("date", "symbol", F.col("method").alias("left_name"), F.col("score").alias("x"))
    b = a.select("date", "symbol", F.col("left_name").alias("right_name"), F.col("x").alias("y"), F.lit("composite").alias("right_type"))
    pairs = a.join(b, ["date", "symbol"]).filter("left_name <= right_name")
    if scored is not None:
        c = scored.filter(F.col("score_size_neutral").isNotNull()).select(
            "date", "symbol", F.col("factor_name").alias("right_name"), F.col("score_size_neutral").alias("y"), F.lit("single_factor").alias("right_type")
        )
        pairs = pairs.unionByName(a.join(c, ["date", "symbol"]))
    keys = ["left_name", "right_name", "right_type"]
    monthly = spearman(pairs, ["date", *keys], "x", "y", minimum, ("insufficient_common_securities", "constant_series", "constant_series"))
    return monthly.groupBy(*keys).agg(
        F.avg("rank_ic").alias("mean_correlation"), F.count("rank_ic").alias("common_months"), F.count_if(F.col("rank_ic").isNull()).alias("invalid_months"),
        F.mode("reason", True).alias("primary_reason"),
    )


def rank_stability(scores: DataFrame, minimum: int = 3) -> DataFrame:
    """method, ranking_stability (mean month-to-month rank correlation), top10_turnover."""
    dates = scores.select("method", "date").distinct().withColumn("previous", F.lag("date").over(Window.partitionBy("method").orderBy("date")))
    now = scores.select("method", "date", "symbol", "score").join(dates, ["method", "date"])
    old = scores.select("method", F.col("date").alias("previous"), "symbol", F.col("score").alias("old"))
    paired = spearman(now.join(old, ["method", "previous", "symbol"]), ["method", "date"], "old", "score", minimum)
    stability = paired.groupBy("method").agg(F.avg("rank_ic").alias("ranking_stability"))
    cross = Window.partitionBy("method", "date")
    size = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(cross) * 0.1))
    top = now.withColumn("__k", size).withColumn("__i", F.row_number().over(cross.orderBy(F.desc("score"), "symbol"))).filter("__i <= __k")
    kept = top.join(top.select("method", F.col("date").alias("previous"), "symbol", F.lit(1).alias("was")), ["method", "previous", "symbol"], "left")
    turnover = kept.filter("previous IS NOT NULL").groupBy("method", "date").agg((1 - F.count("was") / F.count(F.lit(1))).alias("t")).groupBy("method").agg(F.avg("t").alias("top10_turnover"))
    return stability.join(turnover, "method", "full_outer")


def rolling_mean_ic(ic: DataFrame, window: int = 12) -> DataFrame:
    w = Window.partitionBy("method", "horizon").orderBy("date")
    return ic.withColumn("rolling_ic", complete(F.avg, "rank_ic", w, window))


def quintile_excess(quantiles: DataFrame, name: str) -> DataFrame:
    """Mean monthly return of each quantile over the count-weighted mean of its month."""
    w = Window.partitionBy("date", name)
    universe = F.sum(F.col("mean_return") * F.col("n_obs")).over(w) / F.sum("n_obs").over(w)
    rows = quantiles.withColumn("excess", F.col("mean_return") - universe)
    return rows.groupBy(name, "quantile").agg(F.avg("excess").alias("mean_excess"), F.count(F.lit(1)).alias("months"))


def leg_decomposition(quantiles: DataFrame, name: str | list[str], buckets: int = 5, horizon: int = 20) -> DataFrame:
    """Long leg (top over universe) and short leg (universe over bottom) with Newey-West t values, for each object."""
    keys = [name] if isinstance(name, str) else name
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_return")))
    monthly = quantiles.groupBy("date", *keys).agg((F.sum(F.col("mean_return") * F.col("n_obs")) / F.sum("n_obs")).alias("u"), at(buckets).alias("top"), at(1).alias("low")).dropna(subset=["u", "top", "low"])
    both = F.array(F.struct(F.lit("long").alias("leg"), (F.col("top") - F.col("u")).alias("v")), F.struct(F.lit("short").alias("leg"), (F.col("u") - F.col("low")).alias("v")))
    legs = monthly.select("date", *keys, F.explode(both).alias("x")).select("date", *keys, "x.*")
    test = newey_west(legs, [*keys, "leg"], "date", "v", published_lag(F.lit(horizon)), with_p=False)
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    out = test.groupBy(*keys).agg(
        F.max("n").alias("months"), pick("long", "mean").alias("long_leg"), pick("long", "t").alias("long_leg_t"), pick("short", "mean").alias("short_leg"), pick("short", "t").alias("short_leg_t")
    )
    spread = F.col("long_leg") + F.col("short_leg")
    return out.withColumn("spread", spread).withColumn("long_share", F.when(spread > 0, F.try_divide("long_leg", spread)))
