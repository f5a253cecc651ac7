"""Winsorizing, directed standardization and size neutralization of each cross-section.

Both steps are closed forms over windows of a (date, factor) cross-section, so one factor
and date is the largest group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, when_finite
from .factors import BY_NAME, SIZE

EPSILON = 2.220446049250313e-16


def score(long_panel: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Adds winsorized_value, score (direction * z, ddof 0) and preprocessing_reason; raw_value becomes null where not finite."""
    direction = F.create_map(*[x for n, f in BY_NAME.items() for x in (F.lit(n), F.lit(f.direction))])[F.col("factor_name")]
    cross = Window.partitionBy("date", "factor_name")
    reason = F.when(F.col("raw_value").isNull(), "missing_raw_value").when(~finite("raw_value"), "non_finite_raw_value")
    df = long_panel.withColumn("preprocessing_reason", reason).withColumn("raw_value", when_finite("raw_value"))
    bounds = F.percentile("raw_value", F.array(F.lit(lower), F.lit(upper))).over(cross)
    df = df.withColumn("__b", bounds).withColumn(
        "winsorized_value", F.when(F.col("raw_value").isNotNull(), F.least(F.greatest("raw_value", F.col("__b")[0]), F.col("__b")[1]))
    )
    w = F.col("winsorized_value")
    df = df.withColumn("__n", F.count(w).over(cross)).withColumn("__s", F.stddev_pop(w).over(cross)).withColumn("__m", F.avg(w).over(cross))
    flat = (F.max(w).over(cross) == F.min(w).over(cross)) | ~(F.col("__s") > 0)
    df = df.withColumn("__flat", flat)
    late = F.when(F.col("__n") < 2, "insufficient_valid_values").when(F.col("__flat"), "zero_score_variance")
    return df.withColumn("score", F.when(late.isNull(), direction * F.try_divide(w - F.col("__m"), F.col("__s")))).withColumn(
        "preprocessing_reason", F.coalesce("preprocessing_reason", late)
    ).drop("__b", "__n", "__s", "__m", "__flat")


def neutralize_size(scored: DataFrame) -> DataFrame:
    """Adds score_size_neutral: the standardized residual of the score on the size score, and extends the reason."""
    size = scored.filter(F.col("factor_name") == SIZE).select("date", "symbol", F.col("score").alias("__x"))
    df = scored.join(size, ["date", "symbol"], "left")
    neutral = F.create_map(*[x for n, f in BY_NAME.items() for x in (F.lit(n), F.lit(f.size_neutral))])[F.col("factor_name")]
    cross = Window.partitionBy("date", "factor_name")
    common = finite("score") & finite("__x")
    x, y = F.when(common, F.col("__x")), F.when(common, F.col("score"))
    df = df.withColumn("__c", common).withColumn("__x0", x).withColumn("__y0", y)
    n = F.count("__x0").over(cross)
    df = (
        df.withColumn("__n", n)
        .withColumn("__mx", F.avg("__x0").over(cross))
        .withColumn("__my", F.avg("__y0").over(cross))
        .withColumn("__b", F.try_divide(F.covar_pop("__x0", "__y0").over(cross), F.var_pop("__x0").over(cross)))
        .withColumn("__flatx", F.max("__x0").over(cross) == F.min("__x0").over(cross))
    )
    df = df.withColumn("__e", F.col("__y0") - F.col("__my") - F.col("__b") * (F.col("__x0") - F.col("__mx")))
    scale = F.greatest(F.max(F.abs("__y0")).over(cross), F.max(F.abs(F.col("__y0") - F.col("__e"))).over(cross), 1 + F.max(F.abs(F.col("__x0") - F.col("__mx"))).over(cross))
    df = df.withColumn("__se", F.stddev_pop("__e").over(cross)).withColumn("__tiny", F.max(F.abs("__e")).over(cross) <= 16 * EPSILON * F.col("__n") * scale)
    df = df.withColumn("__me", F.avg("__e").over(cross))
    failed = (
        F.when(F.col("__n") < 3, "insufficient_size_samples")
        .when(F.col("__flatx"), "singular_size_control")
        .when(F.col("__tiny") | ~(F.col("__se") > 0), "constant_size_residual")
    )
    value = F.when(neutral & F.col("__c") & failed.isNull(), F.try_divide(F.col("__e") - F.col("__me"), F.col("__se")))
    late = F.when(neutral, F.when(finite("score") & ~finite("__x"), "missing_size_score").when(F.col("__c"), failed))
    out = df.withColumn("score_size_neutral", value).withColumn("preprocessing_reason", F.coalesce("preprocessing_reason", late))
    return out.select(*scored.columns, "score_size_neutral")


def preprocess(long_panel: DataFrame, statuses: dict[str, str] | None = None) -> DataFrame:
    """Both steps, the point-in-time status of each factor, and the industry-neutral score as typed null."""
    known = statuses or {n: "unverified" if f.needs_verified else "ready" for n, f in BY_NAME.items()}
    status = F.create_map(*[x for n, s in known.items() for x in (F.lit(n), F.lit(s))])[F.col("factor_name")]
    return (
        neutralize_size(score(long_panel))
        .withColumn("score_industry_size_neutral", F.lit(None).cast("double"))
        .withColumn("point_in_time_status", status)
        .select(
            "date",
            "symbol",
            "factor_name",
            "family",
            "raw_value",
            "winsorized_value",
            "score",
            "score_size_neutral",
            "score_industry_size_neutral",
            "point_in_time_status",
            "preprocessing_reason",
        )
    )
