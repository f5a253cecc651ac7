"""Constraints on published tables, declared once and compiled to a few aggregations a table.

A :class:`Table` declares types, keys, row rules and a grid of keys that must be complete;
:func:`violations` compiles it to one aggregation of all row rules, one of the keys, and one
join with the grid.  :func:`metric_catalogue` declares the eight tables of an evaluation, and
:func:`metric_violations` adds what holds between them: a matrix is symmetric, and flags follow from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .factors import FACTORS

TOLERANCE = 1e-12


@dataclass(frozen=True)
class Table:
    """``types`` (column: type, or several separated by |), ``keys``, ``rules`` (name: condition that a bad row meets), ``grid`` of rows over ``grid_keys``."""

    types: Mapping[str, str]
    keys: tuple[str, ...]
    rules: Mapping[str, Column] = field(default_factory=dict)
    grid_keys: tuple[str, ...] = ()
    grid: tuple[tuple, ...] = ()


def _rows(spark: SparkSession, found: Iterable[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(list(found), "rule string, violations long")


def violations(df: DataFrame, table: Table) -> DataFrame:
    """rule, violations of one table, rules with violations alone.

    Columns that are missing or have another type are found from the schema (rules ``missing_column:name`` and
    ``type:name``); the other rules then count rows only if their columns are there.
    """
    spark = df.sparkSession
    have = dict(df.dtypes)
    schema = [(f"missing_column:{c}", 1) for c in table.types if c not in have]
    schema += [(f"type:{c}", 1) for c, t in table.types.items() if c in have and have[c] not in t.split("|")]
    out = _rows(spark, schema)
    if any(c not in have for c in table.types):
        return out
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in table.keys])
    rules = {"null_key": null_key, **table.rules}
    wide = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"r{i}") for i, t in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])
    out = out.unionByName(wide.select(F.explode(each).alias("x")).select("x.*"))
    twice = df.groupBy(*table.keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
    out = out.unionByName(twice.select(F.lit("duplicate_key").alias("rule"), "violations"))
    if table.grid:
        keys = list(table.grid_keys)
        ddl = ", ".join(f"{k} {have[k]}" for k in keys)
        want = spark.createDataFrame(list(table.grid), ddl).withColumn("__w", F.lit(1))
        both = F.broadcast(want).join(df.select(*keys).distinct().withColumn("__h", F.lit(1)), keys, "full_outer")
        got = both.agg(F.count_if(F.col("__h").isNull()).alias("a"), F.count_if(F.col("__w").isNull()).alias("b"))
        each = F.array(F.struct(F.lit("missing_key").alias("rule"), F.col("a").alias("violations")), F.struct(F.lit("unknown_key").alias("rule"), F.col("b").alias("violations")))
        out = out.unionByName(got.select(F.explode(each).alias("x")).select("x.*"))
    return out.filter("violations > 0")


def _lookup(values: Mapping[str, str], c: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(c)]


def variants(factor) -> tuple[str, ...]:
    return ("score", "score_size_neutral") if factor.size_neutral else ("score",)


def metric_catalogue(*, horizons: Iterable[int], quantiles: int, start: str, end: str, periods: Iterable[tuple[str, str, str]], primary_horizon: int) -> dict[str, Table]:
    """The eight tables of an evaluation over the registered factors."""
    horizons, periods = tuple(horizons), tuple(periods)
    family = _lookup({f.name: f.family for f in FACTORS}, "factor_name")
    two = F.array(*[F.lit(f.name) for f in FACTORS if f.size_neutral])
    primary = lambda c: F.when(F.array_contains(two, F.col(c)), "score_size_neutral").otherwise("score")
    known = lambda c: F.col(c).isin(*[f.name for f in FACTORS])
    text = {"factor_name": "string", "family": "string", "score_variant": "string"}
    whole = "int|bigint"
    factor = {
        "unknown_factor": ~known("factor_name"),
        "other_family": known("factor_name") & ~F.col("family").eqNullSafe(family),
        "unknown_variant": known("factor_name") & ~(F.col("score_variant").eqNullSafe(F.lit("score")) | (F.col("score_variant").eqNullSafe(F.lit("score_size_neutral")) & F.array_contains(two, F.col("factor_name")))),
    }
    horizon = {"unknown_horizon": F.col("horizon").isNull() | ~F.col("horizon").isin(*horizons)}
    dated = {"outside_period": F.col("date").isNull() | ~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))}
    edges = {n: (a, b) for n, a, b in periods}
    edge = lambda i: _lookup({n: e[i] for n, e in edges.items()}, "period").cast("date")
    pair = {"unknown_factor": ~(known("factor_a") & known("factor_b"))}
    place = F.create_map(*[x for i, f in enumerate(FACTORS) for x in (F.lit(f.name), F.lit(i))])
    names = [f.name for f in FACTORS]
    return {
        "rank_ic": Table({"date": "date", **text, "horizon": whole, "n_obs": whole, "rank_ic": "double", "reason": "string"}, ("date", "factor_name", "score_variant", "horizon"), {**factor, **horizon, **dated, "rank_ic_range": F.abs("rank_ic") > 1 + 1e-9}),
        "quantile_returns": Table(
            {"date": "date", **text, "quantile": whole, "n_obs": whole, "mean_return": "double"}, ("date", "factor_name", "score_variant", "quantile"),
            {**factor, **dated, "invalid_quantile": F.col("quantile").isNull() | ~F.col("quantile").between(1, quantiles)},
        ),
        "factor_turnover": Table({"date": "date", **text, "turnover": "double"}, ("date", "factor_name", "score_variant"), {**factor, **dated, "turnover_range": ~F.col("turnover").between(0.0, 1.0)}),
        "factor_summary": Table(
            {**text, "horizon": whole, "coverage": "double", "mean_ic": "double"}, ("factor_name", "score_variant", "horizon"), {**factor, **horizon, "coverage_range": ~F.col("coverage").between(0.0, 1.0)},
            ("factor_name", "score_variant", "horizon"), tuple((f.name, v, h) for f in FACTORS for v in variants(f) for h in horizons),
        ),
        "subperiod_metrics": Table(
            {"factor_name": "string", "score_variant": "string", "period": "string", "start": "date", "end": "date"}, ("factor_name", "score_variant", "period"),
            {"unknown_factor": factor["unknown_factor"], "unknown_variant": factor["unknown_variant"], "period_dates": F.col("period").isin(*edges) & ~(F.col("start").eqNullSafe(edge(0)) & F.col("end").eqNullSafe(edge(1)))},
            ("factor_name", "score_variant", "period"), tuple((f.name, v, n) for f in FACTORS for v in variants(f) for n in edges),
        ),
        "classification": Table(
            {"factor_name": "string", "family": "string", "primary_score_variant": "string", "primary_horizon": whole, "classification": "string"}, ("factor_name",),
            {"unknown_factor": factor["unknown_factor"], "other_family": factor["other_family"], "other_primary_variant": ~F.col("primary_score_variant").eqNullSafe(primary("factor_name")), "other_primary_horizon": ~F.col("primary_horizon").eqNullSafe(F.lit(primary_horizon))},
            ("factor_name",), tuple((n,) for n in names),
        ),
        "factor_correlations": Table({"factor_a": "string", "factor_b": "string", "mean_correlation": "double", "common_months": whole}, ("factor_a", "factor_b"), {**pair, "correlation_range": F.abs("mean_correlation") > 1 + 1e-9}, ("factor_a", "factor_b"), tuple((a, b) for a in names for b in names)),
        "redundancy_flags": Table(
            {"factor_a": "string", "factor_b": "string", "mean_correlation": "double", "absolute_correlation": "double", "correlation_direction": "string", "common_months": whole}, ("factor_a", "factor_b"),
            {**pair, "pair_order": ~(place[F.col("factor_a")] < place[F.col("factor_b")])},
        ),
    }


def _near(a: str, b: str) -> Column:
    """Both null, or finite and within the tolerance."""
    return (F.col(a).isNull() & F.col(b).isNull()) | F.coalesce(F.abs(F.col(a) - F.col(b)) <= TOLERANCE, F.lit(False))


def symmetry_violations(pairs: DataFrame) -> DataFrame:
    """rule asymmetric_pair: rows without an equal mirror row."""
    other = pairs.select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), F.col("mean_correlation").alias("m"), F.col("common_months").alias("c"), F.lit(1).alias("h"))
    both = pairs.join(other, ["factor_a", "factor_b"], "left")
    bad = F.col("h").isNull() | ~_near("mean_correlation", "m") | ~F.col("c").eqNullSafe(F.col("common_months"))
    return both.agg(F.count_if(bad).alias("violations")).select(F.lit("asymmetric_pair").alias("rule"), "violations").filter("violations > 0")


def flag_violations(flags: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """rules missing_flag, unexpected_flag, flag_values: flags against the pairs that reach the threshold in registry order."""
    place = F.create_map(*[x for i, f in enumerate(FACTORS) for x in (F.lit(f.name), F.lit(i))])
    due = pairs.filter((place[F.col("factor_a")] < place[F.col("factor_b")]) & (F.abs("mean_correlation") >= threshold))
    due = due.select("factor_a", "factor_b", F.col("mean_correlation").alias("m"), F.abs("mean_correlation").alias("x"), F.when(F.col("mean_correlation") >= 0, "positive").otherwise("negative").alias("d"), F.col("common_months").alias("c"), F.lit(1).alias("due"))
    both = due.join(flags.withColumn("got", F.lit(1)), ["factor_a", "factor_b"], "full_outer")
    here = F.col("due").isNotNull() & F.col("got").isNotNull()
    same = _near("mean_correlation", "m") & _near("absolute_correlation", "x") & F.col("correlation_direction").eqNullSafe(F.col("d")) & F.col("common_months").eqNullSafe(F.col("c"))
    rules = {"missing_flag": F.col("got").isNull(), "unexpected_flag": F.col("due").isNull(), "flag_values": here & ~same}
    wide = both.agg(*[F.count_if(t).alias(n) for n, t in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*").filter("violations > 0")


def metric_violations(tables: Mapping[str, DataFrame], catalogue: Mapping[str, Table], threshold: float) -> DataFrame:
    """table_name, rule, violations of all tables of a catalogue and of what holds between them; a missing table raises ValueError."""
    lacking = set(catalogue) - set(tables)
    if lacking:
        raise ValueError("tables are missing: " + ", ".join(sorted(lacking)))
    named = lambda df, n: df.select(F.lit(n).alias("table_name"), "rule", "violations")
    parts = [named(violations(tables[n], t), n) for n, t in catalogue.items()]
    parts.append(named(symmetry_violations(tables["factor_correlations"]), "factor_correlations"))
    parts.append(named(flag_violations(tables["redundancy_flags"], tables["factor_correlations"], threshold), "redundancy_flags"))
    return reduce(DataFrame.unionByName, parts)


def require_metrics(tables: Mapping[str, DataFrame], catalogue: Mapping[str, Table], threshold: float) -> None:
    """Raises ValueError, with the first rules, if a table of the catalogue breaks one."""
    found = metric_violations(tables, catalogue, threshold).orderBy("table_name", "rule").limit(10).collect()
    if found:
        raise ValueError("metric tables: " + "; ".join(f"{r['table_name']} {r['rule']} {r['violations']}" for r in found))
