"""Row checks, field audits and dataset contracts: counts of violations, in one pass each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, invalid_ohlc, market, positive, require_none

PRICES = [f"{p}_{k}" for k in ("raw", "adj") for p in ("open", "high", "low", "close")]


def _any_null(columns: list[str]):
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return bad


def row_rules(columns: list[str]) -> dict[tuple[str, str], Column]:
    """(severity, code) of each rule on single rows, and what breaks it; rules on columns that are not there are left out."""
    rules = {
        ("error", "missing_price"): (PRICES, lambda: _any_null(PRICES)),
        ("error", "invalid_ohlc"): (PRICES, invalid_ohlc),
        ("error", "missing_trade_data"): (["volume", "amount"], lambda: _any_null(["volume", "amount"])),
        ("error", "negative_volume_amount"): (["volume", "amount"], lambda: (F.col("volume") < 0) | (F.col("amount") < 0)),
        ("error", "missing_date"): (["date"], lambda: F.col("date").isNull()),
        ("warning", "missing_industry"): (["industry"], lambda: F.col("industry").isNull()),
        ("warning", "missing_margin"): (["is_margin"], lambda: F.col("is_margin").isNull()),
        ("warning", "missing_prev_close"): (["prev_close_raw", "prev_close_adj"], lambda: _any_null(["prev_close_raw", "prev_close_adj"])),
        ("warning", "missing_valuation"): (["pe_ttm", "pb", "ps_ttm"], lambda: _any_null(["pe_ttm", "pb", "ps_ttm"])),
        ("warning", "zero_volume_amount"): (["volume", "amount"], lambda: (F.col("volume") == 0) | (F.col("amount") == 0)),
    }
    return {k: v() for k, (need, v) in rules.items() if set(need) <= set(columns)}


def panel_issues(panel: DataFrame) -> DataFrame:
    """severity, code, count of each rule that some row breaks; errors first, then by code."""
    found = row_rules(panel.columns)
    counts = panel.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{s}|{code}") for (s, code), c in found.items()])
    wide = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(f"`{s}|{c}`").alias("count")) for s, c in found])).alias("x"))
    keys = panel.groupBy("date", "symbol").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    twice = keys.select(F.lit("error").alias("severity"), F.lit("duplicate_key").alias("code"), "count")
    return wide.select("x.*").unionByName(twice).filter("count > 0").orderBy(F.col("severity") != "error", "code")


def raise_on_errors(issues: DataFrame) -> None:
    """Raises ValueError naming the errors (at most eleven rows come to the driver)."""
    rows = issues.filter("severity = 'error'").limit(20).collect()
    if rows:
        raise ValueError("data quality errors: " + "; ".join(f"{r['code']}:{r['count']}" for r in rows))


def field_audit(panel: DataFrame, fields: list[str]) -> DataFrame:
    """field, non_null_rate, finite_rate, positive_rate, earliest_date, latest_date, status: one aggregation over all fields."""
    have = [f for f in fields if f in panel.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in have:
        x = F.col(f).cast("double")
        aggs += [
            F.count(f).alias(f"{f}|0"),
            F.count_if(finite(x)).alias(f"{f}|1"),
            F.count_if(positive(x)).alias(f"{f}|2"),
            F.min(F.when(F.col(f).isNotNull(), F.col("date"))).alias(f"{f}|3"),
            F.max(F.when(F.col(f).isNotNull(), F.col("date"))).alias(f"{f}|4"),
        ]
    rate = lambda c: F.coalesce(F.try_divide(c, F.col("__n")), F.lit(0.0))
    rows = []
    for f in fields:
        if f in have:
            count = [F.col(f"`{f}|{k}`") for k in range(5)]
            status = F.when(count[0] == 0, "missing").otherwise("ready")
            parts = [rate(count[0]), rate(count[1]), rate(count[2]), count[3], count[4], status]
        else:
            parts = [F.lit(0.0)] * 3 + [F.lit(None).cast("date")] * 2 + [F.lit("missing")]
        names = ["non_null_rate", "finite_rate", "positive_rate", "earliest_date", "latest_date", "status"]
        rows.append(F.struct(F.lit(f).alias("field"), *[p.alias(n) for p, n in zip(parts, names, strict=True)]))
    return panel.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@dataclass(frozen=True)
class Contract:
    name: str
    key: tuple[str, ...]
    date: str | None = None
    minimum: str | None = None
    maximum: str | None = None
    finite: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """rule, violations for each rule of the contract."""
    tests = {"null_key": _any_null(list(contract.key))}
    if contract.date:
        tests["null_date"] = F.col(contract.date).isNull()
        if contract.minimum:
            tests["date_too_early"] = F.col(contract.date) < F.lit(contract.minimum).cast("date")
        if contract.maximum:
            tests["date_too_late"] = F.col(contract.date) > F.lit(contract.maximum).cast("date")
    tests |= {f"{c}_not_finite": ~finite(c) & F.col(c).isNotNull() for c in contract.finite}
    tests |= {f"{c}_negative": F.col(c) < 0 for c in contract.non_negative}
    counts = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in tests])).alias("x")).select("x.*")
    twice = df.groupBy(*contract.key).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit("duplicate_key").alias("rule"), "violations")
    return rows.unionByName(twice)


def require_contract(df: DataFrame, contract: Contract) -> DataFrame:
    broken = contract_violations(df, contract).filter("violations > 0").limit(20).collect()
    if broken:
        raise ValueError(f"{contract.name}: " + ", ".join(f"{r['rule']}={r['violations']}" for r in broken))
    return df


def only_markets(df: DataFrame, markets: tuple[str, ...], symbol: str = "symbol") -> DataFrame:
    return df.filter(market(symbol).isin(*markets))


def require_markets(df: DataFrame, markets: tuple[str, ...], symbol: str = "symbol") -> DataFrame:
    return require_none(df, ~F.coalesce(market(symbol).isin(*markets), F.lit(False)), f"unsupported market in {symbol}")


def weights_sum_to_one(weights: DataFrame, keys: list[str], weight: str, tolerance: float = 1e-12) -> DataFrame:
    """The groups whose weights are not finite, negative or do not sum to one."""
    return (
        weights.groupBy(*keys)
        .agg(F.sum(weight).alias("total"), F.count_if(~finite(weight) | (F.col(weight) < 0)).alias("invalid"))
        .filter((F.abs(F.col("total") - 1) > tolerance) | (F.col("invalid") > 0))
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often (a run compared with its repeat)."""
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)
