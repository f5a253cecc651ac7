"""Prices of holdings, prices that must agree, extended panels and the contract of security events."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelweave.operators import comparison, portfolio, valuation

D = [datetime.date(2000, 1, 3) + datetime.timedelta(i) for i in range(8)]
PANEL = "date date, symbol string, open_adj double, close_adj double"


def test_holdings_are_valued_at_the_last_valid_price(spark):
    rows = [(D[0], "a", 9.0, 10.0), (D[1], "a", None, math.nan), (D[2], "a", -1.0, 12.0), (D[3], "a", 13.0, None), (D[1], "b", 5.0, 0.0), (D[2], "b", 6.0, 7.0)]
    panel = spark.createDataFrame(rows, PANEL).repartition(3)
    held = spark.createDataFrame([(d, "a") for d in D[:6]] + [(D[2], "b"), (D[2], "b")], "date date, symbol string")
    got = {(r["date"], r["symbol"]): (r["opening_price"], r["closing_price"], r["close_date"]) for r in valuation.valuation_prices(held.filter(F.col("date") > D[0]), panel).collect()}
    assert got == {(D[1], "a"): (10.0, 10.0, D[0]), (D[2], "a"): (10.0, 12.0, D[2]), (D[3], "a"): (13.0, 12.0, D[2]), (D[4], "a"): (12.0, 12.0, D[2]), (D[5], "a"): (12.0, 12.0, D[2]), (D[2], "b"): (6.0, 7.0, D[2])}
    first = valuation.valuation_prices(held.filter(F.col("date") == D[0]), panel).first()
    assert (first["opening_price"], first["closing_price"]) == (9.0, 10.0)
    for when, symbol in (("at the close", "b"), ("at the open", "c")):
        with pytest.raises(Exception, match=f"no price {when}"):
            valuation.valuation_prices(spark.createDataFrame([(D[1], symbol)], "date date, symbol string"), panel).collect()
    assert valuation.valuation_prices(held.limit(0), panel).count() == 0


def test_prices_must_agree_exactly(spark):
    one = spark.createDataFrame([(D[0], "a", 1.0), (D[1], "a", 0.1 + 0.2), (D[2], "a", None), (D[3], "a", 4.0)], "date date, symbol string, close_adj double")
    two = spark.createDataFrame([(D[0], "a", 1.0), (D[1], "a", 0.3), (D[4], "a", 9.0)], "date date, symbol string, close_adj double")
    assert sorted((r["date"], r["fault"]) for r in valuation.price_mismatches(one, two).collect()) == [(D[1], "differing"), (D[3], "missing")]
    assert valuation.price_mismatches(one, one).count() == 0


def test_members_need_a_market_value(spark):
    panel = spark.createDataFrame([(D[0], "a", 5.0), (D[0], "b", 0.0), (D[0], "c", math.nan)], "date date, symbol string, total_market_cap double")
    keys = lambda *s: spark.createDataFrame([(D[0], x) for x in s], "date date, symbol string")
    assert valuation.benchmark_members(keys("a"), panel).collect()[0]["market_cap"] == 5.0
    for s in ("b", "c", "z"):
        with pytest.raises(ValueError, match="positive market value"):
            valuation.benchmark_members(keys("a", s), panel)
    with pytest.raises(ValueError, match="duplicate"):
        valuation.benchmark_members(keys("a", "a"), panel)


def test_extended_panels_drop_the_warm_up(spark):
    rows = lambda ds: spark.createDataFrame([(d, "a", 1.0) for d in ds], "date date, symbol string, adv double")
    got = valuation.extended_panel(rows(D[:3]), rows(D[1:6]), start=str(D[3]), end=str(D[5]))
    assert sorted(r["date"] for r in got.collect()) == D[:6]
    for history, extension, end, why in ((D[:4], D[3:5], D[5], "reaches"), (D[:3], D[3:8], D[5], "passes"), (D[:3], [*D[3:5], D[4]], D[5], "duplicate")):
        with pytest.raises(ValueError, match=why):
            valuation.extended_panel(rows(history), rows(extension), start=str(D[3]), end=str(end))


@pytest.mark.parametrize(
    "row, rules",
    [
        (("a", D[0], "stock_merger", "b", 0.5, 0.0), set()),
        (("a", D[0], "cash_exit", None, None, 2.0), set()),
        (("a", D[0], "write_off", " ", 0.0, None), set()),
        (("a", D[0], "stock_merger", "a", 0.5, 0.0), {"merger_terms", "target_is_gone"}),
        (("a", D[0], "stock_merger", "b", 0.0, 0.0), {"merger_terms"}),
        (("a", D[0], "cash_exit", "b", 0.0, 2.0), {"exit_terms"}),
        (("a", D[0], "write_off", None, 0.0, 1.0), {"write_off_terms"}),
        (("a", D[7], "write_off", None, 0.0, 0.0), {"sealed_date"}),
        ((None, D[0], None, None, 0.0, 0.0), {"unknown_type", "missing_key"}),
    ],
)
def test_events_keep_their_contract(spark, row, rules):
    events = spark.createDataFrame([row], "source_symbol string, effective_date date, event_type string, target_symbol string, ratio double, cash_per_share double")
    assert {r["rule"] for r in valuation.event_violations(events, str(D[6])).collect()} == rules


def test_events_of_one_table(spark):
    rows = [("a", D[0], "write_off", None, 0.0, 0.0), ("a", D[0], "write_off", None, 0.0, 0.0), ("b", D[1], "stock_merger", "a", 1.0, 0.0)]
    events = spark.createDataFrame(rows, "source_symbol string, effective_date date, event_type string, target_symbol string, ratio double, cash_per_share double")
    assert sorted(tuple(r) for r in valuation.event_violations(events, str(D[6])).collect()) == [("a", D[0], "duplicate_key"), ("b", D[1], "target_is_gone")]


def test_portfolios_compared(spark):
    rows = [("p", D[0], "a", 1.0), ("p", D[1], "b", 1.0), ("q", D[0], "a", 0.5), ("q", D[0], "b", 0.5), ("q", D[1], "a", 0.5), ("q", D[1], "b", 0.5)]
    targets = spark.createDataFrame(rows, "portfolio_name string, date date, symbol string, target_weight double")
    got = portfolio.compared(targets, portfolio.diagnostics(targets), "p", "q").orderBy("date").collect()
    assert [(r["holding_overlap"], r["turnover_difference"]) for r in got] == [(1.0, 0.0), (1.0, -1.0)]


def test_published_values_must_be_reproduced(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, x double")
    comparison.require_reproduced(df, df, ["k"], ["x"])
    with pytest.raises(ValueError, match="beyond_tolerance"):
        comparison.require_reproduced(df, df.withColumn("x", F.col("x") + 1e-9), ["k"], ["x"])


def test_industries_support_no_conclusion(spark):
    segments = spark.createDataFrame([("industry", "x"), ("market_trend", "up")], "segment_type string, segment string")
    assert valuation.industry_limitation(segments).collect() == [("descriptive_only", "historical_industry_point_in_time_unverified", False, 1)]


def test_fill_statistics(spark):
    rows = [("a", 100, 100), ("a", 200, 50), ("a", 300, 0), ("a", None, 0), ("b", None, None)]
    orders = spark.createDataFrame(rows, "k string, quantity long, fill_quantity long")
    got = {r["k"]: r for r in portfolio.fill_statistics(orders, ["k"]).collect()}
    assert tuple(got["a"])[1:] == (4, 1, 1, 2, 2, 0.25, 0.25, 0.75)
    assert tuple(got["b"])[1:] == (1, 0, 0, 1, 0, 0.0, 0.0, None)
    assert portfolio.fill_statistics(orders.limit(0), ["k"]).count() == 0
    with pytest.raises(Exception, match="beyond its quantity"):
        portfolio.fill_statistics(spark.createDataFrame([("a", 1, 2)], orders.schema), ["k"]).collect()
