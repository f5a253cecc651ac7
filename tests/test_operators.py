"""Hand-made cases: nulls, NaN, ties, short windows, constant inputs, no look-ahead, order independence."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import average_rank, equal_bucket, invalid_ohlc, market, require_unique, safe_return, ticks
from panelweave.functions.statistics import benjamini_hochberg, newey_west, spearman
from panelweave.operators import audits, checks, combination, evaluation, performance, portfolio, supplements, universe
from panelweave.operators.factors import raw_factors
from panelweave.operators.preprocess import preprocess
from panelweave.sources import panel_io

NAN, INF = float("nan"), float("inf")


def day(i):
    return dt.date(2000, 1, 3) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(30):
        price = 10.0 + s
        for i in range(90):
            last, price = price, price * float(np.exp(rng.normal(0, 0.02)))
            ok = (i + s) % 17 != 0
            rows.append((day(i), f"{s:06d}", price, price * 1.01, price * 0.99, price, last, price if ok else None, last, 1000.0 + s, 1e6 + 100 * s if ok else NAN, 0.01 * s, 1e8 * (s + 1), 5.0 + s, 1.0, 2.0, s == 3))
    names = "date symbol open_raw high_raw low_raw close_raw prev_close_raw close_adj prev_close_adj volume amount turnover total_market_cap pe_ttm pb ps_ttm is_st".split()
    df = spark.createDataFrame(rows, names)
    return df.withColumn("open_adj", F.col("open_raw")).withColumn("high_adj", F.col("high_raw")).withColumn("low_adj", F.col("low_raw")).cache()


def test_safe_return_refuses_what_is_not_positive_and_finite(spark):
    rows = [(2.0, 1.0), (1.0, 0.0), (1.0, None), (NAN, 1.0), (INF, 1.0), (-1.0, 1.0), (1.0, -1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(safe_return("a", "b")).collect()]
    assert got == [1.0] + [None] * 6


def test_invalid_ohlc_and_ticks(spark):
    names = [f"{p}_{k}" for k in ("raw", "adj") for p in ("open", "high", "low", "close")]
    good = [1.0, 2.0, 0.5, 1.5] * 2
    rows = [good, [1.0, 0.9, 0.5, 0.8] + good[4:], [None] * 8, [0.0] + good[1:]]
    assert [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(invalid_ohlc()).collect()] == [False, True, False, True]
    assert [r[0] for r in spark.createDataFrame([(1.005,), (2.675,), (1.004,)], "x double").select(ticks("x")).collect()] == [1.01, 2.68, 1.0]


def test_market_classes(spark):
    rows = [("600000",), ("000001",), ("430001",), ("920001",), ("900001",), ("70000",), ("700000",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(market("s")).collect()] == ["sh", "sz", "bj", "bj", "sh", None, None, None]


def test_average_ranks_and_buckets(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 3.0)], "k string, x double")
    assert sorted(r[0] for r in df.select(average_rank("x", ["k"])).collect()) == [1.0, 2.5, 2.5, 4.0]
    got = spark.range(7).select(equal_bucket(F.col("id") + 1, F.lit(7), 5)).collect()
    assert [r[0] for r in got] == [i * 5 // 7 + 1 for i in range(7)]


def test_spearman_reasons(spark):
    rows = [("few", 1.0, 1.0)] * 2 + [("flat", 1.0, float(i)) for i in range(5)] + [("same", float(i), 2.0) for i in range(5)]
    rows += [("ok", float(i), float(-i)) for i in range(5)] + [("none", None, 1.0), ("none", NAN, 1.0)]
    got = {r["k"]: (r["n_obs"], r["rank_ic"], r["reason"]) for r in spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 3).collect()}
    assert got["few"] == (2, None, "insufficient_observations") and got["none"] == (0, None, "insufficient_observations")
    assert got["flat"] == (5, None, "constant_score") and got["same"] == (5, None, "constant_forward_return")
    assert got["ok"][0] == 5 and math.isclose(got["ok"][1], -1.0)


def test_newey_west_by_hand(spark):
    x = np.array([0.1, -0.2, 0.3, 0.05, 0.2, 0.4, -0.1])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 1.0), ("flat", 0, 1.0), ("flat", 1, 1.0)], "k string, o int, v double")
    got = {r["k"]: r for r in newey_west(df, ["k"], "o", "v", F.lit(2)).collect()}
    e = x - x.mean()
    lrv = e @ e / 7 + sum(2 * (1 - k / 3) * (e[k:] @ e[:-k]) / 7 for k in (1, 2))
    t = x.mean() / math.sqrt(lrv / 7)
    assert math.isclose(got["a"]["t"], t) and math.isclose(got["a"]["p"], math.erfc(abs(t) / math.sqrt(2)))
    assert got["one"]["reason"] == "insufficient_observations" and got["flat"]["reason"] == "non_positive_long_run_variance"


def test_false_discovery_steps(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 1.5)], "n string, p double")
    got = {r["n"]: r["q"] for r in benjamini_hochberg(df, "p", ["n"]).collect()}
    assert got["d"] is None and got["e"] is None
    assert [round(got[k], 6) for k in "acb"] == [0.03, 0.04, 0.04]


def test_factors_skip_invalid_rows(spark, panel):
    got = {(r["symbol"], r["date"]): r for r in raw_factors(panel, ["reversal_5", "volatility_20"]).collect()}
    src = sorted((r for r in panel.filter("symbol = '000002'").collect()), key=lambda r: r["date"])
    valid = [r for r in src if r["close_adj"] is not None and r["amount"] == r["amount"]]
    for i, r in enumerate(valid):
        want = r["close_adj"] / valid[i - 5]["close_adj"] - 1 if i >= 5 else None
        have = got["000002", r["date"]]["reversal_5"]
        assert (have is None) == (want is None) and (want is None or math.isclose(have, want))
        if i >= 19:
            w = [v["close_adj"] / v["prev_close_adj"] - 1 for v in valid[i - 19 : i + 1]]
            assert math.isclose(got["000002", r["date"]]["volatility_20"], np.std(w, ddof=1) * math.sqrt(252))
    assert all(got["000002", r["date"]]["reversal_5"] is None for r in src if r not in valid)


def test_no_look_ahead_and_order_independence(spark, panel):
    cut = day(60)
    changed = panel.withColumn("close_adj", F.when(F.col("date") > cut, F.col("close_adj") * 3).otherwise(F.col("close_adj"))).repartition(7, "volume")
    for f in (lambda p: raw_factors(p, ["momentum_60", "amihud_20"]), lambda p: universe.research_universe(p, minimum_history=10, size=20).select("date", "symbol", "is_eligible", "liquidity_rank")):
        a, b = (f(p).filter(F.col("date") <= cut) for p in (panel, changed))
        assert checks.same_rows(a, b)


def test_universes_rank_differently(panel):
    simple = universe.simple_universe(panel, minimum_history=5, lookback=3, size=30).filter("symbol = '000003'")
    assert simple.filter("liquidity_rank IS NOT NULL").count() > 0 and simple.filter("is_eligible").count() == 0
    assert universe.research_universe(panel, minimum_history=5, lookback=3, size=30).filter("symbol = '000003' AND liquidity_rank IS NOT NULL").count() == 0


def test_preprocess_reasons(spark):
    d = day(0)
    rows = [(d, f"{i:06d}", "bp", "value", float(i) if i < 10 else None) for i in range(11)] + [(d, f"{i:06d}", "sp_ttm", "value", 1.0) for i in range(5)]
    rows += [(d, f"{i:06d}", "log_market_cap", "size", float(i % 4)) for i in range(8)] + [(d, "000001", "ep_ttm", "value", 1.0), (d, "000002", "ep_ttm", "value", NAN)]
    got = {(r["factor_name"], r["symbol"]): r for r in preprocess(spark.createDataFrame(rows, "date date, symbol string, factor_name string, family string, raw_value double")).collect()}
    assert got["bp", "000010"]["preprocessing_reason"] == "missing_raw_value"
    assert got["bp", "000009"]["preprocessing_reason"] == "missing_size_score" and got["bp", "000009"]["score"] is not None
    assert got["sp_ttm", "000000"]["preprocessing_reason"] == "zero_score_variance"
    assert got["ep_ttm", "000001"]["preprocessing_reason"] == "insufficient_valid_values" and got["ep_ttm", "000002"]["preprocessing_reason"] == "non_finite_raw_value"
    x = np.array([-float(i % 4) for i in range(8)])
    y = np.clip(np.arange(10.0), *np.quantile(np.arange(10.0), [0.01, 0.99]))
    y = ((y - y.mean()) / y.std())[:8]
    e = y - y.mean() - np.cov(x, y, ddof=0)[0, 1] / x.var() * (x - x.mean())
    assert np.allclose([got["bp", f"{i:06d}"]["score_size_neutral"] for i in range(8)], e / e.std())


def test_turnover_of_tops(spark):
    rows = [(day(0), f"{i:06d}", "bp", "value", float(i), None) for i in range(10)] + [(day(31), f"{i:06d}", "bp", "value", float(-i), None) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, symbol string, factor_name string, family string, score double, score_size_neutral double")
    got = {r["date"]: r["turnover"] for r in evaluation.top_turnover(df).filter("score_variant = 'score'").collect()}
    assert got == {day(0): None, day(31): 1.0}


def test_buffer_keeps_members(spark):
    rows = [("m", day(30 * k), f"{i:06d}", 1, i + 1 if k == 0 else 10 - i) for k in range(2) for i in range(10)]
    ranked = spark.createDataFrame(rows, "method string, date date, symbol string, size_group int, group_rank int")
    got = portfolio.buffered_portfolio(ranked, per_group=2, buffer_rank=9, name="b").collect()
    second = {r["symbol"] for r in got if r["date"] == day(30)}
    assert second == {"000001", "000009"}  # 000001 stays at rank 9, 000000 fell to 10, 000009 is best of the rest


def test_orders_respect_limits_and_lots(spark):
    t = spark.createDataFrame([("p", day(0), "000001", 0.5), ("p", day(0), "000002", 0.5)], "portfolio_name string, date date, symbol string, target_weight double")
    q = spark.createDataFrame([(day(1), "000001", 11.0, 10.0, 0.1, 1e6, False), (day(1), "000002", 10.0, 10.0, 0.1, 1e6, False)], "date date, symbol string, open_raw double, prev_close_raw double, limit_rate double, adv double, is_suspended boolean")
    cal = spark.createDataFrame([(day(0), day(1)), (day(1), None)], "date date, next_date date")
    got = {r["symbol"]: r for r in portfolio.rebalance_orders(t, q, cal, capital=100000.0).collect()}
    assert got["000001"]["reason"] == "limit_up_buy" and got["000001"]["fill_quantity"] == 0
    assert got["000002"]["quantity"] == 5000 and got["000002"]["fill_quantity"] == 5000


def test_fee_rules_must_cover(spark):
    rules = spark.createDataFrame([(day(0), day(4), "sh"), (day(3), day(6), "sh")], "start date, end date, market string")
    got = {r["day"]: r["rules"] for r in portfolio.uncovered_days(rules, str(day(0)), str(day(8)), ["market"]).collect()}
    assert got == {day(3): 2, day(4): 2, day(7): 0, day(8): 0}


def test_benchmark_by_hand(spark):
    prices = spark.createDataFrame([(day(0), "a", 1.0), (day(1), "a", 2.0), (day(3), "a", 4.0), (day(0), "b", 1.0), (day(2), "b", 3.0), (day(3), "b", 3.0)], "date date, symbol string, close_adj double")
    members = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 3.0), (day(2), "b", 1.0)], "date date, symbol string, market_cap double")
    got = {r["date"]: (round(r["equal_weight"], 6), round(r["cap_weight"], 6), r["member_count"]) for r in performance.universe_benchmark(prices, members, prices.select("date").distinct()).collect()}
    assert got == {day(0): (1.0, 1.0, 0), day(1): (1.5, 1.25, 2), day(2): (2.5, 2.75, 2), day(3): (2.5, 2.75, 1)}


def test_regression_equals_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [0.3, -0.2] + rng.normal(size=40)
    df = spark.createDataFrame([(day(0), f"{i:06d}", *map(float, x[i]), float(y[i])) for i in range(40)], "date date, symbol string, u double, v double, y double")
    got = {r["factor_name"]: r for r in performance.monthly_regressions(df, ["u", "v"], "y", 10).collect()}
    z = np.column_stack([np.ones(40), (x - x.mean(0)) / x.std(0, ddof=1)])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    assert np.allclose([got["u"]["coefficient"], got["v"]["coefficient"]], beta[1:])
    assert math.isclose(got["u"]["r_squared"], 1 - ((y - z @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_bootstrap_is_repeatable(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("k", day(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0.001, 0.01, (60, 2)))], "k string, date date, strategy double, benchmark double")
    run = lambda d: performance.block_bootstrap(d, ["k"], years=1.0, block=5, replications=120, seed=3).collect()
    a, b = run(df), run(df.repartition(5))
    assert a == b and a[0]["annual_return_low"] < a[0]["annual_return"] < a[0]["annual_return_high"]


def test_contract_and_duplicates(spark):
    df = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "a", -1.0), (None, "b", NAN)], "date date, symbol string, x double")
    got = {r["rule"]: r["violations"] for r in checks.contract_violations(df, checks.Contract("t", ("date", "symbol"), "date", finite=("x",), non_negative=("x",))).collect()}
    assert got == {"null_key": 1, "null_date": 1, "x_not_finite": 1, "x_negative": 1, "duplicate_key": 1}
    with pytest.raises(ValueError):
        require_unique(df, ["date", "symbol"])


def test_actions(spark):
    a = spark.createDataFrame([("1", day(0), day(1), 0.5, None, "x"), ("2", day(0), day(1), 0.0, 0.0, "x"), ("x1", day(0), day(1), 1.0, 0.0, "x")], "symbol string, ex_date date, effective_date date, cash_per_share double, share_ratio double, source string")
    n = audits.normalize_actions(a, "2000-01-01", "2000-12-31")
    assert n.count() == 3 and audits.invalid_actions(n).count() == 2 and n.select("action_id").distinct().count() == 3
    more = a.withColumn("source", F.lit("y")).withColumn("effective_date", F.when(F.col("symbol") == "2", F.date_add("effective_date", 1)).otherwise(F.col("effective_date")))
    assert audits.merge_actions(a, more).count() == 4


def test_verdicts_and_gate(spark):
    reg = spark.createDataFrame([("portfolio_baseline", "portfolio"), ("v", "portfolio"), ("w", "portfolio"), ("gone", "execution")], "experiment_id string, category string")
    res = spark.createDataFrame([("portfolio_baseline", "ready", "annual_return", 0.1), ("v", "ready", "annual_return", 0.11), ("w", "ready", "annual_return", 0.2)], "experiment_id string, status string, metric string, value double")
    table = audits.verdicts(res, reg)
    assert {r["experiment_id"]: r["interpretation"] for r in table.collect()} == {"portfolio_baseline": "stable", "v": "stable", "w": "sensitive", "gone": "failed"}
    assert audits.protocol_gate(table).first()["status"] == "incomplete"


def test_csv_pairs_and_partitions(spark, tmp_path):
    import os

    for kind, headers in (("raw", panel_io.RAW_HEADERS), ("adj", panel_io.ADJUSTED_HEADERS)):
        os.makedirs(tmp_path / kind)
        for i in range(2):
            lines = [",".join(headers)]
            for code in ("1", "600000"):
                values = {"日期": str(day(i)), "代码": code, "是否ST": "否", "上市时间": "1999-01-01", "退市时间": "-", "总股本（股）": "7"}
                lines.append(",".join(values.get(h, "2.5") for h in headers))
            (tmp_path / kind / f"{day(i)}_x.csv").write_text("\n".join(lines))
    both = panel_io.read_daily_pairs(spark, str(tmp_path / "raw"), str(tmp_path / "adj"))
    assert both.count() == 4 and {r["symbol"] for r in both.collect()} == {"000001", "600000"}
    assert both.select("is_st").distinct().collect()[0][0] is False
    panel_io.write_panel(both, str(tmp_path / "out"))
    assert panel_io.scan_panel(spark, str(tmp_path / "out"), str(day(0)), str(day(0)), ["date", "symbol"]).count() == 2
    good, log = panel_io.quarantine(both)
    assert good.count() == 4 and log.count() == 0
    assert {(r["list_date"], r["delist_date"], r["total_shares"], r["is_margin"]) for r in both.collect()} == {(dt.date(1999, 1, 1), None, 7, None)}
    sides = str(tmp_path / "raw"), str(tmp_path / "adj")
    years, records = panel_io.build_panel(spark, *sides, f"file://{tmp_path}/built", str(day(0)), str(day(1)), markets=("sh",))
    assert [(r["year"], r["rows"]) for r in years.collect()] == [(2000, 2)]
    assert {(r["date"], r["code"], r["count"]) for r in records.filter("code LIKE 'outside%'").collect()} == {(day(0), "outside_supported_markets_excluded", 1), (day(1), "outside_supported_markets_excluded", 1)}
    with pytest.raises(ValueError, match="no_rows_left"):
        panel_io.build_panel(spark, *sides, f"file://{tmp_path}/none", str(day(0)), str(day(1)), markets=("bj",))
    with pytest.raises(ValueError, match="precedes"):
        panel_io.build_panel(spark, *sides, f"file://{tmp_path}/none", str(day(1)), str(day(0)))
    late = tmp_path / "adj" / f"{day(1)}_x.csv"
    late.rename(tmp_path / "adj" / f"{day(2)}_x.csv")
    with pytest.raises(ValueError, match="not that of its file"):
        panel_io.read_daily_pairs(spark, *sides, panel_io.FILE_DATE)
    with pytest.raises(ValueError, match="unpaired"):
        panel_io.discover_pairs(spark, *sides, str(day(0)), str(day(5)))
    (tmp_path / "adj" / f"{day(2)}_x.csv").unlink()
    with pytest.raises(ValueError, match="keys differ"):
        panel_io.read_daily_pairs(spark, *sides)


def test_scans_and_sinks(spark, panel, tmp_path):
    two = spark.createDataFrame([("000001",), ("000002",), ("000002",)], "symbol string")
    assert panel_io.scan_symbols(panel, two).select("symbol").distinct().count() == 2 and panel_io.scan_symbols(panel, two).count() == 180
    assert panel_io.require_range(panel, str(day(0)), str(day(89))) is panel
    with pytest.raises(ValueError):
        panel_io.require_range(panel, str(day(0)), str(day(88)))
    panel_io.write_families(panel.limit(9).withColumn("family", F.lit("value")), str(tmp_path / "families"))
    assert spark.read.parquet(str(tmp_path / "families")).filter("family = 'value'").count() == 9
    panel.select("date", "symbol").write.parquet(str(tmp_path / "kept"))
    assert panel_io.read_verified(spark, str(tmp_path / "kept"), rows=2700, start=str(day(0)), end=str(day(89))).count() == 2700
    for rows, end in ((2699, day(89)), (2700, day(88))):
        with pytest.raises(ValueError):
            panel_io.read_verified(spark, str(tmp_path / "kept"), rows=rows, start=str(day(0)), end=str(end))
    with pytest.raises(ValueError):
        checks.require_markets(panel, ("sh",))
    with pytest.raises(ValueError, match="invalid_ohlc"):
        checks.raise_on_errors(checks.panel_issues(panel.withColumn("low_adj", F.lit(1e9))))
    assert frozenset(r["symbol"] for r in audits.first_of_each(panel, ["symbol"], [F.desc("date")]).filter(F.col("date") == day(89)).collect()) == frozenset(f"{s:06d}" for s in range(30))


def test_overrides_and_actions(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, x int")
    over = spark.createDataFrame([("b", 5)], "k string, x int")
    assert {(r["k"], r["x"]) for r in audits.overridden(rows, over, ["k"], "x", replace=False).collect()} == {("a", 1), ("b", 5)}
    for bad in ([("a", 2)], [("c", 1)], [("b", 1), ("b", 2)]):
        with pytest.raises(ValueError):
            audits.overridden(rows, spark.createDataFrame(bad, "k string, x int"), ["k"], "x", replace=False)
    held = spark.createDataFrame([("s", 5), ("t", 15), ("u", 3)], "symbol string, shares long")
    acts = spark.createDataFrame([("1", "s", 0.5, 0.1), ("2", "t", 0.0, 0.1), ("3", "v", 1.0, 1.0)], "action_id string, symbol string, cash_per_share double, share_ratio double")
    assert {(r["symbol"], r["shares"], r["cash"]) for r in audits.apply_actions(held, acts).collect()} == {("s", 6, 2.5), ("t", 16, 0.0), ("u", 3, 0.0)}
    with pytest.raises(ValueError):
        audits.apply_actions(held, acts, acts.select("action_id").limit(1))


def test_halves_round_to_even(spark):
    held = spark.createDataFrame([("s", 5), ("t", 7)], "symbol string, shares long")
    acts = spark.createDataFrame([("1", "s", 0.0, 0.5), ("2", "t", 0.0, 0.5)], "action_id string, symbol string, cash_per_share double, share_ratio double")
    assert {r["symbol"]: r["shares"] for r in audits.apply_actions(held, acts).collect()} == {"s": 8, "t": 10}


def test_fees_need_one_rule(spark):
    trades = spark.createDataFrame([("600000", day(1), "buy", 100, 1000.0, 1.0, 1.0), ("430001", day(1), "buy", 100, 1000.0, 1.0, 1.0)], "symbol string, date date, side string, fill_quantity long, amount double, slippage_cost double, impact_cost double")
    stamp = spark.createDataFrame([(day(0), day(9), 0.0, 0.001)], "start date, end date, buy_rate double, sell_rate double")
    fee = spark.createDataFrame([(day(0), day(9), "sh", "amount", 0.0001, 0.0)], "start date, end date, market string, basis string, rate double, minimum double")
    assert portfolio.with_fees(trades.filter("symbol = '600000'"), stamp, fee).first()["total_cost"] == pytest.approx(5.0 + 0.1 + 2.0)
    with pytest.raises(Exception, match="no transfer fee rule for 430001"):
        portfolio.with_fees(trades, stamp, fee).collect()
    with pytest.raises(ValueError, match="overlap"):
        portfolio.with_fees(trades, stamp.unionByName(stamp), fee)


def test_a_turnover_of_one_half_is_no_warning(spark):
    rows = [("p", day(0), f"{i}", 1 / 6) for i in range(6)] + [("p", day(30), f"{i + 3}", 1 / 6) for i in range(6)]
    d = portfolio.diagnostics(spark.createDataFrame(rows, "portfolio_name string, date date, symbol string, target_weight double"))
    assert {r["date"]: r["one_way_turnover"] for r in d.collect()}[day(30)] == 0.5


def test_positions_are_held_to_the_end(spark):
    bars = spark.createDataFrame([(day(i), "a", 1.0 + i) for i in range(0, 60, 5)], "date date, symbol string, close_raw double")
    targets = spark.createDataFrame([("p", day(10), "a", 1.0)], "portfolio_name string, date date, symbol string, target_weight double")
    got = audits.marked_positions(targets, bars, universe.next_dates(bars)).collect()
    assert sorted(r["date"] for r in got) == [day(i) for i in range(10, 60, 5)]


def test_gates(spark):
    registry = [(n, f, "candidate", "score_size_neutral") for f, ns in combination.CANDIDATES.items() for n in ns]
    schema = "factor_name string, family string, classification string, primary_score_variant string"
    assert supplements.require_registry(spark.createDataFrame([*registry, ("bp", "value", "watch", "score")], schema)).count() == 7
    for bad in (registry[1:], [*registry, ("bp", "value", "candidate", "score_size_neutral")], [(*registry[0][:1], "size", *registry[0][2:]), *registry[1:]]):
        with pytest.raises(ValueError):
            supplements.require_registry(spark.createDataFrame(bad, schema))
    prices = spark.createDataFrame([(day(1), "a")], "date date, symbol string")
    schema = "signal_date date, execution_date date, symbol string, target_weight double"
    assert supplements.require_targets(spark.createDataFrame([(day(0), day(1), "a", 1.0)], schema), prices).count() == 1
    for bad in ([(day(1), day(1), "a", 1.0)], [(day(0), day(2), "a", 1.0)], [(day(0), day(1), "a", 0.5)] * 2):
        with pytest.raises(ValueError):
            supplements.require_targets(spark.createDataFrame(bad, schema), prices)
    weights = spark.createDataFrame([(day(0), "a", 1.0)], "date date, symbol string, target_weight double")
    with pytest.raises(ValueError, match="cross"):
        supplements.continuous_targets(weights, weights, start=str(day(0)), end=str(day(9)))
    with pytest.raises(ValueError, match="labels"):
        supplements.redundancy_input_violations(weights.withColumn("forward_return_5", F.lit(1.0)), start="2000-01-01", end="2000-12-31")
    index = spark.createDataFrame([("i", day(1), 2.0, 1.0), ("i", day(2), 3.0, 2.0)], "index string, date date, close double, preclose double")
    days = spark.createDataFrame([(day(i),) for i in range(4)], "date date")
    assert [(r["date"], r["i"]) for r in supplements.index_levels(index, days, ["i"]).orderBy("date").collect()] == [(day(0), 1.0), (day(1), 2.0), (day(2), 3.0)]
    with pytest.raises(ValueError):
        supplements.index_levels(index.filter(F.col("date") == day(1)).unionByName(index.withColumn("date", F.lit(day(3))).limit(1)), days, ["i"])
    nav = spark.createDataFrame([("c", day(i), 1.0 + i, 1.0 + i, 0.0) for i in range(4)], "candidate string, date date, nav double, zero_cost_nav double, cash double")
    with pytest.raises(ValueError, match="boundary"):
        supplements.slice_metrics(nav, nav.withColumn("amount", F.lit(1.0)), ["candidate"], boundary=str(day(9)), start=str(day(9)), end=str(day(99)))


def test_variants_and_evidence(spark, tmp_path):
    base = {"portfolio_size": 10, "buffer_rank": 4, "universe_size": 25, "rebalance_months": 1}
    assert supplements.variant_parameters(base, {"v": {"buffer_rank": 2}})["v"]["buffer_rank"] == 2
    for bad in ({"buffer_rank": 4}, {"buffer_rank": 2, "universe_size": 9}, {"other": 1}):
        with pytest.raises(ValueError):
            supplements.variant_parameters(base, {"v": bad})
    (tmp_path / "e.csv").write_text("symbol,day\n000001,2000-01-03\n")
    got = panel_io.read_evidence(spark, str(tmp_path / "e.csv"), "symbol string, day date").collect()
    assert [tuple(r) for r in got] == [("000001", day(0))]
    with pytest.raises(Exception):
        panel_io.read_evidence(spark, str(tmp_path / "e.csv"), "symbol string, other date").collect()
    sums = supplements.target_violations(spark.createDataFrame([("p", day(0), "a", -0.5), ("p", day(0), "b", 1.5)], "portfolio_name string, date date, symbol string, target_weight double"), ["portfolio_name"], names=3)
    assert {r["rule"]: r["violations"] for r in sums.collect()} == {"other_count": 1, "other_sum": 0, "bad_weight": 1}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from panelweave.sources.stage import scratch_dir

    session = lambda base, master: SimpleNamespace(conf={"spark.checkpoint.dir": base} if base else {}, sparkContext=SimpleNamespace(master=master, applicationId="app"))
    assert scratch_dir(session("s3://b/x/", "yarn")) == "s3://b/x/panelweave-app"
    assert scratch_dir(session(None, "local[4]")).startswith("file:///")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(session(None, "yarn"))


def test_event_stream_equals_batch(spark, tmp_path):
    from panelweave.streaming.events import windowed_events

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = windowed_events(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert checks.same_rows(spark.table("windows").select("window_start", "event_type", "n"), windowed_events(events).select("window_start", "event_type", "n"))
