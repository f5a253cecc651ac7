"""Buys under a limit of cash, scenarios, figures of a report, comparisons, catalogues, and the folds that replaced Python groups."""

import datetime
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import catalogue, comparison, performance, portfolio, sizing
from panelweave.operators.delivery import Selection, resolve
from panelweave.operators.factors import FACTORS

DAY = datetime.date(2000, 1, 3)
WISH = "portfolio_name string, date date, symbol string, quantity long, price double"
CASH = "portfolio_name string, date date, available_cash double"


def buy(rows, cash, lot):
    """The rule, request by request, in exact numbers."""
    price = {s: Fraction(str(p)) for s, _, p in rows}
    wish = {s: q for s, q, _ in rows}
    cash = Fraction(str(cash))
    value = sum(wish[s] * price[s] for s in wish)
    if value <= cash:
        return wish, cash - value
    got = {s: math.floor(Fraction(wish[s]) * cash / value / lot) * lot for s in wish}
    left = cash - sum(got[s] * price[s] for s in got)
    for s in sorted(wish, key=lambda s: (-(wish[s] - got[s]) * price[s], s)):
        if got[s] + lot <= wish[s] and price[s] * lot <= left:
            got[s] += lot
            left -= price[s] * lot
    return got, left


@pytest.mark.parametrize("lot", [1, 100])
def test_proportional_buys_equal_the_rule(spark, lot):
    r = random.Random(lot)
    wishes, cash, want = [], [], {}
    for k in range(60):
        rows = [(f"{i:06d}", r.randint(0, 40) * lot, r.choice([1.5, 9.99, 12.3456, 100.0, 0.0001])) for i in range(r.randint(1, 12))]
        have = r.choice([0.0, 1e9, round(r.uniform(0, 30_000 * lot), 2)])
        name = f"p{k}"
        wishes += [(name, DAY, *x) for x in rows]
        cash.append((name, DAY, have))
        got, left = buy(rows, have, lot)
        want |= {(name, s): (q, float(left)) for s, q in got.items()}
    out = sizing.proportional_buys(spark.createDataFrame(wishes, WISH), spark.createDataFrame(cash, CASH), lot=lot)
    got = {(x["portfolio_name"], x["symbol"]): (x["allocated"], x["cash_left"]) for x in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_proportional_buys_pass_over_what_does_not_fit(spark):
    wishes = [("p", DAY, "a", 200, 60.0), ("p", DAY, "b", 200, 5.0), ("p", DAY, "c", 200, 5.0)]
    got = sizing.proportional_buys(spark.createDataFrame(wishes, WISH), spark.createDataFrame([("p", DAY, 1_600.0)], CASH)).collect()
    # The dear lot (6,000) does not fit; the cheaper ones still do, in order of their symbols.
    assert {r["symbol"]: r["allocated"] for r in got} == {"a": 0, "b": 100, "c": 100} and got[0]["cash_left"] == 600.0


@pytest.mark.parametrize("wish, cash", [((-100, 1.0), 5.0), ((100, 0.0), 5.0), ((100, None), 5.0), ((100, 1.0), -1.0), ((100, 1.0), None)])
def test_invalid_requests_raise(spark, wish, cash):
    wishes = spark.createDataFrame([("p", DAY, "a", *wish)], WISH)
    money = spark.createDataFrame([("p", DAY, cash)] if cash is not None else [], CASH)
    with pytest.raises(Exception, match="invalid buy request|negative cash|no cash entry"):
        sizing.proportional_buys(wishes, money).collect()
    assert sizing.proportional_buys(wishes.limit(0), money).count() == 0


BASE = {"participation": 0.1, "fixed_bps": 5.0, "impact_bps": 10.0, "reference": 0.01, "most_bps": 50.0, "commission": 0.0003, "least": 5.0}


def test_scenarios_are_registered(spark):
    table = sizing.execution_scenarios(spark, BASE, [("zero", "execution", {"cost_mode": "zero"}), ("big", "execution", {"participation": 0.2}), ("other", "portfolio", {"any": 1})])
    got = {r["scenario"]: r.asDict() for r in table.collect()}
    assert set(got) == {"baseline", "zero", "big"}
    assert got["zero"]["fee_scale"] == 0.0 and got["zero"]["fixed_bps"] == 0.0 and got["big"]["participation"] == 0.2 and got["big"]["fixed_bps"] == 5.0
    for bad, why in (({"speed": 1}, "unsupported execution"), ({"cost_mode": "half"}, "unsupported cost mode")):
        with pytest.raises(ValueError, match=why):
            sizing.execution_scenarios(spark, BASE, [("x", "execution", bad)])
    with pytest.raises(ValueError, match="twice"):
        sizing.execution_scenarios(spark, BASE, [("x", "execution", {}), ("x", "execution", {})])
    with pytest.raises(ValueError, match="baseline needs"):
        sizing.execution_scenarios(spark, {}, [])


def test_every_scenario_equals_a_run_of_its_own(spark):
    r = random.Random(3)
    rows = [("p", DAY, DAY, f"{600000 + i}", r.choice(["buy", "sell"]), r.randint(1, 50) * 100, round(r.uniform(1, 50), 2), round(r.uniform(1e4, 1e6), 2), r.choice([None, None, "limit_up_buy"])) for i in range(40)]
    planned = spark.createDataFrame(rows, "portfolio_name string, signal_date date, date date, symbol string, side string, quantity long, open_raw double, adv double, reason string")
    stamp = spark.sql("SELECT DATE'1999-01-01' AS start, DATE'2001-01-01' AS end, 0.0D AS buy_rate, 0.001D AS sell_rate")
    transfer = spark.sql("SELECT DATE'1999-01-01' AS start, DATE'2001-01-01' AS end, 'sh' AS market, 'shares' AS basis, 0.001D AS rate, 1.0D AS minimum")
    table = sizing.execution_scenarios(spark, BASE, [("dear", "execution", {"commission": 0.01, "fixed_bps": 30.0}), ("wide", "execution", {"participation": 0.5}), ("free", "execution", {"cost_mode": "zero"})])
    orders, trades = sizing.scenario_trades(planned, table, stamp, transfer)
    got = {(x["scenario"], x["symbol"]): (x["fill_quantity"], x["total_cost"]) for x in trades.collect()}
    for s in table.collect():
        own = portfolio.priced(portfolio.filled(planned, participation=s["participation"]), **{k: s[k] for k in ("fixed_bps", "impact_bps", "reference", "most_bps")})
        own = portfolio.with_fees(own, stamp, transfer, commission=s["commission"], least=s["least"], scale=s["fee_scale"]).collect()
        assert {x["symbol"]: (x["fill_quantity"], x["total_cost"]) for x in own} == {k[1]: v for k, v in got.items() if k[0] == s["scenario"]}
    summary = {x["scenario"]: x for x in sizing.scenario_summary(orders, trades).collect()}
    assert summary["free"]["total_cost"] == 0.0 and summary["baseline"]["cost_rate_delta"] == 0.0
    assert summary["dear"]["cost_rate_delta"] > 0 > summary["free"]["cost_rate_delta"]
    assert summary["wide"]["unfilled_rate"] < summary["baseline"]["unfilled_rate"]


def test_buffered_portfolio_equals_month_by_month(spark):
    r = random.Random(5)
    rows = []
    for name, m in itertools.product(("a", "b"), range(14)):
        symbols = [f"s{i:02d}" for i in range(30)]
        r.shuffle(symbols)
        for g in range(3):
            rows += [(name, datetime.date(2000 + m // 12, m % 12 + 1, 28), s, g + 1, i + 1) for i, s in enumerate(symbols[g * 10 : g * 10 + r.randint(1, 10)])]
    ranked = spark.createDataFrame(rows, "method string, date date, symbol string, size_group int, group_rank int").repartition(7)
    got = portfolio.buffered_portfolio(ranked, per_group=2, buffer_rank=5, name="x")
    want = set()
    for name in ("a", "b"):
        held = set()
        for d in sorted({x[1] for x in rows}):
            now = set()
            for g in (1, 2, 3):
                month = sorted((x[4], x[2]) for x in rows if x[:2] == (name, d) and x[3] == g and x[4] <= 5)
                order = [x for x in month if x[1] in held] + [x for x in month if x[1] not in held]
                now |= {(s, g, i) for i, s in order[:2]}
            held = {s for s, _, _ in now}
            want |= {(name, d, s, g, i, 1 / len(now)) for s, g, i in now}
    assert {(x["method"], x["date"], x["symbol"], x["size_group"], x["group_rank"], x["target_weight"]) for x in got.collect()} == want
    assert not any("Python" in x or "Pandas" in x for x in [got._jdf.queryExecution().toString()])
    assert portfolio.buffered_portfolio(ranked.limit(0), per_group=2, buffer_rank=5, name="x").count() == 0


def test_bootstrap_equals_block_by_block(spark):
    import hashlib

    r = np.random.default_rng(2)
    n, block, reps = 47, 6, 40
    s, b = r.normal(0.001, 0.02, n), r.normal(0.0, 0.02, n)
    rows = [("p", DAY + datetime.timedelta(i), float(s[i]), float(b[i])) for i in range(n)]
    pairs = spark.createDataFrame(rows, "pair string, date date, strategy double, benchmark double")
    got = performance.block_bootstrap(pairs, ["pair"], years=1.5, block=block, replications=reps, seed=9).first()

    def figures(at):
        x, total = s[at], np.log1p(s[at]).sum()
        return math.expm1(total / 1.5), math.expm1((total - np.log1p(b[at]).sum()) / 1.5), x.mean() / x.std(ddof=1) * math.sqrt(252)

    draws = []
    for i in range(reps):
        starts = [int(hashlib.md5(f"9:{i}:{j}".encode()).hexdigest()[:12], 16) % n for j in range(-(-n // block))]
        draws.append(figures(np.array([(a + o) % n for a in starts for o in range(block)])[:n]))
    point = figures(np.arange(n))
    for k, name in enumerate(("annual_return", "annual_relative_return", "sharpe")):
        low, high = np.quantile([d[k] for d in draws], [0.025, 0.975])
        assert np.allclose([got[name], got[f"{name}_low"], got[f"{name}_high"]], [point[k], low, high], atol=1e-10)
    assert got["relative_non_positive_share"] == np.mean([d[1] <= 1e-15 for d in draws])
    long = performance.block_bootstrap(pairs, ["pair"], years=1.5, block=1000, replications=3, seed=9).first()
    assert abs(long["annual_return_low"] - point[0]) < 1e-10  # one block is the whole series, turned round
    assert performance.block_bootstrap(pairs.limit(0), ["pair"], years=1.5, block=5, replications=3, seed=9).count() == 0
    for bad in (-1.0, math.nan, None):
        odd = pairs.withColumn("strategy", F.when(F.col("date") == DAY, F.lit(bad)).otherwise(F.col("strategy")))
        with pytest.raises(Exception, match="cannot be compounded"):
            performance.block_bootstrap(odd, ["pair"], years=1.5, block=5, replications=3, seed=9).collect()
    with pytest.raises(ValueError):
        performance.block_bootstrap(pairs, ["pair"], years=1.5, block=0, replications=3, seed=9)


def test_figures_of_a_report(spark):
    t = spark.createDataFrame([("a", 1, 2.0, True), ("a", 2, None, False), ("b", None, 6.0, True)], "k string, n int, x double, ok boolean")
    picks = [
        Selection("rows", "t", "count"), Selection("rows_a", "t", "count", where={"k": "a"}), Selection("kinds", "t", "n_unique", "n"), Selection("kinds_a", "t", "n_unique", "n", where={"k": "a"}),
        Selection("mean", "t", "mean", "x"), Selection("ratio", "t", "sum_ratio", "x", "n"), Selection("ratio_none", "t", "sum_ratio", "x", "n", where={"k": "z"}),
        Selection("one", "t", "value", "x", where={"k": "b", "ok": True}), Selection("null", "t", "value", "x", where={"n": 2}),
    ]
    got = {r["name"]: r["value"] for r in resolve({"t": t}, picks).collect()}
    assert got == {"rows": 3.0, "rows_a": 2.0, "kinds": 3.0, "kinds_a": 2.0, "mean": 4.0, "ratio": 8 / 3, "ratio_none": None, "one": 6.0, "null": None}
    for where, n in (({"k": "a"}, 2), ({"k": "z"}, 0)):
        with pytest.raises(Exception, match=f"exactly one row of t, found {n}"):
            resolve({"t": t}, [Selection("bad", "t", "value", "x", where=where)]).collect()
    for bad, why in ((Selection("a", "t", "median", "x"), "unknown statistic"), (Selection("a", "t"), "a column"), (Selection("a", "t", "sum_ratio", "x"), "denominator"), (Selection("a", "u", "count"), "unknown table"), (Selection("a", "t", "mean", "y"), "lacks y"), (Selection("a", "t", "count", where={"y": 1}), "lacks y")):
        with pytest.raises(ValueError, match=why):
            resolve({"t": t}, [bad])
    with pytest.raises(ValueError, match="twice"):
        resolve({"t": t}, [picks[0], picks[0]])


def test_one_scan_serves_all_figures_of_a_table(spark):
    t = spark.range(10).selectExpr("id % 3 AS k", "id AS x")
    plan = resolve({"t": t}, [Selection(f"v{i}", "t", "mean", "x", where={"k": i % 3}) for i in range(20)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 1


def test_run_comparison(spark):
    rows = [(1, 0.5, "a", None), (2, math.nan, "b", [1]), (2, math.nan, "b", [1]), (3, -0.0, None, []), (4, math.inf, "d", None)]
    ddl = "k int, x double, s string, l array<int>"
    one = spark.createDataFrame(rows, ddl)
    same = spark.createDataFrame([rows[i] for i in (4, 2, 0, 3, 1)], ddl).repartition(3).withColumn("x", F.when(F.col("k") == 3, F.lit(0.0)).otherwise(F.col("x"))).select("s", "l", "k", "x")
    comparison.require_equal(one, same)
    other = spark.createDataFrame([rows[0], rows[1], (3, 0.0, "", []), rows[4]], ddl)
    got = sorted((r["times_one"], r["times_two"]) for r in comparison.differences(one, other).collect())
    assert got == [(0, 1), (1, 0), (2, 1)]
    with pytest.raises(ValueError, match="differ"):
        comparison.require_equal(one, other)
    with pytest.raises(ValueError, match="columns"):
        comparison.differing_buckets(one, one.drop("l"))
    empty = one.limit(0)
    assert comparison.differences(empty, empty).count() == 0 and comparison.differences(one, empty).count() == 4
    assert comparison.digest(one, 1).collect() == comparison.digest(same, 1).collect()


def test_published_values_within_a_tolerance(spark):
    ddl = "k int, x double, y double"
    mine = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, math.nan, 0.0), (4, 1.0, 1.0), (6, math.inf, math.inf)], ddl)
    theirs = spark.createDataFrame([(1, 1.0 + 5e-13, 2.1), (2, None, None), (3, None, 0.0), (5, 1.0, 1.0), (6, math.inf, -math.inf)], ddl)
    got = sorted((r["k"], r["value"], r["reason"]) for r in comparison.unreproduced(mine, theirs, ["k"], ["x", "y"]).collect())
    assert got == [(1, "y", "beyond_tolerance"), (2, "y", "null_on_one_side"), (4, "x", "not_published"), (4, "y", "not_published"), (5, "x", "not_recomputed"), (5, "y", "not_recomputed"), (6, "y", "beyond_tolerance")]


@pytest.fixture(scope="module")
def metric_tables(spark):
    """Sound tables of the catalogue over the registered factors."""
    d = datetime.date(2000, 1, 31)
    two = [(f.name, f.family, v) for f in FACTORS for v in catalogue.variants(f)]
    primary = lambda f: catalogue.variants(f)[-1]
    place = {f.name: i for i, f in enumerate(FACTORS)}
    value = lambda a, b: 1.0 if a == b else ((place[a] + place[b]) % 10) / 10 - 0.4
    pairs = [(a, b, value(a, b), 12) for a in place for b in place]
    flags = [(a, b, v, abs(v), "positive" if v >= 0 else "negative", n) for a, b, v, n in pairs if place[a] < place[b] and abs(v) >= 0.4]
    periods = (("p1", "2000-01-01", "2000-06-30"), ("p2", "2000-07-01", "2000-12-31"))
    day = datetime.date.fromisoformat
    make = spark.createDataFrame
    text = "factor_name string, family string, score_variant string"
    tables = {
        "rank_ic": make([(d, *x, h, 30, 0.1, None) for x in two for h in (5, 20)], f"date date, {text}, horizon int, n_obs long, rank_ic double, reason string"),
        "quantile_returns": make([(d, *x, q, 6, 0.01) for x in two for q in range(1, 6)], f"date date, {text}, quantile int, n_obs long, mean_return double"),
        "factor_turnover": make([(d, *x, 0.3) for x in two], f"date date, {text}, turnover double"),
        "factor_summary": make([(*x, h, 1.0, 0.1) for x in two for h in (5, 20)], f"{text}, horizon int, coverage double, mean_ic double"),
        "subperiod_metrics": make([(n, v, p, day(a), day(b)) for n, _, v in two for p, a, b in periods], "factor_name string, score_variant string, period string, start date, end date"),
        "classification": make([(f.name, f.family, primary(f), 20, "watch") for f in FACTORS], "factor_name string, family string, primary_score_variant string, primary_horizon int, classification string"),
        "factor_correlations": make(pairs, "factor_a string, factor_b string, mean_correlation double, common_months long"),
        "redundancy_flags": make(flags, "factor_a string, factor_b string, mean_correlation double, absolute_correlation double, correlation_direction string, common_months long"),
    }
    rules = catalogue.metric_catalogue(horizons=(5, 20), quantiles=5, start="2000-01-01", end="2000-12-31", periods=periods, primary_horizon=20)
    return tables, rules


def test_sound_metric_tables_break_no_rule(metric_tables):
    tables, rules = metric_tables
    catalogue.require_metrics(tables, rules, 0.4)


first = "factor_name = 'reversal_5'"
FAULTS = [
    ("rank_ic", lambda t: t.withColumn("horizon", F.lit(7)), {"unknown_horizon", "duplicate_key"}),
    ("rank_ic", lambda t: t.withColumn("rank_ic", F.when(F.expr(first), 1.5).otherwise(F.col("rank_ic"))), {"rank_ic_range"}),
    ("rank_ic", lambda t: t.withColumn("date", F.when(F.expr(first), F.lit("1999-12-31").cast("date")).otherwise(F.col("date"))), {"outside_period"}),
    ("rank_ic", lambda t: t.drop("reason").withColumn("n_obs", F.lit("x")), {"missing_column:reason", "type:n_obs"}),
    ("quantile_returns", lambda t: t.withColumn("quantile", F.when(F.col("quantile") == 5, 0).otherwise(F.col("quantile"))), {"invalid_quantile"}),
    ("quantile_returns", lambda t: t.withColumn("factor_name", F.when(F.expr(first), None).otherwise(F.col("factor_name"))), {"null_key"}),
    ("factor_turnover", lambda t: t.withColumn("turnover", F.lit(1.5)), {"turnover_range"}),
    ("factor_turnover", lambda t: t.withColumn("factor_name", F.when(F.expr(first), "other").otherwise(F.col("factor_name"))), {"unknown_factor"}),
    ("factor_summary", lambda t: t.filter(f"NOT ({first})"), {"missing_key"}),
    ("factor_summary", lambda t: t.unionByName(t.filter("factor_name = 'log_market_cap'").withColumn("score_variant", F.lit("score_size_neutral"))), {"unknown_variant", "unknown_key"}),
    ("subperiod_metrics", lambda t: t.withColumn("end", F.date_add("end", 1)), {"period_dates"}),
    ("classification", lambda t: t.withColumn("primary_horizon", F.lit(5)), {"other_primary_horizon"}),
    ("classification", lambda t: t.withColumn("family", F.lit("size")), {"other_family"}),
    ("factor_correlations", lambda t: t.withColumn("common_months", F.when(F.expr("factor_a = 'bp' AND factor_b = 'sp_ttm'"), 3).otherwise(F.col("common_months"))), {"asymmetric_pair"}),
    ("factor_correlations", lambda t: t.withColumn("mean_correlation", F.when(F.expr("factor_a = factor_b"), None).otherwise(F.col("mean_correlation"))), set()),
    ("redundancy_flags", lambda t: t.limit(1), {"missing_flag"}),
    ("redundancy_flags", lambda t: t.withColumn("absolute_correlation", F.col("absolute_correlation") + 1e-6), {"flag_values"}),
    ("redundancy_flags", lambda t: t.select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), *t.columns[2:]), {"pair_order", "missing_flag", "unexpected_flag"}),
]


@pytest.mark.parametrize("i", range(len(FAULTS)))
def test_each_fault_of_a_metric_table_is_found(metric_tables, i):
    tables, rules = metric_tables
    name, change, want = FAULTS[i]
    own = catalogue.metric_violations({**tables, name: change(tables[name])}, {name: rules[name]}, 0.4)
    got = {r["rule"] for r in own.collect() if r["table_name"] == name and r["violations"] > 0}
    if name == "factor_correlations" and want == {"asymmetric_pair"}:
        assert want <= got
    else:
        assert got == want


def test_a_missing_table_raises(metric_tables):
    tables, rules = metric_tables
    with pytest.raises(ValueError, match="missing: rank_ic"):
        catalogue.metric_violations({k: v for k, v in tables.items() if k != "rank_ic"}, rules, 0.4)
