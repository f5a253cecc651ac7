"""What larger tables showed: results that depended on the order of rows, and rows sent that nothing needs."""

import duckdb

from panelweave.operators import evaluation as ev
from panelweave.operators import factors, portfolio, universe, valuation
from panelweave.plans.queries import QUERIES
from panelweave.plans.research import Research
from panelweave.sources import stage
from panelweave.sources.bars import BARS, BARS_SQL, read_bars

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_directions_of_a_correlation_come_from_one_mean(spark):
    scored = spark.range(60).selectExpr("DATE'2000-01-31' AS date", "CAST(id % 30 AS STRING) AS symbol", "IF(id < 30, 'reversal_5', 'turnover_20') AS factor_name", "CAST(id * 7 % 31 AS DOUBLE) AS score", "CAST(id * 7 % 31 AS DOUBLE) AS score_size_neutral")
    pairs = ev.redundancy(scored)
    assert plan(pairs).count("avg(rank_ic") == 1
    got = {(r["factor_a"], r["factor_b"]): r["mean_correlation"] for r in pairs.collect()}
    assert len(got) == 4 and got["reversal_5", "turnover_20"] == got["turnover_20", "reversal_5"]


def shuffles(df, key: str = "") -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({key}")


def test_bars_shuffle_order_lines_once(spark):
    bars = read_bars(spark, SF)
    assert shuffles(bars) == 1
    assert bars.columns == BARS


def test_windows_over_staged_buckets_need_no_shuffle(spark):
    table = stage.staged_buckets(read_bars(spark, SF, 4), "bars", "symbol", "date", 4)
    assert shuffles(universe.forward_labels(table, (5,))) == 0
    assert sorted(table.collect()) == sorted(read_bars(spark, SF).collect())
    assert shuffles(QUERIES["forward_labels"](spark, SF)) == 0


def test_monthly_panel_sends_the_factors_of_signal_dates_alone(spark):
    bars = read_bars(spark, SF)
    assert plan(factors.monthly_panel(bars, bars.withColumn("is_eligible", bars["is_st"]), ["reversal_5"])).count("Join LeftSemi") == 2


def test_mvp_signal_ranks_after_a_symbols_windows(spark):
    assert shuffles(QUERIES["mvp_signal"](spark, SF), "symbol") == 0


def test_executable_labels_send_the_entry_dates_alone(spark):
    bars = read_bars(spark, SF)
    assert plan(universe.executable_labels(bars, bars, (5,), "2001-06-30")).count("Join LeftSemi") == 1


def test_valuation_prices_shuffle_once(spark):
    bars = spark.range(1).selectExpr("DATE'2000-01-03' AS date", "CAST(id AS STRING) AS symbol", "1.0D AS open_adj", "1.0D AS close_adj")
    got = valuation.valuation_prices(bars, bars)._jdf.queryExecution().executedPlan().toString()
    assert got.count("Exchange hashpartitioning(symbol") == 1 and "hashpartitioning(date" not in got.split("Union")[0]


def test_orders_take_quotes_of_target_symbols_where_they_lie(spark):
    bars = stage.staged_buckets(read_bars(spark, SF, 4), "bars", "symbol", "date", 4)
    calendar = universe.next_dates(bars)
    targets = stage.staged(bars.join(universe.signal_dates(bars), "date", "left_semi").filter("symbol <= '000003'").selectExpr("'p' AS portfolio_name", "date", "symbol", "0.5D AS target_weight"), "targets")
    got = portfolio.planned_orders(targets, universe.execution_panel(bars, calendar=calendar), calendar, capital=1e5)
    below = plan(got).split("Window [avg(amount")[1]
    assert "Join LeftSemi, (symbol" in below  # the window sees no other symbols
    assert got.count() > 0


def test_cost_components_start_from_orders_that_are_there(spark):
    assert "Window" not in plan(QUERIES["cost_components"](spark, SF))


def test_factors_run_for_symbols_that_were_members(spark, monkeypatch):
    monkeypatch.setattr(Research, "_staged", lambda self, df, *a: df)
    panel = plan(Research(spark, SF).panel)
    assert "Join LeftSemi, (symbol" in panel.split("stddev_samp")[-1]  # below the windows


def test_money_is_rounded_as_in_sql(spark, tmp_path):
    path = f"{tmp_path}/lineitem.parquet"
    con = duckdb.connect()
    con.sql(
        "COPY (SELECT i AS l_orderkey, i AS l_suppkey, 1 AS l_linenumber, p AS l_extendedprice, 1.0::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax, 'R' AS l_returnflag, TIMESTAMP '1998-01-05' AS l_shipdate"
        f" FROM (VALUES (1, 1.005::DOUBLE), (2, 0.125), (3, 2.675), (4, 0.135), (5, 0.994999999999), (6, -0.125), (7, 104949.5), (8, 123456789012.34), (9, NULL), (10, 0.0)) AS t(i, p)) TO '{path}' (FORMAT parquet)"
    )
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    columns = "symbol, amount, total_market_cap, close_adj"
    want = con.sql(f"WITH {BARS_SQL} SELECT {columns} FROM bars").fetchall()
    assert sorted(tuple(r) for r in read_bars(spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()) == sorted(want)
