"""Registered panel queries against DuckDB on the same tables."""

import math

import duckdb
import pytest

from panelweave.operators.factors import FACTORS
from panelweave.plans.oracles import ORACLE_SQL
from panelweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
NAMES = [
    "mvp_rank_ic", "research_universe", "forward_labels", "factor_momentum", "factor_low_volatility", "preprocess_scores", "rank_ic", "quantile_spread", "factor_turnover",
    "newey_west_ic", "benjamini_hochberg_q", "classification", "redundancy", "rolling_ic_weights", "composite_correlations", "composite_stability", "portfolio_diagnostics",
    "rebalance_orders", "trade_costs", "universe_benchmark", "market_regimes", "fama_macbeth_univariate", "shadow_audit", "stale_positions", "candidate_selection", "event_windows",
    "portfolio_warnings", "marked_positions", "path_summary", "robustness_verdicts", "protocol_gate", "buffered_portfolio", "fama_macbeth_monthly", "fama_macbeth_summary", "executable_ic", "lag_table",
    "relative_by_period", "slice_metrics", "slice_verdicts", "validation_metrics", "index_levels", "index_violations", "combination_audit", "panel_coverage", "redundancy_reasons", "composite_subperiods",
    "legs_by_period", "quantile_frames", "cost_components", "correlation_matrix", "continuous_targets", "applied_actions", "redundancy_input", "metric_tables", "panel_build_counts", "panel_build_records",
    "mvp_ic_summary", "supplement_ic", "attached_metrics", "target_contract", "sealed_dates", "source_coverage", "variant_targets",
    "fee_coverage", "factor_p_values", "block_bootstrap", "proportional_buys", "execution_scenarios", "mvp_targets", "metric_catalogue", "report_figures", "run_differences", "unreproduced_ic", "stage_statistics",
    "source_footers", "source_violations", "replaced_year", "cache_faults", "refreshed_cache",
    "portfolio_comparison", "valuation_prices", "price_mismatches", "extended_panel", "event_contract", "fill_statistics",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)[:19].removesuffix(" 00:00:00")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    assert want.shape[0] > 0


def test_every_factor_is_preprocessed(spark):
    got = QUERIES["preprocess_scores"](spark, SF)
    assert {r[0] for r in got.select("factor_name").distinct().collect()} == {f.name for f in FACTORS}
    assert got.filter("factor_name = 'amihud_20' AND abs(winsorized_value) > 0.001").count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
