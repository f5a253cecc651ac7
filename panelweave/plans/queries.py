"""The registered queries of the panel operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import equal_bucket, market
from ..functions.statistics import benjamini_hochberg, newey_west, published_lag, spearman
from ..operators import audits, catalogue, checks, comparison, performance, portfolio, preprocess, sizing, supplements, universe, valuation
from ..operators import combination as comb
from ..operators import evaluation as ev
from ..operators.delivery import Selection, resolve
from ..operators.factors import FACTORS, liquidity_proxy, raw_factors
from ..sources import footers, panel_io, shards
from ..sources.stage import scratch_dir
from ..streaming.events import windowed_events
from .research import HISTORY, HORIZONS, LOOKBACK, PERIODS, PRIMARY, UNIVERSE, Research, research

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONTRACT = checks.Contract(
    "bars", ("date", "symbol"), "date", "1995-06-01", "2001-06-30", ("close_adj", "pe_ttm"), ("volume", "amount")
)


def rounded(df: DataFrame, digits: int = 6, exact: bool = False) -> DataFrame:
    """Floating columns rounded, so that results of other engines compare equal.

    ``exact`` rounds in decimal arithmetic: columns of short decimals lie on half-way
    points, which engines round differently as floating numbers.
    """
    number = lambda c: F.round(F.col(c).cast("decimal(28,9)"), digits).cast("double") if exact else F.round(c, digits)
    return df.select(*[number(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(digits: int = 6, exact: bool = False):
    def register(f: Callable[[Research], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(research(spark, sf_dir)), digits, exact)
        return f

    return register


# --- universe, labels, factors -----------------------------------------------------


def _month_end_momentum(r: Research) -> DataFrame:
    """A symbol's figures first, then the ranks of the signal dates alone: other rows leave their symbol for nothing."""
    rows = universe.momentum_returns(r.bars, lookback=8, horizon=4)
    return universe.standardized_momentum(universe.simple_universe(rows, minimum_history=HISTORY, lookback=LOOKBACK, size=UNIVERSE, dates=universe.signal_dates(r.bars)))


@query()
def mvp_rank_ic(r):
    signal = _month_end_momentum(r)
    names = ("insufficient_stocks", "constant_factor", "constant_forward_return")
    return spearman(signal, ["date"], "momentum_z", "forward_return", 20, names)


@query()
def mvp_universe(r):
    uni = universe.simple_universe(r.bars, minimum_history=HISTORY, lookback=LOOKBACK, size=UNIVERSE)
    return uni.select("date", "symbol", "history_observations", "amount_mean", "liquidity_rank", "is_eligible")


@query()
def mvp_signal(r):
    rows = universe.momentum_returns(r.bars, lookback=8, horizon=4)
    rows = universe.standardized_momentum(universe.simple_universe(rows, minimum_history=HISTORY, lookback=LOOKBACK, size=UNIVERSE))
    return rows.select("date", "symbol", "momentum", "forward_return", "momentum_z")


@query()
def research_universe(r):
    return r.universe.select("date", "symbol", "is_valid", "history_observations", "amount_mean", "liquidity_rank", "is_eligible")


@query(9)
def forward_labels(r):
    return r.labels


@query(6, exact=True)
def month_end_panel(r):
    return universe.month_ends(r.bars).select("date", "symbol", "close_adj")


def _factor_query(family: str, digits: int):
    names = [f.name for f in FACTORS if f.family == family]

    def run(r):
        return raw_factors(r.bars, names)

    run.__name__ = f"factor_{family}"
    query(digits)(run)


for _family, _digits in (("value", 9), ("momentum", 9), ("reversal", 9), ("liquidity", 12), ("low_volatility", 9), ("size", 9)):
    _factor_query(_family, _digits)


@query(9)
def factor_panel(r):
    return r.panel


@query()
def preprocess_scores(r):
    """Values of ``amihud_20`` are given in billionths, so that six digits tell them apart."""
    value = F.when(F.col("factor_name") == "amihud_20", F.col("winsorized_value") * 1e9).otherwise(F.col("winsorized_value"))
    return r.scored.select("date", "symbol", "factor_name", value.alias("winsorized_value"), "score", "score_size_neutral", "point_in_time_status", "preprocessing_reason")


@query()
def preprocess_scores_amihud(r):
    """The factor with the smallest values alone."""
    return r.scored.filter("factor_name = 'amihud_20'").select(
        "date", "symbol", "factor_name", (F.col("winsorized_value") * 1e9).alias("winsorized_value_e9"), "score", "score_size_neutral", "point_in_time_status", "preprocessing_reason"
    )


@query()
def winsorized_scores(r):
    return preprocess.score(r.panel).select("date", "symbol", "factor_name", "score", "preprocessing_reason")


@query()
def signal_liquidity(r):
    return r.liquidity


@query(12)
def liquidity_proxy_rows(r):
    return liquidity_proxy(r.panel)


@query(9)
def executable_labels(r):
    return universe.executable_labels(r.bars, r.panel.select("date", "symbol").distinct(), (5, 20), "2001-06-30")


# --- single-factor evaluation ------------------------------------------------------


@query()
def rank_ic(r):
    return r.ic


@query()
def quantile_returns(r):
    return r.quantiles


@query()
def quantile_spread(r):
    return ev.quantile_spread(r.quantiles)


@query()
def factor_turnover(r):
    return r.turnover


@query()
def subperiod_ic(r):
    return r.periods


@query()
def newey_west_ic(r):
    test = newey_west(r.ic, ["factor_name", "score_variant", "horizon"], "date", "rank_ic", published_lag(F.col("horizon")), with_p=False)
    return test.select("factor_name", "score_variant", "horizon", F.col("n").cast("long").alias("n"), "mean", "std", "lag", "t")


@query()
def benjamini_hochberg_q(r):
    """q-values of pseudo p-values taken from positive IC rates, so that SQL can follow."""
    p = r.ic.filter("horizon = 20").groupBy("factor_name", "score_variant").agg((1 - F.abs(F.avg("rank_ic"))).alias("p"))
    return benjamini_hochberg(p, "p", ["factor_name"], ["score_variant"])


@query()
def factor_summary(r):
    return r.summary.select(
        "factor_name", "family", "score_variant", "horizon", "coverage", F.col("valid_months").cast("long").alias("valid_months"), "mean_ic", "ic_std", "icir", "positive_ic_rate", "nw_lag", "nw_t",
        "q5_q1", "monotonicity", "avg_turnover", "point_in_time_status", "summary_reason",
    )


@query(4)
def factor_p_values(r):
    return r.summary.select("factor_name", "score_variant", "horizon", "nw_p", "bh_q")


@query()
def classification(r):
    return ev.classify(r.summary, r.periods, primary_horizon=PRIMARY, months=24)


@query()
def redundancy(r):
    return r.correlations


@query()
def redundancy_flags(r):
    return ev.redundancy_flags(r.correlations, 0.5)


# --- composites --------------------------------------------------------------------


@query()
def composite_static(r):
    return r.static


@query()
def rolling_ic_weights(r):
    return r.weights


@query()
def composite_rolling(r):
    return r.rolling


@query()
def ablation_scores(r):
    return comb.ablation_scores(r.scored, r.weights, "liquidity")


@query()
def static_weights(r):
    return comb.static_weights(r.scored.select("date"))


@query()
def composite_rank_ic(r):
    return r.composite_ic


@query()
def composite_quantile_returns(r):
    return r.composite_quantiles


@query()
def composite_summary(r):
    spread = ev.quantile_spread(r.composite_quantiles, ["method"])
    return comb.composite_summary(r.composite_ic).withColumn("valid_months", F.col("valid_months").cast("long")).join(spread, "method", "left")


@query()
def composite_correlations(r):
    return comb.composite_correlations(r.composites, r.scored)


@query()
def composite_stability(r):
    return comb.rank_stability(r.composites)


@query()
def composite_rolling_ic(r):
    return comb.rolling_mean_ic(r.composite_ic).select("date", "method", "horizon", "rolling_ic")


@query()
def quintile_excess(r):
    return comb.quintile_excess(r.composite_quantiles, "method")


@query()
def leg_decomposition(r):
    return comb.leg_decomposition(r.composite_quantiles, "method").withColumn("months", F.col("months").cast("long"))


# --- portfolios and execution ------------------------------------------------------


@query()
def top_n_portfolio(r):
    return r.targets


@query()
def portfolio_diagnostics(r):
    return portfolio.diagnostics(r.targets)


@query()
def portfolio_overlap(r):
    return portfolio.overlap(r.targets, "top10_equal", "top20_equal")


@query()
def portfolio_warnings(r):
    coverage = r.static.filter("method = 'family_equal'").groupBy("date").agg((F.count(F.lit(1)) / UNIVERSE).alias("coverage"))
    return portfolio.quality_warnings(portfolio.diagnostics(r.targets), coverage, expected=20, minimum_coverage=0.9, turnover=0.5)


@query(9)
def portfolio_exposures(r):
    return portfolio.exposures(r.targets, r.scored, r.liquidity, comb.NAMES)


@query()
def size_groups(r):
    return portfolio.size_groups(r.static.filter("method = 'family_equal'"), r.sizes, 5).select("date", "symbol", "size_group", "group_rank")


@query()
def buffered_portfolio(r):
    ranked = portfolio.size_groups(r.composites, r.sizes, 5, ["method"])
    return portfolio.buffered_portfolio(ranked, per_group=2, buffer_rank=4, name="size_stratified_buffered")


@query()
def rebalance_schedule(r):
    return portfolio.rebalance_schedule(r.static.filter("method = 'family_equal'"), 3).select("date", "symbol", "score")


@query()
def liquid_universe(r):
    return portfolio.liquid_universe(r.static.filter("method = 'family_equal'"), liquidity_proxy(r.panel), 15, strict=False).select("date", "symbol", "score")


@query()
def execution_panel(r):
    return universe.execution_panel(r.bars).select("date", "symbol", "adv", "limit_rate", "is_suspended")


def _orders(r: Research) -> DataFrame:
    return portfolio.filled(r.planned, participation=0.5, lot=100).select(*portfolio.ORDER)


@query(6, exact=True)
def rebalance_orders(r):
    return _orders(r)


def _rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    stamp = spark.sql("SELECT * FROM VALUES (DATE'1995-01-01', DATE'1998-06-11', 0.003D, 0.003D), (DATE'1998-06-12', DATE'2001-12-31', 0.0D, 0.004D) AS t(start, end, buy_rate, sell_rate)")
    transfer = spark.sql(
        "SELECT * FROM VALUES (DATE'1995-01-01', DATE'2001-12-31', 'sh', 'shares', 0.001D, 1.0D), (DATE'1995-01-01', DATE'1999-12-31', 'sz', 'amount', 0.0D, 0.0D),"
        " (DATE'2000-01-01', DATE'2001-12-31', 'sz', 'amount', 0.00002D, 0.0D) AS t(start, end, market, basis, rate, minimum)"
    )
    return stamp, transfer


@query(6, exact=True)
def trade_costs(r):
    return portfolio.with_fees(portfolio.priced(_orders(r)), *_rules(r.spark)).select(
        "portfolio_name", "date", "symbol", "side", "fill_quantity", "amount", "commission", "stamp_duty", "transfer_fee", "slippage_cost", "impact_cost", "total_cost"
    )


@query()
def fee_coverage(r):
    """Order days of the turn of 1999 for which a transfer fee rule of a market is missing."""
    _, transfer = _rules(r.spark)
    orders = r.spark.read.parquet(f"{r.sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).filter("day BETWEEN DATE'1999-10-01' AND DATE'2000-03-31'")
    return portfolio.uncovered_dates(transfer.filter("start < DATE'2000-01-01' OR market = 'sh'"), orders, ["market"])


@query()
def proportional_buys(r):
    """What the buys of each date get out of 4,000,000."""
    wishes = r.planned.filter("side = 'buy' AND reason IS NULL").select("portfolio_name", "date", "symbol", "quantity", F.col("open_raw").alias("price"))
    cash = wishes.select("portfolio_name", "date").distinct().withColumn("available_cash", F.lit(4_000_000.0))
    return sizing.proportional_buys(wishes, cash)


SETTINGS = {"participation": 0.5, "fixed_bps": 5.0, "impact_bps": 10.0, "reference": 0.01, "most_bps": 50.0, "commission": 0.0003, "least": 5.0}
EXPERIMENTS = [
    ("execution_full_cost", "execution", {}),
    ("zero_cost", "execution", {"cost_mode": "zero"}),
    ("explicit_fees", "execution", {"cost_mode": "explicit_only"}),
    ("participation_10", "execution", {"participation": 0.1}),
    ("double_slippage", "execution", {"fixed_bps": 10.0, "impact_bps": 20.0}),
    ("dear_broker", "execution", {"commission": 0.001, "least": 25.0}),
    ("monthly_rebalance", "portfolio", {"rebalance_months": 1}),
]


@query()
def execution_scenarios(r):
    scenarios = sizing.execution_scenarios(r.spark, SETTINGS, EXPERIMENTS)
    orders, trades = sizing.scenario_trades(r.planned, scenarios, *_rules(r.spark))
    return sizing.scenario_summary(orders, trades).withColumns({c: F.round(c, 2) for c in ("amount", "total_cost")})


@query()
def blocked_orders(r):
    return _orders(r).filter("reason IS NOT NULL").groupBy("portfolio_name", "side", "reason").agg(F.count(F.lit(1)).alias("orders"))


# --- benchmarks and supplements ----------------------------------------------------


def _members(r: Research) -> DataFrame:
    caps = r.bars.select("date", "symbol", F.col("total_market_cap").alias("market_cap"))
    return r.scored.select("date", "symbol").distinct().join(caps, ["date", "symbol"])


def _benchmark(r: Research) -> DataFrame:
    return performance.universe_benchmark(r.bars, _members(r), r.calendar)


@query()
def universe_benchmark(r):
    """Levels as natural logarithms: the made-up prices of small data grow beyond what rounding can compare."""
    return _benchmark(r).select("date", F.ln("equal_weight").alias("log_equal_weight"), F.ln("cap_weight").alias("log_cap_weight"), "member_count")


@query()
def relative_performance(r):
    levels = _benchmark(r).select("date", F.col("equal_weight").alias("strategy"), F.col("cap_weight").alias("benchmark"))
    return performance.relative_performance(levels.withColumn("pair", F.lit("equal_over_cap")), ["pair"], 6.75)


@query()
def fill_statistics(r):
    return portfolio.fill_statistics(_orders(r), ["portfolio_name", "side"])


@query()
def benchmark_drawdown(r):
    return universe.drawdown(_benchmark(r).withColumn("k", F.lit(1)), ["k"], "date", "equal_weight").select("date", "drawdown")


@query()
def path_summary(r):
    """Total returns as natural logarithms of growth, like ``universe_benchmark``."""
    levels = _benchmark(r).select("date", F.explode(F.array(F.struct(F.lit("equal").alias("path"), F.col("equal_weight").alias("nav")), F.struct(F.lit("cap").alias("path"), F.col("cap_weight").alias("nav")))).alias("x"))
    out = performance.path_summary(levels.select("date", "x.*"), ["path"])
    return out.withColumn("log_total_return", F.ln(F.col("total_return") + 1)).drop("total_return")


@query()
def calendar_year_returns(r):
    levels = _benchmark(r).select("date", F.lit("equal").alias("path"), F.col("equal_weight").alias("nav"))
    return performance.calendar_year_returns(levels, ["path"])


@query()
def market_return(r):
    return performance.market_return(r.bars)


@query()
def market_regimes(r):
    """Trailing returns as natural logarithms of growth, like ``universe_benchmark``."""
    rows = performance.market_regimes(performance.market_return(r.bars), 20, 10)
    return rows.withColumn("log_trailing_growth", F.ln(F.col("trailing_market_return") + 1)).drop("trailing_market_return")


@query()
def regime_summary(r):
    market_rows = performance.market_return(r.bars)
    rows = performance.market_regimes(market_rows, 20, 10).select("date", F.col("market_return").alias("return"), F.lit("trend").alias("segment_type"), F.col("market_trend").alias("segment"))
    rows = rows.unionByName(performance.time_segments(market_rows.select("date", F.col("market_return").alias("return")), "1998-12-31", ("early", "late")))
    return performance.segment_summary(rows, {"trend": 52}, 52)


@query()
def size_segments(r):
    return performance.size_segments(r.panel, r.signal_labels)


@query()
def fama_macbeth_monthly(r):
    return _regressions(r)


def _regressions(r: Research) -> DataFrame:
    wide = r.scored.filter(F.col("factor_name").isin("reversal_20", "turnover_20", "volatility_60")).groupBy("date", "symbol").pivot("factor_name", ["reversal_20", "turnover_20", "volatility_60"]).agg(F.max("score"))
    frame = wide.join(r.signal_labels.select("date", "symbol", "forward_return_20"), ["date", "symbol"])
    return performance.monthly_regressions(frame, ["reversal_20", "turnover_20", "volatility_60"], "forward_return_20", 20)


@query()
def fama_macbeth_univariate(r):
    frame = r.scored.filter("factor_name = 'reversal_20'").select("date", "symbol", F.col("score").alias("reversal_20")).join(r.signal_labels.select("date", "symbol", "forward_return_20"), ["date", "symbol"])
    return performance.monthly_regressions(frame, ["reversal_20"], "forward_return_20", 20)


@query()
def fama_macbeth_summary(r):
    return performance.regression_summary(_regressions(r), 0)


@query()
def block_bootstrap(r):
    levels = _benchmark(r).select("date", F.lit("equal_over_cap").alias("pair"), F.col("equal_weight").alias("strategy"), F.col("cap_weight").alias("benchmark"))
    pairs = performance.returns(levels, ["pair"], ["strategy", "benchmark"])
    return performance.block_bootstrap(pairs, ["pair"], years=6.75, block=13, replications=500, seed=7)


# --- checks, audits, verdicts ------------------------------------------------------


@query()
def panel_issues(r):
    return checks.panel_issues(r.bars)


@query()
def field_audit(r):
    return checks.field_audit(r.bars, ["pe_ttm", "pb", "ps_ttm", "close_adj", "turnover", "industry"])


@query()
def contract_violations(r):
    return checks.contract_violations(r.bars, CONTRACT)


@query()
def frame_statistics(r):
    return panel_io.frame_statistics(r.bars)


@query()
def market_classes(r):
    number = F.lpad((F.substring("symbol", 1, 6).cast("long") * 10007 % 1000000).cast("string"), 6, "0")
    return r.bars.select("symbol", number.alias("code")).distinct().select("symbol", "code", market("code").alias("market"))


@query()
def weight_sums(r):
    return checks.weights_sum_to_one(r.targets.filter("symbol <> '000001'"), ["portfolio_name", "date"], "target_weight", 1e-9).drop("invalid")


@query()
def equal_buckets(r):
    w = Window.partitionBy("date")
    rows = r.bars.select("date", "symbol", equal_bucket(F.row_number().over(w.orderBy("amount", "symbol")), F.count(F.lit(1)).over(w), 7).alias("bucket"))
    return rows.groupBy("date", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _actions(r: Research) -> DataFrame:
    """Made-up actions: a payment with every 26th bar of a symbol, new shares with every 52nd, four days before the bar."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    rows = r.bars.withColumn("i", i).filter("i % 26 = 0")
    return rows.select(
        "symbol", F.date_sub("date", 4).alias("ex_date"), F.date_add("date", 10).alias("effective_date"), F.round(F.col("close_raw") * 0.01, 2).alias("cash_per_share"),
        F.when(F.col("i") % 52 == 0, 0.1).otherwise(0.0).alias("share_ratio"), F.lit("made_up").alias("source"),
    )


@query()
def corporate_actions(r):
    main = _actions(r)
    more = main.withColumn("source", F.lit("second")).withColumn("effective_date", F.when(F.col("share_ratio") > 0, F.date_add("effective_date", 1)).otherwise(F.col("effective_date")))
    merged = audits.normalize_actions(audits.merge_actions(main, more), "1995-01-01", "2001-12-31")
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("actions"), F.sum("cash_per_share").alias("cash"), F.count_if(F.col("share_ratio") > 0).alias("share_actions"))


@query()
def first_quote_after_action(r):
    return audits.first_on_or_after(_actions(r), r.bars, "ex_date").select("symbol", "ex_date", "date")


def _positions(r: Research) -> DataFrame:
    return audits.marked_positions(r.targets, r.bars, r.calendar)


@query(6, exact=True)
def marked_positions(r):
    return _positions(r)


@query()
def shadow_audit(r):
    held = _positions(r).filter("portfolio_name = 'top20_equal'")
    return audits.shadow_audit(r.bars, _actions(r), held, r.calendar)


@query()
def stale_positions(r):
    events = _actions(r).filter("share_ratio > 0").select(F.col("symbol").alias("source_symbol")).filter("source_symbol < '000030'")
    evidence = r.bars.select("symbol").distinct().filter("symbol > '000080'")
    return audits.stale_intervals(_positions(r), r.bars.filter("date < DATE'2001-06-01'"), events, evidence, 10)


def _verdicts(r: Research) -> DataFrame:
    registry = r.spark.sql("SELECT * FROM VALUES ('portfolio_baseline', 'portfolio'), ('top10_equal', 'portfolio'), ('execution_full_cost', 'execution'), ('never_run', 'factor_ablation') AS t(experiment_id, category)")
    d = portfolio.diagnostics(r.targets).groupBy("portfolio_name").agg(F.avg("one_way_turnover").alias("turnover"), F.avg("hhi").alias("hhi"))
    name = F.when(F.col("portfolio_name") == "top20_equal", "portfolio_baseline").otherwise(F.col("portfolio_name"))
    results = d.select(name.alias("experiment_id"), F.lit("ready").alias("status"), "turnover", "hhi").unpivot(["experiment_id", "status"], ["turnover", "hhi"], "metric", "value")
    return audits.verdicts(results, registry, turnover=0.05)


@query()
def robustness_verdicts(r):
    return _verdicts(r)


@query()
def protocol_gate(r):
    return audits.protocol_gate(_verdicts(r))


@query()
def candidate_selection(r):
    summary = comb.composite_summary(r.composite_ic).filter("horizon = 20").select(F.col("method").alias("candidate"), F.col("mean_ic").alias("net_annual_return"))
    stable = comb.rank_stability(r.composites).select(F.col("method").alias("candidate"), (-F.col("top10_turnover")).alias("maximum_drawdown"), F.col("top10_turnover").alias("turnover"))
    return audits.select_candidate(summary.join(stable, "candidate"), "candidate_equal", improvement=-0.01, deterioration=0.2, turnover_increase=0.05)


# --- tables by period and object, gates ---------------------------------------------

BOUNDARY, LAST = "1998-12-31", "2001-12-31"


def _objects(r: Research) -> DataFrame:
    """Primary factor scores and composites as one table of objects."""
    factor = ev.primary_scores(r.scored).select(F.lit("factor").alias("object_type"), F.col("factor_name").alias("object_name"), "date", "symbol", "value")
    composite = r.composites.select(F.lit("composite").alias("object_type"), F.col("method").alias("object_name"), "date", "symbol", F.col("score").alias("value"))
    return factor.unionByName(composite)


@query()
def executable_ic(r):
    horizons = (5, 20)
    labels = universe.executable_labels(r.bars, r.panel.select("date", "symbol").distinct(), horizons, "2001-06-30")
    rows = _objects(r).join(r.signal_labels.select("date", "symbol", *[f"forward_return_{h}" for h in horizons]), ["date", "symbol"]).join(labels, ["date", "symbol"])
    return supplements.executable_ic(rows, horizons)


@query()
def lag_table(r):
    """p and q values are those of ``factor_p_values``."""
    primary = F.when(F.col("factor_name") == "log_market_cap", "score").otherwise("score_size_neutral")
    factor = r.ic.filter((F.col("horizon") == PRIMARY) & (F.col("score_variant") == primary)).select(F.lit("factor").alias("object_type"), F.col("factor_name").alias("object_name"), "date", "rank_ic")
    composite = r.composite_ic.filter(F.col("horizon") == PRIMARY).select(F.lit("composite").alias("object_type"), F.col("method").alias("object_name"), "date", "rank_ic")
    table = supplements.lag_table(factor.unionByName(composite), PERIODS)
    return table.select("period", "object_type", "object_name", "months", "mean_ic", "published_lag", "t_published_lag", "automatic_lag", "t_automatic_lag")


def _pair(r: Research) -> DataFrame:
    return _benchmark(r).select("date", F.lit("equal_over_cap").alias("pair"), F.col("equal_weight").alias("strategy"), F.col("cap_weight").alias("benchmark"))


@query()
def relative_by_period(r):
    return supplements.relative_by_period(_pair(r), PERIODS, ["pair"])


def _nav(r: Research) -> DataFrame:
    """The benchmark's two paths as a net and a costless NAV, with a made-up cash share."""
    return _benchmark(r).select("date", F.lit("equal").alias("candidate"), F.col("equal_weight").alias("nav"), F.col("cap_weight").alias("zero_cost_nav"), (F.col("equal_weight") * 0.05).alias("cash"))


def _slice(r: Research) -> DataFrame:
    nav = _nav(r)
    boundary = nav.filter(F.col("date") <= F.lit(BOUNDARY).cast("date")).agg(F.max("date")).first()[0]  # one row
    trades = portfolio.priced(_orders(r)).filter("portfolio_name = 'top20_equal'").select("date", F.lit("equal").alias("candidate"), "amount")
    return supplements.slice_metrics(nav, trades, ["candidate"], boundary=str(boundary), start="1999-01-01", end=LAST)


@query()
def slice_metrics(r):
    return _slice(r)


@query()
def slice_verdicts(r):
    own = _slice(r).withColumnRenamed("candidate", "experiment_id")
    base = own.withColumn("experiment_id", F.lit("baseline")).withColumn("annual_return", F.col("zero_cost_annual_return")).withColumn("maximum_drawdown", F.col("maximum_drawdown") + 0.1)
    return supplements.judged(own.unionByName(base), "baseline", {"annual_return": 0.02, "maximum_drawdown": 0.05, "turnover": 0.5})


@query()
def validation_metrics(r):
    own = portfolio.diagnostics(r.targets).filter("portfolio_name = 'top20_equal'").withColumn("candidate", F.lit("equal"))
    gap = _nav(r).select("candidate", "date", (F.ln("nav") - F.ln("zero_cost_nav")).alias("difference"))
    return supplements.validation_metrics(_nav(r), own, own.withColumn("target_deviation_l1", F.col("max_weight")), gap, start="1999-01-01", end=LAST)


def _index(r: Research) -> DataFrame:
    """The benchmark's paths as two published indices, from the third date on."""
    w = Window.orderBy("date")
    rows = _benchmark(r).select("date", F.row_number().over(w).alias("i"), *[x for c in ("equal_weight", "cap_weight") for x in (F.col(c), F.lag(c).over(w).alias(f"{c}_before"))])
    both = F.array(*[F.struct(F.lit(n).alias("index"), F.col(c).alias("close"), F.col(f"{c}_before").alias("preclose")) for n, c in (("equal", "equal_weight"), ("cap", "cap_weight"))])
    return rows.filter("i > 2").select("date", F.explode(both).alias("x")).select("date", "x.*")


@query()
def index_levels(r):
    """Levels as natural logarithms, like ``universe_benchmark``."""
    return supplements.index_levels(_index(r), r.calendar, ["equal", "cap"]).select("date", F.ln("equal").alias("equal"), F.ln("cap").alias("cap"))


@query()
def index_violations(r):
    broken = _index(r).filter("index = 'equal' OR day(date) <> 7").withColumn("preclose", F.when((F.col("index") == "cap") & (F.day("date") == 15), F.col("preclose") * 2).otherwise(F.col("preclose")))
    return supplements.index_violations(broken, r.calendar, start="1996-01-01", end="2001-06-30", tolerance=1e-9)


@query()
def combination_audit(r):
    return supplements.combination_audit(r.composites, r.weights)


@query()
def panel_coverage(r):
    return supplements.panel_coverage(r.scored)


@query()
def redundancy_reasons(r):
    return supplements.correlation_reasons(ev.monthly_correlations(r.scored, 45))


@query()
def composite_subperiods(r):
    return supplements.composite_subperiods(r.composite_ic, PERIODS)


@query()
def legs_by_period(r):
    return comb.leg_decomposition(supplements.tagged(r.composite_quantiles, PERIODS), ["period", "method"]).withColumn("months", F.col("months").cast("long"))


@query()
def quantile_frames(r):
    """Mean return of each quantile by period, factors' primary scores and composites together."""
    primary = F.when(F.col("factor_name") == "log_market_cap", "score").otherwise("score_size_neutral")
    factor = r.quantiles.filter(F.col("score_variant") == primary).select("date", F.col("factor_name").alias("object_name"), "quantile", "n_obs", "mean_return")
    both = factor.unionByName(r.composite_quantiles.select("date", F.col("method").alias("object_name"), "quantile", "n_obs", "mean_return"))
    rows = supplements.tagged(both, PERIODS)
    return rows.groupBy("period", "object_name", "quantile").agg(F.count(F.lit(1)).alias("months"), F.avg("mean_return").alias("mean_return"), F.sum("n_obs").alias("n_obs"))


COSTS = ["commission", "stamp_duty", "transfer_fee", "slippage_cost", "impact_cost"]


@query()
def cost_components(r):
    trades = portfolio.with_fees(portfolio.priced(_orders(r)), *_rules(r.spark))
    return supplements.cost_components(trades, ["portfolio_name"], COSTS)


@query()
def correlation_matrix(r):
    order = [f.name for f in FACTORS if f.family in ("reversal", "liquidity", "size")]
    return supplements.correlation_matrix(r.correlations, order)


@query()
def continuous_targets(r):
    split = F.lit(BOUNDARY).cast("date")
    early = r.targets.filter((F.col("portfolio_name") == "top10_equal") & (F.col("date") <= split))
    late = r.targets.filter((F.col("portfolio_name") == "top20_equal") & (F.col("date") > split))
    return supplements.continuous_targets(early, late, start="1999-01-01", end=LAST)


@query()
def applied_actions(r):
    """The last action of each symbol on made-up holdings of odd sizes."""
    last = audits.first_of_each(_actions(r), ["symbol"], [F.desc("effective_date")]).withColumn("action_id", F.col("symbol"))
    held = r.bars.select("symbol").distinct().withColumn("shares", F.col("symbol").cast("long") * 7 + 100)
    return audits.apply_actions(held, last)


@query()
def redundancy_input(r):
    return supplements.redundancy_input_violations(r.scored, start="1996-06-01", end="2001-06-30")


@query()
def metric_tables(r):
    pairs = r.correlations
    flags = ev.redundancy_flags(pairs, 0.5).filter("factor_a <> 'reversal_5'")
    return supplements.metric_table_violations(r.summary.filter("NOT (factor_name = 'bp' AND horizon = 60)"), pairs.filter("NOT (factor_a = 'bp' AND factor_b = 'sp_ttm')"), flags, HORIZONS, 0.5)


@query()
def mvp_ic_summary(r):
    return supplements.ic_summary(mvp_rank_ic(r))


@query()
def supplement_ic(r):
    """Rank IC of the composites without the months that have no pair."""
    rows = r.composites.join(r.signal_labels.select("date", "symbol", "forward_return_60"), ["date", "symbol"])
    return spearman(rows, ["date", "method"], "score", "forward_return_60", 3, all_groups=False)


@query()
def attached_metrics(r):
    base = comb.rank_stability(r.composites).select(F.concat(F.col("method"), F.lit("_top")).alias("candidate"), "top10_turnover")
    spread = ev.quantile_spread(r.composite_quantiles, ["method"]).select("method", "monotonicity")
    summary = comb.composite_summary(r.composite_ic).join(spread, "method", "left")
    return supplements.attach_composite_metrics(base, summary, {f"{m}_top": m for m in (*comb.STATIC, comb.ROLLING)})


@query()
def target_contract(r):
    return supplements.target_violations(r.targets, ["portfolio_name"], names=10, before="2001-06-30")


@query()
def sealed_dates(r):
    tables = {"bars": r.bars, "scores": r.scored, "weights": r.weights.withColumnRenamed("history_end", "history_end_date"), "targets": r.targets}
    return supplements.sealed_dates(tables, "2001-11-01")


@query()
def source_coverage(r):
    acts = _actions(r)
    paid = acts.withColumn("payment_date", F.when(F.dayofmonth("ex_date") != 9, F.col("effective_date")))
    return supplements.source_coverage(r.bars.select("symbol"), acts.filter("share_ratio > 0"), paid)


@query()
def variant_targets(r):
    baseline = {"portfolio_size": 10, "buffer_rank": 4, "universe_size": 25, "rebalance_months": 1}
    parameters = supplements.variant_parameters(baseline, {"quarterly": {"rebalance_months": 3}, "tight_buffer": {"buffer_rank": 2}, "wide": {"universe_size": 40}})
    return supplements.variant_targets(r.rolling, r.sizes, liquidity_proxy(r.panel), parameters, strict=False)


@query()
def panel_build_counts(r):
    """Partitions of the panel that a build keeps."""
    kept, _ = panel_io.cleaned(_listed(r), ("sh", "sz"))
    return panel_io.year_counts(kept)


@query()
def panel_build_records(r):
    _, records = panel_io.cleaned(_listed(r), ("sh", "sz"))
    return records


def _listed(r: Research) -> DataFrame:
    """The bars under codes that spread over all markets."""
    number = F.lpad((F.substring("symbol", 1, 6).cast("long") * 10007 % 1000000).cast("string"), 6, "0")
    return r.bars.withColumn("symbol", number)


def _shifted(df: DataFrame, test: str, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(F.expr(test), value).otherwise(F.col(column)))


@query()
def mvp_targets(r):
    """The ten strongest of each signal date, held from the next session on."""
    signal = _month_end_momentum(r)
    picked = portfolio.top_n(signal, 10, "momentum", score="momentum_z").join(F.broadcast(r.calendar.filter("next_date IS NOT NULL")), "date")
    return picked.select(F.col("date").alias("signal_date"), F.col("next_date").alias("execution_date"), "symbol", "target_weight")


@query()
def metric_catalogue(r):
    """Rules that tables with planted faults break."""
    pairs = r.correlations
    bp5 = r.ic.filter("factor_name = 'bp' AND horizon = 5")
    tables = {
        "rank_ic": _shifted(r.ic, "factor_name = 'bp' AND horizon = 60", "horizon", F.lit(61)).unionByName(bp5),
        "quantile_returns": _shifted(r.quantiles, "factor_name = 'ep_ttm' AND quantile = 5", "quantile", F.lit(6)),
        "factor_turnover": _shifted(r.turnover, "factor_name = 'momentum_60'", "family", F.lit("value")),
        "factor_summary": r.summary.filter("NOT (factor_name = 'bp' AND horizon = 60)"),
        "subperiod_metrics": _shifted(r.periods.withColumnRenamed("subperiod", "period"), "period = '1998-1999' AND factor_name = 'sp_ttm'", "start", F.lit("1998-02-01").cast("date")),
        "classification": _shifted(classification(r).withColumn("primary_horizon", F.lit(PRIMARY)), "factor_name = 'reversal_5'", "primary_score_variant", F.lit("score")),
        "factor_correlations": pairs.filter("NOT (factor_a = 'bp' AND factor_b = 'sp_ttm')"),
        "redundancy_flags": _shifted(ev.redundancy_flags(pairs, 0.5).filter("factor_a <> 'reversal_5'"), "factor_a = 'turnover_20'", "correlation_direction", F.lit("none")),
    }
    rules = catalogue.metric_catalogue(horizons=HORIZONS, quantiles=5, start="1996-01-01", end="2001-12-31", periods=PERIODS, primary_horizon=PRIMARY)
    return catalogue.metric_violations(tables, rules, 0.5)


FIGURES = [
    Selection("ic_rows", "ic", "count"),
    Selection("ic_rows_20", "ic", "count", where={"horizon": 20}),
    Selection("ic_factors", "ic", "n_unique", "factor_name"),
    Selection("ic_months", "ic", "n_unique", "date"),
    Selection("ic_reasons", "ic", "n_unique", "reason"),
    Selection("ic_mean_reversal_5", "ic", "mean", "rank_ic", where={"factor_name": "reversal_5", "score_variant": "score_size_neutral", "horizon": 5}),
    Selection("ic_mean_turnover_20", "ic", "mean", "rank_ic", where={"factor_name": "turnover_20", "score_variant": "score", "horizon": 20}),
    Selection("ic_weighted_reversal_20", "ic", "sum_ratio", "n_obs", "horizon", where={"factor_name": "reversal_20"}),
    *[Selection(f"summary_mean_ic_{n}", "summary", "value", "mean_ic", where={"factor_name": n, "score_variant": "score_size_neutral", "horizon": 20}) for n in ("reversal_5", "turnover_20", "amihud_20", "volatility_60")],
    *[Selection(f"summary_months_{h}", "summary", "value", "valid_months", where={"factor_name": "log_market_cap", "score_variant": "score", "horizon": h}) for h in HORIZONS],
    Selection("summary_rows", "summary", "count"),
    Selection("orders_all", "orders", "count"),
    Selection("orders_portfolios", "orders", "n_unique", "portfolio_name"),
    Selection("orders_filled_rate", "orders", "sum_ratio", "fill_quantity", "quantity"),
    Selection("orders_sell_filled_rate", "orders", "sum_ratio", "fill_quantity", "quantity", where={"side": "sell", "portfolio_name": "top20_equal"}),
    Selection("turnover_mean_bp", "turnover", "mean", "turnover", where={"factor_name": "bp", "score_variant": "score"}),
]


@query()
def report_figures(r):
    return resolve({"ic": r.ic, "summary": r.summary, "orders": _orders(r), "turnover": r.turnover}, FIGURES)


def _altered(ic: DataFrame) -> DataFrame:
    """The IC table without some rows, with some twice, and some changed in value."""
    kept = ic.filter("NOT (factor_name = 'bp' AND horizon = 5)")
    return _shifted(kept, "factor_name = 'ep_ttm' AND horizon = 60", "rank_ic", F.col("rank_ic") + 0.001).unionByName(ic.filter("factor_name = 'sp_ttm' AND horizon = 20"))


@query()
def run_differences(r):
    """How many rows of two runs occur how often in each, where that differs."""
    return comparison.differences(r.ic, _altered(r.ic)).groupBy("times_one", "times_two").agg(F.count(F.lit(1)).alias("rows"))


@query()
def unreproduced_ic(r):
    keys = ["date", "factor_name", "score_variant", "horizon"]
    published = _altered(r.ic).dropDuplicates(keys).filter("NOT (factor_name = 'size' AND horizon = 5)")
    return comparison.unreproduced(r.ic.filter("NOT (factor_name = 'momentum_60' AND horizon = 60)"), published, keys, ["rank_ic"])


@query()
def stage_statistics(r):
    """Rows and dates of stage tables, as seen while they were written."""
    for name in ("bars", "panel", "scored", "ic", "quantiles", "turnover", "static", "composites", "targets"):
        getattr(r, name)
    seen = [(s.name, s.rows, s.min_date, s.max_date, s.seconds > 0) for s in r.statistics.values() if s.name in ("bars", "panel", "scored", "ic", "quantiles", "turnover", "static", "composites", "targets")]
    return r.spark.createDataFrame(seen, "stage string, rows long, min_date date, max_date date, timed boolean")


SOURCES = {"lineitem": "l_shipdate", "events": "ts", "orders": "o_orderdate"}


@query()
def source_footers(r):
    """Rows, dates and columns of the sources from their footers alone."""
    parts = [footers.footers(r.spark, f"{r.sf_dir}/{t}.parquet", d).withColumn("table_name", F.lit(t)) for t, d in SOURCES.items()]
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return files.groupBy("table_name").agg(F.sum("rows").alias("rows"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), F.max("columns").alias("columns"))


@query()
def source_violations(r):
    """The files of the sources against a record with planted faults."""
    parts = [footers.record_source(r.spark, f"{r.sf_dir}/{t}.parquet", d).withColumn("path", F.lit(f"{t}.parquet")) for t, d in SOURCES.items()]
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    files = files.groupBy("path").agg(*[f(c).alias(c) for c, f in (("size_bytes", F.sum), ("rows", F.sum), ("schema_sha256", F.min), ("min_date", F.min), ("max_date", F.max), ("sha256", F.min))])
    recorded = _shifted(files.filter("path <> 'events.parquet'"), "path = 'orders.parquet'", "rows", F.col("rows") + 1)
    recorded = _shifted(recorded, "path = 'lineitem.parquet'", "min_date", F.col("min_date") - F.expr("INTERVAL 1 DAY"))
    gone = files.filter("path = 'orders.parquet'").withColumn("path", F.lit("gone.parquet"))
    return footers.source_violations(recorded.unionByName(gone), files, start="1990-01-01", end="2001-06-30")


@query()
def replaced_year(r):
    """A built panel after one of its years was built again."""
    path = f"{scratch_dir(r.spark)}/panel-{uuid.uuid4().hex}"
    bars = r.bars.select("date", "symbol", F.col("volume").cast("long").alias("volume"))
    panel_io.write_panel(bars, path)
    known = footers.record_source(r.spark, path, "date")
    panel_io.replace_year(bars.filter("year(date) = 1998").withColumn("volume", F.col("volume") * 2), path, 1998, known)
    return r.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


YEARS = list(range(1995, 2002))


def _shards(r: Research) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, coverage, symbols) of made-up shards of ``orders``: a security is a customer number modulo 40."""
    n = F.col("o_custkey") % 40
    rows = r.spark.read.parquet(f"{r.sf_dir}/orders.parquet").select(
        F.concat(F.lit("shard"), (n % 3).cast("string")).alias("shard"), F.lpad(n.cast("string"), 6, "0").alias("symbol"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice"
    )
    symbols = rows.select("symbol").distinct()
    coverage = shards.coverage_of(rows, symbols, YEARS).join(rows.select("symbol", "shard").distinct(), "symbol")
    return rows, coverage.select("shard", "symbol", "year", "row_count"), symbols


@query()
def cache_faults(r):
    """What keeps shards with planted faults from making one cache."""
    rows, coverage, symbols = _shards(r)
    odd = coverage.filter("NOT (symbol = '000004' AND year = 1996)")
    odd = _shifted(odd, "symbol = '000006' AND year = 1998", "row_count", F.col("row_count") + 1)
    again = coverage.filter("symbol = '000005' AND year = 1997").withColumn("shard", F.lit("shard9")).withColumn("row_count", F.lit(0).cast("long"))
    foreign = coverage.filter("symbol = '000007' AND year = 1999").withColumn("symbol", F.lit("999999")).withColumn("row_count", F.lit(0).cast("long"))
    found = shards.coverage_faults(odd.unionByName(again).unionByName(foreign), rows, symbols, YEARS)
    return found.select("symbol", "year", "fault", F.concat_ws(",", "shards").alias("shards"))


@query()
def refreshed_cache(r):
    """Rows of each security and year after the answers for 1997 came anew: cheap orders are gone, and a later round found nothing for ten securities."""
    rows, coverage, symbols = _shards(r)
    rows, coverage = shards.merged_shards(rows, coverage, symbols, YEARS)
    fresh = rows.filter("year = 1997 AND o_totalprice > 100000").withColumn("shard", F.lit("round1"))
    first = shards.coverage_of(fresh, symbols, [1997]).withColumn("shard", F.lit("round1")).withColumn("asked_at", F.lit(1))
    second = first.filter("symbol < '000010'").withColumn("row_count", F.lit(0).cast("long")).withColumn("shard", F.lit("round2")).withColumn("asked_at", F.lit(2))
    rows, coverage = shards.refreshed(rows, coverage, fresh, first.unionByName(second))
    held = rows.groupBy("symbol", "year").agg(F.count(F.lit(1)).alias("rows"))
    return coverage.join(held, ["symbol", "year"], "left").select("symbol", "year", "shard", "row_count", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


@query()
def portfolio_comparison(r):
    return portfolio.compared(r.targets, portfolio.diagnostics(r.targets), "top10_equal", "top20_equal")


@query()
def valuation_prices(r):
    """Prices of the ten holdings at the session after each signal, where every fifth opening and every seventh close is missing."""
    held = r.targets.filter("portfolio_name = 'top10_equal'").join(F.broadcast(r.calendar.filter("next_date IS NOT NULL")), "date").select(F.col("next_date").alias("date"), "symbol")
    k = F.dayofyear("date") + F.col("symbol").cast("int")
    panel = r.bars.select("date", "symbol", F.when(k % 5 != 0, F.col("open_adj")).alias("open_adj"), F.when((k % 7 != 0) | (F.year("date") < 1996), F.col("close_adj")).alias("close_adj"))
    return valuation.valuation_prices(held, panel)


@query(6, exact=True)
def price_mismatches(r):
    """Executed prices against a panel in which some rows are missing and some prices moved."""
    k = F.dayofyear("date") + F.col("symbol").cast("int")
    rebuilt = r.bars.filter(k % 101 != 0).withColumn("close_adj", F.when(k % 97 == 0, F.col("close_adj") + 1).otherwise(F.col("close_adj")))
    return valuation.price_mismatches(r.bars.filter("year(date) = 1999"), rebuilt)


@query()
def extended_panel(r):
    """An execution panel to the end of 1998, extended by one that is built from the middle of 1998 on."""
    columns = ["date", "symbol", "adv", "limit_rate", "is_suspended"]
    history = universe.execution_panel(r.bars.filter("date < DATE'1999-01-01'")).select(*columns)
    extension = universe.execution_panel(r.bars.filter("date >= DATE'1998-06-01'")).select(*columns)
    return valuation.extended_panel(history, extension, start="1999-01-01", end="2001-12-31")


@query()
def event_contract(r):
    """What a table of security events, made up from large orders, breaks."""
    n = F.col("o_orderkey")
    code = lambda x: F.lpad((x % 1000).cast("string"), 6, "0")
    orders = r.spark.read.parquet(f"{r.sf_dir}/orders.parquet").filter("o_orderkey % 29 = 0")
    events = orders.select(
        code(n).alias("source_symbol"), F.col("o_orderdate").cast("date").alias("effective_date"),
        F.when(n % 4 == 0, "cash_exit").when(n % 4 == 1, "stock_merger").when(n % 4 == 2, "write_off").otherwise("other").alias("event_type"),
        F.when(n % 4 == 1, code(n + n % 3)).alias("target_symbol"), F.when(n % 4 == 1, (n % 5).cast("double")).otherwise(0.0).alias("ratio"), F.when(n % 4 == 0, (n % 3).cast("double")).otherwise(F.when(n % 8 == 1, 1.0).otherwise(0.0)).alias("cash_per_share"),
    )
    return valuation.event_violations(events, "2001-06-30")


@query()
def event_windows(r):
    return windowed_events(r.spark.read.parquet(f"{r.sf_dir}/events.parquet"))
