"""Target portfolios, their diagnostics, and the cost of trading to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import equal_bucket, finite, market, positive, require_none, ticks

TARGET = ["portfolio_name", "date", "symbol", "target_weight"]
ORDER = ["portfolio_name", "signal_date", "date", "symbol", "side", "quantity", "fill_quantity", "open_raw", "adv", "reason"]


def top_n(scores: DataFrame, size: int, name: str, score: str = "score") -> DataFrame:
    """Equal weights on the ``size`` best finite scores of each date; ties go by symbol."""
    cross = Window.partitionBy("date")
    rows = scores.filter(finite(score)).withColumn("selection_rank", F.row_number().over(cross.orderBy(F.desc(score), "symbol")))
    rows = rows.filter(F.col("selection_rank") <= size)
    return rows.select(F.lit(name).alias("portfolio_name"), "date", "symbol", "selection_rank", (1.0 / F.count(F.lit(1)).over(cross)).alias("target_weight"))


def rebalance_schedule(scores: DataFrame, every: int) -> DataFrame:
    """Rows on every ``every``-th signal date."""
    dates = scores.select("date").distinct().withColumn("__i", F.row_number().over(Window.orderBy("date")) - 1)
    return scores.join(F.broadcast(dates.filter(F.col("__i") % every == 0).select("date")), "date", "left_semi")


def liquid_universe(scores: DataFrame, liquidity: DataFrame, size: int, strict: bool = True) -> DataFrame:
    """The ``size`` most liquid scored symbols of each date.

    A date with fewer raises when it is computed, or keeps what it has if not ``strict``.
    """
    cross = Window.partitionBy("date").orderBy(F.col("liquidity").desc_nulls_last(), "symbol")
    rows = scores.join(liquidity.select("date", "symbol", "liquidity"), ["date", "symbol"], "left")
    short = F.raise_error(F.concat(F.lit(f"fewer than {size} scored symbols on "), F.col("date").cast("string"))).cast("int")
    many = F.count(F.lit(1)).over(Window.partitionBy("date")) >= size
    place = F.row_number().over(cross)
    return rows.withColumn("__i", F.when(many, place).otherwise(short) if strict else place).filter(F.col("__i") <= size).drop("__i", "liquidity")


def size_groups(scores: DataFrame, sizes: DataFrame, groups: int, keys: list[str] | None = None) -> DataFrame:
    """Adds size_group (equal-count by size, ties by symbol) and group_rank (best score first) for each date and ``keys``."""
    by = ["date", *(keys or [])]
    rows = scores.join(sizes.select("date", "symbol", "log_market_cap"), ["date", "symbol"]).filter(finite("score") & finite("log_market_cap"))
    cross = Window.partitionBy(*by)
    rows = rows.withColumn("size_group", equal_bucket(F.row_number().over(cross.orderBy("log_market_cap", "symbol")), F.count(F.lit(1)).over(cross), groups))
    return rows.withColumn("group_rank", F.row_number().over(Window.partitionBy(*by, "size_group").orderBy(F.desc("score"), "symbol")))


def buffered_portfolio(ranked: DataFrame, *, per_group: int, buffer_rank: int, name: str, scenario: str = "method") -> DataFrame:
    """Size-stratified portfolio that keeps last month's members while they rank within the buffer.

    A month depends on the one before, so the months of a scenario are one array, folded in order
    inside the engine: as long as the history has months, whatever the panel's size.
    ``ranked`` comes from :func:`size_groups`; only ranks that can matter
    (up to max(buffer_rank, 2 * per_group)) are passed on.
    """
    within = max(buffer_rank, 2 * per_group)

    # A symbol can change its size group; holdings of any group count, so the groups of a scenario run together.
    row = F.struct("size_group", "group_rank", "symbol")
    close = ranked.filter(F.col("group_rank") <= within).groupBy(scenario, "date").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    months = close.groupBy(scenario).agg(F.array_sort(F.collect_list(F.struct("date", "rows"))).alias("months"))
    kind = "array<struct<date:date,symbol:string,size_group:int,group_rank:int>>"
    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast(kind).alias("out"))

    def month(s: Column, m: Column) -> Column:
        stays = lambda x: F.array_contains(s["held"], x["symbol"]) & (x["group_rank"] <= buffer_rank)
        ordered = F.concat(F.filter(m["rows"], stays), F.filter(m["rows"], lambda x: ~stays(x)))
        groups = F.array_sort(F.array_distinct(F.transform(m["rows"], lambda x: x["size_group"])))
        chosen = F.flatten(F.transform(groups, lambda g: F.slice(F.filter(ordered, lambda x: x["size_group"] == g), 1, per_group)))
        out = F.transform(chosen, lambda x: F.struct(m["date"].alias("date"), x["symbol"].alias("symbol"), x["size_group"].cast("int").alias("size_group"), x["group_rank"].cast("int").alias("group_rank")))
        return F.struct(F.transform(chosen, lambda x: x["symbol"]).alias("held"), F.concat(s["out"], out.cast(kind)).alias("out"))

    chosen = months.select(scenario, F.inline(F.aggregate("months", start, month)["out"]))
    count = F.count(F.lit(1)).over(Window.partitionBy(scenario, "date"))
    return chosen.select(F.lit(name).alias("portfolio_name"), scenario, "date", "symbol", "size_group", "group_rank", (1.0 / count).alias("target_weight"))


def diagnostics(targets: DataFrame) -> DataFrame:
    """portfolio_name, date, one_way_turnover (against the date before; 12 digits, free of the order of sums), holdings, max_weight, hhi, effective_holdings."""
    dates = targets.select("portfolio_name", "date").distinct()
    dates = dates.withColumn("next", F.lead("date").over(Window.partitionBy("portfolio_name").orderBy("date")))
    old = targets.join(dates, ["portfolio_name", "date"]).filter("next IS NOT NULL")
    old = old.select("portfolio_name", F.col("next").alias("date"), "symbol", (-F.col("target_weight")).alias("w"))
    moves = targets.select("portfolio_name", "date", "symbol", F.col("target_weight").alias("w")).unionByName(old).groupBy("portfolio_name", "date", "symbol").agg(F.sum("w").alias("d"))
    turnover = moves.groupBy("portfolio_name", "date").agg(F.round(F.sum(F.abs("d")) * 0.5, 12).alias("one_way_turnover"))
    stats = targets.groupBy("portfolio_name", "date").agg(F.count(F.lit(1)).alias("holdings"), F.max("target_weight").alias("max_weight"), F.sum(F.col("target_weight") * F.col("target_weight")).alias("hhi"))
    return stats.join(turnover, ["portfolio_name", "date"]).withColumn("effective_holdings", 1.0 / F.col("hhi"))


def overlap(targets: DataFrame, baseline: str, other: str) -> DataFrame:
    """date, holding_overlap of two portfolios, over the smaller one."""
    a = targets.filter(F.col("portfolio_name") == baseline).select("date", "symbol", F.lit(1).alias("x"))
    b = targets.filter(F.col("portfolio_name") == other).select("date", "symbol", F.lit(1).alias("y"))
    both = a.join(b, ["date", "symbol"], "full_outer").groupBy("date").agg(F.count("x").alias("n"), F.count("y").alias("m"), F.count(F.col("x") + F.col("y")).alias("k"))
    return both.select("date", (F.col("k") / F.greatest(F.least("n", "m"), F.lit(1))).alias("holding_overlap"))


def compared(targets: DataFrame, diagnostic: DataFrame, baseline: str, other: str) -> DataFrame:
    """date, holding_overlap, turnover_difference (other less baseline) of the dates that both portfolios have."""
    turn = lambda n, c: diagnostic.filter(F.col("portfolio_name") == n).select("date", F.col("one_way_turnover").alias(c))
    both = turn(baseline, "__b").join(turn(other, "__o"), "date").select("date", (F.col("__o") - F.col("__b")).alias("turnover_difference"))
    return overlap(targets, baseline, other).join(both, "date")


def quality_warnings(diagnostic: DataFrame, coverage: DataFrame, *, expected: int, minimum_coverage: float, turnover: float) -> DataFrame:
    """date, portfolio_name, severity, rule, details: one row for each rule that a month breaks."""
    rows = diagnostic.join(coverage, "date", "left")
    rule = lambda test, name, value: F.when(test, F.struct(F.lit(name).alias("rule"), value.alias("details")))
    found = F.array_compact(
        F.array(
            rule(F.col("holdings") < expected, "insufficient_holdings", F.col("holdings").cast("string")),
            rule(F.col("coverage") < minimum_coverage, "coverage_decline", F.format_string("%.6f", "coverage")),
            rule(F.col("one_way_turnover") > turnover, "high_target_turnover", F.format_string("%.6f", "one_way_turnover")),
        )
    )
    return rows.select("date", "portfolio_name", F.lit("warning").alias("severity"), F.explode(found).alias("r")).select("date", "portfolio_name", "severity", "r.*")


def exposures(targets: DataFrame, scored: DataFrame, liquidity: DataFrame, candidates: list[str]) -> DataFrame:
    """Weighted factor and family exposures, and capacity (largest weight over mean amount, null if any is missing)."""
    value = F.when(F.col("factor_name") == "log_market_cap", F.col("raw_value")).otherwise(F.col("score_size_neutral"))
    rows = scored.filter(F.col("factor_name").isin(*candidates, "log_market_cap")).select("date", "symbol", "factor_name", "family", value.alias("value"))
    joined = targets.join(rows, ["date", "symbol"])
    total = F.coalesce(F.sum(F.col("target_weight") * F.col("value")), F.lit(0.0))
    keys = ["date", "portfolio_name"]
    factor = joined.groupBy(*keys, "family", "factor_name").agg(total.alias("exposure")).withColumn("exposure_type", F.lit("factor"))
    family = joined.filter(F.col("factor_name").isin(*candidates)).groupBy(*keys, "family").agg((total / F.countDistinct("factor_name")).alias("exposure"))
    family = family.withColumn("factor_name", F.col("family")).withColumn("exposure_type", F.lit("family"))
    load = targets.join(liquidity, ["date", "symbol"], "left").groupBy(*keys).agg(
        F.when(F.bool_and(F.col("amount_mean").isNotNull()), F.max(F.try_divide("target_weight", "amount_mean"))).alias("exposure")
    )
    load = load.withColumn("family", F.lit("capacity")).withColumn("factor_name", F.lit("amount_mean")).withColumn("exposure_type", F.lit("capacity"))
    return factor.unionByName(family).unionByName(load)


def with_limits(panel: DataFrame) -> DataFrame:
    """Adds limit_low and limit_high: the previous close moved by the limit rate, half up at 0.01."""
    exact = lambda c: F.col(c).cast("string").cast("decimal(20,10)")
    ok = positive("prev_close_raw")
    move = lambda s: F.when(ok, F.round(exact("prev_close_raw") * (F.lit(1) + s * exact("limit_rate")), 2).cast("double"))
    return panel.withColumn("limit_low", move(F.lit(-1))).withColumn("limit_high", move(F.lit(1)))


def planned_orders(targets: DataFrame, panel: DataFrame, calendar: DataFrame, *, capital: float, lot: int = 100) -> DataFrame:
    """Orders that move each portfolio from one target to the next at the next date's open, before any is filled.

    Quantities are whole lots of the target weight of ``capital``; a position is the target
    of the date before.  Each order gets the first reason that keeps it from trading.
    Windows of ``panel`` by symbol run for the symbols of ``targets`` alone, and quotes of
    order dates alone are sent: a panel in buckets by symbol is not shuffled.
    """
    dates = targets.select("portfolio_name", "date").distinct()
    dates = dates.withColumn("next_signal", F.lead("date").over(Window.partitionBy("portfolio_name").orderBy("date")))
    # Every holding is wanted on its own signal and is to be left on the one after.
    gone = targets.join(dates, ["portfolio_name", "date"]).filter("next_signal IS NOT NULL").select("portfolio_name", F.col("next_signal").alias("date"), "symbol", F.lit(0.0).alias("target_weight"))
    wish = targets.select(*TARGET).unionByName(gone).groupBy("portfolio_name", "date", "symbol").agg(F.sum("target_weight").alias("target_weight"))
    wish = wish.join(F.broadcast(calendar), "date").filter("next_date IS NOT NULL")
    days = targets.select("date").distinct().join(F.broadcast(calendar), "date").select("next_date").distinct()
    quotes = panel.join(targets.select("symbol").distinct(), "symbol", "left_semi").withColumn("next_date", F.col("date")).join(F.broadcast(days), "next_date", "left_semi")
    quotes = with_limits(quotes).select("symbol", "next_date", "open_raw", "adv", "is_suspended", "limit_low", "limit_high")
    rows = wish.join(quotes, ["symbol", "next_date"], "left")
    lots = F.floor(F.lit(capital) * F.col("target_weight") / F.col("open_raw") / lot) * lot
    rows = rows.withColumn("quantity", F.when(positive("open_raw"), lots).cast("long"))
    mine = Window.partitionBy("portfolio_name", "symbol").orderBy("date")
    rows = rows.withColumn("held", F.coalesce(F.last("quantity", ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    rows = rows.withColumn("change", F.col("quantity") - F.col("held")).filter("change IS NULL OR change <> 0")
    side = F.when(F.col("change") > 0, "buy").otherwise("sell")
    rows = rows.withColumn("side", side)
    reason = (
        F.when(F.col("change").isNull() | F.coalesce("is_suspended", F.lit(True)), "suspended_or_missing_open")
        .when(~positive("adv"), "missing_lagged_adv")
        .when((F.col("side") == "buy") & (F.col("open_raw") >= F.col("limit_high")) & (F.col("open_raw") <= F.col("limit_high") + 0.01), "limit_up_buy")
        .when((F.col("side") == "sell") & (F.col("open_raw") <= F.col("limit_low")) & (F.col("open_raw") >= F.col("limit_low") - 0.01), "limit_down_sell")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("portfolio_name", F.col("date").alias("signal_date"), F.col("next_date").alias("date"), "symbol", "side", F.abs("change").alias("quantity"), "open_raw", "adv", "reason")


def filled(planned: DataFrame, *, participation: float | Column, lot: int = 100) -> DataFrame:
    """Adds fill_quantity: the part of each order that a share of the mean amount allows, none where a reason blocks it."""
    room = F.floor(F.col("adv") * F.lit(participation) / F.col("open_raw"))
    room = F.when(F.col("side") == "buy", F.floor(room / lot) * lot).otherwise(room).cast("long")
    return planned.withColumn("fill_quantity", F.when(F.col("reason").isNull(), F.least("quantity", room)).otherwise(F.lit(0).cast("long")))


def rebalance_orders(targets: DataFrame, panel: DataFrame, calendar: DataFrame, *, capital: float, lot: int = 100, participation: float = 0.1) -> DataFrame:
    """:func:`planned_orders` with what of each is filled."""
    return filled(planned_orders(targets, panel, calendar, capital=capital, lot=lot), participation=participation, lot=lot).select(*ORDER)


def fill_statistics(orders: DataFrame, keys: list[str]) -> DataFrame:
    """keys, order_count, filled, partially_filled, expired, trade_count, the rates of filled and of partly filled orders, and unfilled_rate (share of the quantity).

    ``orders``: keys, quantity, fill_quantity.  An order without a quantity (no price to plan
    it at) has expired and counts in no share of the quantity; one filled beyond its quantity raises.
    """
    got = F.coalesce("fill_quantity", F.lit(0))
    over = F.when(got > F.col("quantity"), F.raise_error(F.lit("an order is filled beyond its quantity")).cast("boolean"))
    n = F.count(F.lit(1))
    rows = orders.withColumn("__over", over).withColumn("__whole", F.coalesce("__over", (got > 0) & (got == F.col("quantity"))))
    out = rows.groupBy(*keys).agg(
        n.alias("order_count"), F.count_if("__whole").alias("filled"), F.count_if((got > 0) & (got < F.col("quantity"))).alias("partially_filled"),
        F.count_if(got == 0).alias("expired"), F.count_if(got > 0).alias("trade_count"), F.sum("quantity").alias("__q"), F.sum(F.when(F.col("quantity").isNotNull(), got)).alias("__f"),
    )
    share = lambda c: F.try_divide(c, "order_count")
    return out.select(
        *keys, "order_count", "filled", "partially_filled", "expired", "trade_count", share("filled").alias("filled_order_rate"), share("partially_filled").alias("partially_filled_order_rate"),
        (1 - F.try_divide("__f", "__q")).alias("unfilled_rate"),
    )


def priced(orders: DataFrame, *, fixed_bps: float | Column = 5.0, impact_bps: float | Column = 10.0, reference: float | Column = 0.01, most_bps: float | Column = 50.0) -> DataFrame:
    """Adds impact_bps and execution_price (square-root impact, capped; price half up at 0.01) to filled orders.

    Each parameter is a number or a column of ``orders``.
    """
    filled = orders.filter("fill_quantity > 0")
    fixed_bps, impact_bps, reference = F.lit(fixed_bps), F.lit(impact_bps), F.lit(reference)
    share = F.col("fill_quantity") * F.col("open_raw") / F.col("adv")
    impact = F.least(F.lit(most_bps), impact_bps * F.sqrt(share / reference))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    raw = F.col("open_raw") * (1 + sign * (fixed_bps + F.col("impact_bps")) / 10000)
    filled = filled.withColumn("impact_bps", impact).withColumn("execution_price", ticks(raw))
    gross = F.col("fill_quantity") * F.col("open_raw") / 10000
    return filled.withColumn("amount", F.col("fill_quantity") * F.col("execution_price")).withColumn("slippage_cost", gross * fixed_bps).withColumn("impact_cost", gross * F.col("impact_bps"))


def with_fees(trades: DataFrame, stamp: DataFrame, transfer: DataFrame, *, commission: float | Column = 0.0003, least: float | Column = 5.0, scale: float | Column = 1.0) -> DataFrame:
    """Adds commission, stamp_duty, transfer_fee and total_cost; rate, minimum and ``scale`` of the fees are numbers or columns.

    ``stamp``: start, end, buy_rate, sell_rate; ``transfer``: start, end, market, basis,
    rate, minimum.  Both are small rule tables.  Rules that overlap raise ValueError; a
    trade on a day (and market) without a rule raises when it is computed.
    """
    for rules, keys in ((stamp, []), (transfer, ["market"])):
        _one_rule_a_day(rules, keys)
    rows = trades.withColumn("market", market("symbol"))
    within = lambda t: (F.col("date") >= F.col(f"{t}.start")) & (F.col("date") <= F.col(f"{t}.end"))
    rows = rows.join(F.broadcast(stamp).alias("s"), within("s"), "left").join(F.broadcast(transfer).alias("f"), within("f") & (F.col("f.market") == rows["market"]), "left")
    none = lambda what: F.raise_error(F.concat(F.lit(f"no {what} rule for "), F.col("symbol"), F.lit(" on "), F.col("date").cast("string")))
    basis = F.when(F.col("f.basis").isNull(), none("transfer fee").cast("double")).when(F.col("f.basis") == "amount", F.col("amount")).otherwise(F.col("fill_quantity"))
    rate = F.when(F.col("s.start").isNull(), none("stamp duty").cast("double")).otherwise(F.when(F.col("side") == "buy", F.col("s.buy_rate")).otherwise(F.col("s.sell_rate")))
    plain = lambda c: c if isinstance(scale, float) and scale == 1.0 else c * F.lit(scale)
    kept = [F.col(c) for c in trades.columns if c not in ("commission", "stamp_duty", "transfer_fee")]  # a parameter column gives way to its result
    out = rows.select(
        *kept, plain(F.greatest(F.lit(least), F.col("amount") * F.lit(commission))).alias("commission"), plain(F.col("amount") * rate).alias("stamp_duty"),
        plain(F.greatest(F.col("f.minimum"), basis * F.col("f.rate"))).alias("transfer_fee"),
    )
    return out.withColumn("total_cost", F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee") + F.col("slippage_cost") + F.col("impact_cost"))


def _one_rule_a_day(rules: DataFrame, keys: list[str]) -> None:
    """Raises ValueError if two rules of a key hold on one day; rule tables are a handful of rows."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    require_none(rules.withColumn("__until", F.lag("end").over(w)), F.coalesce(F.col("__until") >= F.col("start"), F.lit(False)), "fee rules overlap")


def uncovered_days(rules: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Days (and keys) of a range for which not exactly one rule holds."""
    return uncovered_dates(rules, rules.sparkSession.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day"), keys)


def uncovered_dates(rules: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Days of ``days`` (day), and keys of the rules, for which not exactly one rule holds, with their number."""
    days = days.select("day").distinct()
    grid = days.crossJoin(F.broadcast(rules.select(*keys).distinct())) if keys else days  # trading days by a handful of keys
    r = rules.alias("r")
    on = (F.col("g.day") >= F.col("r.start")) & (F.col("g.day") <= F.col("r.end"))
    for k in keys:
        on = on & (F.col(f"g.{k}") == F.col(f"r.{k}"))
    return grid.alias("g").join(F.broadcast(r), on, "left").groupBy("g.day", *[F.col(f"g.{k}") for k in keys]).agg(F.count("r.start").alias("rules")).filter("rules <> 1")
