"""Buying under a limit of cash, and trading costs under many sets of assumptions in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .portfolio import filled, priced, with_fees

UNITS = 10_000


def _units(c: str, places: str = "decimal(28,4)") -> Column:
    return (F.col(c).cast("string").cast(places) * UNITS).cast("decimal(38,0)")


def proportional_buys(requests: DataFrame, cash: DataFrame, *, keys: tuple[str, ...] = ("portfolio_name", "date"), lot: int = 100) -> DataFrame:
    """keys, symbol, quantity, price, allocated, cash_left: what each portfolio can buy with its cash.

    ``requests``: keys, symbol, quantity, price; ``cash``: keys, available_cash.  If all fits it is bought as wished.
    Otherwise wishes are scaled to the cash and cut down to whole lots; the cash that is left
    goes lot by lot, one lot a symbol, to those with the largest value still wished for (ties
    by symbol), passing over a lot that does not fit.  Money is counted in ten-thousandths, so nothing depends
    on the order of sums.  A negative quantity or cash, a price that is not positive, and a
    portfolio without cash raise when computed.

    The wishes of one portfolio and date are one array, folded in order: as long as the
    portfolio has orders that day.
    """
    if lot <= 0:
        raise ValueError("a lot must be positive")
    q, price = F.col("quantity"), _units("price")
    sound = (q >= 0) & (price > 0)
    row = F.struct("symbol", q.cast("long").alias("quantity"), F.when(sound, price).otherwise(F.raise_error(F.lit("invalid buy request")).cast("decimal(38,0)")).alias("p"), F.col("price").alias("price"))
    groups = requests.groupBy(*keys).agg(F.collect_list(row).alias("rows"))
    money = cash.select(*keys, F.when(F.col("available_cash") >= 0, _units("available_cash")).otherwise(F.raise_error(F.lit("negative cash")).cast("decimal(38,0)")).alias("cash"))
    groups = groups.join(money, list(keys), "left").withColumn("cash", F.coalesce("cash", F.raise_error(F.lit("a portfolio has no cash entry")).cast("decimal(38,0)")))
    whole = lambda x: x.cast("decimal(38,0)")
    total = lambda rows, of: F.aggregate(rows, F.lit(0).cast("decimal(38,0)"), lambda s, x: whole(s + whole(of(x))))
    groups = groups.withColumn("wanted", total(F.col("rows"), lambda x: x["quantity"] * x["p"]))
    fits = F.col("wanted") <= F.col("cash")

    def base(x: Column) -> Column:
        lots = F.call_function("div", whole(x["quantity"] * F.col("cash")), whole(F.col("wanted") * lot))
        return F.when(fits, x["quantity"]).otherwise((lots * lot).cast("long"))

    based = F.transform("rows", lambda x: F.struct(x["symbol"].alias("symbol"), x["quantity"].alias("quantity"), x["p"].alias("p"), x["price"].alias("price"), base(x).alias("base")))
    groups = groups.withColumn("rows", based)
    # The largest unmet value first: structs sort by their fields.
    ordered = F.array_sort(F.transform("rows", lambda x: F.struct(whole(-(x["quantity"] - x["base"]) * x["p"]).alias("unmet"), *[x[c].alias(c) for c in ("symbol", "quantity", "p", "price", "base")])))
    groups = groups.withColumn("rows", ordered).withColumn("left", whole(F.col("cash") - total(F.col("rows"), lambda x: x["base"] * x["p"])))
    kind = "array<struct<symbol:string,quantity:bigint,price:double,allocated:bigint>>"
    start = F.struct(F.col("left").alias("left"), F.array().cast(kind).alias("done"))

    def step(s: Column, x: Column) -> Column:
        more = ~fits & (x["base"] + lot <= x["quantity"]) & (x["p"] * lot <= s["left"])
        got = F.struct(x["symbol"].cast("string").alias("symbol"), x["quantity"].alias("quantity"), x["price"].cast("double").alias("price"), (x["base"] + F.when(more, lot).otherwise(0)).cast("bigint").alias("allocated"))
        return F.struct(F.when(more, whole(s["left"] - x["p"] * lot)).otherwise(s["left"]).alias("left"), F.array_append(s["done"], got).alias("done"))

    bought = groups.withColumn("bought", F.aggregate("rows", start, step))
    cash_left = (F.col("bought.left").cast("decimal(38,4)") / UNITS).cast("double")
    return bought.select(*keys, cash_left.alias("cash_left"), F.explode("bought.done").alias("x")).select(*keys, "x.*", "cash_left")


#: What an execution scenario can set, with the kind of each.
SETTINGS = ("participation", "fixed_bps", "impact_bps", "reference", "most_bps", "commission", "least")
MODES = ("full", "explicit_only", "zero")


def execution_scenarios(spark: SparkSession, baseline: Mapping[str, float], experiments: Iterable[tuple[str, str, Mapping]], base: str = "baseline") -> DataFrame:
    """scenario, the SETTINGS and fee_scale: the baseline and each registered experiment of category ``execution``.

    ``experiments``: (id, category, parameters).  Parameters replace settings of the
    baseline; ``cost_mode`` is ``full``, ``explicit_only`` (no slippage) or ``zero`` (no fees either).
    An unknown parameter or mode, a repeated id, or a baseline that lacks a setting raises ValueError.  The
    table has one row a scenario and is small whatever the panel.
    """
    if set(baseline) != set(SETTINGS):
        raise ValueError("the baseline needs " + ", ".join(SETTINGS))
    rows: dict[str, tuple] = {base: (base, *[float(baseline[k]) for k in SETTINGS], 1.0)}
    for name, category, parameters in experiments:
        if category != "execution":
            continue
        own = dict(parameters)
        mode = own.pop("cost_mode", "full")
        if set(own) - set(SETTINGS):
            raise ValueError(f"unsupported execution parameters for {name}: " + ", ".join(sorted(set(own) - set(SETTINGS))))
        if mode not in MODES:
            raise ValueError(f"unsupported cost mode: {mode}")
        if name in rows:
            raise ValueError(f"a scenario is registered twice: {name}")
        full = {**baseline, **own}
        if mode != "full":
            full |= {"fixed_bps": 0.0, "impact_bps": 0.0}
        rows[name] = (name, *[float(full[k]) for k in SETTINGS], 0.0 if mode == "zero" else 1.0)
    return spark.createDataFrame(list(rows.values()), "scenario string, " + ", ".join(f"{k} double" for k in SETTINGS) + ", fee_scale double")


def scenario_trades(planned: DataFrame, scenarios: DataFrame, stamp: DataFrame, transfer: DataFrame, *, lot: int = 100) -> tuple[DataFrame, DataFrame]:
    """(orders, trades) of every scenario, each with a column scenario; ``planned`` as from ``planned_orders``.

    One plan serves all scenarios: the orders are planned once, and the table of scenarios is
    broadcast to them.
    """
    orders = filled(planned.crossJoin(F.broadcast(scenarios)), participation=F.col("participation"), lot=lot)  # one row a scenario
    trades = priced(orders, **{k: F.col(k) for k in ("fixed_bps", "reference", "most_bps")}, impact_bps=F.col("impact_bps"))
    trades = with_fees(trades, stamp, transfer, commission=F.col("commission"), least=F.col("least"), scale=F.col("fee_scale"))
    return orders, trades


def scenario_summary(orders: DataFrame, trades: DataFrame, base: str = "baseline") -> DataFrame:
    """scenario, portfolio_name, orders, requested, filled, unfilled_rate, amount, total_cost, cost_rate, cost_rate_delta (against the base scenario)."""
    keys = ["scenario", "portfolio_name"]
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double")
    wished = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("requested"), F.sum("fill_quantity").alias("filled"))
    paid = trades.groupBy(*keys).agg(exact("amount").alias("amount"), exact("total_cost").alias("total_cost"))
    rows = wished.join(paid, keys, "left").fillna(0.0, ["amount", "total_cost"])
    rows = rows.withColumn("unfilled_rate", 1 - F.try_divide("filled", "requested")).withColumn("cost_rate", F.try_divide("total_cost", "amount"))
    at_base = rows.filter(F.col("scenario") == base).select("portfolio_name", F.col("cost_rate").alias("__base"))
    return rows.join(at_base, "portfolio_name", "left").withColumn("cost_rate_delta", F.col("cost_rate") - F.col("__base")).select(*keys, "orders", "requested", "filled", "unfilled_rate", "amount", "total_cost", "cost_rate", "cost_rate_delta")
