"""The factor registry, raw factors and the monthly long panel."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complete, downside, finite, safe_log, safe_reciprocal, safe_return, valid_trade
from .universe import signal_dates


@dataclass(frozen=True)
class Factor:
    name: str
    family: str
    sources: tuple[str, ...]
    lookback: int
    direction: int
    needs_verified: bool = False
    size_neutral: bool = True


TRADE = ("close_adj", "volume", "amount")
RETURN = ("close_adj", "prev_close_adj", "volume", "amount")

# Names, families, sources, lookbacks and directions of the factors.
FACTORS: tuple[Factor, ...] = (
    Factor("ep_ttm", "value", ("pe_ttm",), 0, 1, needs_verified=True),
    Factor("bp", "value", ("pb",), 0, 1, needs_verified=True),
    Factor("sp_ttm", "value", ("ps_ttm",), 0, 1, needs_verified=True),
    Factor("momentum_60", "momentum", TRADE, 60, 1),
    Factor("momentum_120", "momentum", TRADE, 120, 1),
    Factor("momentum_12_1", "momentum", TRADE, 252, 1),
    Factor("reversal_5", "reversal", TRADE, 5, -1),
    Factor("reversal_20", "reversal", TRADE, 20, -1),
    Factor("turnover_20", "liquidity", ("turnover", *TRADE), 20, -1),
    Factor("amihud_20", "liquidity", RETURN, 20, 1),
    Factor("volatility_20", "low_volatility", RETURN, 20, -1),
    Factor("volatility_60", "low_volatility", RETURN, 60, -1),
    Factor("downside_volatility_60", "low_volatility", RETURN, 60, -1),
    Factor("log_market_cap", "size", ("total_market_cap",), 0, -1, size_neutral=False),
)
BY_NAME = {f.name: f for f in FACTORS}
SIZE = "log_market_cap"


def primary_variant(name: str) -> str:
    return "score_size_neutral" if BY_NAME[name].size_neutral else "score"


def sources(names: list[str]) -> list[str]:
    unknown = [n for n in names if n not in BY_NAME]
    if unknown:
        raise ValueError("unknown factors: " + ", ".join(unknown))
    return list(dict.fromkeys(c for n in names for c in BY_NAME[n].sources))


def raw_factors(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """date, symbol and one column a factor; all factors of a symbol share one shuffle and one sort.

    Price factors look at valid rows alone (windows are partitioned by validity) and are
    null on invalid rows.
    """
    names = [f.name for f in FACTORS] if names is None else names
    need = sources(names)
    traded = set(TRADE) <= set(need)
    df = panel.select("date", "symbol", *need).withColumn("__v", valid_trade() if traded else F.lit(True))
    w = Window.partitionBy("symbol", "__v").orderBy("date")
    close = F.col("close_adj")
    if "prev_close_adj" in need:
        df = df.withColumn("__r", safe_return("close_adj", "prev_close_adj"))
        illiquid = F.try_divide(F.abs("__r"), F.col("amount"))
        df = df.withColumn("__a", F.when(finite(illiquid), illiquid))
    if "turnover" in need:
        df = df.withColumn("__t", F.when(finite("turnover") & (F.col("turnover") >= 0), F.col("turnover")))
    year = math.sqrt(252.0)
    lagged = lambda k: F.lag("close_adj", k).over(w)
    formulas = {
        "ep_ttm": lambda: safe_reciprocal("pe_ttm"),
        "bp": lambda: safe_reciprocal("pb"),
        "sp_ttm": lambda: safe_reciprocal("ps_ttm"),
        "momentum_60": lambda: safe_return(close, lagged(60)),
        "momentum_120": lambda: safe_return(close, lagged(120)),
        "momentum_12_1": lambda: safe_return(lagged(21), lagged(252)),
        "reversal_5": lambda: safe_return(close, lagged(5)),
        "reversal_20": lambda: safe_return(close, lagged(20)),
        "turnover_20": lambda: complete(F.avg, "__t", w, 20),
        "amihud_20": lambda: complete(F.avg, "__a", w, 20),
        "volatility_20": lambda: complete(F.stddev_samp, "__r", w, 20) * year,
        "volatility_60": lambda: complete(F.stddev_samp, "__r", w, 60) * year,
        "downside_volatility_60": lambda: downside("__r", w, 60) * year,
        SIZE: lambda: safe_log("total_market_cap"),
    }
    timeless = {"ep_ttm", "bp", "sp_ttm", SIZE}
    value = lambda n: formulas[n]() if n in timeless else F.when(F.col("__v"), formulas[n]())
    return df.select("date", "symbol", *[value(n).alias(n) for n in names])


def monthly_panel(panel: DataFrame, universe: DataFrame, names: list[str] | None = None, dates: DataFrame | None = None) -> DataFrame:
    """date, symbol, factor_name, family, raw_value for eligible symbols on the last date of each month (on ``dates``, if given)."""
    names = [f.name for f in FACTORS] if names is None else names
    dates = F.broadcast(signal_dates(panel) if dates is None else dates)
    keys = universe.filter("is_eligible").select("date", "symbol").join(dates, "date", "left_semi")
    # The other dates' factors are left where they were computed.
    wide = keys.join(raw_factors(panel, names).join(dates, "date", "left_semi"), ["date", "symbol"], "left")
    family = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(BY_NAME[n].family))])
    return wide.unpivot(["date", "symbol"], names, "factor_name", "raw_value").select(
        "date", "symbol", "factor_name", family[F.col("factor_name")].alias("family"), "raw_value"
    )


def liquidity_proxy(long_panel: DataFrame) -> DataFrame:
    return long_panel.filter("factor_name = 'amihud_20'").select("date", "symbol", (-F.col("raw_value")).alias("liquidity"))
