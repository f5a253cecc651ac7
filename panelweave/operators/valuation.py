"""Prices at which holdings are valued, prices that two panels must share, and what an extended panel needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import positive, require_none, require_unique

EVENTS = ("stock_merger", "write_off", "cash_exit")


def valuation_prices(holdings: DataFrame, panel: DataFrame, *, open_price: str = "open_adj", close_price: str = "close_adj") -> DataFrame:
    """date, symbol, opening_price, closing_price, close_date of each holding (date, symbol).

    At the open a holding is worth the day's valid opening price, else the last valid close
    of the days before; at the close the day's valid close, else the last one before, with its date.  A
    holding that never had a valid close (or, at the open, has neither) raises when computed.  One sorted pass
    over a symbol's rows; the panel is not joined day by day.
    """
    quotes = panel.select("date", "symbol", F.when(positive(open_price), F.col(open_price)).alias("o"), F.when(positive(close_price), F.col(close_price)).alias("c"), F.lit(False).alias("held"))
    asked = holdings.select("date", "symbol").distinct().withColumns({"o": F.lit(None).cast("double"), "c": F.lit(None).cast("double"), "held": F.lit(True)})
    days = quotes.unionByName(asked).repartition("symbol").groupBy("date", "symbol").agg(F.max("o").alias("o"), F.max("c").alias("c"), F.bool_or("held").alias("held"))
    mark = F.when(F.col("c").isNotNull(), F.struct(F.col("date").alias("d"), F.col("c").alias("p")))
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("now", F.last(mark, ignorenulls=True).over(upto)).withColumn("earlier", F.last(mark, ignorenulls=True).over(before)).filter("held")
    none = lambda when: F.raise_error(F.concat(F.lit(f"no price {when} to value "), F.col("symbol"), F.lit(" on "), F.col("date").cast("string"))).cast("double")
    return days.select(
        "date", "symbol", F.coalesce("o", "earlier.p", none("at the open")).alias("opening_price"), F.coalesce("now.p", none("at the close")).alias("closing_price"), F.col("now.d").alias("close_date"),
    )


def price_mismatches(executed: DataFrame, rebuilt: DataFrame, price: str = "close_adj") -> DataFrame:
    """date, symbol, executed, rebuilt, fault of every executed price that a rebuilt panel does not have exactly: missing or differing."""
    one = executed.select("date", "symbol", F.col(price).alias("executed"))
    two = rebuilt.select("date", "symbol", F.col(price).alias("rebuilt"))
    fault = F.when(F.col("rebuilt").isNull() & F.col("executed").isNotNull(), "missing").when(F.col("rebuilt") != F.col("executed"), "differing")
    return one.join(two, ["date", "symbol"], "left").withColumn("fault", fault).filter("fault IS NOT NULL")


def benchmark_members(keys: DataFrame, panel: DataFrame) -> DataFrame:
    """date, symbol, market_cap of the members; a repeated key or a member without a positive market value raises ValueError."""
    members = require_unique(keys.select("date", "symbol"), ["date", "symbol"], "benchmark members")
    rows = members.join(panel.select("date", "symbol", F.col("total_market_cap").alias("market_cap")), ["date", "symbol"], "left")
    return require_none(rows, ~positive("market_cap"), "benchmark members lack a positive market value")


def extended_panel(history: DataFrame, extension: DataFrame, *, start: str, end: str) -> DataFrame:
    """``history`` followed by the rows of ``extension`` from ``start`` on.

    ``extension`` is built from bars that begin early enough for its rolling values; those warm-up rows are
    dropped.  Raises ValueError if history reaches ``start``, the extension passes ``end``, or a key repeats.
    """
    day = lambda x: F.lit(x).cast("date")
    require_none(history, F.col("date") >= day(start), f"the history reaches {start}")
    require_none(extension, F.col("date") > day(end), f"the extension passes {end}")
    both = history.unionByName(extension.filter(F.col("date") >= day(start)).select(*history.columns))
    return require_unique(both, ["date", "symbol"], "extended panel")


def event_violations(events: DataFrame, end: str) -> DataFrame:
    """source_symbol, effective_date, rule: one row for each term of the contract of security events that a row breaks.

    A stock_merger has another target and a positive ratio and pays no cash; a cash_exit pays cash and has no target and no
    ratio; a write_off has none of these.  Types are known, keys (source_symbol, effective_date)
    unique, no date is missing or sealed (after ``end``), and there is no chain: a target is not gone by then.
    """
    ratio, cash = F.coalesce("ratio", F.lit(0.0)), F.coalesce("cash_per_share", F.lit(0.0))
    target = F.coalesce(F.trim("target_symbol"), F.lit(""))
    kind = F.col("event_type")
    rules: dict[str, Column] = {
        "unknown_type": ~kind.isin(*EVENTS) | kind.isNull(),
        "missing_key": F.col("source_symbol").isNull() | F.col("effective_date").isNull(),
        "sealed_date": F.col("effective_date") > F.lit(end).cast("date"),
        "merger_terms": (kind == "stock_merger") & ((target == "") | (target == F.col("source_symbol")) | ~positive(ratio) | (cash != 0)),
        "exit_terms": (kind == "cash_exit") & ((target != "") | ~positive(cash) | (ratio != 0)),
        "write_off_terms": (kind == "write_off") & ((target != "") | (cash != 0) | (ratio != 0)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in rules.items()]))
    keys = ["source_symbol", "effective_date"]
    out = events.select(*keys, F.explode(found).alias("rule"))
    twice = events.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("duplicate_key").alias("rule"))
    gone = events.select(F.col("source_symbol").alias("__s"), F.col("effective_date").alias("__d"))
    chained = events.join(gone, (F.col("target_symbol") == F.col("__s")) & (F.col("__d") <= F.col("effective_date")), "left_semi").select(*keys, F.lit("target_is_gone").alias("rule"))
    return out.unionByName(twice).unionByName(chained)


def industry_limitation(segments: DataFrame) -> DataFrame:
    """status, reason, eligible_for_primary_conclusion, once: industries of the past are not known point in time, so no segment by industry supports a conclusion."""
    row = segments.sparkSession.createDataFrame([("descriptive_only", "historical_industry_point_in_time_unverified", False)], "status string, reason string, eligible_for_primary_conclusion boolean")
    by_industry = segments.filter("segment_type = 'industry'").agg(F.count(F.lit(1)).alias("industry_segments"))
    return row.crossJoin(by_industry)  # one row each
