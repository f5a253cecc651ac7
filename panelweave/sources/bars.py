"""A weekly price panel of suppliers, derived from order lines.

symbol: supplier number in six digits; date: Monday of the week.  Money is summed in whole
cents, so sums are exact and ranks do not depend on summation order; a sum beyond 64 bits raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

# Columns that repeat another one.
SAME = {"open_adj": "open_raw", "high_adj": "high_raw", "low_adj": "low_raw"}
BARS = [
    "date", "symbol", "open_raw", "high_raw", "low_raw", "close_raw", "prev_close_raw", "open_adj", "high_adj", "low_adj", "close_adj", "prev_close_adj",
    "volume", "amount", "turnover", "total_market_cap", "pe_ttm", "pb", "ps_ttm", "is_st",
]


def cents(c: str) -> Column:
    """Hundredths, halves away from zero, as DuckDB casts to DECIMAL(18,2); null unless finite, beyond 64 bits the cast raises."""
    return F.when(finite(c), (F.col(c) * 100 + F.signum(c) * 0.5).cast("long"))


def weekly_bars(lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """One shuffle, of order lines by symbol: most weeks of a symbol have one or two lines, so summing before it would save nothing.

    ``parts``: number of partitions, by symbol; Spark's own choice if None.
    """
    money = lambda c: F.sum(cents(c))
    units = lambda c: c / F.lit(100.0)
    place = F.unix_date(F.to_date("l_shipdate")) * F.lit(10**12) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    week = lineitem.select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        place.alias("place"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )
    bar = week.repartition(*([parts] if parts else []), "symbol").groupBy("symbol", "date").agg(
        F.min_by("unit", "place").alias("open_raw"),
        F.max("unit").alias("high_raw"),
        F.min("unit").alias("low_raw"),
        F.max_by("unit", "place").alias("close_raw"),
        money("l_extendedprice").alias("money"),
        units(money("l_quantity")).alias("volume"),
        units(money("l_discount")).alias("discount"),
        units(money("l_tax")).alias("tax"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("returned").alias("returned"),
    )
    past = Window.partitionBy("symbol").orderBy("date")
    upto = past.rowsBetween(Window.unboundedPreceding, 0)
    bar = bar.withColumn("amount", units(F.col("money"))).withColumn("close_adj", F.col("amount") / F.col("volume"))
    return bar.select(
        "date",
        "symbol",
        "open_raw",
        "high_raw",
        "low_raw",
        "close_raw",
        F.lag("close_raw").over(past).alias("prev_close_raw"),
        F.col("open_raw").alias("open_adj"),
        F.col("high_raw").alias("high_adj"),
        F.col("low_raw").alias("low_adj"),
        "close_adj",
        F.lag("close_adj").over(past).alias("prev_close_adj"),
        "volume",
        "amount",
        (F.col("lines") / F.sum("lines").over(upto)).alias("turnover"),
        units(F.sum("money").over(upto)).alias("total_market_cap"),
        F.try_divide(F.col("close_adj") * F.col("lines"), F.col("discount")).alias("pe_ttm"),
        F.try_divide(F.col("close_adj") * F.col("lines"), F.col("tax")).alias("pb"),
        F.try_divide(F.col("close_adj") * F.col("lines"), F.col("volume")).alias("ps_ttm"),
        (F.col("returned") * 2 > F.col("lines")).alias("is_st"),
    )


def read_bars(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return weekly_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), parts)


BARS_SQL = """
week AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         l_extendedprice / l_quantity AS unit, (CAST(l_shipdate AS DATE) - DATE '1970-01-01') * 1000000000000 + l_orderkey * 10 + l_linenumber AS place,
         l_extendedprice, l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem
), bar AS (
  SELECT symbol, date, arg_min(unit, place) AS open_raw, max(unit) AS high_raw, min(unit) AS low_raw, arg_max(unit, place) AS close_raw,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS money, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax, count(*) AS lines, sum(returned) AS returned
  FROM week GROUP BY symbol, date
), bars AS (
  SELECT date, symbol, open_raw, high_raw, low_raw, close_raw, lag(close_raw) OVER w AS prev_close_raw, open_raw AS open_adj,
         high_raw AS high_adj, low_raw AS low_adj, amount / volume AS close_adj, lag(amount / volume) OVER w AS prev_close_adj, volume, amount,
         CAST(lines AS DOUBLE) / CAST(sum(lines) OVER u AS DOUBLE) AS turnover, CAST(sum(money) OVER u AS DOUBLE) AS total_market_cap,
         CASE WHEN discount <> 0 THEN amount / volume * lines / discount END AS pe_ttm, CASE WHEN tax <> 0 THEN amount / volume * lines / tax END AS pb,
         amount / volume * lines / volume AS ps_ttm, returned * 2 > lines AS is_st
  FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY date), u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)
)"""
