"""A cache of query results kept in shards: rows, and a coverage table that says which (symbol, year) was asked.

A shard that was asked for a symbol and year and got nothing has a coverage row with 0 rows,
so "no rows" and "not asked" stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import require_none

GRID = ["symbol", "year"]


def provider_code(symbol: str | Column) -> Column:
    """``sh.`` or ``sz.`` and the six digits of a symbol of the main markets; anything else raises when computed."""
    s = F.lpad((F.col(symbol) if isinstance(symbol, str) else symbol).cast("string"), 6, "0")
    bad = F.raise_error(F.concat(F.lit("unsupported security: "), F.coalesce(s, F.lit("null"))))
    known = s.rlike("^[0-9]{6}$")
    return F.when(known & s.startswith("6"), F.concat(F.lit("sh."), s)).when(known & (s.startswith("0") | s.startswith("3")), F.concat(F.lit("sz."), s)).otherwise(bad)


def sealed_responses(rows: DataFrame, dates: list[str], end: str) -> DataFrame:
    """symbol, year, field, value of every date field of a response that lies after ``end``; blanks are no dates."""
    text = lambda c: F.substring(F.trim(F.col(c).cast("string")), 1, 10)
    day = lambda c: F.when(F.coalesce(text(c), F.lit("")) != "", F.to_date(text(c), "yyyy-MM-dd"))
    found = F.array(*[F.struct(F.lit(c).alias("field"), day(c).alias("value")) for c in dates])
    return rows.select(*GRID, F.explode(found).alias("x")).select(*GRID, "x.*").filter(F.col("value") > F.lit(end).cast("date"))


def coverage_of(rows: DataFrame, symbols: DataFrame, years: list[int]) -> DataFrame:
    """symbol, year, row_count of the full grid, for a cache kept without one: pairs without rows count 0.

    Raises ValueError if a row lies outside the grid, as then the cache cannot have been asked for it.
    """
    grid = symbols.select("symbol").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    counts = rows.groupBy(*GRID).agg(F.count(F.lit(1)).alias("row_count"))
    require_none(counts.join(grid, GRID, "left_anti"), F.lit(True), "the cache holds rows outside its symbols and years")
    return grid.join(counts, GRID, "left").withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))


def coverage_faults(coverage: DataFrame, rows: DataFrame, symbols: DataFrame, years: list[int]) -> DataFrame:
    """symbol, year, fault, shards: what keeps shards from making one cache.

    ``coverage``: shard, symbol, year, row_count; ``rows``: shard, symbol, year, ...  Faults:
    not_covered (no shard asked), covered_twice, unexpected (outside the grid of symbols
    by years), row_count (the rows of a shard are not as many as it says), row_without_coverage.
    """
    grid = symbols.select("symbol").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    asked = coverage.groupBy(*GRID).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("shard")).alias("shards"))  # a handful of shards
    both = grid.withColumn("due", F.lit(True)).join(asked, GRID, "full_outer")
    fault = F.when(F.col("n").isNull(), "not_covered").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "covered_twice")
    none = F.array().cast("array<string>")
    out = both.withColumn("fault", fault).filter("fault IS NOT NULL").select(*GRID, "fault", F.coalesce("shards", none).alias("shards"))
    held = rows.groupBy("shard", *GRID).agg(F.count(F.lit(1)).alias("held"))
    said = coverage.groupBy("shard", *GRID).agg(F.max("row_count").alias("row_count"))
    counts = said.join(held, ["shard", *GRID], "full_outer")
    fault = F.when(F.col("row_count").isNull(), "row_without_coverage").when(F.col("row_count") != F.coalesce("held", F.lit(0)), "row_count")
    odd = counts.withColumn("fault", fault).filter("fault IS NOT NULL").select(*GRID, "fault", F.array("shard").alias("shards"))
    return out.unionByName(odd)


def merged_shards(rows: DataFrame, coverage: DataFrame, symbols: DataFrame, years: list[int]) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage) of one cache from shards that cover each symbol and year exactly once; rows keep the column shard as their origin.

    Raises ValueError with the first faults otherwise; see :func:`coverage_faults`.
    """
    found = coverage_faults(coverage, rows, symbols, years).orderBy(*GRID, "fault").limit(5).collect()
    if found:
        raise ValueError("cache shards do not fit: " + "; ".join(f"{r['symbol']} {r['year']} {r['fault']}" for r in found))
    return rows, coverage.select(*GRID, "row_count", "shard")


def refreshed(rows: DataFrame, coverage: DataFrame, new_rows: DataFrame, new_coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage) after later answers replace earlier ones, (symbol, year) by (symbol, year).

    An answer of no rows removes those of before.  ``new_coverage`` may hold answers of several
    rounds (column ``asked_at``); the latest of a pair counts, with the rows of its shard.
    """
    last = Window.partitionBy(*GRID).orderBy(F.desc("asked_at"), F.desc("shard"))
    latest = new_coverage.withColumn("__i", F.row_number().over(last)).filter("__i = 1").drop("__i")
    fresh = new_rows.join(latest.select("shard", *GRID), ["shard", *GRID], "left_semi")
    kept = rows.join(latest.select(*GRID), GRID, "left_anti")
    columns = ["symbol", "year", "row_count", "shard"]
    covered = coverage.join(latest.select(*GRID), GRID, "left_anti").select(*columns).unionByName(latest.select(*columns))
    return kept.select(*rows.columns).unionByName(fresh.select(*rows.columns)), covered
