"""Reading paired daily CSV files, bounded Parquet scans, and partitioned sinks.

A day's quotes come as two files, unadjusted and adjusted prices; whole ranges are read
in one job and joined on (date, symbol), never day by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import invalid_ohlc, market, padded_symbol, require_none
from ..operators.checks import row_rules
from .footers import record_source

# The column headers of the published daily files and their names here.
RAW_HEADERS = {
    "日期": "date",
    "代码": "symbol",
    "名称": "name",
    "所属行业": "industry",
    "开盘价": "open_raw",
    "最高价": "high_raw",
    "最低价": "low_raw",
    "收盘价": "close_raw",
    "前收盘价": "prev_close_raw",
    "成交量（股）": "volume",
    "成交额（元）": "amount",
    "换手率": "turnover",
    "是否ST": "is_st",
    "是否涨停": "is_limit_up",
    "总股本（股）": "total_shares",
    "流通股本（股）": "float_shares",
    "总市值（元）": "total_market_cap",
    "流通市值（元）": "float_market_cap",
    "滚动市盈率": "pe_ttm",
    "市净率": "pb",
    "滚动市销率": "ps_ttm",
    "上市时间": "list_date",
    "退市时间": "delist_date",
    "是否融资融券": "is_margin",
}
ADJUSTED_HEADERS = {
    "日期": "date",
    "代码": "symbol",
    "开盘价": "open_adj",
    "最高价": "high_adj",
    "最低价": "low_adj",
    "收盘价": "close_adj",
    "前收盘价": "prev_close_adj",
}
TEXT = {"date", "symbol", "name", "industry"}
FLAGS = {"is_st", "is_limit_up", "is_margin"}
DAYS = {"list_date", "delist_date"}
WHOLE = {"volume", "total_shares", "float_shares"}
OPTIONAL = {"是否融资融券"}
FILE_DATE = r"/([0-9]{4}-[0-9]{2}-[0-9]{2})_[^/]*\.csv$"


def _files(spark: SparkSession, path: str, start: str, end: str, pattern: str) -> DataFrame:
    """date, path of the files under a folder whose name starts with a date of the closed range, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    named = listed.withColumn("date", F.try_to_date(F.regexp_extract(F.url_decode("path"), pattern, 1), "yyyy-MM-dd"))
    return named.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def discover_pairs(spark: SparkSession, unadjusted: str, adjusted: str, start: str, end: str, pattern: str = FILE_DATE) -> DataFrame:
    """date, unadjusted, adjusted: the files of each day; other files are left out.

    Raises ValueError if a day has two files of a kind, a file of one kind only, or no day has any.
    """
    sides = [_files(spark, p, start, end, pattern) for p in (unadjusted, adjusted)]
    one, two = (f.groupBy("date").agg(F.count(F.lit(1)).alias(f"n{i}"), F.min("path").alias(n)) for i, (f, n) in enumerate(zip(sides, ("unadjusted", "adjusted"), strict=True)))
    days = one.join(two, "date", "full_outer")
    require_none(days, (F.col("n0") > 1) | (F.col("n1") > 1), "two files of a kind for one day")
    lone = days.filter(F.col("n0").isNull() | F.col("n1").isNull()).orderBy("date").limit(10).collect()
    if lone:
        raise ValueError("unpaired days: " + ", ".join(str(r["date"]) for r in lone))
    if not days.head(1):
        raise ValueError("no paired daily files found")
    return days.select("date", "unadjusted", "adjusted")


def _read(spark: SparkSession, path: str, headers: dict[str, str], pattern: str | None) -> DataFrame:
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)  # all columns as text: symbols keep their zeros
    missing = [h for h in headers if h not in raw.columns and h not in OPTIONAL]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    file_date = F.try_to_date(F.regexp_extract(F.url_decode("_metadata.file_path"), pattern or "$^", 1), "yyyy-MM-dd")
    named = raw.select(*[F.col(f"`{h}`").alias(n) if h in raw.columns else F.lit(None).cast("string").alias(n) for h, n in headers.items()], file_date.alias("__file_date"))

    def typed(n: str) -> Column:
        if n in TEXT:
            return F.col(n)
        if n in FLAGS:
            return parse_flag(n).alias(n)
        if n in DAYS:
            return F.try_to_date(n, "yyyy-MM-dd").alias(n)
        return F.expr(f"try_cast({n} AS DOUBLE)").cast("long" if n in WHOLE else "double").alias(n)

    out = named.select(*[typed(n) for n in headers.values()], "__file_date")
    out = out.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).withColumn("symbol", padded_symbol("symbol"))
    require_none(out, F.col("date").isNull() | F.col("symbol").isNull(), "invalid date or symbol")
    if pattern:
        require_none(out, ~F.col("__file_date").eqNullSafe(F.col("date")), "a row's date is not that of its file")
    return out.drop("__file_date")


def parse_flag(c: str) -> Column:
    return F.when(F.col(c) == "是", True).when(F.col(c) == "否", False)


def read_daily_pairs(spark: SparkSession, unadjusted: str, adjusted: str, pattern: str | None = None) -> DataFrame:
    """The paired panel under two folders of CSV files; both must hold the same (date, symbol) keys.

    With a ``pattern`` for the date in a file's name, rows of another date raise ValueError.
    """
    raw = _read(spark, unadjusted, RAW_HEADERS, pattern)
    adj = _read(spark, adjusted, ADJUSTED_HEADERS, pattern)
    both = raw.groupBy("date", "symbol").count().join(
        adj.groupBy("date", "symbol").agg(F.count("*").alias("other")), ["date", "symbol"], "full_outer"
    )
    odd = (F.coalesce("count", F.lit(0)) != 1) | (F.coalesce("other", F.lit(0)) != 1)
    require_none(both, odd, "unadjusted and adjusted (date, symbol) keys differ or repeat")
    return raw.join(adj, ["date", "symbol"])


def cleaned(panel: DataFrame, markets: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, records of what was left out or looks odd): a build's filters and checks, by date.

    Rows of other markets are excluded and rows with impossible prices quarantined; the
    records have date, severity, code and count.  A date that loses all its rows keeps its
    records, with code ``no_rows_left`` and severity ``error``.
    """
    here = market("symbol").isin(*markets) if markets else F.lit(True)
    here = F.coalesce(here, F.lit(False))
    bad = invalid_ohlc()
    tests = {
        ("warning", "outside_supported_markets_excluded"): ~here,
        ("warning", "invalid_ohlc_quarantined"): here & bad,
        **{(s, c): here & ~bad & t for (s, c), t in row_rules(panel.columns).items() if c != "invalid_ohlc"},
    }
    counts = panel.groupBy("date").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"{s}|{c}") for (s, c), t in tests.items()], F.count_if(here & ~bad).alias("kept"))
    wide = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(f"`{s}|{c}`").alias("count")) for s, c in tests], F.struct(F.lit("error").alias("severity"), F.lit("no_rows_left").alias("code"), (F.col("kept") == 0).cast("long").alias("count")))
    records = counts.select("date", F.explode(wide).alias("x")).select("date", "x.*").filter("count > 0")
    twice = panel.filter(here).groupBy("date", "symbol").count().filter("count > 1").groupBy("date").agg(F.sum("count").alias("count"))
    return panel.filter(here & ~bad), records.unionByName(twice.select("date", F.lit("error").alias("severity"), F.lit("duplicate_key").alias("code"), "count"))


def year_counts(panel: DataFrame) -> DataFrame:
    """year, rows, minimum_date, maximum_date: the partitions of a built panel."""
    return panel.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("minimum_date"), F.max("date").alias("maximum_date"))


def build_panel(
    spark: SparkSession, unadjusted: str, adjusted: str, output: str, start: str, end: str, *, markets: tuple[str, ...] | None = None, pattern: str = FILE_DATE
) -> tuple[DataFrame, DataFrame]:
    """Pair, read, check, clean and write a panel by year; (counts by year, quality records), read back from ``output``.

    The whole range is one job.  Errors of any date raise ValueError before a row of the
    panel is written; records go to ``output``/quality and the panel to ``output``/panel.
    """
    if end < start:
        raise ValueError("build end precedes start")
    pairs = discover_pairs(spark, unadjusted, adjusted, start, end, pattern)
    panel = read_daily_pairs(spark, unadjusted, adjusted, pattern).join(F.broadcast(pairs.select("date")), "date", "left_semi")  # one row a day
    kept, records = cleaned(panel, markets)
    records.write.mode("overwrite").parquet(f"{output}/quality")
    records = spark.read.parquet(f"{output}/quality")
    found = records.filter("severity = 'error'").orderBy("date", "code").limit(20).collect()
    if found:
        raise ValueError("data quality errors: " + "; ".join(f"{r['date']} {r['code']}:{r['count']}" for r in found))
    write_panel(kept, f"{output}/panel")
    return year_counts(spark.read.parquet(f"{output}/panel")), records


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header under a schema of its own, so that symbols stay text; a header that differs or a value that does not fit raises."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_verified(spark: SparkSession, path: str, *, rows: int, start: str, end: str, date: str = "date") -> DataFrame:
    """A cached table, refused with ValueError if its row count or its dates are not those recorded for it."""
    df = spark.read.parquet(path)
    got = df.agg(F.count(F.lit(1)), F.min(date).cast("string"), F.max(date).cast("string")).first()
    if got[0] != rows or (rows and (got[1] < start or got[2] > end)):
        raise ValueError(f"{path}: {got[0]} rows from {got[1]} to {got[2]}, not {rows} within {start}..{end}")
    return df


def quarantine(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with valid prices, one row a date with the count and symbols of the others)."""
    bad = invalid_ohlc()
    log = panel.filter(bad).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return panel.filter(~bad), log


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Hive-style year partitions, rows in (date, symbol) order inside a file."""
    years = panel.withColumn("year", F.year("date"))
    years.repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(8))).sortWithinPartitions("year", "date", "symbol").write.mode(mode).partitionBy(
        "year"
    ).parquet(path)


def replace_year(rows: DataFrame, path: str, year: int, expected: DataFrame | None = None) -> DataFrame:
    """Replace the partition of one year of a panel written by :func:`write_panel`; the files of other years stay as they are.

    Returns the files now there (path, size_bytes, rows, ...).  ``expected`` is what the caller
    believes is there (as from :func:`record_source`).  Raises ValueError, before anything is written, if the
    files are others, if ``rows`` is empty, or if it holds a date of another year; and
    after the write if a file of another year changed meanwhile.
    """
    spark = rows.sparkSession
    before = record_source(spark, path, "date").collect()  # one row a file
    if expected is not None:
        known = {(r["path"], r["size_bytes"], r["rows"]) for r in expected.collect()}
        if known != {(r["path"], r["size_bytes"], r["rows"]) for r in before}:
            raise ValueError(f"{path} is not what it was when the rebuild of {year} began")
    require_none(rows, ~F.coalesce(F.year("date") == year, F.lit(False)), f"rows of other years than {year}")
    if not rows.head(1):
        raise ValueError(f"a rebuild of {year} without rows")
    parts = rows.withColumn("year", F.lit(year)).repartition(F.pmod(F.xxhash64("symbol"), F.lit(8))).sortWithinPartitions("date", "symbol")
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    after = record_source(spark, path, "date")
    others = lambda files: {(r["path"], r["size_bytes"], r["rows"]) for r in files if not r["path"].startswith(f"year={year}/")}
    if others(after.collect()) != others(before):
        raise ValueError(f"files of other years changed while {year} was replaced")
    return after


def write_families(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    panel.repartition("family", F.pmod(F.xxhash64("symbol"), F.lit(8))).write.mode(mode).partitionBy("family").parquet(path)


def scan_panel(spark: SparkSession, path: str, start: str, end: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the closed date range; the year filter prunes partitions."""
    panel = spark.read.parquet(path)
    rows = panel.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if "year" in panel.columns:
        rows = rows.filter(F.col("year").between(int(start[:4]), int(end[:4])))
    return rows.select(*columns) if columns else rows


def scan_symbols(panel: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the given symbols."""
    return panel.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def require_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """``df`` itself; raises ValueError if a date lies outside the closed range or is null."""
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return require_none(df, ~F.coalesce(inside, F.lit(False)), f"{date} leaves {start}..{end}")


def frame_statistics(df: DataFrame, date: str = "date") -> DataFrame:
    """rows, minimum_date, maximum_date."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("minimum_date"), F.max(date).alias("maximum_date"))
