"""Footers, recorded sources, the year sink, observed stages and cache shards."""

import datetime
import glob
import math
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelweave.sources import footers, panel_io, shards
from panelweave.sources.stage import staged_with_statistics


def day(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture
def panel(spark, tmp_path):
    rows = [(day(f"{y}-0{m}-15"), f"{s:06d}", 10 * y + m) for y in (1998, 1999, 2000) for m in (1, 2, 3) for s in range(5)]
    path = str(tmp_path / "panel")
    panel_io.write_panel(spark.createDataFrame(rows, "date date, symbol string, volume long"), path)
    return path


def stamps(path, but=None):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(f"{path}/year=*/*.parquet") if but is None or f"year={but}/" not in f}


def found(spark, path, recorded, **more):
    period = {"start": "1998-01-01", "end": "2000-12-31", "by_year": True} | more
    got = footers.source_violations(recorded, footers.footers(spark, path, "date", digest=True), **period)
    return sorted((r["path"], r["rule"]) for r in got.collect())


def test_footers_say_what_a_scan_says(spark, panel):
    files = footers.footers(spark, panel, "date", digest=True).collect()
    assert sum(r["rows"] for r in files) == 45 and {r["columns"] for r in files} == {3}
    for r in files:
        content = spark.read.format("binaryFile").load(f"{panel}/{r['path']}").select(F.sha2("content", 256), "length").first()
        assert (r["sha256"], r["size_bytes"]) == tuple(content)
        table = pq.read_table(f"{panel}/{r['path']}", partitioning=None)
        assert (r["min_date"], r["max_date"]) == (min(table["date"].to_pylist()), max(table["date"].to_pylist()))


def test_footers_of_odd_files(spark, tmp_path):
    path = tmp_path / "odd"
    os.makedirs(path / "_temporary")
    for name, values in (("empty", []), ("nulls", [None, None]), ("some", [None, day("2000-02-03")])):
        pq.write_table(pa.table({"date": pa.array(values, pa.date32())}), path / f"{name}.parquet")
    pq.write_table(pa.table({"date": pa.array([day("2000-01-01")])}), path / "bare.parquet", write_statistics=False)
    shutil.copy(path / "some.parquet", path / "_temporary" / "x.parquet")
    (path / "_SUCCESS").write_text("")
    got = {r["path"]: (r["rows"], r["min_date"]) for r in footers.footers(spark, str(path), "date").collect()}
    assert got == {"empty.parquet": (0, None), "nulls.parquet": (2, None), "some.parquet": (2, day("2000-02-03")), "bare.parquet": (1, None)}
    none = footers.footers(spark, str(tmp_path / "absent"), "date")
    assert none.count() == 0 and none.columns[0] == "path"
    recorded = footers.record_source(spark, str(path), "date")
    rules = footers.source_violations(recorded, recorded, start="2000-01-01", end="2000-12-31")
    assert sorted((r["path"], r["rule"]) for r in rules.collect()) == [("bare.parquet", "no_dates"), ("empty.parquet", "empty_file"), ("nulls.parquet", "no_dates")]


def test_a_recorded_source_is_proved(spark, panel):
    recorded = spark.createDataFrame(footers.record_source(spark, panel, "date", digest=True).collect(), footers.RECORD)
    assert found(spark, panel, recorded) == []
    assert footers.require_source(spark, panel, recorded, date="date", start="1998-01-01", end="2000-12-31", by_year=True, digest=True).count() == 45
    assert {x for _, x in found(spark, panel, recorded, end="2000-02-28")} == {"outside_period"}

    # The same number of rows and bytes, another value: only the digest tells.
    file = sorted(glob.glob(f"{panel}/year=1999/*.parquet"))[0]
    name = os.path.relpath(file, panel)
    table = pq.read_table(file, partitioning=None)
    raw = bytearray(open(file, "rb").read())
    raw[10] ^= 1
    open(file, "wb").write(bytes(raw))
    assert found(spark, panel, recorded) == [(name, "sha256")]

    # A row less, and a file in the folder of another year.
    pq.write_table(table.slice(1), file)
    assert (name, "rows") in found(spark, panel, recorded)
    with pytest.raises(ValueError, match="rows"):
        footers.require_source(spark, panel, recorded, date="date", start="1998-01-01", end="2000-12-31")
    os.makedirs(f"{panel}/year=2001")
    os.rename(file, f"{panel}/year=2001/moved.parquet")
    got = found(spark, panel, recorded)
    assert (name, "missing_file") in got and ("year=2001/moved.parquet", "unrecorded_file") in got and ("year=2001/moved.parquet", "year_path") in got
    twice = recorded.unionByName(recorded.filter(F.col("path") != name).limit(1))
    assert "duplicate_record" in {x for _, x in found(spark, panel, twice)}


def test_a_gap_of_years_and_a_changed_schema(spark, panel):
    recorded = spark.createDataFrame(footers.record_source(spark, panel, "date").collect(), footers.RECORD)
    shutil.rmtree(f"{panel}/year=1999")
    assert ("year=1999", "missing_year") in found(spark, panel, recorded)
    file = glob.glob(f"{panel}/year=1998/*.parquet")[0]
    table = pq.read_table(file, partitioning=None)
    pq.write_table(table.append_column("more", pa.array([1] * len(table))), file)
    assert (os.path.relpath(file, panel), "schema_sha256") in found(spark, panel, recorded)


def test_period_gate_reads_no_data(spark, panel):
    assert footers.require_period(spark, panel, date="date", start="1998-01-01", end="2000-12-31").count() == 45
    with pytest.raises(ValueError, match="1998"):
        footers.require_period(spark, panel, date="date", start="1998-01-16", end="2000-12-31")


def test_a_year_is_replaced_and_others_stay(spark, panel):
    before = stamps(panel, but=1999)
    known = spark.createDataFrame(footers.record_source(spark, panel, "date").collect(), footers.RECORD)
    rows = spark.createDataFrame([(day("1999-05-01"), "000001", 7)], "date date, symbol string, volume long")
    after = panel_io.replace_year(rows, panel, 1999, known)
    assert stamps(panel, but=1999) == before
    assert after.agg(F.sum("rows")).first()[0] == 31
    got = spark.read.parquet(panel)
    assert got.filter("year = 1999").select("date", "volume").collect() == [(day("1999-05-01"), 7)]
    with pytest.raises(ValueError, match="not what it was"):
        panel_io.replace_year(rows, panel, 1999, known)  # the record is of the time before
    for bad, why in ((rows.withColumn("date", F.lit("2000-01-01").cast("date")), "other years"), (rows.limit(0), "without rows"), (rows.withColumn("date", F.lit(None).cast("date")), "other years")):
        state = stamps(panel)
        with pytest.raises(ValueError, match=why):
            panel_io.replace_year(bad, panel, 1999)
        assert stamps(panel) == state


def test_stage_statistics_come_with_the_write(spark):
    df = spark.range(100).select(F.expr("date_add(DATE'2000-01-01', cast(id as int))").alias("date"), "id")
    table, seen = staged_with_statistics(df, "some")
    assert (seen.rows, seen.min_date, seen.max_date) == (100, day("2000-01-01"), day("2000-04-09")) and seen.seconds > 0 and table.count() == 100
    _, seen = staged_with_statistics(df.limit(0), "none")
    assert (seen.rows, seen.min_date, seen.max_date) == (0, None, None)
    _, seen = staged_with_statistics(df.drop("date"), "undated", None)
    assert (seen.rows, seen.min_date) == (100, None)


ROWS = "shard string, symbol string, year int, value long"
COVER = "shard string, symbol string, year int, row_count long"


def cache(spark):
    symbols = spark.createDataFrame([("000001",), ("000002",)], "symbol string")
    rows = spark.createDataFrame([("a", "000001", 2000, 1), ("a", "000001", 2000, 2), ("b", "000002", 2001, 3)], ROWS)
    cover = spark.createDataFrame([("a", "000001", 2000, 2), ("a", "000001", 2001, 0), ("b", "000002", 2000, 0), ("b", "000002", 2001, 1)], COVER)
    return rows, cover, symbols


def test_shards_make_one_cache(spark):
    rows, cover, symbols = cache(spark)
    got, grid = shards.merged_shards(rows, cover, symbols, [2000, 2001])
    assert got.count() == 3 and grid.count() == 4
    faults = lambda c, r=rows: sorted((x["symbol"], x["year"], x["fault"]) for x in shards.coverage_faults(c, r, symbols, [2000, 2001]).collect())
    assert faults(cover) == []
    assert faults(cover.filter("NOT (symbol = '000002' AND year = 2000)")) == [("000002", 2000, "not_covered")]
    assert faults(cover.filter("NOT (symbol = '000002' AND year = 2001)")) == [("000002", 2001, "not_covered"), ("000002", 2001, "row_without_coverage")]
    again = spark.createDataFrame([("c", "000001", 2001, 0), ("c", "000001", 2002, 0)], COVER)
    assert faults(cover.unionByName(again)) == [("000001", 2001, "covered_twice"), ("000001", 2002, "unexpected")]
    assert faults(cover, rows.limit(0)) == [("000001", 2000, "row_count"), ("000002", 2001, "row_count")]
    with pytest.raises(ValueError, match="not_covered"):
        shards.merged_shards(rows, cover.limit(0), symbols, [2000, 2001])


def test_later_answers_replace_earlier_ones(spark):
    rows, cover, _ = cache(spark)
    new = spark.createDataFrame([("n1", "000001", 2000, 9), ("n2", "000002", 2000, 8), ("n1", "000002", 2000, 7)], ROWS)
    asked = spark.createDataFrame([("n1", "000001", 2000, 1, 1), ("n1", "000002", 2000, 1, 1), ("n2", "000002", 2000, 1, 2), ("n2", "000002", 2001, 0, 2)], COVER + ", asked_at int")
    got, grid = shards.refreshed(rows, cover, new, asked)
    assert sorted((r["symbol"], r["year"], r["value"]) for r in got.collect()) == [("000001", 2000, 9), ("000002", 2000, 8)]
    assert sorted((r["symbol"], r["year"], r["shard"], r["row_count"]) for r in grid.collect()) == [("000001", 2000, "n1", 1), ("000001", 2001, "a", 0), ("000002", 2000, "n2", 1), ("000002", 2001, "n2", 0)]


def test_a_cache_without_coverage_gets_its_grid(spark):
    rows, _, symbols = cache(spark)
    got = {(r["symbol"], r["year"]): r["row_count"] for r in shards.coverage_of(rows, symbols, [2000, 2001]).collect()}
    assert got == {("000001", 2000): 2, ("000001", 2001): 0, ("000002", 2000): 0, ("000002", 2001): 1}
    with pytest.raises(ValueError, match="outside"):
        shards.coverage_of(rows, symbols, [2000])


def test_provider_codes_and_sealed_responses(spark):
    code = lambda s: spark.createDataFrame([(s,)], "s string").select(shards.provider_code("s")).first()[0]
    assert [code(s) for s in ("600000", "1", "300001")] == ["sh.600000", "sz.000001", "sz.300001"]
    for bad in ("900001", "abc", None):
        with pytest.raises(Exception, match="unsupported security"):
            code(bad)
    rows = spark.createDataFrame([("000001", 2000, "2000-05-01", " "), ("000002", 2000, "2002-01-01 00:00", None)], "symbol string, year int, ex string, paid string")
    got = shards.sealed_responses(rows, ["ex", "paid"], "2001-12-31").collect()
    assert [(r["symbol"], r["field"], r["value"]) for r in got] == [("000002", "ex", day("2002-01-01"))]


def test_error_function(spark):
    from panelweave.functions.statistics import erfc, two_sided_p

    x = [0.0, 1e-12, 0.1, 0.7, 1.5, 2.499999, 2.5, 2.6, 3.0, 5.0, 9.0, 20.0, 26.0, 30.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for (got,), v in zip(df.select(erfc("x")).collect(), x, strict=True):
        assert abs(got - math.erfc(v)) <= 1e-15 and abs(got - math.erfc(v)) <= 2e-12 * math.erfc(v)
    odd = spark.createDataFrame([(None,), (math.nan,), (-1.96,), (math.inf,)], "t double").select(two_sided_p("t")).collect()
    assert odd[0][0] is None and odd[1][0] is None and abs(odd[2][0] - math.erfc(1.96 / math.sqrt(2))) < 1e-15 and odd[3][0] == 0.0
