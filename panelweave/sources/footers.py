"""What Parquet footers say about a source, and a source held against what was recorded for it.

``parquet_footers`` is a Spark data source: its tasks open the footers of some files each and
no data page is read, so a table of any size costs two small reads a file.

    register(spark)
    spark.read.format("parquet_footers").option("date", "date").load("/data/panel")

Paths are whatever ``pyarrow.fs`` opens: local ones, ``file://``, ``hdfs://``, ``s3://``, ``gs://``.
Files and folders whose names start with ``.`` or ``_`` are left out, as Spark does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes long, rows long, row_groups int, columns int, schema_sha256 string, min_date date, max_date date, sha256 string"
RECORD = "path string, size_bytes long, rows long, schema_sha256 string, min_date date, max_date date, sha256 string"
FILES = 64
CHUNK = 1 << 20


def _as_date(x) -> date | None:
    return x.date() if isinstance(x, datetime) else x if isinstance(x, date) else None


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str, int]]) -> None:
        self.paths = paths


class FooterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.date = options["path"], options.get("date")
        self.digest = options.get("digest", "false").lower() == "true"
        self.files = int(options.get("files", FILES))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        """Groups of files, from one listing, as Spark makes its own of a table."""
        from pyarrow import fs

        system, root = self._open()
        root = root.rstrip("/")
        if system.get_file_info(root).type == fs.FileType.File:
            found = [(root, root.rsplit("/", 1)[1], system.get_file_info(root).size)]
        else:
            listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            found = [(f.path, f.path[len(root) + 1 :], f.size) for f in listed if f.type == fs.FileType.File]
        found = sorted(f for f in found if f[1].endswith(".parquet") and not any(p[0] in "._" for p in f[1].split("/")))
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        system, _ = self._open()
        for path, name, size in partition.paths:
            with system.open_input_file(path) as f:
                meta = pq.read_metadata(f)
            schema = meta.schema.to_arrow_schema()
            names = ",".join(f"{c.name} {c.type}" for c in schema)
            low, high = self._dates(meta)
            content = None
            if self.digest:
                h = hashlib.sha256()
                with system.open_input_stream(path) as s:
                    while chunk := s.read(CHUNK):
                        h.update(chunk)
                content = h.hexdigest()
            yield name, size, meta.num_rows, meta.num_row_groups, len(schema), hashlib.sha256(names.encode()).hexdigest(), low, high, content

    def _dates(self, meta) -> tuple[date | None, date | None]:
        """The smallest and largest date of all row groups; null unless each with rows has statistics or nulls alone."""
        lows, highs = [], []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for i in range(group.num_columns):
                column = group.column(i)
                if column.path_in_schema != self.date or not group.num_rows:
                    continue
                s = column.statistics
                if s is not None and s.has_null_count and s.null_count == group.num_rows:
                    continue
                if s is None or not s.has_min_max:
                    return None, None
                lows.append(_as_date(s.min))
                highs.append(_as_date(s.max))
        return (min(lows), max(highs)) if lows and None not in lows + highs else (None, None)


class ParquetFooters(DataSource):
    """path (below the loaded folder), size_bytes, rows, row_groups, columns, schema_sha256, min_date, max_date, sha256.

    Options: ``date`` names the column whose range is read from the statistics; ``digest`` true
    streams the files, a megabyte at a time, for the digest of their content, null otherwise;
    ``files`` is the number of files a task opens.
    """

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FooterReader:
        return FooterReader(dict(self.options))


def footers(spark: SparkSession, path: str, date: str | None = None, digest: bool = False) -> DataFrame:
    """The footers of the Parquet files under ``path``; see :class:`ParquetFooters`."""
    spark.dataSource.register(ParquetFooters)
    reader = spark.read.format("parquet_footers").option("digest", str(digest).lower())
    return (reader.option("date", date) if date else reader).load(path)


def record_source(spark: SparkSession, path: str, date: str, digest: bool = False) -> DataFrame:
    """What to record for a source today, one row a file."""
    return footers(spark, path, date, digest).select(*[c.split()[0] for c in RECORD.split(", ")])


def source_violations(recorded: DataFrame, files: DataFrame, *, start: str, end: str, by_year: bool = False) -> DataFrame:
    """path, rule, recorded, found: one row for each way in which the files are not those recorded.

    Rules: missing_file, unrecorded_file, size_bytes, rows, schema_sha256, min_date, max_date and
    sha256 (where a digest is recorded) differ, duplicate_record, no_dates, empty_file,
    outside_period (a date beyond [start, end]); and ``by_year``: year_path (a file's dates are not of the
    ``year=`` folder it lies in) and missing_year (a gap between the first and last year).
    """
    columns = ["size_bytes", "rows", "schema_sha256", "min_date", "max_date", "sha256"]
    side = lambda df, p: df.select("path", *[F.col(c).cast("string").alias(f"{p}_{c}") for c in columns], F.lit(True).alias(p))
    once = recorded.dropDuplicates(["path"])
    both = side(once, "r").join(side(files, "f"), "path", "full_outer")
    here = F.col("r").isNotNull() & F.col("f").isNotNull()
    day = lambda c: F.col(c).cast("date")
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    year = F.regexp_extract("path", r"(?:^|/)year=([0-9]+)/", 1)

    def rule(test: Column, name: str, want: Column, got: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule"), want.cast("string").alias("recorded"), got.cast("string").alias("found")))

    nothing = F.lit(None).cast("string")
    tests = [rule(F.col("f").isNull(), "missing_file", F.col("r_rows"), nothing), rule(F.col("r").isNull(), "unrecorded_file", nothing, F.col("f_rows"))]
    for c in columns:
        differ = ~F.col(f"r_{c}").eqNullSafe(F.col(f"f_{c}")) if c != "sha256" else F.col("r_sha256").isNotNull() & ~F.col("r_sha256").eqNullSafe(F.col("f_sha256"))
        tests.append(rule(here & differ, c, F.col(f"r_{c}"), F.col(f"f_{c}")))
    found = F.col("f").isNotNull()
    some = found & (F.col("f_rows").cast("long") > 0)
    tests += [
        rule(found & (F.col("f_rows").cast("long") == 0), "empty_file", F.col("r_rows"), F.col("f_rows")),
        rule(some & F.col("f_min_date").isNull(), "no_dates", F.col("r_min_date"), nothing),
        rule((day("f_min_date") < low) | (day("f_max_date") > high), "outside_period", F.lit(f"{start}..{end}"), F.concat_ws("..", "f_min_date", "f_max_date")),
    ]
    if by_year:
        own = F.concat_ws("..", F.year(day("f_min_date")), F.year(day("f_max_date")))
        tests.append(rule(some & (own != F.concat_ws("..", year, year)), "year_path", year, own))
    out = both.select("path", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("path", "x.*")
    twice = recorded.groupBy("path").count().filter("count > 1")
    out = out.unionByName(twice.select("path", F.lit("duplicate_record").alias("rule"), F.col("count").cast("string").alias("recorded"), nothing.alias("found")))
    if by_year:
        years = files.filter("rows > 0").select(F.year("min_date").alias("a"), F.year("max_date").alias("b"))
        span = years.agg(F.sequence(F.min("a"), F.max("b")).alias("s")).select(F.explode("s").alias("y"))
        gaps = span.join(years.select(F.explode(F.sequence("a", "b")).alias("y")).distinct(), "y", "left_anti")
        out = out.unionByName(gaps.select(F.concat(F.lit("year="), "y").alias("path"), F.lit("missing_year").alias("rule"), F.col("y").cast("string").alias("recorded"), nothing.alias("found")))
    return out


def require_source(spark: SparkSession, path: str, recorded: DataFrame, *, date: str, start: str, end: str, by_year: bool = False, digest: bool = False) -> DataFrame:
    """The table at ``path``; raises ValueError, before any data is read, if its files are not those recorded.

    ``recorded`` as from :func:`record_source`; see :func:`source_violations` for the rules.
    """
    found = source_violations(recorded, footers(spark, path, date, digest), start=start, end=end, by_year=by_year).orderBy("path", "rule").limit(10).collect()
    if found:
        raise ValueError(f"{path} is not the recorded source: " + "; ".join(f"{r['path']} {r['rule']} ({r['recorded']} recorded, {r['found']} found)" for r in found))
    return spark.read.parquet(path)


def require_period(spark: SparkSession, path: str, *, date: str, start: str, end: str) -> DataFrame:
    """The table at ``path``; raises ValueError from the footers alone, before any data is read, if a date leaves [start, end] or a file's dates are not known."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    bad = (F.col("rows") > 0) & (F.col("min_date").isNull() | (F.col("min_date") < low) | (F.col("max_date") > high))
    found = footers(spark, path, date).filter(bad).orderBy("path").limit(5).collect()
    if found:
        raise ValueError(f"dates leave {start}..{end}: " + "; ".join(f"{r['path']} {r['min_date']}..{r['max_date']}" for r in found))
    return spark.read.parquet(path)
