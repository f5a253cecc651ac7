"""Stage tables: results that many steps read, written once to the folder driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``.

    Only a session that runs in one process (``local[...]``) may do without the setting; it
    gets a temporary folder that goes when Python ends.  On a cluster executors would write
    where nobody reads, so a missing setting raises ValueError.
    """
    context = spark.sparkContext
    name = f"panelweave-{context.applicationId}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}"
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors have no folder in common")
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="panelweave-")
        atexit.register(shutil.rmtree, _local[name], ignore_errors=True)
    return f"file://{_local[name]}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application has written to its scratch folder; results that still read from it can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and return a scan of it.

    Later plans start from the scan: they stay small, and nothing before it is computed
    again when an executor is lost.
    """
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_buckets(df: DataFrame, tag: str, key: str, order: str, buckets: int) -> DataFrame:
    """:func:`staged`, in ``buckets`` by ``key``: windows and groups by the key then need no shuffle.

    ``df`` should come partitioned by ``key`` in as many parts, so that each task writes one file.
    """
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{key}`) SORTED BY (`{key}`, `{order}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    df.write.insertInto(name)
    return spark.table(name)


@dataclass(frozen=True)
class StageStatistics:
    """What was seen of a stage table as it was written."""

    name: str
    rows: int
    min_date: date | None
    max_date: date | None
    seconds: float


def staged_with_statistics(df: DataFrame, name: str, date_column: str | None = "date", write: Callable[[DataFrame, str], DataFrame] = staged) -> tuple[DataFrame, StageStatistics]:
    """:func:`staged` (or another ``write``), with rows, first and last date and time taken, observed while the table is written: no second scan."""
    seen = Observation(f"stage-{name}-{uuid.uuid4().hex}")
    day = F.col(date_column).cast("date") if date_column else F.lit(None).cast("date")
    began = time.monotonic()
    table = write(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(day).alias("low"), F.max(day).alias("high")), name)
    taken = time.monotonic() - began
    got = seen.get
    return table, StageStatistics(name, got["rows"], got["low"], got["high"], taken)
