"""Shared plumbing: the scratch folder, tables written to cut lineage, distributed ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, tag: str, batch: int = 1024) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and return a scan of it.

    Cuts the lineage: what reads the result survives lost executors without
    recomputing ``df``, and every reader sees the same rows.  ``batch`` bounds the rows
    that go to a Python worker at once while it is written; the session's own setting is
    put back.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name whatever else ``df`` holds (also ``TEXT`` beside ``text``)."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed by position, so that no name clashes with an operator's own, and the new names."""
    fresh = [f"__c{i}" for i in range(len(df.columns))]
    named: dict[str, str] = {}
    for old, new in zip(df.columns, fresh, strict=True):
        named.setdefault(old, new)
    return df.toDF(*fresh), named


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(rows: int, per_bucket: int = 2_000, most: int = 1 << 16) -> int:
    """Buckets of about ``per_bucket`` rows; of more rows only beyond ``most`` buckets."""
    return min(most, max(1, -(-rows // per_bucket)))


def gapless(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without a group meeting in one task.

    Rows are numbered inside (group, bucket); the counts of the buckets before are
    added.  ``bucket`` must be a function of the row that spreads a group evenly.
    """
    part = df.withColumn("__b", bucket)
    inner = Window.partitionBy(*group, "__b")
    part = part.withColumn("__i", F.row_number().over(inner.orderBy(*order)) - 1)
    sizes = part.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (
        part.join(sizes, [*group, "__b"])
        .withColumn(name, (F.col("__i") + F.col("__before")).cast("long"))
        .drop("__b", "__i", "__before")
    )
