"""Two runs of a table compared: digests that do not depend on the order of rows, and keyed values within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    """bucket, the row as text, and two hashes of it; NaN, infinities and nulls are values like others, -0.0 is 0.0."""
    plain = [(F.when(F.col(f"`{c}`") == 0, F.lit(0.0)).otherwise(F.col(f"`{c}`")) if t in ("double", "float") else F.col(f"`{c}`")).alias(c) for c, t in sorted(df.dtypes)]
    text = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    rows = df.select(text.alias("row"))
    hashes = rows.select("row", F.xxhash64("row").alias("h1"), F.xxhash64(F.lit("second"), "row").alias("h2"))
    return hashes.withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))


def digest(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows, sum1, sum2: the multiset of rows in each bucket, as sums of two 64-bit row hashes.

    Equal tables have equal digests in whatever order their rows come.  One pass; what is
    shuffled is at most ``buckets`` rows a task.
    """
    each = _keyed(df, buckets)
    add = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), add("h1").alias("sum1"), add("h2").alias("sum2"))


def differing_buckets(one: DataFrame, two: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows_one, rows_two of the buckets in which two tables (of equal columns) differ."""
    if sorted(one.dtypes) != sorted(two.dtypes):
        raise ValueError("the tables differ in columns")
    a, b = digest(one, buckets).alias("a"), digest(two, buckets).alias("b")
    same = F.lit(True)
    for c in ("rows", "sum1", "sum2"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    both = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full_outer").filter(~same)
    return both.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), zero("a.rows").alias("rows_one"), zero("b.rows").alias("rows_two"))


def differences(one: DataFrame, two: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """row (JSON of the columns by name), times_one, times_two: the rows that do not occur equally often in both.

    Only rows of differing buckets are compared: equal tables cost two digests and no join of rows.
    """
    odd = differing_buckets(one, two, buckets).select("bucket")  # at most ``buckets`` rows
    count = lambda df, name: _keyed(df, buckets).join(F.broadcast(odd), "bucket", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias(name))
    both = count(one, "times_one").join(count(two, "times_two"), "row", "full_outer").fillna(0, ["times_one", "times_two"])
    return both.filter("times_one <> times_two")


def require_equal(one: DataFrame, two: DataFrame, what: str = "runs") -> None:
    """Raises ValueError, with some of the rows, if two tables differ."""
    found = differences(one, two).orderBy("row").limit(5).collect()
    if found:
        raise ValueError(f"{what} differ: " + "; ".join(f"{r['row']} {r['times_one']} and {r['times_two']} times" for r in found))


def unreproduced(recomputed: DataFrame, published: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """keys, value, recomputed, published, reason of every published value that a recomputation does not give.

    A full outer join on the keys.  Reasons: not_recomputed and not_published (the key is on one
    side only), null_on_one_side, beyond_tolerance; two nulls or NaNs agree.
    """
    side = lambda df, p: df.select(*keys, *[F.col(v).cast("double").alias(f"{p}_{v}") for v in values], F.lit(True).alias(p))
    both = side(recomputed, "r").join(side(published, "p"), keys, "full_outer")

    def entry(v: str) -> Column:
        a, b = F.col(f"r_{v}"), F.col(f"p_{v}")
        none = lambda x: x.isNull() | F.isnan(x)
        reason = (
            F.when(F.col("r").isNull(), "not_recomputed").when(F.col("p").isNull(), "not_published").when(none(a) & none(b), None)
            .when(none(a) | none(b), "null_on_one_side").when((a != b) & ~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)), "beyond_tolerance")
        )
        return F.struct(F.lit(v).alias("value"), a.alias("recomputed"), b.alias("published"), reason.alias("reason"))

    return both.select(*keys, F.explode(F.array(*[entry(v) for v in values])).alias("x")).select(*keys, "x.*").filter("reason IS NOT NULL")


def require_reproduced(recomputed: DataFrame, published: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> None:
    """Raises ValueError, with some of the keys, if a recomputation does not give the published values."""
    found = unreproduced(recomputed, published, keys, values, tolerance).orderBy(*keys, "value").limit(5).collect()
    if found:
        raise ValueError("published values are not reproduced: " + "; ".join(f"{[r[k] for k in keys]} {r['value']} {r['reason']}" for r in found))
