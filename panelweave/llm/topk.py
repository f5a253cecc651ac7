"""Exact top-k by inner product over vector-approximation files.

Equal vectors have equal scores, so they are searched once, as one *group* with its k + 1
smallest ids (one more than k, as a query leaves out its own row).  Groups are cut into a grid
of uniform cells of ``2**bits`` values a component; the codes (one byte a component) are
a table of their own, and the scan reads nothing else.  A cell bounds the inner product with
a query from both sides.

Queries go in blocks of at most ``QUERY_BYTES`` to the tasks that scan the codes, so codes
are never shuffled.  A task keeps the k + 1 best lower bounds of each query as it goes
along and hands on the groups whose upper bound reaches them: a few rows for each query
and task.  Across tasks the best lower bounds cut once more.  Exact vectors are then read
in the order of the bounds, in two batches: the k + 1 best, and after that only the
groups whose bound still reaches the exact score of the last of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, only, written

BITS = 6
QUERY_BYTES = 16 << 20
QUERY_PIECE = 512
CODE_PIECE = 4096


def integer_vectors(embeddings: DataFrame, scale: int = 256, *kept: str) -> DataFrame:
    """vec_id, the ``kept`` columns, v array<long>, dim: floor(scale * x) of each component.

    Left out: null or empty vectors and vectors with a null, NaN or infinite component.
    Rows with the same id, or without one, are rows like any others; other columns are
    left out.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    return (
        only(embeddings, "vec_id", "embedding", *kept)
        .filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .filter(sound)
        .select("vec_id", *kept, v.alias("v"))
        .withColumn("dim", F.size("v"))
    )


def _encode(batches):
    """g, dim, least, width and the codes of the vectors of each batch."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        out = [None] * len(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            least, width = (batch.column(i)[int(at[0])].as_py() for i in (3, 4))
            v = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i, code in zip(at, ((v - least) // width).astype(np.uint8), strict=True):
                out[i] = code.tobytes()
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(out, pa.binary())], ["g", "dim", "least", "width", "code"])


class _Best:
    """What a task keeps of a piece of queries: the k best lower bounds, and the groups whose upper bound reaches them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.up, self.size = np.maximum(q, 0).sum(axis=1), np.abs(q).sum(axis=1)
        self.top = np.full((len(ids), k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def see(self, g: np.ndarray, low: np.ndarray, width: int) -> None:
        """Meet cells with lower corners ``low`` (groups x components)."""
        high = self.q @ low.T + ((width - 1) * self.up)[:, None]
        self.slack = (width - 1) * self.size
        if self.top[0, 0] == -np.inf and len(g) > self.k:  # k lower bounds at once instead of all entries
            seeds = np.partition(high, len(g) - self.k, axis=1)[:, len(g) - self.k :] - self.slack[:, None]
            floor_ = np.maximum(self.top, np.sort(seeds, axis=1))[:, 0]
        else:
            floor_ = self.top[:, 0]
        a, b = np.nonzero(high >= floor_[:, None])
        if not len(a):
            return
        upper = high[a, b]
        owner = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), a])
        lower = np.concatenate([self.top.ravel(), upper - self.slack[a]])
        order = np.lexsort((-lower, owner))
        counts = np.bincount(owner, minlength=len(self.ids))
        first = np.cumsum(counts) - counts
        self.top = lower[order][first[:, None] + np.arange(self.k)][:, ::-1]
        self.held.append((a, g[b], upper))
        self.many += len(a)
        if self.many > 64 * self.k * len(self.ids):
            self.held = [self.left()]
            self.many = len(self.held[0][0])

    def left(self):
        a, g, upper = (np.concatenate(x) for x in zip(*self.held, strict=True))
        stay = upper >= self.top[a, 0]
        return a[stay], g[stay], upper[stay]

    def batch(self) -> pa.RecordBatch:
        a, g, upper = self.left() if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        slack = self.slack[a] if len(a) else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a] if len(a) else a), pa.array(g), pa.array(upper), pa.array(slack)], ["q", "g", "upper", "slack"])


def _scan(shared, k: int):
    """q, g, upper, slack: for the queries of a block, the groups of the task's codes that may be among the k best."""

    def run(batches):
        best: dict[int, list[_Best]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in shared.value:
                    continue
                if int(dim) not in best:
                    ids, q = shared.value[int(dim)]
                    best[int(dim)] = [_Best(ids[i : i + QUERY_PIECE], q[i : i + QUERY_PIECE], k) for i in range(0, len(ids), QUERY_PIECE)]
                at = np.flatnonzero(dims == dim)
                least, width = (batch.column(i)[int(at[0])].as_py() for i in (2, 3))
                code = np.frombuffer(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, dim)
                g = batch.column(0).to_numpy()[at]
                for i in range(0, len(g), CODE_PIECE):
                    low = least + code[i : i + CODE_PIECE].astype(np.float64) * width
                    for piece in best[int(dim)]:
                        piece.see(g[i : i + CODE_PIECE], low, width)
        for pieces in best.values():
            for piece in pieces:
                yield piece.batch()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` of :func:`integer_vectors`.

    Queries are the rows for which the column ``is_query`` holds (null: no), candidates all
    other rows of the same dimension; ties go to the smaller id, null ids last; with fewer
    than k candidates all are returned.  A repeated id is as many rows, and as many
    queries; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.withColumn("asked", F.coalesce(is_query, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "topk-rows"
    )
    # Spark limits each group before the shuffle, so countless copies of a vector are a few rows.
    copies = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    few = rows.withColumn("i", F.row_number().over(copies)).filter(F.col("i") <= k + 1)
    groups = few.groupBy("v").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("vec_id", "row")).alias("members"))
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "topk-groups")
    asked = written(
        rows.filter("asked").join(groups.select("v", "g"), "v").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("g").alias("q")),
        "topk-asked",
    )
    scale = groups.groupBy("dim").agg(F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most"))
    scale = scale.withColumn("width", F.ceil((F.col("most") - F.col("least") + 1) / (1 << bits)).cast("long"))
    codes = written(
        groups.join(scale, "dim").select("g", "dim", "v", "least", "width").mapInArrow(_encode, "g long, dim int, least long, width long, code binary"),
        "topk-codes",
    )
    queries = groups.select(F.col("g").alias("q"), "dim", F.col("v").alias("w")).join(asked.select("q").distinct(), "q")
    volume = queries.agg(F.sum("dim")).first()[0] or 0
    n_blocks = bucket_count(8 * volume, QUERY_BYTES, 1 << 40)
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")), "topk-queries")
    near = None
    for block in range(n_blocks):
        table = queries.filter(F.col("block") == block).select("q", "dim", "w").toArrow()
        dims = table.column("dim").to_numpy()
        parts = {}
        for dim in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == dim))
            w = own.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            parts[dim] = (own.column("q").to_numpy(), w.reshape(-1, dim))
        found = codes.mapInArrow(_scan(spark.sparkContext.broadcast(parts), k + 1), "q long, g long, upper double, slack double")
        found = written(found, "topk-bounds", CODE_PIECE)
        near = found if near is None else near.unionByName(found)

    # The best upper bounds of a query, less its slack, are its best lower bounds.
    by_upper = Window.partitionBy("q").orderBy(F.desc("upper"), "g")
    best = near.withColumn("i", F.row_number().over(by_upper)).filter(F.col("i") <= k + 1)
    floor_ = best.groupBy("q").agg(F.when(F.count("*") > k, F.min("upper") - F.max("slack")).alias("floor"))
    near = near.join(floor_, "q").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))

    def exact(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("w", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return pairs.join(queries.select("q", "w"), "q").join(groups.select("g", "v", "members"), "g").select("q", "g", dot.alias("score"), "members")

    read = written(exact(best.select("q", "g")), "topk-first")
    sure = read.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
    more = (
        near.join(best.select("q", "g"), ["q", "g"], "left_anti").join(sure, "q").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    )
    ranked = lambda key: Window.partitionBy(key).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    top = read.unionByName(exact(more.select("q", "g"))).select("q", "score", F.inline("members"))
    top = top.withColumn("i", F.row_number().over(ranked("q"))).filter(F.col("i") <= k + 1).drop("i")
    return (
        asked.join(top, "q")
        .filter("row <> own")
        .withColumn("rank", F.row_number().over(ranked("own")))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS row, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, row) AS rank FROM s
) WHERE rank <= 5
"""
