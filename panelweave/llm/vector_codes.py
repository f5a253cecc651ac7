"""Product-quantized codes of vectors: one byte for each part, by integer codebooks.

Vectors are cut into equal parts.  Each part position has a codebook of at most 256
entries that starts as the parts of the first vectors and is refined for some rounds:
every part goes to its nearest entry (squared distance, ties to the lower index), and every
entry becomes the floored mean of its parts.

The codebooks (``entries * dim`` integers, whatever the number of rows) are broadcast.
Tasks take Arrow batches, a piece of rows at a time, and get all distances of a part from
``|c|^2 - 2 x c``, an exact product of 64-bit integers.  A task hands on one row of sums for
each entry; those are merged by a shuffle on (entry, component).  Every round starts from
the table itself, so nothing is kept between rounds but the codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .int_vectors import PIECE, SLOT_SUMS, SlotSums, first_vectors, floored_means, long_array, matrix, of_length

#: Labels up to which the table of their sums (some 16 bytes a row) is broadcast; above, the join shuffles, each label cut into SALTS.
BROADCAST_LABELS = 50_000
SALTS = 16


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest row of ``book`` (the first of equals) and the squared distance to it."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    beyond = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    at = beyond.argmin(axis=1)
    return at, (x * x).sum(axis=1) + beyond[np.arange(len(x)), at]


def _pieces(column: pa.Array):
    """Integer matrices of at most PIECE rows, and the row each starts at."""
    for i in range(0, len(column), PIECE):
        yield i, matrix(column.slice(i, PIECE))


def train_codebooks(vectors: DataFrame, *, parts: int, entries: int, rounds: int) -> np.ndarray:
    """parts x entries x width integers from ``vectors`` (vec_id, v of one length); fewer entries if there are fewer vectors."""
    first = first_vectors(vectors, [F.col("vec_id").asc_nulls_last()], entries)
    n = len(first)
    if not n:
        return np.zeros((parts, 0, 1), np.int64)
    books = first.reshape(n, parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            books = shared.value
            got = SlotSums(parts * n, width)
            for batch in batches:
                for _, v in _pieces(batch.column(0)):
                    for p in range(parts):
                        x = v[:, p * width : (p + 1) * width]
                        got.add(nearest(x, books[p])[0] + p * n, x)
            yield got.batch()

        flat = floored_means(vectors.select("v").mapInArrow(sums, SLOT_SUMS), books.reshape(parts * n, width))
        books = flat.reshape(parts, n, width)
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The columns of ``vectors`` but v, with code (a byte for each part) and error (squared distances summed over the parts)."""
    parts, _, width = books.shape
    others = [c for c in vectors.columns if c != "v"]
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for batch in batches:
            codes, errors = [], []
            for _, v in _pieces(batch.column(0)):
                code = np.empty((len(v), parts), np.uint8)
                error = 0
                for p in range(parts):
                    code[:, p], d = nearest(v[:, p * width : (p + 1) * width], books[p])
                    error = error + d
                codes += [c.tobytes() for c in code]
                errors.append(long_array(error))
            kept = [batch.column(i + 1) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.binary()), pa.concat_arrays(errors or [pa.array([], pa.int64())])], [*others, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "v")
    return vectors.select("v", *others).mapInArrow(run, f"{kinds}, code binary, error long")


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame, *, dim: int = 64, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (binary), error, label_error, codebooks_sha256 of every row with a sound vector of ``dim`` components.

    Left out: rows whose vector is null, holds a null, NaN or infinite component, or has
    another length.  Codebooks start from the smallest vec_ids (null ids last, equal
    ids by their vectors).  With fewer rows than entries the codebooks are as small; an empty
    table gives no rows.  Repeated rows are coded each; a null label is a label of its own; other
    columns are left out.  Components of 2**27 and more are computed with Python's integers;
    components and errors that do not fit 64 bits raise an error.
    """
    if dim % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide the vectors equally, and an entry's index is one byte")
    vectors = of_length(embeddings, dim, scale, "label")
    books = train_codebooks(vectors, parts=parts, entries=entries, rounds=rounds)
    if not books.shape[1]:
        empty = vectors.select("vec_id", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")).filter(F.lit(False))
        return empty.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(""))
    coded = written(encode(vectors, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        rows = coded.alias("c").join(F.broadcast(by_label).alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        copies = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = salted.alias("c").join(copies.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.salt") == F.col("s.salt")))
    return rows.select("c.vec_id", "c.code", "c.error", "s.label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    width = 64 // parts
    square = " + ".join(f"(x.p{i} - b.p{i}) * (x.p{i} - b.p{i})" for i in range(width))
    pick = lambda b: f"SELECT x.r, x.part, min(CAST({square} AS BIGINT) * {entries} + b.e) AS best FROM x JOIN {b} b USING (part) GROUP BY x.r, x.part"
    cols = ", ".join(f"p{i}" for i in range(width))
    steps = []
    for k in range(rounds):
        means = ", ".join(f"CAST(floor(sum(x.p{i})::DOUBLE / count(*)) AS BIGINT) AS p{i}" for i in range(width))
        keep = ", ".join(f"coalesce(m.p{i}, b.p{i}) AS p{i}" for i in range(width))
        steps.append(f"a{k} AS MATERIALIZED ({pick(f'b{k}')})")
        steps.append(f"m{k} AS (SELECT x.part, best % {entries} AS e, {means} FROM x JOIN a{k} USING (r, part) GROUP BY ALL)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, {keep} FROM b{k} b LEFT JOIN m{k} m USING (part, e))")
    text = " || ',' || ".join(f"p{i}" for i in range(width))
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, vec_id, label, part, {", ".join(f"v[part * {width} + {i + 1}] AS p{i}" for i in range(width))} FROM k, range(0, {parts}) AS t(part)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS e, {cols} FROM x WHERE r <= {entries}),
{", ".join(steps)},
z AS MATERIALIZED ({pick(f"b{rounds}")}),
y AS (SELECT vec_id, label, r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM z JOIN (SELECT DISTINCT r, vec_id, label FROM x) USING (r) GROUP BY vec_id, label, r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg({text}, ',' ORDER BY part, e) FROM b{rounds})) AS codebooks_sha256 FROM y
"""


ORACLE = _oracle()
