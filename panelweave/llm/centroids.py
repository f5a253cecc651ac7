"""Clusters of integer vectors around floored centroids, with exact distances only where block norms cannot rule a centroid out.

A vector is compressed to the norms of its segments (floored square roots, computed once).  By
Cauchy-Schwarz a segment of a vector and one of a centroid are at least as far apart as
their norms differ, so the squared differences of the norms, each less the 1 that
flooring may hide, sum up to a lower bound of the squared distance, in exact integers.
The centroid with the smallest bound is measured first; others only if their bound does not
exceed its distance.  Ties go to the smaller number, as everything that could tie is
measured.

The centroids are broadcast (``k * dim`` integers); a task hands on one row of sums for each
cluster, merged by a shuffle on (cluster, component).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .int_vectors import PIECE, SLOT_SUMS, SlotSums, first_vectors, floored_means, long_array, matrix, of_length

SEGMENTS = 8


def roots(x: np.ndarray) -> np.ndarray:
    """Floored square roots of integers below 2**62."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def segment_norms(v: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Floored norms of the segments of each row; the last segments are one component shorter where they do not divide evenly."""
    edges = [len(a) for a in np.array_split(np.arange(v.shape[1]), segments)]
    first = np.cumsum([0, *edges[:-1]])
    return roots(np.add.reduceat(v * v, first, axis=1)) if len(v) else np.zeros((0, segments), np.int64)


def lower_bounds(norms: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
    """rows x centroids: at most the squared distance."""
    out = np.zeros((len(norms), len(of_centroids)), np.int64)
    for j, c in enumerate(of_centroids):
        gap = np.maximum(np.abs(norms - c) - 1, 0)
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def screened(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid and its squared distance, and how many distances were measured."""
    if v.dtype == object or centroids.dtype == object:  # too wide for the bounds: measure all
        d = np.stack([((v - c.astype(object)) ** 2).sum(axis=1) for c in centroids], axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(v)), at], d.size
    bounds = lower_bounds(norms, of_centroids)
    best = bounds.argmin(axis=1)
    gap = v - centroids[best]
    least = (gap * gap).sum(axis=1)
    measured = len(v)
    pivot = best.copy()
    for j in range(len(centroids)):
        rows = np.flatnonzero((bounds[:, j] <= least) & (pivot != j))
        gap = v[rows] - centroids[j]
        d = (gap * gap).sum(axis=1)
        measured += len(rows)
        nearer = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
        best[rows[nearer]], least[rows[nearer]] = j, d[nearer]
    return best, least, measured


def with_norms(vectors: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, v and norms array<long> (empty where components are too wide for them)."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            norms = [[]] * len(v) if v.dtype == object else list(segment_norms(v, segments))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norms, pa.list_(pa.int64()))], ["vec_id", "v", "norms"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<long>, norms array<long>")


def _assigner(shared, segments: int):
    """(rows of the batch, clusters, distances, measured) for pieces of a batch whose columns start with v and norms."""

    def pieces(batch):
        centroids = shared.value
        wide = np.abs(centroids).max(initial=0) >= 1 << 27
        of_centroids = None if wide else segment_norms(centroids, segments)
        c = centroids.astype(object) if wide else centroids
        for i in range(0, batch.num_rows, PIECE):
            v = matrix(batch.column(0).slice(i, PIECE))
            norms = batch.column(1).slice(i, PIECE)
            if v.dtype != object and not wide:
                flat = norms.flatten().to_numpy(zero_copy_only=False)
                norms = flat.reshape(len(v), segments) if len(flat) == len(v) * segments else segment_norms(v, segments)
            yield v, *screened(v, norms, c, of_centroids)

    return pieces


def fit(vectors: DataFrame, centroids: np.ndarray, rounds: int, segments: int = SEGMENTS) -> np.ndarray:
    """The centroids after ``rounds`` of assigning and replacing; ``vectors`` as from :func:`with_norms`."""
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centroids)
        pieces = _assigner(shared, segments)
        k, dim = centroids.shape

        def sums(batches, pieces=pieces):
            got = SlotSums(k, dim)
            for batch in batches:
                for v, at, _, _ in pieces(batch):
                    got.add(at, v)
            yield got.batch()

        centroids = floored_means(vectors.select("v", "norms").mapInArrow(sums, SLOT_SUMS), centroids)
        shared.unpersist()
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, and measured: the distances computed for the row's piece, on the first row of each piece."""
    pieces = _assigner(vectors.sparkSession.sparkContext.broadcast(centroids), segments)

    def run(batches):
        for batch in batches:
            at, distance, measured = [pa.array([], pa.int32())], [pa.array([], pa.int64())], []
            for _, a, d, m in pieces(batch):
                at.append(pa.array(a, pa.int32()))
                distance.append(long_array(d))
                measured += [m] + [0] * (len(a) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.concat_arrays(at), pa.concat_arrays(distance), pa.array(measured, pa.int64())], ["vec_id", "cluster", "distance", "measured"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("v", "norms", "vec_id").mapInArrow(run, f"vec_id {kind}, cluster int, distance long, measured long")


def clustered(embeddings: DataFrame, *, dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row with a sound vector of ``dim`` components.

    Left out: rows whose vector is null, of another length, or holds a null, NaN or infinite
    component.  Centroids start as the ``k`` vectors with the smallest SHA-256 of
    ``seed:vec_id`` (null ids last, equal ids by their vectors); with fewer rows there are as
    many centroids.  Equal centroids stay apart: the smaller number takes their vectors
    and the others keep their place.  Repeated rows count each; an empty table gives no rows; other
    columns are left out.  Components of 2**27 and more are computed with Python's integers;
    components, distances and sums that do not fit 64 bits raise an error.
    """
    vectors = written(with_norms(of_length(embeddings, dim, scale)), "cluster-vectors")
    first = first_vectors(vectors, [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()], k)
    if not len(first):
        none = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid_sha256": F.lit("")})
    centroids = fit(vectors, first, rounds)
    rows = written(assign(vectors, centroids).drop("measured"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    table = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    facts = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int = 8, rounds: int = 10) -> str:
    pick = lambda c: f"SELECT x.r, min(CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * {k} + c.j) AS best FROM x, {c} c GROUP BY x.r"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({pick(f'c{i}')})")
        steps.append(
            f"m{i} AS (SELECT j, list(s ORDER BY pos) AS v FROM (SELECT best % {k} AS j, pos, CAST(floor(sum(v[pos])::DOUBLE / count(*)) AS BIGINT) AS s FROM x JOIN a{i} USING (r), range(1, 65) AS t(pos) GROUP BY ALL) GROUP BY j)"
        )
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (j))")
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT r - 1 AS j, v FROM x WHERE r <= {k}),
{", ".join(steps)},
z AS MATERIALIZED ({pick(f"c{rounds}")}),
y AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance FROM z JOIN x USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM y JOIN c{rounds} c ON c.j = y.cluster
"""


ORACLE = _oracle()
