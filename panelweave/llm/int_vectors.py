"""What the operators on integer vectors share: matrices from Arrow lists, and sums by slot merged in a shuffle."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import integer_vectors

#: Components below this keep every squared distance of 64 of them inside 64 bits; others go through Python's integers.
NARROW = 1 << 27
LONGEST = 1 << 62
SLOT_SUMS = "slot int, n long, sums array<decimal(38,0)>"
PIECE = 4096


def of_length(embeddings: DataFrame, dim: int, scale: int, *kept: str) -> DataFrame:
    """vec_id, v and the ``kept`` columns of the rows whose vector has ``dim`` sound components; v as in :func:`integer_vectors`."""
    rows = integer_vectors(embeddings, scale, *kept).filter(F.col("dim") == dim).drop("dim")
    wide = F.exists("v", lambda x: (x >= LONGEST) | (x <= -LONGEST))  # where the floor of a double ends
    return rows.withColumn("v", F.when(~wide, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("array<bigint>")))


def first_vectors(vectors: DataFrame, order: list[Column], n: int) -> np.ndarray:
    """The first ``n`` vectors, as rows of a matrix; vectors that tie in ``order`` go by their components."""
    rows = vectors.orderBy(*order, "v").select("v").limit(n).collect()
    return np.array([r[0] for r in rows], dtype=np.int64) if rows else np.zeros((0, 0), np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length; of Python integers where 64 bits might not do for distances."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    v = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return v if not v.size or max(int(v.max()), -int(v.min())) < NARROW else v.astype(object)


def long_array(values) -> pa.Array:
    return pa.array(values.tolist() if values.dtype == object else values, pa.int64())


class SlotSums:
    """Counts and component sums by slot over the batches of a task."""

    def __init__(self, slots: int, width: int) -> None:
        self.n = np.zeros(slots, np.int64)
        self.sums = np.zeros((slots, width), object)

    def add(self, slot: np.ndarray, v: np.ndarray) -> None:
        """Row i of ``v`` belongs to ``slot[i]``; at most PIECE rows at a time."""
        order = np.argsort(slot, kind="stable")
        here, first = np.unique(slot[order], return_index=True)
        self.n[here] += np.diff(np.append(first, len(slot)))
        self.sums[here] = self.sums[here] + np.add.reduceat(v[order], first, axis=0).astype(object)

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.n)
        sums = [[Decimal(x) for x in self.sums[i]] for i in used]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(self.n[used]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["slot", "n", "sums"])


def floored_means(partial: DataFrame, old: np.ndarray) -> np.ndarray:
    """``old`` (slots x width) with the rows that got vectors replaced by floor(sum / count).

    ``partial`` holds the sums of each task; they meet by (slot, component), never in one task.
    """
    each = partial.select("slot", "n", F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # slots x width rows
    new = old.copy()
    for r in rows:
        new[r["slot"], r["at"]] = int(r["x"]) // r["n"]
    return new
