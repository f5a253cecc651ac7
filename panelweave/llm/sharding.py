"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are counted with a partial aggregation over their digests.  Their
sizes are rounded up to classes of 12 significant bits, so the histogram that the driver
packs has a bounded number of rows (under 2**12 for each power of two) whatever the
corpus holds.  Groups of one class are interchangeable, and best fit puts them into the
tightest bin one after another until it is full; a class is therefore packed run by run,
which is the same as group by group.  The open bins stand in a balanced search tree
ordered by what is left in them.  Groups then find their bin by their rank, which comes
from bucketed windows, so no class and no shard meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, gapless, only, written

BITS = 12


class Tree:
    """A treap of (remaining, bin): balanced in expectation, priorities from a fixed generator."""

    def __init__(self) -> None:
        self.root = None
        self.draw = np.random.default_rng(7).random

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def add(self, remaining: int, bin_: int) -> None:
        left, right = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(left, [(remaining, bin_), self.draw(), None, None]), right)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the entry with the smallest remaining capacity of at least ``least``."""
        left, right = self._split(self.root, (least, -1))
        if right is None:
            self.root = left
            return None
        node, rest = right, None
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


@dataclass
class Packing:
    """Runs in class-decreasing order: run i starts at global rank starts[i] and lies in bins[i].

    A run over ``step[i]`` > 0 groups a bin goes on through following bins.
    """

    starts: list[int]
    bins: list[int]
    step: list[int]
    n_bins: int


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> Packing:
    """Pack ``count`` groups of each ``size`` (sizes decreasing); a group over the capacity gets a bin alone.

    The open bins stand on the driver: some hundred bytes a bin, whatever lies in it.
    """
    tree, out, rank = Tree(), Packing([], [], [], 0), 0
    for size, count in classes:
        while count:
            found = tree.take(size)
            if found is not None:
                left, bin_ = found
                n = min(count, left // size)
                out.starts.append(rank)
                out.bins.append(bin_)
                out.step.append(0)
                if left - n * size:
                    tree.add(left - n * size, bin_)
            else:
                each = max(1, capacity // size)
                full = count // each
                if full:  # equal new bins, each filled by this class
                    n = full * each
                    spare = capacity - each * size
                    if spare > 0:
                        for b in range(out.n_bins, out.n_bins + full):
                            tree.add(spare, b)
                else:
                    n, full = count, 1
                    tree.add(capacity - n * size, out.n_bins)
                out.starts.append(rank)
                out.bins.append(out.n_bins)
                out.step.append(each)
                out.n_bins += full
            rank += n
            count -= n
    return out


def smallest_capacity(classes: list[tuple[int, int]], n_bins: int) -> Packing:
    """The packing of the smallest capacity for which best-fit decreasing needs at most ``n_bins`` bins.

    Found by bisection, to one part in 2**20 of an even share.
    """
    if not classes:
        return Packing([], [], [], 0)
    total = sum(s * n for s, n in classes)
    low, high = max(1, -(-total // n_bins)), max(total, classes[0][0])
    best = None
    # An item above the capacity takes a bin alone, so the bins that are left share the rest.
    floor_, rest = low, total
    for size, n in classes:
        if size * n_bins <= rest or n_bins <= 1:
            break
        floor_ = max(1, rest // n_bins)
        break
    low = min(low, floor_)
    first = best_fit_decreasing(classes, low)
    if first.n_bins <= n_bins:
        best, high, low = first, low, max(1, low // n_bins)
    tolerance = max(1, high >> 20, total // n_bins >> 20)
    while high - low > tolerance or best is None:
        middle = (low + high) // 2 if high - low > tolerance else high
        packed = best_fit_decreasing(classes, middle)
        if packed.n_bins <= n_bins:
            best, high = packed, middle
        else:
            low = middle
    return best


def _class(size):
    """Round up to ``BITS`` significant bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) - (BITS - 1))).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def shard_documents(
    docs: DataFrame,
    *,
    n_shards: int | None = 16,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row.

    Equal texts stay together; null counts as empty.  With ``n_shards``, the capacity is
    the smallest that needs no more shards; with ``capacity``, as few shards as best fit
    opens.  A group above the capacity has a shard alone.  Empty input gives no rows.
    Repeated rows are members of their group like any others; other columns are left out.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = written(
        only(docs, id_col, text_col).select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("__text"),
        ),
        "shard-keys",
    )
    groups = written(
        keyed.groupBy("__text").agg(F.sum("size").alias("__bytes")).withColumn("__class", _class(F.col("__bytes"))),
        "shard-groups",
    )
    histogram = sorted(((r[0], r[1]) for r in groups.groupBy("__class").count().collect()), reverse=True)
    packed = smallest_capacity(histogram, n_shards) if n_shards else best_fit_decreasing(histogram, capacity)
    firsts, rank = [], 0
    for size, count in histogram:
        firsts.append((size, rank))
        rank += count
    starts, bins, step = (np.array(x or [0], dtype=np.int64) for x in (packed.starts, packed.bins, packed.step))
    class_sizes = np.array([-s for s, _ in firsts] or [0], dtype=np.int64)  # ascending
    class_first = np.array([r for _, r in firsts] or [0], dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(class_: pd.Series, rank_: pd.Series) -> pd.Series:
        at = class_first[np.searchsorted(class_sizes, -class_.to_numpy())] + rank_.to_numpy()
        run = np.searchsorted(starts, at, side="right") - 1
        more = np.where(step[run] > 0, (at - starts[run]) // np.maximum(step[run], 1), 0)
        return pd.Series((bins[run] + more).astype(np.int32))

    n = keyed.count()
    n_buckets = bucket_count(n)
    ranked = gapless(
        groups, ["__class"], F.pmod(F.xxhash64("__text"), F.lit(n_buckets)), [F.col("__text")], "__rank"
    ).select("__text", shard_of("__class", "__rank").alias("shard"))
    placed = keyed.join(ranked, "__text").drop("__text")
    return gapless(
        placed,
        ["shard"],
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets)),
        [F.col("doc_id"), F.col("text_crc32")],
        "slot",
    )
