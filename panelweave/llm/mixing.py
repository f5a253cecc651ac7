"""Mixing sources to target weights, in DataFrame functions alone.

Each document gets a hash-random key.  Keys are cut into ranges of equal width, so a
source of any size is spread over as many (source, range) groups as its rows need.
Prefix sums of the ranges' token counts tell in which range a source's integer budget
ends, after whole epochs: documents of the ranges before it are taken once more, those
after it are not.  Only the rows of that one range, some two thousand a source, are sorted
by key and summed up to find the key at which the budget is cut, the last document in
part.  The documents themselves, with their texts, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, neutral, written

#: Sources up to which their table (some 100 bytes a row) is broadcast; above, the joins shuffle.
BROADCAST_SOURCES = 50_000


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """Water level over the table of sources: one row a source, ``__words`` its size.

    Sources in code-point order, null last, take the weights in turn.  Sorted by
    limit/weight, the sources that stop at their limit are a prefix.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = sources.withColumn("__w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("__cap", F.col("__words") * limit)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__words").over(every) * F.lit(float(share))
    left = total - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weight_left = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    s = s.withColumn("__total", total).withColumn(
        "__full", left * F.col("__w") >= F.col("__cap").cast("double") * weight_left
    )
    open_ = ~F.col("__full")
    level = (F.col("__total") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0))) / F.sum(
        F.when(open_, F.col("__w"))
    ).over(every)
    return s.withColumn(
        "__target", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(level * F.col("__w"))
    ).select("__source", "__words", "__target")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All columns of ``docs`` plus ``mix_size, mix_source_size, mix_target, mix_taken``.

    Null text counts 0 words; a null source is a source of its own, after all others.
    Empty input gives an empty result; a source without words has target 0.  Rows equal
    in id and text share a key: they are interchangeable, and if the budget ends among
    them some are taken once more and others not.  Further columns of any name pass through, except those with the
    name of a result.
    """
    names = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_taken")]
    docs, named = neutral(docs)
    id_col, text_col, source_col = named[id_col], named[text_col], named[source_col]
    key = F.md5(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    )
    buckets = bucket_count(docs.count())
    high = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = (
        docs.withColumn("__key", key)
        .withColumn("__source", F.col(source_col))
        .withColumn("__bucket", F.shiftright(high * F.lit(buckets), 32).cast("int"))
    )
    sums = written(keyed.select("__source", "__bucket", size.alias("__size")).groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words")), "mix-sums")
    targets = _targets(sums.groupBy("__source").agg(F.sum("__words").alias("__words")), weights, share, limit)
    targets = targets.withColumn("__budget", F.floor("__target").cast("long")).withColumn(
        "__epochs", F.when(F.col("__words") > 0, F.expr("__budget div __words")).otherwise(F.lit(0)).cast("long")
    )
    targets = written(targets.withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("__words")).drop("__budget"), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    with_source = lambda rows, by: rows.join(
        F.broadcast(by.withColumnRenamed("__source", "__of")) if few else by.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))
    ).drop("__of")
    cuts = written(_cuts(sums, targets, keyed, size, with_source), "mix-cuts")
    ends = targets.alias("t").join(cuts.alias("c"), F.col("t.__source").eqNullSafe(F.col("c.__source")), "left")
    ends = ends.select("t.__source", "__words", "__target", "__epochs", "__cut", "__whole", "__part")
    joined = with_source(keyed, ends)
    at_cut = F.coalesce(F.col("__key") == F.col("__cut"), F.lit(False))
    before = F.coalesce(F.col("__key") < F.col("__cut"), F.lit(False))
    order = F.row_number().over(Window.partitionBy("__source", "__key").orderBy("__key"))
    rows = joined.filter(~at_cut).withColumn("__extra", before.cast("long")).withColumn("__words_extra", F.lit(0).cast("long"))
    tied = joined.filter(at_cut).withColumn("__n", order)
    tied = tied.withColumn("__extra", (F.col("__n") <= F.col("__whole")).cast("long")).withColumn(
        "__words_extra", F.when(F.col("__n") == F.col("__whole") + 1, F.col("__part")).otherwise(F.lit(0)).cast("long")
    )
    sized = rows.unionByName(tied.drop("__n")).withColumn("__size", size)
    return sized.select(
        *[F.col(named[c]).alias(c) for c in names],
        F.col("__size").alias("mix_size"),
        F.col("__words").alias("mix_source_size"),
        F.col("__target").alias("mix_target"),
        ((F.col("__epochs") + F.col("__extra")) * F.col("__size") + F.col("__words_extra")).alias("mix_taken"),
    )


def _cuts(sums: DataFrame, targets: DataFrame, keyed: DataFrame, size: Column, with_source) -> DataFrame:
    """source, cut, whole, part: the key at which the last epoch of a source ends.

    Of the rows with that key ``whole`` are taken in full and one for ``part`` words.  Only
    the rows of one key range a source are put in order.
    """
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
    inside = (F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("r.__words"))
    hit = ranges.alias("r").join(targets.alias("t"), F.col("r.__source").eqNullSafe(F.col("t.__source"))).filter(inside & (F.col("__rest") > 0))
    hit = hit.select("r.__source", F.col("__bucket").alias("__at"), (F.col("__rest") - F.col("__before")).alias("__left"))
    rows = with_source(keyed, hit).filter("__bucket = __at").withColumn("__size", size).filter("__size > 0")
    groups = rows.groupBy("__source", "__key", "__size", "__left").agg(F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__sum", F.coalesce(F.sum(F.col("__size") * F.col("__n")).over(by_key), F.lit(0)))
    ends = groups.filter((F.col("__sum") <= F.col("__left")) & (F.col("__left") < F.col("__sum") + F.col("__size") * F.col("__n")))
    over = F.col("__left") - F.col("__sum")
    return ends.select("__source", F.col("__key").alias("__cut"), F.expr("(__left - __sum) div __size").alias("__whole"), (over % F.col("__size")).alias("__part"))


def repeat_taken(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each whole copy that the mix takes; a part of a document of half or more counts as a copy."""
    copies = F.floor((F.col("mix_taken") * 2 + F.col("mix_size")) / (F.col("mix_size") * 2)).cast("int")
    return mixed.filter("mix_taken > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.array_repeat(F.lit(1), copies))).select(
        *[F.col(f"`{c}`") for c in columns]
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, 2 * CAST(sum(size) AS BIGINT) AS cap,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source
), r AS (
  SELECT *, 1.5::DOUBLE * sum(words) OVER () AS total, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight_left,
         coalesce(sum(cap) OVER b, 0) AS taken_before
  FROM s WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (total - taken_before) * w >= CAST(cap AS DOUBLE) * weight_left AS is_full FROM r
), t AS (
  SELECT source, words, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () * w END AS target
  FROM f
), q AS (
  SELECT d.doc_id, d.size, t.words, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CASE WHEN t.words > 0 THEN CAST(floor(t.target) AS BIGINT) // t.words ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * words - before)) AS BIGINT) AS taken FROM q
"""
