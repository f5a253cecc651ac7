"""Quality rules whose thresholds come from quantile sketches per language and source.

Features are counted with array operations over Arrow batches.  Each metric of each
(language, source) goes into a sketch of logarithmic buckets (relative error ``ALPHA``),
a table of counts: sketches merge by adding counts, so they do not depend on how rows
were dealt out, and a group with few rows uses the merged sketch of its language, or of
all rows.  A document is rejected if a metric lies beyond the fence that its group's
quartiles put up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import neutral, only, written
from .textcore import Block, blocks, mix

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: metric: (value, smallest spread that counts, whether low values are suspect too).  FENCE times the smallest spread is
#: how far a fence lies at least beyond its quartile: 0.12 for repeat_share, below the 0.20 of the base rules, and 0.3 for dup_line_share.
METRICS: dict[str, tuple[str, float, bool]] = {
    "symbol_share": ("n_symbols / word_chars", 0.01, False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.1, False),
    "repeat_share": ("n_repeat_words / n_words", 0.04, False),
    "mean_word": ("word_chars / n_words", 0.5, True),
}
FENCE = 3.0
MIN_ROWS = 100


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Flags of the entries whose key occurs more than once."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _block_counts(b: Block) -> list[np.ndarray]:
    docs = np.arange(b.n, dtype=np.uint64)
    words = np.diff(b.bounds)
    chars = b.count(b.solid & ((b.buf & 0xC0) != 0x80))
    symbols = b.count(SYMBOL[b.buf])

    newlines = np.flatnonzero(b.buf == 10)
    begin = np.unique(np.concatenate([b.offsets[:-1], newlines + 1]))
    begin = begin[begin < len(b.buf)]
    doc = np.searchsorted(b.offsets, begin, side="right") - 1
    stops = np.append(newlines, len(b.buf))
    end = np.minimum(stops[np.searchsorted(newlines, begin)], b.offsets[doc + 1])
    full = np.searchsorted(b.starts, end) > np.searchsorted(b.starts, begin)
    begin, end, doc = begin[full], end[full], doc[full]
    lines = np.bincount(doc, minlength=b.n)
    keys = mix(b.ranges.hash(begin, end) ^ mix(docs[doc] + np.uint64(1)))
    distinct = np.unique(keys, return_index=True)[1]
    dups = lines - np.bincount(doc[distinct], minlength=b.n)

    hashes, at = b.windows(5)
    doc = np.searchsorted(b.bounds, at, side="right") - 1
    again = at[_repeats(mix(hashes ^ mix(docs[doc] + np.uint64(1))))]
    n = len(b.hashes)
    covered = np.cumsum(np.bincount(again, minlength=n + 1) - np.bincount(again + 5, minlength=n + 6)[: n + 1])[:n] > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    return [words, chars, symbols, lines, dups, np.diff(sums[b.bounds])]


def with_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the counts of :data:`COUNTS`; null text counts as empty."""
    schema = docs.select(*keep).schema

    def count(batches):
        for batch in batches:
            parts = [_block_counts(b) for b in blocks(batch.column(batch.num_columns - 1))]
            arrays = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(len(COUNTS))] if parts else [
                pa.array([], pa.int64()) for _ in COUNTS
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + arrays, [*batch.schema.names[:-1], *COUNTS])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    ddl = ", ".join([ddl, *[f"{c} long" for c in COUNTS]])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(count, ddl)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """groups, metric, bucket, n: the sketch of each metric over the rows that pass the base rules."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.try_divide(*(F.col(c) for c in v.split(" / "))).alias("x")) for m, (v, _, _) in METRICS.items()]
    rows = counts.filter(~base_failed()).select(*groups, F.explode(F.array(*pairs)).alias("p")).filter("p.x IS NOT NULL")
    bucket = F.when(F.col("p.x") <= 1e-9, F.lit(-(10**6))).otherwise(F.ceil(F.log(F.col("p.x")) / math.log(GAMMA)))
    return rows.groupBy(*groups, F.col("p.metric").alias("metric"), bucket.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _quartiles(sketch: DataFrame, groups: list[str], name: str) -> DataFrame:
    by = Window.partitionBy(*groups, "metric")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sketch.withColumn("total", F.sum("n").over(by)).withColumn("cum", F.sum("n").over(upto))
    value = F.when(F.col("bucket") == -(10**6), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (GAMMA + 1)))
    at = lambda q: F.min(F.when(F.col("cum") >= F.col("total") * q, value))
    return cum.groupBy(*groups, "metric").agg(
        F.struct(F.max("total").alias("rows"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3")).alias(name)
    )


def thresholds(counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, limits map<metric, struct<low, high>>: one row for each language and source.

    Nulls in either column are a group of their own.
    """
    keyed = counts.select(
        F.to_json(F.struct(F.col(lang_col).alias("l"))).alias("__lang"),
        F.to_json(F.struct(F.col(source_col).alias("s"))).alias("__source"),
        *COUNTS,
    )
    fine = written(sketches(keyed, ["__lang", "__source"]), "quality-sketch")
    merged = lambda g: fine.groupBy(*g, "metric", "bucket").agg(F.sum("n").alias("n"))
    quart = (
        _quartiles(fine, ["__lang", "__source"], "own")
        .join(_quartiles(merged(["__lang"]), ["__lang"], "of_lang"), ["__lang", "metric"])
        .join(_quartiles(merged([]), [], "of_all"), ["metric"])
    )
    use = (
        F.when(F.col("own.rows") >= MIN_ROWS, F.col("own"))
        .when(F.col("of_lang.rows") >= MIN_ROWS, F.col("of_lang"))
        .otherwise(F.col("of_all"))
    )
    rows = quart.withColumn("use", use)
    least = F.create_map(*[x for m, (_, s, _) in METRICS.items() for x in (F.lit(m), F.lit(s))])[F.col("metric")]
    spread = F.greatest(F.col("use.q3") - F.col("use.q1"), least)
    limit = F.struct((F.col("use.q1") - spread * FENCE).alias("low"), (F.col("use.q3") + spread * FENCE).alias("high"))
    return rows.groupBy("__lang", "__source").agg(F.map_from_entries(F.collect_list(F.struct("metric", limit))).alias("limits"))


#: Groups up to which the table of limits (some 300 bytes a row) is broadcast; above, the join shuffles.
BROADCAST_GROUPS = 50_000


def judge(counts: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``counts`` plus base_failed and kept.  A group without limits (all its rows failed the base rules) keeps nothing."""
    beyond = F.lit(False)
    for m, (v, _, both) in METRICS.items():
        x = F.try_divide(*(F.col(c) for c in v.split(" / ")))
        bad = x > F.col("limits")[m]["high"]
        if both:
            bad = bad | (x < F.col("limits")[m]["low"])
        beyond = beyond | F.coalesce(bad, F.lit(False))
    small = limits.count() <= BROADCAST_GROUPS
    return (
        counts.withColumn("__lang", F.to_json(F.struct(F.col(lang_col).alias("l"))))
        .withColumn("__source", F.to_json(F.struct(F.col(source_col).alias("s"))))
        .join(F.broadcast(limits) if small else limits, ["__lang", "__source"], "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~base_failed() & ~beyond)
        .drop("__lang", "__source", "limits")
    )


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row.

    Null or empty text has no words and fails the base rules.  Repeated rows are judged
    each for itself; further columns are left out; an empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text", "lang", "source")
    counts = written(with_counts(docs, ["doc_id", "lang", "source"]), "quality-counts")
    return judge(counts, written(thresholds(counts), "quality-limits")).drop("lang", "source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns; see :func:`quality_counts` for odd rows."""
    plain, named = neutral(docs)
    text, lang, source = (named[c] for c in ("text", "lang", "source"))
    limits = written(thresholds(with_counts(plain, [lang, source], text), lang, source), "quality-limits")
    kept = judge(with_counts(plain, plain.columns, text), limits, lang, source).filter("kept")
    return kept.select(*plain.columns).toDF(*docs.columns)


def _oracle() -> str:
    metrics = ", ".join(f"('{m}', {v.replace(' / ', ' / nullif(')}, 0), {s!r}::DOUBLE, {str(both).lower()})" for m, (v, s, both) in METRICS.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, s, md5(array_to_string(w[s:s + 4], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS s FROM d)
), again AS (
  SELECT r, count(DISTINCT s + o) AS n FROM (SELECT r, s, count(*) OVER (PARTITION BY r, h) AS k FROM g), range(0, 5) AS t(o) WHERE k > 1 GROUP BY r
), lines AS (
  SELECT r, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), c AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (r) LEFT JOIN again USING (r)
), b AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM c
), m AS (
  SELECT b.*, metric, x, least_spread, both_sides FROM b, LATERAL (VALUES {metrics}) AS t(metric, x, least_spread, both_sides)
), k AS (
  SELECT lang, source, metric, CASE WHEN x <= 1e-9 THEN -1000000 ELSE ceil(ln(x) / {math.log(GAMMA)!r}::DOUBLE) END AS bucket, count(*) AS n FROM m WHERE NOT base_failed AND x IS NOT NULL GROUP BY ALL
), q AS (
  SELECT level, lang, source, metric, bucket, sum(n) AS n FROM (SELECT 0 AS level, * FROM k UNION ALL SELECT 1, lang, NULL, metric, bucket, n FROM k UNION ALL SELECT 2, NULL, NULL, metric, bucket, n FROM k) GROUP BY ALL
), cum AS (
  SELECT *, CASE WHEN bucket = -1000000 THEN 0.0::DOUBLE ELSE pow({GAMMA!r}::DOUBLE, bucket) * {2 / (GAMMA + 1)!r}::DOUBLE END AS v,
         sum(n) OVER p AS total, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto FROM q WINDOW p AS (PARTITION BY level, lang, source, metric)
), qq AS (
  SELECT level, lang, source, metric, max(total) AS total, min(CASE WHEN upto >= total * 0.25 THEN v END) AS q1, min(CASE WHEN upto >= total * 0.75 THEN v END) AS q3 FROM cum GROUP BY level, lang, source, metric
), bad AS (
  SELECT m.r, bool_or(coalesce(x > q3 + {FENCE} * greatest(q3 - q1, least_spread) OR both_sides AND x < q1 - {FENCE} * greatest(q3 - q1, least_spread), false)) AS beyond FROM (
    SELECT m.*, CASE WHEN o.total >= {MIN_ROWS} THEN o.q1 WHEN l.total >= {MIN_ROWS} THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.total >= {MIN_ROWS} THEN o.q3 WHEN l.total >= {MIN_ROWS} THEN l.q3 ELSE a.q3 END AS q3
    FROM m LEFT JOIN qq o ON o.level = 0 AND o.metric = m.metric AND o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source
    LEFT JOIN qq l ON l.level = 1 AND l.metric = m.metric AND l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN qq a ON a.level = 2 AND a.metric = m.metric) AS m GROUP BY m.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM b JOIN bad USING (r)
"""


ORACLE = _oracle()
