"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words (runs of letters, in lower case) and the starts of words
of 4 to 7 bytes, which stand for all inflections of a stem; each is a 64-bit hash, so distinct
terms do not share a weight.  A text is the set of its terms that the model knows, each with
a fixed value: the root of its rarity, from 0 (in every text) to 1 (in one).  The score is the logistic
function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so a pair of terms counts for more, or less, than both alone: an insult beside a group's
name, say.  The pair sum takes one pass, as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.

Fitting: labelled texts outside the held-out fold are sampled by a hash of their id, at most
about ``CLASS_ROWS`` of each label; the sample's ids are few enough to broadcast, so no text
is shuffled.  Terms are counted in the sample by label, distributed, and the ``MOST_TERMS``
that tell most about the label are kept.  The sets of known terms, ``ENTRIES`` entries at the
most, then come to the driver, which fits the machine by full-batch steps.  The
bounds do not depend on the size of the corpus.  Scoring is a pass over whole texts without
a shuffle, with the model broadcast (some 2 MB).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .textcore import Block, blocks, mix

#: Sampled rows of each label, at about; known terms at most; entries (a known term of a sampled text) at about.
CLASS_ROWS = 20_000
MOST_TERMS = 1 << 15
ENTRIES = 1 << 22
#: A term must be in so many sampled texts, and its likelihood ratio against the label at least this.
LEAST_TEXTS = 3
LEAST_GAIN = 10.0
STARTS = (4, 5, 6, 7)
FACTORS = 4
STEPS = 150
THRESHOLD = 0.3
_PARTS = 1 << 20
_SALTS = mix(np.arange(1, 9, dtype=np.uint64))

#: Bytes that part words: all of ASCII but letters.
GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from: CRC-32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a block, repeats included, and the text of the block each is from."""
    text = np.repeat(np.arange(block.n), np.diff(block.bounds))
    hashes, owners = [block.hashes], [text]
    for k in STARTS:
        at = np.flatnonzero(block.ends - block.starts >= k)
        hashes.append(block.ranges.hash(block.starts[at], block.starts[at] + k) ^ _SALTS[k])
        owners.append(text[at])
    return np.concatenate(hashes), np.concatenate(owners)


def _blocks(column: pa.Array):
    """Blocks of a text column in lower case (all of Unicode), nulls as empty texts."""
    return blocks(pc.utf8_lower(column.cast(pa.large_string())), gaps=GAPS)


def _tallies(batches):
    """term, n, toxic: in how many texts and toxic texts of a batch each term is, from columns toxic and text."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in _blocks(batch.column(1)):
            h, text = _terms(b)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            found.append((h[first], toxic[text[first] + b.first]))
        if found:
            h, t = (np.concatenate(x) for x in zip(*found, strict=True))
            term, back, n = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n), pa.array(np.bincount(back, t, len(term)).astype(np.int64))], ["term", "n", "toxic"])


class Vocabulary:
    """Known terms, ascending, and the places where a text has them."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = np.sort(terms.astype(np.uint64))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.terms >> np.uint64(42)] = True

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def places(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(text, index of a known term), each pair once, by text."""
        h, text = _terms(block)
        at = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        h, text = h[at], text[at]
        i = np.searchsorted(self.terms, h)
        known = np.flatnonzero(i < len(self.terms))
        known = known[self.terms[i[known]] == h[known]]
        pairs = np.unique(text[known] * np.int64(len(self.terms) + 1) + i[known])
        return pairs // (len(self.terms) + 1), pairs % (len(self.terms) + 1)


@dataclass
class Machine:
    """A fitted model: the value x of each known term, and the weights w0, w and v."""

    vocabulary: Vocabulary
    x: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of n texts, given their (row, term) pairs."""
        return self._parts(n, row, term)[0]

    def _parts(self, n: int, row: np.ndarray, term: np.ndarray):
        x = self.x[term]
        z = self.w0 + np.bincount(row, self.w[term] * x, n)
        sums = []
        for f in range(self.v.shape[1]):
            vx = self.v[term, f] * x
            s = np.bincount(row, vx, n)
            z += 0.5 * (s * s - np.bincount(row, vx * vx, n))
            sums.append((s, vx))
        return z, x, sums

    def gradients(self, n: int, row: np.ndarray, term: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Of the weighted mean log loss by w0, w and v."""
        z, x, sums = self._parts(n, row, term)
        g = weight * (_logistic(z) - y)
        gx = g[row] * x
        dv = [np.bincount(term, gx * (s[row] - vx), len(self.w)) for s, vx in sums]
        return g.sum(), np.bincount(term, gx, len(self.w)), np.stack(dv, axis=1) if dv else np.zeros_like(self.v)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(machine: Machine, n: int, row: np.ndarray, term: np.ndarray, y: np.ndarray, weight: np.ndarray, *, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the whole sample; ``decay`` is the weight of the squared weights.  The same input gives the same model."""
    weight = weight / weight.sum()
    m = machine
    share = float(np.clip((weight * y).sum(), 1e-6, 1 - 1e-6))
    m.w0 = float(np.log(share / (1 - share)))
    m.v = np.random.default_rng(seed).normal(0, 0.1, m.v.shape)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (np.zeros(1), m.w, m.v)]
    for step in range(1, steps + 1):
        grads = m.gradients(n, row, term, y, weight)
        for i, (p, g) in enumerate(zip((np.array([m.w0]), m.w, m.v), grads, strict=True)):
            g = g + (decay * p if i else 0)
            a, b = state[i]
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
            if not i:
                m.w0 = float(p[0])
    return m


def _gain(n: Column, toxic: Column, rows: int, toxic_rows: int) -> Column:
    """Likelihood ratio statistic of a term against the label."""

    def cell(got: Column, a: Column, b: int) -> Column:
        return F.when(got > 0, got * F.log(got * rows / (a * b))).otherwise(0.0)

    r, others = F.lit(rows), rows - toxic_rows
    inside = cell(toxic, n, toxic_rows) + cell(n - toxic, n, others)
    outside = cell(toxic_rows - toxic, r - n, toxic_rows) + cell(others - (n - toxic), r - n, others)
    return 2 * (inside + outside)


def _best_terms(sample: DataFrame, rows: int, toxic_rows: int) -> list[tuple[int, int]]:
    """(term, texts) of at most MOST_TERMS terms with the highest gain; a threshold on the gain, found from its histogram, bounds what is collected."""
    counts = sample.select("toxic", "text").mapInArrow(_tallies, "term long, n long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_TEXTS)
    gains = counts.select("term", "n", _gain(F.col("n"), F.col("toxic"), rows, toxic_rows).alias("gain")).filter(F.col("gain") >= LEAST_GAIN)
    gains = written(gains, "toxic-terms")
    step = F.floor(F.log("gain") * 64).cast("int")
    total, least = 0, 0
    for r in gains.groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():  # some 1,000 steps between 10 and the largest gain
        total += r["count"]
        if total > MOST_TERMS and least:
            break
        least = r["b"]
    kept = gains.filter(step >= least) if least else gains
    return [(r["term"], r["n"]) for r in kept.orderBy(F.desc("gain"), "term").limit(MOST_TERMS).collect()]


def train(docs: DataFrame, labels: DataFrame, *, class_rows: int = CLASS_ROWS, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """Fit on the labelled texts outside the held-out fold; see :func:`scored` for odd rows."""
    fold = only(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = fold.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    rate = {t: min(1.0, class_rows / n) for t, n in sizes.items()}
    below = F.when(F.col("toxic") == 1, int(rate.get(1, 1.0) * _PARTS)).otherwise(int(rate.get(0, 1.0) * _PARTS))
    chosen = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)) < below)  # about 2 * class_rows rows
    sample = written(only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxic-sample")
    got = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    weight = {t: 1.0 / rate.get(t, 1.0) for t in (0, 1)}
    rows = sum(got.values())
    best = _best_terms(sample, rows, got.get(1, 0)) if len(got) == 2 else []
    vocabulary = Vocabulary(np.array([t for t, _ in best], np.int64).view(np.uint64))
    texts_of = dict(best)
    df = np.array([texts_of[t] for t in vocabulary.terms.view(np.int64).tolist()], np.float64)
    machine = Machine(vocabulary, np.sqrt(np.log((rows + 1) / np.maximum(df, 1)) / np.log(rows + 1)) if rows else df, 0.0, np.zeros(len(df)), np.zeros((len(df), factors)))
    if not best:
        share = (got.get(1, 0) * weight[1] + 0.5) / (got.get(1, 0) * weight[1] + got.get(0, 0) * weight[0] + 1.0)
        machine.w0 = float(np.log(share / (1 - share)))
        return machine
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def known(batches):
        for batch in batches:
            lists = []
            for b in _blocks(batch.column(1)):
                text, term = shared.value.places(b)
                lists += np.split(term.astype(np.int32), np.searchsorted(text, np.arange(1, b.n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "terms"])

    sets = written(sample.select("toxic", "text").mapInArrow(known, "toxic int, terms array<int>"), "toxic-sets")
    entries = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    if entries > ENTRIES:
        sets = sets.filter(F.pmod(F.xxhash64("terms"), F.lit(_PARTS)) < int(ENTRIES / entries * _PARTS))
    got_sets = sets.select("toxic", "terms", F.xxhash64("terms").alias("h")).toArrow()  # about ENTRIES entries
    # In order of their hashes: sums, and so the model, are the same in every run.
    got_sets = got_sets.take(np.lexsort((got_sets.column("toxic").to_numpy(), got_sets.column("h").to_numpy())))
    y = got_sets.column("toxic").to_numpy().astype(np.float64)
    terms = got_sets.column("terms").combine_chunks()
    sizes_ = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    row, term = np.repeat(np.arange(len(y)), sizes_), terms.flatten().to_numpy().astype(np.int64)
    return fit(machine, len(y), row, term, y, np.where(y > 0, weight[1], weight[0]), steps=steps)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text), by whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            m = shared.value
            out = [m_scores for b in _blocks(batch.column(2)) for m_scores in [_logistic(m.logits(b.n, *m.vocabulary.places(b)))]]
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if the score is at least THRESHOLD) of every row of ``docs``.

    Trained on ``labels`` (doc_id, toxic) outside the held-out fold alone; null ids and
    labels teach nothing, an id with several labels is toxic if one of them says so, and a label
    without a document is passed over.  Without labels, or with one kind only, every text gets
    the share of toxic labels (0.5 without any).  Null, empty and word-less texts get the score of
    no known terms.  Repeated rows are scored each, and repeated documents count as often in the
    sample; an empty table gives no rows.  Other columns are left out.
    """
    return score(docs, train(docs, labels))
