"""The factorization machine: gradients, interactions, held-out accuracy on the tables, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, score double, toxic int, held_out string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    n, terms = 12, 9
    pairs = sorted({(int(r), int(t)) for r, t in zip(rng.integers(0, n, 60), rng.integers(0, terms, 60), strict=True)})
    row, term = (np.array(x) for x in zip(*pairs, strict=True))
    y, weight = rng.integers(0, 2, n).astype(float), rng.random(n)
    m = toxicity.Machine(toxicity.Vocabulary(np.arange(terms, dtype=np.uint64)), rng.random(terms), 0.3, rng.normal(0, 1, terms), rng.normal(0, 1, (terms, 3)))

    def loss():
        p = toxicity._logistic(m.logits(n, row, term))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    z = m.w0 + np.zeros(n)
    for i in range(n):
        own = term[row == i]
        z[i] += sum(m.w[t] * m.x[t] for t in own) + sum(m.v[a] @ m.v[b] * m.x[a] * m.x[b] for k, a in enumerate(own) for b in own[k + 1 :])
    assert np.allclose(m.logits(n, row, term), z)
    g0, gw, gv = m.gradients(n, row, term, y, weight)
    h = 1e-6
    for array, grad in ((m.w, gw), (m.v, gv)):
        for at in np.ndindex(array.shape):
            array[at] += h
            up = loss()
            array[at] -= 2 * h
            down = loss()
            array[at] += h
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-5
    m.w0 += h
    up = loss()
    m.w0 -= 2 * h
    assert abs((up - loss()) / (2 * h) - g0) < 1e-5


def terms_of(text):
    """The terms by plain means: lower-case words of letters, and the first 4 to 7 bytes of longer ones."""
    out, word = set(), b""
    for b in text.lower().encode() + b" ":
        if b >= 128 or chr(b).isalpha():
            word += bytes([b])
        elif word:
            out.add(word)
            out |= {(k, word[:k]) for k in toxicity.STARTS if len(word) >= k}
            word = b""
    return out


def test_terms_are_words_and_their_starts():
    texts = ["Some-thing STUPID, stupidly; Ünïcode 12abc", "", None, "a bb ccc dddd eeeee", "x" * 100, "stupid"]
    block = next(iter(toxicity._blocks(pa.array(texts))))
    h, text = toxicity._terms(block)
    for i, t in enumerate(texts):
        assert len(set(h[text == i].tolist())) == len(terms_of(t or ""))
    shared = set(h[text == 0].tolist()) & set(h[text == 5].tolist())
    assert len(shared) == len(terms_of(texts[0]) & terms_of("stupid")) == 4  # the word, stup*, stupi*, stupid*


def mixture(n, seed=3):
    """Toxic exactly where an insult and a group's name stand together; each alone, and much else, is clean."""
    r = random.Random(seed)
    insults, groups = [f"insult{c}" for c in "abcd"], [f"group{c}" for c in "abcd"]
    rows = []
    for i in range(n):
        words = [f"word{r.randrange(300)}q" for _ in range(r.randint(20, 60))]
        kind = r.randrange(4)
        words += [r.choice(insults)] * (kind in (1, 3)) + [r.choice(groups)] * (kind in (2, 3))
        r.shuffle(words)
        rows.append((i, " ".join(words), int(kind == 3)))
    return rows


def accuracy(spark, rows, factors):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, factors=factors, steps=300)
    truth = {i: y for i, _, y in rows}
    got = [(truth[r["doc_id"]], r["score"]) for r in toxicity.score(docs, m).collect() if r["held_out"]]
    return sum((s >= 0.5) == bool(y) for y, s in got) / len(got)


def test_pairs_are_learned_that_sums_of_weights_miss(spark):
    rows = mixture(3000)
    # Insult and group also stand together in words of no harm: three quarters of the texts are clean, and a linear model must draw one line.
    pair, linear = accuracy(spark, rows, 4), accuracy(spark, rows, 0)
    assert pair >= 0.97 and pair >= linear


def test_a_line_cannot_tell_these_pairs_apart(spark):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        pair = r.choice(["ab", "cd", "ac", "bd", "ad", "bc"]) if i % 2 else ""
        words = [f"word{r.randrange(300)}q" for _ in range(30)] + [f"term{x}" for x in pair]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(pair in ("ab", "cd"))))
    pair, linear = accuracy(spark, rows, 4), accuracy(spark, rows, 0)
    assert pair >= 0.98 and linear <= 0.88


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op13_toxicity(spark, "/root/testdata/sf0.1").toPandas()


def test_held_out_accuracy_on_the_tables(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    m = scored.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (scored.held_out == scored.doc_id.map(held)).all() and scored.score.between(0, 1).all() and len(scored) == 10_000
    assert (scored.predicted == (scored.score >= 0.3)).all()
    ranks, bad = m.score.rank(), m.toxic == 1
    area = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    hit = (m.predicted == 1) & bad
    assert area > 0.97 and hit.sum() / bad.sum() > 0.83 and hit.sum() / (m.predicted == 1).sum() > 0.93


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    run = lambda x: sorted((r["doc_id"], r["score"]) for r in toxicity.scored(docs, x).collect())
    a = run(labels)
    assert a == run(turned) == run(labels.repartition(7))


def test_odd_rows(spark):
    rows = [(i, f"you idiot number{i} here" if i % 3 == 0 else f"a kind word number{i} here", int(i % 3 == 0)) for i in range(300)]
    texts = [(i, t) for i, t, _ in rows] + [(None, "idiot"), (900, None), (901, ""), (902, " \n"), (903, "IDIOT!" + " fine" * 300_000), (0, rows[0][1]), (904, "Idiotisch")]
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1, "clash") for i, t in texts], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (7, None, "x"), (5, 1, "y"), (99999, 1, "z")], "doc_id long, toxic int, text string")
    got = toxicity.scored(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by.values())) == len(texts) and len(by[0]) == 2 and by[0][0] == by[0][1]
    assert by[None][0]["predicted"] == 1 and not by[None][0]["held_out"] and by[903][0]["predicted"] == 1 and by[904][0]["predicted"] == 1
    assert by[900][0]["score"] == by[901][0]["score"] == by[902][0]["score"] < 0.5
    assert all((r[0]["predicted"] == 1) == (i % 3 == 0) for i, r in by.items() if i is not None and i < 300 and i != 5)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scored(docs, none).collect()] == [0.5, 0.5]
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(0 < r["score"] < 0.5 for r in toxicity.scored(docs, clean).collect())
    assert toxicity.scored(docs.limit(0), clean).count() == 0


def test_the_sample_is_bounded_by_hash(spark):
    rows = mixture(2000, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, class_rows=200)
    share = sum(y for i, _, y in rows if not held(i)) / sum(not held(i) for i, _, _ in rows)
    scores = [r["score"] for r in toxicity.score(docs, m).collect()]
    assert abs(np.mean(scores) - share) < 0.08  # rows weigh in what their class was thinned by
