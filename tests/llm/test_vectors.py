"""Codes of vectors and clusters against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelweave.llm import centroids, int_vectors, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, v int, code string, slot int, cluster double"


def table(spark, vectors, labels=None):
    labels = labels or [i % 3 if i % 7 else None for i in range(len(vectors))]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], lab, "clash", 1, "clash", 2, 3.0) for (i, v), lab in zip(vectors, labels, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def odd_vectors(n=90, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dim))
    out = [(i, (centres[i % 5] + rng.normal(0, 0.05, dim)).astype(np.float32).tolist()) for i in range(n)]
    out += [(1000 + i, out[i][1]) for i in range(8)]  # equal vectors under other ids
    out += [out[3], (5, out[9][1])]  # a repeated row, and an id with two vectors
    bad = [None, [], [1.0] * (dim - 1), [math.nan] + [0.0] * (dim - 1), [0.0] * (dim - 1) + [math.inf], [None] + [0.0] * (dim - 1)]
    out += [(2000 + i, v) for i, v in enumerate(bad)]
    out += [(None, out[1][1]), (-3, [0.0] * dim), (3000, [-0.0] * dim), (3001, [1.0 / 1024] * dim)]
    random.Random(seed).shuffle(out)
    return out


def sound(vectors, scale, dim=64):
    """(id, integers) of the rows that take part."""
    good = [(i, v) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in good]


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v in rows:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, bytes(k for _, k in got), sum(d for d, _ in got)))
    text = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("parts, entries, rounds", [(16, 64, 2), (4, 7, 3), (1, 2, 1), (64, 256, 2)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    vectors = odd_vectors()
    labels = {i: n % 4 for n, (i, _) in enumerate(vectors)}
    labels[None] = None
    df = table(spark, vectors, [labels[i] for i, _ in vectors])
    got = vector_codes.compressed(df, parts=parts, entries=entries, rounds=rounds).collect()
    want, digest = brute_codes(sound(vectors, 256), parts, entries, rounds)
    assert sorted(((r["vec_id"], bytes(r["code"]), r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = {}
    for i, _, e in want:
        sums[labels[i]] = sums.get(labels[i], 0) + e
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in got)


def test_sums_of_very_many_labels_take_the_other_join(spark, monkeypatch):
    df = table(spark, odd_vectors())
    a = sorted(map(tuple, vector_codes.compressed(df).collect()), key=str)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, vector_codes.compressed(df).collect()), key=str) == a


def test_codes_of_wide_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(20)]
    got = vector_codes.compressed(table(spark, rows, [1] * 20), entries=4).collect()
    want, digest = brute_codes(sound(rows, 256), 16, 4, 2)
    assert sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in got) == sorted(want) and got[0]["codebooks_sha256"] == digest
    with pytest.raises(Exception, match="too large for 64 bits"):
        vector_codes.compressed(table(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])).collect()


def test_empty_and_unfit_tables(spark):
    for df in (table(spark, []), table(spark, [(1, None), (2, [1.0])])):
        a, b = vector_codes.compressed(df), centroids.clustered(df)
        assert a.count() == 0 and a.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert b.count() == 0 and b.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        vector_codes.compressed(table(spark, []), parts=7)


def brute_clusters(rows, k, rounds):
    hashed = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else hashed(r[0]), r[1]))
    centres = [v for _, v in rows[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in rows]
    sums = {}
    for _, j, d in got:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in got]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 1), (200, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    vectors = odd_vectors(seed=k)
    got = centroids.clustered(table(spark, vectors), k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_clusters(sound(vectors, 1024), k, rounds), key=key)


def test_clusters_of_wide_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(25)]
    got = centroids.clustered(table(spark, rows), k=4, rounds=3).collect()
    assert sorted(map(tuple, got)) == sorted(brute_clusters(sound(rows, 1024), 4, 3))


def test_equal_centroids_keep_apart(spark):
    rows = [(i, [0.5] * 64) for i in range(12)]
    got = centroids.clustered(table(spark, rows)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}


def test_bounds_never_exceed_distances_and_rule_centroids_out():
    rng = np.random.default_rng(6)
    for size in (1, 30, 1024, 1 << 20):
        v = rng.integers(-size, size + 1, (200, 64))
        c = np.concatenate([v[:5], rng.integers(-size, size + 1, (5, 64)), v[:1]])
        exact = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (centroids.lower_bounds(centroids.segment_norms(v), centroids.segment_norms(c)) <= exact).all()
        at, d, _ = centroids.screened(v, centroids.segment_norms(v), c, centroids.segment_norms(c))
        assert (at == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    centres = rng.integers(-1000, 1000, (8, 64)) * (1 + np.arange(8))[:, None]
    v = np.repeat(centres, 50, axis=0) + rng.integers(-20, 20, (400, 64))
    at, _, measured = centroids.screened(v, centroids.segment_norms(v), centres, centroids.segment_norms(centres))
    assert (at == np.repeat(np.arange(8), 50)).all() and measured < 1.5 * len(v)  # of 8 * len(v)


def test_roots():
    x = np.concatenate([np.arange(2000), (np.arange(1, 2000, dtype=np.int64) * 1_000_003) ** 2, (np.arange(1, 2000, dtype=np.int64) * 1_000_003) ** 2 - 1])
    assert centroids.roots(x).tolist() == [math.isqrt(i) for i in x.tolist()]


def test_slot_sums():
    rng = np.random.default_rng(7)
    v, slot = rng.integers(-50, 50, (300, 4)), rng.integers(0, 9, 300)
    got = int_vectors.SlotSums(12, 4)
    for i in range(0, 300, 77):
        got.add(slot[i : i + 77], v[i : i + 77])
    rows = got.batch().to_pylist()
    assert [r["slot"] for r in rows] == sorted(set(slot.tolist()))
    assert all(r["n"] == (slot == r["slot"]).sum() and [int(x) for x in r["sums"]] == v[slot == r["slot"]].sum(axis=0).tolist() for r in rows)
