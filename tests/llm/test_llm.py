"""The ten operators and the pipeline against brute force on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import licenses, mixing, ngram_join, packing, pii, quality, queries, sharding, substring_dedup, topk, warc
from panelweave.llm.components import connected as components_of
from panelweave.llm.textcore import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words string, size double"
R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefgéß") for _ in range(R.randint(1, 7))) for _ in range(120)]


def words(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def texts():
    base = [words(R.randint(12, 120)) for _ in range(25)]
    passage = words(60)
    out = [None, "", " \n\t ", "one two three", "One two\tTHREE", "word", words(4000), base[0] + "\n" + base[0]]
    out += base + base[:5] + [base[0].upper()] * 3
    for b in base[:8]:  # near copies, one word changed in each
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[R.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    out += [words(20) + "\n" + passage + " " + words(15) for _ in range(6)]
    out += ["Mail a.b@mail.example.com or +1 (523) 555-1055, host 10.0.0.255, card 4111 1111 1111 1111. " + words(20), "x" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, R.choice(["en", "fr", None]), R.choice(["a", "b", "c", None]), len(t or ""), "clash", 1.0) for i, t in enumerate(texts())]
    rows.append(rows[10])  # a repeated row
    rows.append((None, rows[11][1], None, None, 3, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_sharding(spark, docs, empty):
    got = sharding.shard_documents(docs, n_shards=4).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    by_crc = collections.defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        by_crc[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert all(len(s) == 1 for s in by_crc.values())
    want = collections.Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in plain(docs))
    assert collections.Counter((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_equals_brute_force(seed):
    rng = random.Random(seed)
    classes = sorted(((s, rng.randint(1, 6)) for s in rng.sample(range(1, 60), 12)), reverse=True)
    capacity = 64
    packed = sharding.best_fit_decreasing(classes, capacity)
    bins, places = [], []
    for s, n in classes:
        for _ in range(n):
            fit = min(((left, i) for i, left in enumerate(bins) if left >= s), default=None)
            if fit is None:
                bins.append(capacity)
                fit = (capacity, len(bins) - 1)
            bins[fit[1]] -= s
            places.append(fit[1])
    starts = [*packed.starts, len(places)]
    mine = []
    for a, b, bin_, step in zip(starts, starts[1:], packed.bins, packed.step, strict=False):
        mine += [bin_ + (k // step if step else 0) for k in range(b - a)]
    assert mine == places and packed.n_bins == len(bins)


def test_shares_are_even():
    classes = sorted(collections.Counter(R.randint(1, 4000) for _ in range(5000)).items(), reverse=True)
    packed = sharding.smallest_capacity(classes, 16)
    assert packed.n_bins == 16
    loads, sizes = collections.Counter(), [s for s, n in classes for _ in range(n)]
    for a, b, bin_, step in zip(packed.starts, [*packed.starts[1:], len(sizes)], packed.bins, packed.step, strict=True):
        for k in range(a, b):
            loads[bin_ + ((k - a) // step if step else 0)] += sizes[k]
    even = sum(loads.values()) / 16
    assert len(loads) == 16 and all(0.99 * even <= x <= 1.01 * even for x in loads.values())


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    extra = docs.limit(0).unionByName(spark.createDataFrame([(900, "a <|endoftext|> b", None, None, 0, None, None)], SCHEMA))
    table = docs.unionByName(extra)
    got = packing.pack_documents(table, path, length=128, n_open=3, fan_in=2).collect()
    want = collections.Counter()
    for i, t in plain(table):
        want[i, tuple(own.encode(t, add_special_tokens=False).ids + [0])] += 1
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))] and sum(r["length"] for r in s) <= 128
    assert sum(sum(r["length"] for r in s) < 128 for s in by_sequence.values()) <= 1
    for (i, ids), n in want.items():
        mine = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        for r in mine:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert i is None or n > 1 or r["ids_crc32"] == zlib.crc32(piece.tobytes())
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("n", [9_999, 10_000, 1_000_000])
def test_ids_of_long_runs(n):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, mine = Tokenizer.from_file(path), packing.encoder(path)
    for text in (" " * (3 * n) + "x", "a\n" + "\n" * n, "\u3000" * n + "word", "b" * n):
        assert mine(text) == own.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_is_not_ranks_is_refused():
    import json

    with open(queries.tokenizer_path()) as f:
        spec = json.load(f)
    assert packing._as_ranks(spec)
    m = spec["model"]
    assert not packing._as_ranks({**spec, "model": {**m, "merges": [m["merges"][1], m["merges"][0], *m["merges"][2:]]}})
    assert not packing._as_ranks({**spec, "normalizer": {"type": "Lowercase"}})
    assert not packing._as_ranks({**spec, "pre_tokenizer": {"type": "Whitespace"}})


def test_packing_of_a_text_of_blanks(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000 + "x"), (2, "some words")], "doc_id long, text string")
    got = packing.pack_documents(df, queries.tokenizer_path()).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {1: 1_000_001, 2: 3}


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(9)
    odd = ["\u200b\u00ad\ufeff", "e\u0301 \u00e9", "\U0001f468\u200d\U0001f469\u200d\U0001f467 \U0001f1e9\U0001f1ea", "\x00\x1f\x7f\x85\xa0", "\u2028\u3000\u1680x", "\uff21\uff11 \u0661\u0662", "a" * 3000, " " * 500 + "\t\r\n" * 50, "it's IT'S we\u2019ll", "<|endoftext|>", "\ufffd\ufffe\U0010ffff"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(200)) for _ in range(40)]
    for t in odd:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, links=False):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    linked = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                linked[i] += 1
                linked[j] += 1
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d is None, d or 0), len(sets[i]), min(least[find(i)], default=-1), *[linked[i]] * links) for i, (d, _) in enumerate(rows))


def components(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(df).collect())


def test_ngram_join(spark, docs, empty):
    assert components(docs) == brute_components(plain(docs), links=True)
    assert components(empty) == []


@pytest.mark.parametrize("hot, block", [(1, 16), (30, 2048)])
def test_ngram_join_with_hot_shingles(spark, monkeypatch, hot, block):
    """Shared passages, chains of near copies and copies of all lengths, whatever counts as hot and however blocks are cut."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(hot)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (15, 40, 70)]
    made = []
    for _ in range(60):
        made.append([word() for _ in range(rng.randint(3, 60))] + rng.choice(shared) + [word() for _ in range(rng.randint(0, 30))])
        made.append(rng.choice(shared) + [word() for _ in range(rng.randint(0, 14))] + rng.choice(shared))
    for _ in range(12):
        now = list(rng.choice(made))
        for _ in range(12):
            now = list(now)
            for _ in range(rng.randint(1, 3)):
                now[rng.randrange(len(now))] = word()
            made.append(now)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    rows += [(1000 + i, rows[5][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert components(df) == brute_components(rows, links=True)
    least = {c for _, n, c in brute_components(rows) if n}
    kept = {r["doc_id"] for r in ngram_join.one_of_each(df).collect()}
    assert kept == least


def test_forest_of_links_equals_all_pairs(monkeypatch):
    rng = random.Random(4)
    for dense in (6, 256):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        for _ in range(40):
            bases = [rng.sample(range(1000), 40) for _ in range(rng.randint(1, 4))]
            sets = []
            for _ in range(rng.randint(1, 30)):
                base = rng.choice(bases)
                sets.append(np.unique(np.array(rng.sample(base, rng.randint(25, 40)) + [rng.randrange(2000) for _ in range(rng.randint(0, 9))], np.uint64)))
            parent = list(range(len(sets)))

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            links = list(ngram_join.reached(sets))
            assert len(links) <= 2 * len(sets)
            for p, q in links:
                both = len(np.intersect1d(sets[p], sets[q]))
                assert 100 * both >= 75 * (len(sets[p]) + len(sets[q]) - both)
                parent[find(p)] = find(q)
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        assert find(i) == find(j)


def test_pages_of_one_template_are_not_compared(spark):
    """Unlinked pages that share most of their words meet in no list, so work grows with their number."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    sizes = []
    for n in (500, 2000):
        pages = [template + [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(70, 80))] for _ in range(n)]
        sets = [s for b in blocks(pa.array([" ".join(p) for p in pages]), lower=True) for s in ngram_join.shingle_sets(b)]
        df = spark.createDataFrame([(" ".join(p),) for p in pages], "text string")
        table = ngram_join.rarity(df, 4)
        held = collections.Counter()
        for s in sets:
            for c in np.unique(ngram_join.codes(s, table)):
                held[int(c) | 1, int(c) & 1] += 1
        sizes.append(sum(h * (h - 1) // 2 + h * held[c, 1] for (c, light), h in held.items() if not light))
    assert sizes[1] <= 4 * sizes[0] + 2000


def test_intersections_by_products_and_by_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64)) for _ in range(n)] for n in (30, 21))
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    for dense, chunk in ((0, 7), (20, 64), (10**9, 64)):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        assert (ngram_join.common_counts(left, right) == want).all()


def test_one_of_each_with_odd_ids(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    near = [b.replace(f"{c}9 ", "x ") for b, c in zip(base, "abc", strict=True)]
    rows = [(None, base[0]), (None, near[0]), (3, base[1]), (None, near[1]), (4, base[2]), (4, near[1]), (4, base[2]), (None, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()]
    assert len(got) == 5 and {(3, base[1]), (4, base[2]), (None, None), (9, "")} < set(got) and (None in [d for d, t in got if t in (base[0], near[0])])


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    links += [(300 + rng.randrange(50), 300 + rng.randrange(50)) for _ in range(45)] + [(5, 5)]
    order = list(range(400))
    rng.shuffle(order)
    links = [(order[a], order[b]) for a, b in links]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    got = components_of(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {(r["node"], r["root"]) for r in got} == want


def test_sketch_bounds_difference():
    rng = np.random.default_rng(3)
    for n in (5, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 6 :], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        x, y = (np.frombuffer(ngram_join.sketch(s), np.uint64) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "intro " + mit.replace("deal in", "deal freely in").lower() + " é end"), (2, "x\nReleased under the MIT License.\ny"), (3, None), (4, "the license is not here"), (5, "")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1]["template"] == "MIT" and got[1]["coverage"] > 0.99 and got[2]["template"] == "MIT-statement"
    assert rows[1][1][got[2]["span_start"] : got[2]["span_end"]] == "Released under the MIT License"
    assert rows[0][1][got[1]["span_start"] :].startswith("permission is hereby") and rows[0][1][: got[1]["span_end"]].endswith("dealings in the software")
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0


def brute_licenses(text):
    """Best alignments over all words, each without the words of those before."""
    find = lambda x: [(m[0].lower(), *m.span()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", x)]
    own = find(text)
    codes = {w: i for i, w in enumerate(sorted({w for x in [*licenses.TEMPLATES.values(), text] for w, _, _ in find(x)}))}
    ids = np.array([codes[w] for w, _, _ in own])
    free, out = np.ones(len(own), bool), []
    while True:
        best = []
        for k, (name, template) in enumerate(licenses.TEMPLATES.items()):
            t = np.array([codes[w] for w, _, _ in find(template)])
            common = collections.Counter(t.tolist()) & collections.Counter(ids[free].tolist())
            if 5 * common.total() < 4 * len(t):  # too few of its words are there, in any order
                continue
            m, first, last = licenses.align(t, ids, [0], len(ids) + len(t), free, -(-len(t) * 4 // 5))[:, 0].tolist()
            if m:
                best.append((-m, -m / len(t), k, first, last, name))
        if not best:
            return sorted(out)
        m, _, _, first, last, name = min(best)
        free[first : last + 1] = False
        out.append((name, -m, own[first][1], own[last][2]))


def test_licenses_side_by_side(spark):
    mit, apache = (licenses.TEMPLATES[f"{x}-statement"] for x in ("MIT", "Apache-2.0"))
    isc = licenses.TEMPLATES["ISC"]
    texts = [f"{mit} {mit}", " ".join([mit] * 9), "\n".join([mit, apache] * 4), f"{mit} and {mit} so {apache} {mit}", f"{isc} {isc.replace('copy, ', '')} {mit} {mit} {isc}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(rows).collect():
        got[r["doc_id"]].append((r["template"], r["matched_words"], r["span_start"], r["span_end"]))
    assert [len(got[i]) for i in range(5)] == [2, 9, 8, 4, 5]
    assert [sorted(got[i]) for i in range(5)] == [brute_licenses(t) for t in texts]


def plain_align(template, words, least):
    """Cell by cell over all words: the best (score, matched, first, last)."""
    best = (0, 0, -1, -1)
    row = [(0, 0, 0)] * (len(words) + 1)
    for x in template:
        new = [(0, 0, 0)]
        for j, w in enumerate(words):
            options = [(0, 0, 0)]
            if w == x:
                s, m, f = row[j]
                options.append((s + 2, m + 1, f if s else j))
            elif row[j][0] > 1:
                options.append((row[j][0] - 1, *row[j][1:]))
            options += [(o[0] - 1, *o[1:]) for o in (row[j + 1], new[j]) if o[0] > 1]
            new.append(max(options))
            if w == x and new[-1][1] >= least and new[-1][0] > best[0]:
                best = (*new[-1], j)
        row = new
    return best[1:]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_cell_by_cell(seed):
    rng = random.Random(seed)
    t = [rng.randrange(12) for _ in range(rng.randint(3, 25))]
    w = [rng.randrange(12) for _ in range(10)] + [x for x in t if rng.random() < 0.9 for x in ([x] if rng.random() < 0.9 else [x, 3])] + [rng.randrange(12) for _ in range(10)]
    least = rng.randint(1, len(t) // 2)
    got = licenses.align(np.array(t), np.array(w), [0, 0], len(w) + len(t), None, least)
    assert got[:, 0].tolist() == got[:, 1].tolist() == list(plain_align(t, w, least))


def test_mutated_templates_are_found(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        for i in range(3):
            v = [rng.choice(VOCAB) if len(w) > 20 and rng.random() < 0.08 else x for x in w]
            v = [y for x in v for y in ([x, rng.choice(VOCAB)] if len(w) > 20 and rng.random() < 0.02 else [x])]
            rows.append((10 * k + i, words(rng.randint(0, 300)) + "\n" + " ".join(v) + "\n" + words(30)))
            want[10 * k + i] = name
    rows.append((999, words(20000) + " " + licenses.TEMPLATES["Zlib"] + " " + " ".join(["free of charge"] * 3000)))
    want[999] = "Zlib"
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        if r["matched_words"] > got.get(r["doc_id"], (0, ""))[0]:
            got[r["doc_id"]] = (r["matched_words"], r["template"])
    assert {d: t for d, (_, t) in got.items()} == want


def changed(text, rng, share=0.0, insert=0):
    """A license with a share of its words replaced and ``insert`` foreign words in its middle."""
    w = [rng.choice(VOCAB) if rng.random() < share else x for x in text.split()]
    half = len(w) // 2
    return " ".join(w[:half] + [rng.choice(VOCAB) for _ in range(insert)] + w[half:])


LONG = [n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 40]


def found_in(spark, rows):
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect():
        got[r["doc_id"]].add(r["template"])
    return got


def test_inserted_passages_are_bridged(spark):
    rng = random.Random(8)
    cases = [(name, n) for name in LONG for n in (10, 30, 100, 300) if n < 0.8 * len(licenses.TEMPLATES[name].split())]
    rows = [(i, words(40) + " " + changed(licenses.TEMPLATES[name], rng, insert=n) + " " + words(40)) for i, (name, n) in enumerate(cases)]
    got = found_in(spark, rows)
    missed = [c for i, c in enumerate(cases) if c[0] not in got[i]]
    assert not missed


def test_inserts_give_what_the_whole_alignment_gives(spark):
    rng = random.Random(9)
    names = ["MIT", "ISC", "BSD-2-Clause", "Zlib"]
    texts = [words(15) + " " + changed(licenses.TEMPLATES[n], rng, share, insert) + " " + words(15) for n in names for share, insert in ((0.0, 30), (0.05, 60), (0.0, 100), (0.1, 10))]
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect():
        got[r["doc_id"]].append((r["template"], r["matched_words"], r["span_start"], r["span_end"]))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == brute_licenses(t)


@pytest.mark.parametrize("share, least", [(0.08, 1.0), (0.12, 0.97), (0.16, 0.9)])
def test_recall_by_share_of_changed_words(spark, share, least):
    rng = random.Random(10)
    cases = [(name, k) for name in LONG for k in range(2)]
    rows = [(i, words(30) + " " + changed(licenses.TEMPLATES[name], rng, share) + " " + words(30)) for i, (name, _) in enumerate(cases)]
    got = found_in(spark, rows)
    assert sum(name in got[i] for i, (name, _) in enumerate(cases)) >= least * len(cases)


def brute_quality(t):
    w = WORD.findall(t)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(g)
    covered = {j for i, s in enumerate(g) if c[s] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, docs, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.quality_counts(docs).collect()
    want = collections.Counter((i, *brute_quality(t)) for i, t in plain(docs))
    assert collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_counts(empty).count() == 0


def test_each_fence_rejects_what_the_base_rules_pass(spark):
    nth = lambda i: "".join("bcdfghjklm"[int(x)] for x in f"{i:05d}")
    fresh = iter(nth(i) for i in range(10**5))
    some = lambda n: " ".join(next(fresh) for _ in range(n))
    clean = [some(100) for _ in range(200)]
    five, line = some(5), some(4)
    clean += [f"{five} {some(90)} {five}", "\n".join([line, some(4), some(4), line, some(4)])]
    nine, lines = some(9), [some(4) for _ in range(13)]
    planted = [
        some(99) + " " + "#" * 25,
        "\n".join(lines + lines[::-2]),
        f"{nine} {some(82)} {nine}",
        " ".join(next(fresh) * 2 for _ in range(100)),
    ]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + planted)]
    got = quality.quality_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(len(clean), len(rows)))


def test_quality_does_not_depend_on_partitions(spark, docs):
    a, b = (quality.quality_counts(d).select("doc_id", "kept") for d in (docs, docs.repartition(13)))
    assert not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def test_counts_over_block_borders():
    t = [x or "" for x in texts()]
    for target in (1, 100, 1 << 20):
        got = np.concatenate([np.stack(quality._block_counts(b), 1) for b in blocks(pa.array(t), target=target)])
        assert [(a, b, c, e, f) for a, b, c, _, e, f in got.tolist()] == [brute_quality(x) for x in t]


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(130)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (251, [0.5, 0.25]), (252, [0.1, 0.2])]
    rows += [(250, rows[3][1]), (250, rows[4][1]), (100, rows[5][1]), (None, [0.9] * 6), (7, [0.9] * 6), (300, [-0.5] * 6)]
    rows += [(1000 + i, [0.7] * 6) for i in range(40)]  # many copies of one vector, four of them queries or more
    df = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v string, g int, row int").repartition(3)
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.Counter()
    for n, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scores = sorted((-int(q @ x), j is None, j or 0) for m, (j, x) in enumerate(kept) if m != n and len(x) == len(q))[:5]
            want.update((i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(scores))
    for bits, volume in ((2, 1 << 24), (6, 200)):
        monkeypatch.setattr(topk, "QUERY_BYTES", volume)
        got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5, bits).collect()
        assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_scan_keeps_what_may_be_best():
    rng = np.random.default_rng(8)
    q, codes = rng.integers(-40, 40, (9, 5)).astype(float), rng.integers(0, 64, (700, 5)).astype(float)
    best = topk._Best(np.arange(9), q, 4)
    for i in range(0, 700, 90):
        best.see(np.arange(700)[i : i + 90], -100 + 7 * codes[i : i + 90], 7)
    exact = q @ (-100 + 7 * codes + rng.integers(0, 7, codes.shape)).T
    a, g, _ = best.left()
    for i in range(9):
        assert set(np.argsort(-exact[i], kind="stable")[:4]) <= set(g[a == i]) and (a == i).sum() < 300


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = len(WORD.findall(r["text"] or ""))
        assert r["mix_size"] == s and 0 <= r["mix_taken"] <= 2 * s
        size[r["source"]] += s
        taken[r["source"]] += r["mix_taken"]
        target[r["source"]] = r["mix_target"]
    assert all(taken[s] == int(target[s]) for s in size)
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, want = 1.5 * sum(size.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * size[s]}
        for s in full or open_:
            want[s] = 2 * size[s] if full else share * weight[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(target[s] - want[s]) < 1e-6 for s in size)
    assert mixing.mix_sources(empty).count() == 0
    again = {(r["doc_id"], r["mix_taken"]) for r in mixing.mix_sources(docs.repartition(9)).collect()}
    assert {(r["doc_id"], r["mix_taken"]) for r in got} == again


def test_mixing_cut_among_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 7 + [(2, "d e", "t")] * 5 + [(3, None, "u"), (4, "x " * 50, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
        target[r["source"]] = r["mix_target"]
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
    assert len(got) == len(rows) and all(taken[s] == int(target[s]) for s in size)


def test_warc(spark):
    tough = "<p>\r\n\r\n" * 40 + "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + "é\r" * 60
    rows = [(1, "http://a/ b\n", tough), (2, None, tough), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", tough), (7, "u", "z" * 5000), (0, "u", "y" * 100 + "\r\n"), (8, "u", "y" * 100 + "\r\n"), (7, "u", "z" * 5000)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=64).collect()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and i != first[h]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert max(r["chunks"] for r in got) == -(-5000 // 64)


def test_warc_of_empty_long_and_clashing(spark):
    schema = "page_id long, url string, html string, payload string, digest int, bytes string, record_type int, first_id long, again boolean"
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0
    long_ = "é" * (4 << 20)
    rows = [(i, "u", h, "x", 1, "y", 2, 7, True) for i, h in ((2, long_), (1, long_), (3, "z" * 99), (4, "z" * 99))]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r["payload_bytes"], r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: (8 << 20, "response", None), 2: (8 << 20, "revisit", 1), 3: (99, "response", None), 4: (99, "response", None)
    }
    assert got[1]["payload_digest"] == got[2]["payload_digest"] == hashlib.sha256(long_.encode()).hexdigest() and got[1]["chunks"] == (8 << 20) // warc.SEGMENT


def test_warc_reader_refuses_changes():
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc._chunks(iter([body])))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc._chunks(iter([body[:-9]])))


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def literal_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii._luhn(d), 8 <= len(d) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_pii(spark, docs, empty):
    fuzz = ["".join(R.choice("a1@.-+ ()9%25_é\n") for _ in range(R.randint(0, 40))) for _ in range(5000)]
    for t in fuzz + [x or "" for x in texts()]:
        assert pii.base_spans(t) == literal_spans(t)
    got = pii.with_spans(docs, ["doc_id", "source", "n_email"]).collect()
    assert len(got) == docs.count()
    for r in got:
        base, spans = r["base_spans"].split(","), set(r["spans"].split(","))
        assert set(base) <= spans
    hit = next(r for r in got if r["n_email"])
    assert (hit["n_email"], hit["n_ip"], hit["n_card"], hit["n_phone"]) == (1, 1, 1, 1)
    clean = pii.masked(docs)
    assert clean.columns == docs.columns and clean.filter("text LIKE '%<EMAIL>%<PHONE>%<IP>%<CARD>%'").count() == 1
    assert pii.with_spans(empty, ["doc_id"]).count() == 0


NAMED = [
    "mail jo{i}.x{i}@mail{i}.example.com now",
    "call +1 (5{i:02}) 555-10{i:02} or not",
    "host 10.{i}.7.{i} is up",
    "card {c} paid",
    "the {i} of them in 19{i:02} for 3.{i}",
]


def personal(i):
    card = f"4{i:03}{i * 37:06}{i * 11:05}"
    card += next(str(d) for d in range(10) if pii._luhn(card + str(d)))
    return " ".join(x.format(i=i, c=card) for x in NAMED)


@pytest.fixture(scope="module")
def field():
    graphs = [(g.x, g.y, g.chain, g.skip) for i in range(10, 60) for g in pii._graphs(i, personal(i))]
    return pii.learn(graphs)


def added(text, model):
    _, more = pii.find([text], model)
    return [(pii.KINDS[k], text[a:b]) for k, a, b in more[0]]


def test_field_finds_what_the_base_patterns_miss(field):
    hit = total = 0
    for i in range(60, 99):
        text = personal(i)
        other, moved = pii.broken(text, pii.base_spans(text), random.Random(i))
        base, more = pii.find([other], field)
        for k, a, b in moved:
            total += 1
            hit += any(kind == k and s < b and e > a for kind, s, e in [*base[0], *more[0]])
    assert total == 4 * 39 and hit >= 0.9 * total
    ordinary = pii.ordinary(random.Random(77))
    assert len(added(ordinary, field)) <= 4


def test_a_skip_link_alone_adds_a_span(field):
    assert added("ring 5235551055 now", field) == []
    linked = "ring +1 (523) 555-1055 at noon, or else " + "word " * 500 + "5235551055 now"
    assert added(linked, field) == [("phone", "5235551055")]
    cut = {**field, "skip": np.zeros_like(field["skip"])}
    assert added(linked, cut) == []
    many = "ring +1 (523) 555-1055 " + "word 5235551055 word " * 60
    assert added(many, field) == [("phone", "5235551055")] * 60


def test_propagation_with_a_cycle_is_near_the_exact_marginals():
    rng = np.random.default_rng(1)
    n, k = 4, len(pii.LABELS)
    unary = np.log(rng.dirichlet(np.ones(k), n))
    chain, skip = rng.normal(0, 0.4, (k, k)), rng.normal(0, 0.4, (k, k))
    skip = (skip + skip.T) / 2
    links = [([(0, 1), (1, 2), (2, 3)], chain), ([(0, 3), (0, 2)], skip)]
    full = np.zeros((k,) * n)
    for at in np.ndindex(*full.shape):
        full[at] = np.exp(sum(unary[i, at[i]] for i in range(n)) + sum(p[at[a], at[b]] for ends, p in links for a, b in ends))
    full /= full.sum()
    p = pii.marginals(unary, links)
    for i in range(n):
        exact = full.sum(axis=tuple(j for j in range(n) if j != i))
        assert np.abs(p[i] - exact).max() < 0.05 and p[i].argmax() == exact.argmax()


def test_a_document_settles_by_itself():
    """Marginals do not depend on which other documents are in the batch."""
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    chain, skip = rng.normal(0, 1.5, (k, k)), rng.normal(0, 1.5, (k, k))
    skip = (skip + skip.T) / 2
    alone, unary, doc, links = [], [], [], ([], [])
    for d in range(8):
        n = 1 + 3 * d
        u = np.log(rng.dirichlet(np.ones(k), n))
        own = [(i, i + 1) for i in range(n - 1)], [(0, i) for i in range(2, n, 2)]
        alone.append(pii.marginals(u, [(own[0], chain), (own[1], skip)]))
        for to, ends in zip(links, own, strict=True):
            to += [(a + len(doc), b + len(doc)) for a, b in ends]
        unary.append(u)
        doc += [d] * n
    together = pii.marginals(np.concatenate(unary), [(links[0], chain), (links[1], skip)], doc=doc)
    assert np.abs(together - np.concatenate(alone)).max() < 1e-12


@pytest.mark.parametrize("out", [(0, 1), (1, 2), (0, 2)])
def test_forms_left_out_of_training_are_found(monkeypatch, out):
    """A field that was trained without two forms of each kind finds those forms too.

    But for addresses with ``(at)`` and ``[at]`` when neither was in training: no other form has
    that feature, so its weight stays zero.
    """
    all_forms = pii.BREAKS
    monkeypatch.setattr(pii, "BREAKS", {k: [f for i, f in enumerate(fs) if i not in out] for k, fs in all_forms.items()})
    model = pii.learn([(g.x, g.y, g.chain, g.skip) for i in range(10, 60) for g in pii._graphs(i, personal(i))])
    monkeypatch.setattr(pii, "BREAKS", {k: [fs[i] for i in out] for k, fs in all_forms.items()})
    hit, total = collections.Counter(), collections.Counter()
    for i in range(60, 99):
        text = personal(i)
        other, moved = pii.broken(text, pii.base_spans(text), random.Random(i))
        base, more = pii.find([other], model)
        for k, a, b in moved:
            total[k] += 1
            hit[k] += any(kind == k and s < b and e > a for kind, s, e in [*base[0], *more[0]])
    assert all(n == 39 for n in total.values())
    for k in total:
        assert hit[k] >= (0 if (k, out) == (0, (1, 2)) else 20)


def test_skip_links_spread_labels():
    n = len(pii.LABELS)
    agree = np.where(np.eye(n) > 0, 2.0, -2.0)
    unary = np.log(np.array([[0.01, 0.01, 0.01, 0.01, 0.96], [0.45, 0.1, 0.1, 0.1, 0.25], [0.96, 0.01, 0.01, 0.01, 0.01]]))
    p = pii.marginals(unary, [([(0, 1)], agree)])
    assert p[1].argmax() == 4 and p[2].argmax() == 0
    chain = pii.marginals(unary, [([(0, 1), (1, 2)], agree)])
    full = np.zeros((n, n, n))
    for a in range(n):
        for b in range(n):
            for c in range(n):
                full[a, b, c] = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + agree[a, b] + agree[b, c])
    assert np.allclose(chain[1], full.sum(axis=(0, 2)) / full.sum(), atol=1e-3)


def brute_repeats(rows, k):
    split = [WORD.findall(t) for _, t in rows]
    count = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = collections.Counter()
    for (d, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out[d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("length", [35, 12])
def test_substring_dedup(spark, docs, empty, length):
    got = substring_dedup.remove_repeats(docs, length=length).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(plain(docs), length)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_sieve_does_not_depend_on_how_copies_are_dealt(spark):
    passage = words(60)
    rows = [(bytes([i]) * 16, t) for i, t in ((1, passage), (1, passage), (2, words(60)))]
    one, apart = (spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "__key binary, __text string") for n in (1, 3))
    sizes, sieves = substring_dedup.levels(35), []
    for _ in sizes[:-1]:
        sieves.append(substring_dedup._sieve(one, sizes, sieves, 16, 8))
    for dealt in (one, apart):
        runs = substring_dedup._repeats(dealt, sizes, sieves, 16, 8).collect()
        starts = {(bytes(r["key"])[0], int(a) + i) for r in runs for a, n in np.frombuffer(r["runs"], np.uint32).reshape(-1, 2) for i in range(n)}
        assert starts == {(1, i) for i in range(26)}


def test_pipeline_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    kinds = [n for n, _ in corpus_pipeline.STAGES]
    assert kinds == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "packing"]
    kept = corpus_pipeline.keep_quality(spark, table, str(tmp_path))
    one = corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path))
    left = plain(one)
    assert brute_components(left) == sorted(((d is None, d or 0), len(shingles(t)), -1 if d is None else d) for d, t in left)
    assert {c for _, _, c in brute_components(plain(kept))} == {-1 if d is None else d for d, _ in left}
    masked = corpus_pipeline.mask_personal_data(spark, one, str(tmp_path))
    assert masked.count() == one.count() and not any(pii.base_spans(t) for _, t in plain(masked))
    mixed = corpus_pipeline.mix_to_weights(spark, masked, str(tmp_path))
    assert mixed.columns == table.columns and {d for d, _ in plain(mixed)} <= {d for d, _ in left}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
