"""Removal of repeated passages by level-wise doubling.

A window of ``length`` words can only occur twice if its shorter windows do.  Levels
double in length (9, 18, 35 for 35 words).  At each level but the last, a text window
stands for itself by its minimizer, the smallest hash among its sub-windows of the
level's length; two equal windows have the same minimizer, so only minimizers have to be
counted, about one position in fourteen at the first level.  Those that occur twice set
bits in a sieve (broadcast, of ``SIEVE_BITS`` to ``MOST_BITS`` by the bytes of text); windows that
fall through are not extended to the next level.  A sieve only ever lets too much through:
what decides is the last level, where whole windows are compared by 96 bits of two hashes.

Each map task hands over arrays of hashes by bucket, not a row a window.  A hash that is
met twice in one task is settled there and sent on once, so a passage that a third of
all texts share, or a text with countless copies, adds one entry a task to a bucket.  The
sieves count a text that a task meets again twice, so they do not depend on how rows are
dealt to tasks, which may change between the passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import neutral, written
from .textcore import Block, Ranges, blocks, mix

SIEVE_BITS = 27
MOST_BITS = 30
BUCKET_BYTES = 32 << 20
SALT = np.uint64(0xC2B2AE3D27D4EB4F)
FLUSH = 1 << 21
NONE = np.uint32(0xFFFFFFFF)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def levels(length: int, first: int = 9) -> list[int]:
    """Window lengths from about ``first`` to ``length``, each at most twice the one before."""
    out = [length]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def runs_of(labels: np.ndarray):
    """(label, start, stop) of each run of equal entries; labels are not negative."""
    edges = np.flatnonzero(np.diff(labels, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(labels)), strict=False):
        yield labels[a], a, b


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """out[i] = op over a[i : i + width], by doubling (cut off at the end)."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        if step >= len(a):
            break
        out = np.concatenate([op(out[:-step], out[step:]), out[-step:]])
        have += step
    return out


def _hashes(block: Block, ranges, room: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(room), TOP)
    at = np.flatnonzero(room >= k)
    out[at] = np.minimum(np.maximum(ranges.hash(at, at + k), np.uint64(1)), TOP - np.uint64(1))
    return out


def _survivors(block: Block, sizes: list[int], sieves: list[np.ndarray], bits: int):
    """Window starts that pass the sieves, the hashes of the next level, their window minima and those of the first level."""
    room = block.room()
    ranges = Ranges(mix(block.hashes))
    length = sizes[-1]
    alive = room >= length
    mask = np.uint64((1 << bits) - 1)
    first = None
    for k, sieve in zip(sizes, [*sieves, None], strict=False):
        hashes = _hashes(block, ranges, room, k)
        low = slide(hashes, length - k + 1, np.minimum)
        first = low if first is None else first
        if sieve is None:
            return alive, hashes, low, first
        at = low & mask
        alive &= (sieve[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    raise AssertionError


def _second(block: Block, at: np.ndarray, k: int) -> np.ndarray:
    """32 more bits for the windows of k words that start at ``at``, independent of the first hash."""
    return (Ranges(mix(block.hashes ^ SALT)).hash(at, at + k) >> np.uint64(32)).astype(np.uint32)


def _same(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by both hashes, the first place of each value in it, and how often it occurs."""
    order = np.lexsort((more, hashes))
    h, m = hashes[order], more[order]
    firsts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1]))) if len(h) else np.zeros(0, np.int64)
    return order, firsts, np.diff(np.append(firsts, len(h)))


def _cut(keys: np.ndarray, n_buckets: int, bits: int) -> np.ndarray:
    """The bucket of each hash: buckets are ranges of the sieve's bits."""
    low = keys & np.uint64((1 << bits) - 1)
    return ((low * np.uint64(n_buckets)) >> np.uint64(bits)).astype(np.int64)


def _first_copies(batches, seen: dict):
    """(column of texts met for the first time, their keys, keys of texts met again)."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        fresh, again = [], []
        for i, key in enumerate(keys):
            n = seen.get(key, 0)
            if n == 0:
                fresh.append(i)
            elif n == 1:
                again.append(i)
            seen[key] = n + 1
        idx = pa.array(fresh, pa.int32())
        yield batch.column(1).take(idx), [keys[i] for i in fresh], again, batch


def _sieve(texts: DataFrame, sizes: list[int], sieves: list, bits: int, n_buckets: int) -> np.ndarray:
    """Bits of the window minima of level ``len(sieves)`` that occur at two places or more."""
    shared = [texts.sparkSession.sparkContext.broadcast(s) for s in sieves]

    def emit(batches):
        known = [s.value for s in shared]
        held, size, seen = [], 0, {}

        def flush():
            if not held:
                return None
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values = np.repeat(values, np.minimum(counts, 2))
            bucket = _cut(values, n_buckets, bits)
            order = np.argsort(bucket, kind="stable")
            values, bucket = values[order], bucket[order]
            cuts = list(runs_of(bucket))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(k) for k, _, _ in cuts], pa.int32()),
                    pa.array([values[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                ],
                ["bucket", "hashes"],
            )

        for column, _, again, batch in _first_copies(batches, seen):
            # A text met again counts twice: the next pass over the texts may deal its copies to two tasks.
            for part in (column, batch.column(1).take(pa.array(again, pa.int32()))):
                for block in blocks(part):
                    alive, hashes, low, _ = _survivors(block, sizes, known, bits)
                    wanted = np.where(alive, low, np.uint64(0))
                    back = slide(wanted[::-1], sizes[-1] - sizes[len(known)] + 1, np.maximum)[::-1]
                    # A position is some living window's minimizer if it equals a minimum that lies over it.
                    values = hashes[(back == hashes) & (back > 0)]
                    if len(values):
                        held.append(values)
                        size += len(values)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        out = flush()
        if out is not None:
            yield out

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        values = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]))
        twice = values[1:][values[1:] == values[:-1]]
        at = np.unique(twice & np.uint64((1 << bits) - 1)).astype(np.int64)
        start, stop = _span(bucket, n_buckets, bits)
        field = np.zeros(stop - start, np.uint8)
        field[at - start] = 1
        packed = np.packbits(field, bitorder="little")
        return pa.table({"start": pa.array([start], pa.int64()), "bits": pa.array([packed.tobytes()], pa.binary())})

    counted = texts.mapInArrow(emit, "bucket int, hashes binary").groupBy("bucket").applyInArrow(count, "start long, bits binary")
    rows = written(counted, "substring-sieve")  # all buckets at once; what is read below is 2**bits bits
    field = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        bits_in = np.unpackbits(part, bitorder="little")
        at = np.flatnonzero(bits_in) + row["start"]
        np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return field


def _span(bucket: int, n_buckets: int, bits: int) -> tuple[int, int]:
    edge = lambda b: -(-(b << bits) // n_buckets)
    return edge(bucket), edge(bucket + 1)


def _intervals(at: np.ndarray) -> np.ndarray:
    """Sorted starts as (first, length) pairs of runs."""
    edges = np.flatnonzero(np.diff(at, prepend=-9) != 1)
    return np.stack([at[edges], np.diff(np.append(edges, len(at)))], axis=1).astype(np.uint32)


def _repeats(texts: DataFrame, sizes: list[int], sieves: list, bits: int, n_buckets: int) -> DataFrame:
    """key, runs: for each text, (start, length) pairs of runs of repeated windows, in parts."""
    shared = [texts.sparkSession.sparkContext.broadcast(s) for s in sieves]
    length = sizes[-1]

    def emit(batches):
        known = [s.value for s in shared]
        seen: dict = {}
        state = {"n": 0}
        keys: list[bytes] = []
        starts: list[int] = []
        parts: list[tuple] = []

        def flush(direct):
            rows = {"bucket": [], "kind": [], "keys": [], "head": [], "hashes": [], "more": [], "at": []}
            if parts:
                hashes, more, at, minima = (np.concatenate([p[k] for p in parts]) for k in range(4))
                order, firsts, counts = _same(hashes, more)
                hashes, more, at, minima = hashes[order], more[order], at[order], minima[order]
                many = np.repeat(counts > 1, counts)
                begin = np.array(starts, np.int64)
                settled = np.sort(at[many])
                for i, local in _by_text(settled, begin):
                    direct.append((keys[i], _intervals(local)))
                ask = firsts
                pos = np.where(counts > 1, np.int64(-1), at[ask])
                hashes, more, minima = hashes[ask], more[ask], minima[ask]
                bucket = _cut(minima, n_buckets, bits)
                order = np.lexsort((pos, bucket))
                hashes, more, pos, bucket = hashes[order], more[order], pos[order], bucket[order]
                for number, a, b in runs_of(bucket):
                    p = pos[a:b]
                    owner = np.searchsorted(begin, p, side="right") - 1
                    used = np.unique(owner[p >= 0])
                    rows["bucket"].append(int(number))
                    rows["kind"].append(0)
                    rows["keys"].append(b"".join(keys[i] for i in used))
                    rows["head"].append(begin[used].astype(np.uint32).tobytes())
                    rows["hashes"].append(hashes[a:b].tobytes())
                    rows["more"].append(more[a:b].tobytes())
                    rows["at"].append(np.where(p >= 0, p, int(NONE)).astype(np.uint32).tobytes())
            for key, runs in direct:
                rows["bucket"].append(int.from_bytes(key[:4], "big") % n_buckets)
                rows["kind"].append(1)
                rows["keys"].append(key)
                rows["head"].append(b"")
                rows["hashes"].append(b"")
                rows["more"].append(b"")
                rows["at"].append(runs.tobytes())
            keys.clear()
            starts.clear()
            parts.clear()
            state["n"] = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["bucket"], pa.int32()), pa.array(rows["kind"], pa.int32())]
                + [pa.array(rows[c], pa.binary()) for c in ("keys", "head", "hashes", "more", "at")],
                list(rows),
            )

        direct: list[tuple] = []
        size = 0
        for column, names, again, batch in _first_copies(batches, seen):
            if again:
                for block in blocks(batch.column(1).take(pa.array(again, pa.int32()))):
                    for i, n in enumerate(np.diff(block.bounds)):
                        if n >= length:
                            direct.append(
                                (batch.column(0)[again[block.first + i]].as_py(), np.array([[0, n - length + 1]], np.uint32))
                            )
            for block in blocks(column):
                alive, hashes, _, first = _survivors(block, sizes, known, bits)
                at = np.flatnonzero(alive)
                if not len(at):
                    continue
                # Positions are those of the words in this flush; texts without a living window take no room.
                owner = np.searchsorted(block.bounds, at, side="right") - 1
                more = _second(block, at, length)
                for i in np.unique(owner):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    keys.append(names[block.first + i])
                    starts.append(state["n"])
                    parts.append((hashes[at[a:b]], more[a:b], at[a:b] - block.bounds[i] + state["n"], first[at[a:b]]))
                    state["n"] += int(block.bounds[i + 1] - block.bounds[i])
                size += len(at)
                if size >= FLUSH or state["n"] >= 1 << 30:
                    yield flush(direct)
                    direct, size = [], 0
        yield flush(direct)

    def settle(group: pa.Table) -> pa.Table:
        keys, at_key, at_pos, hashes, more, marked = [], [], [], [], [], []
        settled: dict[tuple, None] = {}
        base = 0
        for row in group.to_pylist():
            if row["kind"]:
                settled[row["keys"], row["at"]] = None
                continue
            h, pos = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["at"], np.uint32)
            head = np.frombuffer(row["head"], np.uint32)
            own = np.frombuffer(row["keys"], "V16")
            known = pos != NONE
            text = np.searchsorted(head, pos, side="right") - 1 if len(head) else np.zeros(len(pos), np.int64)
            text[~known] = -1
            keys.append(own)
            at_key.append(np.where(known, text + base, -1))
            at_pos.append(np.where(known, pos - (head[text] if len(head) else 0), 0).astype(np.uint32))
            hashes.append(h)
            more.append(np.frombuffer(row["more"], np.uint32))
            marked.append(~known)
            base += len(own)
        out_keys, out_runs = [k for k, _ in settled], [r for _, r in settled]
        if hashes:
            h, k, p, m = (np.concatenate(x) for x in (hashes, at_key, at_pos, marked))
            order, firsts, counts = _same(h, np.concatenate(more))
            k, p, m = k[order], p[order], m[order]
            twice = (counts > 1) | (np.maximum.reduceat(m, firsts) if len(firsts) else np.zeros(0, bool))
            flag = np.repeat(twice, counts) & (k >= 0)
            names, index = np.unique(np.concatenate(keys), return_inverse=True) if base else (np.zeros(0, "V16"), np.zeros(0, np.int64))
            pairs = np.unique((index[k[flag]].astype(np.uint64) << np.uint64(32)) | p[flag].astype(np.uint64))
            owner, pos = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for i, a, b in runs_of(owner):
                out_keys.append(names[i].tobytes())
                out_runs.append(_intervals(pos[a:b]).tobytes())
        return pa.table({"key": pa.array(out_keys, pa.binary()), "runs": pa.array(out_runs, pa.binary())})

    asked = texts.mapInArrow(emit, "bucket int, kind int, keys binary, head binary, hashes binary, more binary, at binary")
    return asked.groupBy("bucket").applyInArrow(settle, "key binary, runs binary")


def _by_text(at: np.ndarray, begin: np.ndarray):
    """(text, local positions) for sorted positions of a flush."""
    for i, a, b in runs_of(np.searchsorted(begin, at, side="right") - 1):
        yield i, at[a:b] - begin[i]


def remove_repeats(
    docs: DataFrame, *, length: int = 35, text_col: str = "text", first: int = 9, bits: int | None = None, drop_text: bool = False
) -> DataFrame:
    """The columns of ``docs`` (without the text if ``drop_text``) and n_words, n_removed, kept.

    A column that has the name of a result gives way to it.

    A word goes if a window of ``length`` words over it starts anywhere else too, in
    another row or the same; ``kept`` has the other words, joined by single spaces.  Null
    and empty texts have no words.  Two rows with the same text repeat each other.
    """
    spark = docs.sparkSession
    sizes = levels(length, first)
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept") and not (drop_text and c == text_col)]
    docs, named = neutral(docs)
    text_col = named[text_col]
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    texts = keyed.select("__key", F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    volume = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES + 1)
    # About four bits of the first sieve for each of its minimizers (one in some 80 bytes).
    bits = min(MOST_BITS, max(SIEVE_BITS, (volume // 20).bit_length())) if bits is None else bits
    sieves: list[np.ndarray] = []
    for _ in sizes[:-1]:
        sieves.append(_sieve(texts, sizes, sieves, bits, n_buckets))
    runs = written(_repeats(texts, sizes, sieves, bits, n_buckets), "substring-runs")
    runs = runs.groupBy(F.col("key").alias("__key")).agg(F.collect_list("runs").alias("__runs"))
    columns = [named[c] for c in own]
    schema = docs.select(*columns).schema

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            for text, parts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if parts.is_valid:
                    spans = np.concatenate([np.frombuffer(x.as_py(), np.uint32).reshape(-1, 2) for x in parts.values]).astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans[:, 0], 1)
                    np.add.at(edge, np.minimum(spans.sum(axis=1) + length - 1, len(words)), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*batch.schema.names[:-2], "n_words", "n_removed", "kept"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    joined = keyed.join(runs, "__key", "left").select(*columns, F.col(text_col).alias("__text"), "__runs")
    return joined.mapInArrow(cut, f"{ddl}, n_words long, n_removed long, kept string").toDF(*own, "n_words", "n_removed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), i AS (
  SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d
), h AS (
  SELECT r, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM i
), x AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), c AS (
  SELECT r, list(DISTINCT s + o) AS gone FROM x, range(0, 35) AS t(o) GROUP BY r
), k AS (
  SELECT d.doc_id, d.r, len(d.w) AS n_words, coalesce(len(c.gone), 0) AS n_removed, d.w,
         list_sort(coalesce(c.gone, [])) AS gone FROM d LEFT JOIN c USING (r)
), u AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), g AS (
  SELECT r, s + o AS p FROM x, range(0, 35) AS t(o) GROUP BY ALL
), t AS (
  SELECT u.r, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN g ON u.r = g.r AND u.p = g.p WHERE g.r IS NULL GROUP BY u.r
)
SELECT k.doc_id, CAST(k.n_words AS BIGINT) AS n_words, CAST(k.n_removed AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM k LEFT JOIN t USING (r)
"""
