"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, each hashed to 64 bits.  Two sets A and B have
a Jaccard similarity of at least 3/4 just where seven times their symmetric difference is
at most |A| + |B|.

* A first pass counts in how many sets each shingle occurs and keeps the binary logarithm
  of the counts from ``HOT`` on in a table of ``SLOTS`` bytes, which every task gets.  Any
  table gives the same result: it only decides which shingles are *cold* and in which order
  (*rarity*: level, then hash) the others stand.
* Size bands grow by 4/3, so a partner lies in the same band or the next.  For each band
  the cold shingles are dealt to blocks by hash, some more blocks than the largest difference
  allows; a block's part of the sketch is the XOR of its shingles' codes.  By the
  pigeonhole principle two linked sets agree in at least ``spare + 1`` blocks, so in one
  that is not empty if either has at most ``spare`` empty ones.
* Sets with more empty blocks also send a prefix of their shingles by rarity, long enough
  that two linked sets share one.  Of the rarest shingle that they share, the shingles
  before it are in the difference: it cannot stand beyond a seventh of both sets.  A set
  beyond it is *light* there, and two light sets are not compared.  Pages that share a
  template and are not linked thus either meet in no list or are light in all of it.
* Block codes travel as arrays by bucket, six bytes a code, not a row each.  Equal sets
  are one node from the start: a map task sends a set once, and buckets merge the rest.
* A bucket returns the lists of nodes with a code in common.  The first node of each list is
  compared with the others by one-hot parity sketches, whose Hamming distance is at most
  the symmetric difference; lists that still hold several clusters are searched in full, in
  square blocks of ``BLOCK`` nodes, of which only pairs that join two clusters leave.
  Every link lies inside a cluster then.
* Clusters are verified with the exact sets, read again from the texts, in square blocks of
  ``BLOCK`` sets or ``SETS`` shingles a side.  A block counts all links of its sets and
  emits only a forest of them, so a group of near copies costs a few rows a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import neutral, only, written
from .components import connected
from .textcore import Block, Ranges, blocks, mix

K = 5
FLUSH = 1 << 19
NODES = 60_000
BLOCK = 2048
SETS = 1 << 19
BUCKET = 1 << 20
PRUNE_BITS = 24
SLOT_BITS = 24
HOT = 6
DENSE = 256
CHUNK = 2048
SALT = np.uint64(0xD6E8FEB86659FD93)


def bands(limit: int = 1 << 40) -> list[int]:
    """Lower bounds of the size bands."""
    out = [1]
    while out[-1] < limit:
        out.append(-(-out[-1] * 4 // 3))
    return out


BANDS = np.array(bands(), np.int64)


def scheme(band: int) -> tuple[int, int]:
    """(number of blocks, empty blocks that may be spared) of a band.

    A pair belongs to the band of its smaller set, of at most ``most`` shingles; the other
    has at most 4/3 as many.
    """
    most = int(BANDS[band + 1]) - 1
    differ = (most + most * 4 // 3) // 7
    spare = -(-differ // 5)
    return differ + 1 + spare, spare


def shingle_sets(block: Block):
    """The sorted distinct shingle hashes of each text of a block."""
    ranges = Ranges(mix(block.hashes))
    for i in range(block.n):
        a, b = int(block.bounds[i]), int(block.bounds[i + 1])
        if b - a >= K:
            at = np.arange(a, b - K + 1)
            yield np.unique(ranges.hash(at, at + K))
        elif b > a:
            yield ranges.hash(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def node_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set: two independent sums of mixed hashes."""
    pair = np.array([np.add.reduce(mix(s ^ SALT)), np.add.reduce(mix(s + SALT))], np.uint64)
    return pair.tobytes()


def sketch(s: np.ndarray, bits: int | None = None) -> bytes:
    """One-hot parity bits: by default two to four for each shingle, 64 at least."""
    bits = bits or max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity sketches (rows of words) of fewer bits: halves cancel by XOR."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def codes(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The codes by which a set looks for partners, in its own band and the one below; bit 0: the set is light there."""
    n = len(s)
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    level = table[_slot(s)]
    cold = s[level == 0]
    coded = mix(cold ^ SALT)
    out = []
    sparse = False
    for band in (own, own - 1):
        if band < 0:
            continue
        size, spare = scheme(band)
        place = ((cold >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(cold) else np.zeros(0, np.int64)
        if len(starts):
            part = np.bitwise_xor.reduceat(coded, starts)
            out.append(mix(part + place[starts] * SALT + np.uint64(band + 1)) & ~np.uint64(1))
        sparse |= size - len(starts) > spare
    if sparse:
        rare = s[np.argsort(level, kind="stable")[: n - -(-3 * n // 4) + 1]]
        light = 7 * np.arange(len(rare)) > n
        out.append(mix(rare * SALT) & ~np.uint64(1) | light.astype(np.uint64))
    return np.concatenate(out)


def _distinct_sets(batches, seen: set):
    """(node id, set) of the sets that are not empty, each once."""
    for batch in batches:
        for block in blocks(batch.column(0), lower=True):
            for s in shingle_sets(block):
                if len(s) and (name := node_id(s)) not in seen:
                    seen.add(name)
                    yield name, s


def _cuts(bucket: np.ndarray):
    """(bucket, start, stop) of each run of a sorted array."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[edges].tolist(), edges, np.append(edges[1:], len(bucket)), strict=True)


def _tally(n_buckets: int):
    """Counts of shingles, by bucket of slots: the first 32 bits of those met once, and of the others with their counts."""

    def flush(held):
        values, counts = np.unique((np.concatenate(held) >> np.uint64(32)).astype(np.uint32), return_counts=True)
        bucket = ((values >> np.uint32(32 - SLOT_BITS)).astype(np.int64) * n_buckets) >> SLOT_BITS
        rows: list[list] = [[], [], [], []]
        for number, a, b in _cuts(bucket):
            v, c = values[a:b], counts[a:b]
            for column, x in zip(rows, (number, v[c == 1].tobytes(), v[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], ["bucket", "once", "more", "counts"])

    def run(batches):
        held, size = [], 0
        for _, s in _distinct_sets(batches, set()):
            held.append(s)
            size += len(s)
            if size >= 4 * FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _hot(least: int):
    """The slots of shingles that occur 2**least times or more, and the levels of the most frequent in each."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda c: np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column(c)])
        once, more, counts = read("once"), read("more"), read("counts")
        values, index = np.unique(np.concatenate([once, more]), return_inverse=True)
        total = np.bincount(index, np.concatenate([np.ones(len(once)), counts]), len(values))
        level = np.frexp(total)[1] - 1
        hot = level >= least
        slots, level = values[hot] >> np.uint32(32 - SLOT_BITS), level[hot]
        order = np.lexsort((-level, slots))
        slots, first = np.unique(slots[order], return_index=True)
        return pa.table({"slots": pa.array([slots.tobytes()], pa.binary()), "levels": pa.array([level[order][first].astype(np.uint8).tobytes()], pa.binary())})

    return run


def rarity(texts: DataFrame, n_buckets: int) -> np.ndarray:
    """The table of levels: 0 for cold shingles.  Where an eighth of the slots would be hot, the lowest levels count as cold."""
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    counted = texts.select("text").mapInArrow(_tally(n_buckets), "bucket int, once binary, more binary, counts binary")
    hot = written(counted.groupBy("bucket").applyInArrow(_hot(HOT), "slots binary, levels binary"), "ngram-hot")  # all buckets at once
    for row in hot.toLocalIterator():  # 5 bytes a hot slot, 2**24 slots at most
        table[np.frombuffer(row["slots"], np.uint32)] = np.frombuffer(row["levels"], np.uint8)
    least = HOT
    while np.count_nonzero(table) > len(table) >> 3:
        least += 1
        table[table < least] = 0
    return table


def _emit(n_buckets: int, shared):
    def run(batches):
        table = shared.value
        names: list[bytes] = []
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush():
            values = np.concatenate(held)
            index = np.repeat(np.arange(len(names)), owner)
            bucket = (((values >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, index, bucket = values[order], index[order], bucket[order]
            cols: list[list] = [[], [], [], []]
            for number, a, b in _cuts(bucket):
                used, local = np.unique(index[a:b], return_inverse=True)
                cols[0].append(number)
                cols[1].append(b"".join(names[i][:8] for i in used))
                cols[2].append((values[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                cols[3].append(local.astype(np.uint16).tobytes())
            names.clear(), held.clear(), owner.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "nodes", "codes", "at"]
            )

        for name, s in _distinct_sets(batches, set()):
            names.append(name)
            held.append(codes(s, table))
            owner.append(len(held[-1]))
            size += owner[-1]
            if size >= FLUSH or len(names) >= NODES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _lists(group: pa.Table) -> pa.Table:
    """The distinct lists of two nodes or more with a code in common: the ``heavy`` ones (one at least) first.

    Here a node goes by the first 8 bytes of its id; nodes that share them are told apart
    when the lists meet the table of nodes.
    """
    names, values, index, base = [], [], [], 0
    for nodes, code, at in zip(group.column("nodes"), group.column("codes"), group.column("at"), strict=True):
        own = np.frombuffer(nodes.as_py(), np.int64)
        names.append(own)
        values.append(np.frombuffer(code.as_py(), np.uint32))
        index.append(np.frombuffer(at.as_py(), np.uint16).astype(np.int64) + base)
        base += len(own)
    names, inverse = np.unique(np.concatenate(names), return_inverse=True)
    pairs = np.unique((np.concatenate(values).astype(np.uint64) << np.uint64(32)) | inverse[np.concatenate(index)].astype(np.uint64))
    value, node = pairs >> np.uint64(33), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    light = (pairs >> np.uint64(32)) & np.uint64(1) == 1
    firsts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    sizes = np.diff(np.append(firsts, len(value)))
    heavy = np.add.reduceat(~light, firsts, dtype=np.int64)
    two = firsts[(sizes == 2) & (heavy > 0)]
    out = set()
    if len(two):
        couples = np.unique(np.sort(np.stack([node[two], node[two + 1]], axis=1), axis=1), axis=0)
        out.update((2, names[a].tobytes() + names[b].tobytes()) for a, b in couples)
    more = (sizes > 2) & (heavy > 0)
    for a, n, h in zip(firsts[more], sizes[more], heavy[more], strict=True):
        out.add((int(h), names[node[a : a + n]].tobytes()))
    found = sorted(out)
    return pa.table({"list": pa.array([x for _, x in found], pa.binary()), "heavy": pa.array([h for h, _ in found], pa.int32())})


def _stars(batches):
    for batch in batches:
        a, b = [], []
        for x in batch.column(0):
            keys = np.frombuffer(x.as_py(), np.int64)
            a += [keys[0]] * (len(keys) - 1)
            b += keys[1:].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["ka", "kb"])


def _members(batches):
    for batch in batches:
        gid, key, light = [], [], []
        for name, raw, heavy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.frombuffer(raw, np.int64).tolist()
            gid += [name] * len(keys)
            key += keys
            light += [False] * heavy + [True] * (len(keys) - heavy)
        yield pa.RecordBatch.from_arrays([pa.array(gid, pa.binary()), pa.array(key, pa.int64()), pa.array(light, pa.bool_())], ["gid", "key", "light"])


def _possible(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= (na + nb) // 7


def _sieve(batches):
    for batch in batches:
        keep = [_possible(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


class _Side:
    """Nodes of a square block, their sketches by length."""

    def __init__(self, rows: list[dict], root: np.ndarray) -> None:
        self.sizes = np.array([r["n"] for r in rows])
        self.light = np.array([r["light"] for r in rows])
        self.root = root
        self.length = np.array([len(r["sketch"]) // 8 for r in rows])
        self.at = {int(k): np.flatnonzero(self.length == k) for k in np.unique(self.length)}
        self.bits = {k: np.stack([np.frombuffer(rows[i]["sketch"], np.uint64) for i in at]) for k, at in self.at.items()}
        self.half = {k: fold(b, k // 2) for k, b in self.bits.items() if k > 1}
        self.place = np.zeros(len(rows), np.int64)
        for at in self.at.values():
            self.place[at] = np.arange(len(at))

    def near(self, i: int, start: int):
        """Rows from ``start`` on that may be linked with row i and lie in another cluster, the nearest of each cluster, nearest first."""
        k, p = int(self.length[i]), int(self.place[i])
        own, found, apart = self.bits[k][p], [], []
        for other, mine in ((k, own), (2 * k, own), (k // 2, self.half[k][p] if k > 1 else None)):
            if other not in self.at or mine is None:
                continue
            at = self.at[other]
            skip = int(np.searchsorted(at, start))
            j = at[skip:]
            small, large = np.minimum(self.sizes[j], self.sizes[i]), np.maximum(self.sizes[j], self.sizes[i])
            fit = np.flatnonzero((4 * small >= 3 * large) & (self.root[j] != self.root[i]) & ~(self.light[j] & self.light[i]))
            theirs = (self.half if other > k else self.bits)[other][skip + fit]
            distance = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
            close = distance <= (self.sizes[j[fit]] + self.sizes[i]) // 7
            found.append(j[fit][close])
            apart.append(distance[close])
        j = np.concatenate(found)[np.argsort(np.concatenate(apart), kind="stable")]
        return j[np.sort(np.unique(self.root[j], return_index=True)[1])]


def _search(batches):
    """A forest of possible pairs over the clusters in the square blocks of a group."""
    for batch in batches:
        out: list[list] = [[], []]
        for at in range(batch.num_rows):
            left, right = (batch.column(i)[at].as_py() for i in (1, 2))
            rows = left + (right or [])
            root = np.unique([r["root"] for r in rows], return_inverse=True)[1]
            side = _Side(rows, root)
            for i in range(len(left) if right else len(rows)):
                j = side.near(i, len(left) if right else i + 1)
                if not len(j):
                    continue
                merged = np.append(root[j], root[i])
                root[np.isin(root, merged)] = merged.min()
                for k in j:
                    out[0].append(rows[i]["node"])
                    out[1].append(rows[k]["node"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of a left and a right set.

    Shingles that few sets share are paired off; for the others rows of ones are multiplied.
    """
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (left, right))
    shared = np.intersect1d(x, y)
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return total

    def coded(values, owner):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        known = shared[at] == values
        at, owner = at[known], owner[known]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (cx, i), (cy, j) = coded(x, i), coded(y, j)
    fx, fy = np.bincount(cx, minlength=len(shared)), np.bincount(cy, minlength=len(shared))
    dense = fx * fy > DENSE
    few = ~dense[cy]
    if few.any():
        each = fx[cy[few]]
        starts = (np.cumsum(fx) - fx)[cy[few]]
        at = np.arange(each.sum()) + np.repeat(starts - (np.cumsum(each) - each), each)
        total += np.bincount(i[at] * len(right) + np.repeat(j[few], each), minlength=total.size).reshape(total.shape)
    column = np.cumsum(dense) - 1
    (cx, i), (cy, j) = ((column[c[dense[c]]], o[dense[c]]) for c, o in ((cx, i), (cy, j)))
    for low in range(0, int(dense.sum()), CHUNK):
        parts = []
        for c, o, rows in ((cx, i, len(left)), (cy, j, len(right))):
            a, b = np.searchsorted(c, [low, low + CHUNK])
            ones = np.zeros((rows, CHUNK), np.float32)
            ones[o[a:b], c[a:b] - low] = 1
            parts.append(ones)
        total += parts[0] @ parts[1].T
    return total


def forest(linked: np.ndarray):
    """(row, column) pairs of a spanning forest of the bipartite graph ``linked``."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        now = np.array([int(rows.argmax())])
        rows[now] = False
        while len(now):
            reach = linked[now] & columns
            new = np.flatnonzero(reach.any(axis=0))
            yield from zip(now[reach[:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            columns[new] = False
            reach = linked[:, new] & rows[:, None]
            now = np.flatnonzero(reach.any(axis=1))
            yield from zip(now.tolist(), new[reach[now].argmax(axis=1)].tolist() if len(now) else [], strict=True)
            rows[now] = False


def _exact(batches):
    """For the square blocks of clusters: a, b of a forest of links, and (b null) how many documents each node is linked with."""
    for batch in batches:
        a, b, links = [], [], []
        for at in range(batch.num_rows):
            left, right = (batch.column(i)[at].as_py() for i in (1, 2))
            x = [np.frombuffer(r["set"], np.uint64) for r in left]
            y = [np.frombuffer(r["set"], np.uint64) for r in right] if right else x
            linked = _linked(x, y)
            other = right or left
            for p, q in forest(linked):
                if left[p]["node"] != other[q]["node"]:
                    a.append(left[p]["node"]), b.append(other[q]["node"]), links.append(None)
            if not right:
                np.fill_diagonal(linked, False)
            sides = [(left, linked @ np.array([r["copies"] for r in other]))]
            if right:
                sides.append((right, np.array([r["copies"] for r in left]) @ linked))
            for nodes, counts in sides:
                a += [r["node"] for r in nodes]
                b += [None] * len(nodes)
                links += counts.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = common_counts(left, right).astype(np.int64)
    return 100 * both >= 75 * (n[:, None] + m[None, :] - both)


def reached(sets: list[np.ndarray]):
    """(i, j) links, at most two a set, that connect all that the links among ``sets`` connect.

    What the first one reaches is settled by comparing each newly reached set with those not
    reached yet, so a tight group costs a comparison a member; the rest is compared whole.
    """
    front, rest = np.array([0]), np.arange(1, len(sets))
    while len(front) and len(rest):
        linked = _linked([sets[i] for i in front], [sets[i] for i in rest])
        hit = linked.any(axis=0)
        yield from zip(front[linked[:, hit].argmax(axis=0)].tolist(), rest[hit].tolist(), strict=True)
        front, rest = rest[hit], rest[~hit]
    if len(rest):
        own = [sets[i] for i in rest]
        for p, q in forest(_linked(own, own)):
            if p != q:
                yield int(rest[p]), int(rest[q])


def _reached(batches):
    """For the blocks of clusters with themselves: a, b of links that connect what is linked there."""
    for batch in batches:
        a, b = [], []
        for at in range(batch.num_rows):
            side = batch.column(1)[at].as_py()
            for p, q in reached([np.frombuffer(r["set"], np.uint64) for r in side]):
                a.append(side[p]["node"]), b.append(side[q]["node"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _exact_forest(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b of exact links that connect all that is linked inside ``clusters`` (gid, node, n, rep).

    Each node is sent once, to the block of its part of the cluster.  Clusters of several
    parts then compare one node of each component found so far, and only those that this
    does not join are compared in all their square blocks.
    """

    def edges(members: DataFrame, tag: str, across: bool) -> DataFrame:
        held = _read_sets(texts, members).withColumn("copies", F.lit(1).cast("long"))
        squares = _squares(members.select("gid", "node", "n"), held, ["node", "copies", "set"], across)
        if across:
            found = squares.mapInArrow(_exact, "a binary, b binary, links long").filter("b IS NOT NULL").select("a", "b")
        else:
            found = squares.mapInArrow(_reached, "a binary, b binary")
        return written(found, tag, 16)

    size = clusters.groupBy("gid").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("volume"))
    large = clusters.join(size.filter((F.col("many") > BLOCK) | (F.col("volume") > SETS)).select("gid"), "gid")

    def apart(links: DataFrame) -> DataFrame:
        own = large.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = own.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("gid")
        return written(own.join(several, "gid"), "ngram-apart")

    found = edges(clusters, "ngram-within", False)
    if large.isEmpty():
        return found
    left = apart(found)
    if left.isEmpty():
        return found
    heads = left.groupBy("gid", "root").agg(F.min_by(F.struct("node", "n", "rep"), "node").alias("h")).select("gid", "h.*")
    found = found.unionByName(edges(heads, "ngram-heads", True))
    left = apart(found)
    return found if left.isEmpty() else found.unionByName(edges(left, "ngram-rest", True))


def _describe(batches):
    for batch in batches:
        n, node, sk = [], [], []
        for block in blocks(batch.column(batch.num_columns - 1), lower=True):
            for s in shingle_sets(block):
                n.append(len(s))
                node.append(node_id(s) if len(s) else None)
                sk.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(n, pa.int64()),
                pa.array(node, pa.binary()),
                pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in node], pa.int64()),
                pa.array(sk, pa.binary()),
            ],
            [*batch.schema.names[:-1], "n", "node", "key", "sketch"],
        )


def _sets(batches):
    def batch():
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(held, pa.binary())], ["node", "set"])

    names, held, size = [], [], 0
    for name, s in _distinct_sets(batches, set()):
        names.append(name), held.append(s.tobytes())
        size += len(s)
        if size >= SETS:
            yield batch()
            names, held, size = [], [], 0
    yield batch()


def _read_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set for the nodes of ``wanted`` (node, rep; and perhaps some more), from their texts."""
    hit = F.xxhash64("rep").bitwiseAND((1 << PRUNE_BITS) - 1)
    # A bitmap of fixed size (at most 2**18 rows) over the ids keeps most other texts from being read again.
    bitmap = (
        wanted.select(hit.alias("h"))
        .select(F.shiftright("h", 6).cast("int").alias("__word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        .groupBy("__word")
        .agg(F.bit_or("bit").alias("__bits"))
    )
    mine = F.xxhash64("doc_id").bitwiseAND((1 << PRUNE_BITS) - 1)
    texts = (
        texts.withColumn("__h", mine)
        .withColumn("__word", F.shiftright("__h", 6).cast("int"))
        .join(F.broadcast(bitmap), "__word")
        .filter(F.expr("shiftright(__bits, cast(__h & 63 as int)) & 1 = 1"))
        .select("text")
    )
    return texts.mapInArrow(_sets, "node binary, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _possible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b for those of ``pairs`` (ka, kb) whose sketches allow a link."""
    side = lambda k, *to: nodes.select(F.col("key").alias(k), *[F.col(c).alias(t) for c, t in zip(("node", "n", "sketch"), to, strict=True)])
    return (
        pairs.join(side("ka", "a", "na", "sa"), "ka")
        .join(side("kb", "b", "nb", "sb"), "kb")
        .select("a", "b", "na", "nb", "sa", "sb")
        .mapInArrow(_sieve, "a binary, b binary")
    )


def _groups(lists: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """gid, node, root, light: the members of the lists that hold more than one cluster.

    Lists in which a cluster has two nodes or more go together with all others in which
    it leads: a pair is then looked at once, not in each of the many lists that near
    copies share.  That only adds pairs.
    """
    m = lists.select("gid", "list", "heavy").mapInArrow(_members, "gid binary, key long, light boolean")
    m = m.join(nodes.select("key", "node"), "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = m.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("n"))
    lead = each.groupBy("gid").agg(F.max(F.struct("n", "root")).alias("lead"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    m = m.join(lead, "gid").withColumn("to", F.when(F.col("lead.n") > 1, F.col("lead.root")).otherwise(F.col("gid")))
    return m.groupBy(F.col("to").alias("gid"), "node", "root").agg(F.min("light").alias("light"))


def _squares(members: DataFrame, held: DataFrame, one: list[str], across: bool = True) -> DataFrame:
    """gid, x, y: square blocks of the groups, each side an array of nodes (y null: x with itself).

    ``members`` has gid, node and n; ``held`` the wide columns of a node.  A side has about
    ``BLOCK`` nodes and ``SETS`` shingles at most.  Without ``across`` only the blocks of a
    side with itself are made, so each node is sent once.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SETS))
    sizes = members.groupBy("gid").agg(parts.cast("int").alias("parts"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    m = (
        members.join(sizes.select("gid", "parts"), "gid")
        .join(held, "node")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if across else F.col("part"))
        .withColumn("p", F.least("part", "other"))
        .withColumn("q", F.greatest("part", "other"))
    )
    row = F.struct(*one)
    squares = m.groupBy("gid", "p", "q").agg(
        F.collect_list(F.when(F.col("part") == F.col("p"), row)).alias("x"),
        F.collect_list(F.when((F.col("part") == F.col("q")) & (F.col("p") < F.col("q")), row)).alias("y"),
    )
    return squares.filter((F.size("x") > 0) & ((F.col("p") == F.col("q")) | (F.size("y") > 0))).select(
        "gid", "x", F.when(F.col("p") < F.col("q"), F.col("y")).alias("y")
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, count_links: bool = True) -> DataFrame:
    """doc_id, digest (of the text), n, root (null: no shingle), component_id, links (null unless counted) for each row."""
    spark = docs.sparkSession
    texts = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = texts.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    rows = written(described.mapInArrow(_describe, "doc_id long, digest binary, n long, node binary, key long, sketch binary"), "ngram-rows")
    nodes = written(
        rows.filter("n > 0")
        .groupBy("node")
        .agg(*[F.first(c).alias(c) for c in ("n", "key", "sketch")], F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "ngram-nodes",
    )
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET + 1)
    table = spark.sparkContext.broadcast(rarity(texts, n_buckets))
    lists = written(
        texts.select("text")
        .mapInArrow(_emit(n_buckets, table), "bucket int, nodes binary, codes binary, at binary")
        .groupBy("bucket")
        .applyInArrow(_lists, "list binary, heavy int")
        .distinct(),
        "ngram-lists",
    )
    possible = written(_possible_pairs(lists.select("list").mapInArrow(_stars, "ka long, kb long").distinct(), nodes), "ngram-possible")
    roots = written(connected(possible), "ngram-roots")

    open_ = lists.filter(F.octet_length("list") > 16).withColumn("gid", F.unhex(F.md5(F.concat("list", F.col("heavy").cast("string").cast("binary")))))
    members = written(_groups(open_, nodes, roots).join(nodes.select("node", "n"), "node"), "ngram-members")
    searched = _squares(members, nodes.select("node", "sketch"), ["node", "n", "root", "light", "sketch"]).mapInArrow(_search, "a binary, b binary")
    possible = possible.unionByName(written(searched.distinct(), "ngram-forest", 32))
    clusters = written(connected(possible).join(nodes.select("node", "n", "rep", "copies"), "node").withColumnRenamed("root", "gid"), "ngram-clusters")

    if count_links:
        held = _read_sets(texts, clusters)
        exact = written(
            _squares(clusters.select("gid", "node", "n"), held.join(nodes.select("node", "copies"), "node"), ["node", "copies", "set"]).mapInArrow(
                _exact, "a binary, b binary, links long"
            ),
            "ngram-exact",
            16,
        )
        edges = exact.filter("b IS NOT NULL").select("a", "b")
        counts = exact.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    else:
        edges = _exact_forest(texts, clusters)
    roots = written(connected(edges), "ngram-roots")

    found = nodes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if count_links:
        found = found.join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    else:
        found = found.withColumn("links", F.lit(None).cast("long"))
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "root").select("node", "root", "component_id", "links")
    full = rows.filter("n > 0").select("doc_id", "digest", "n", "node").join(found, "node")
    return full.select("doc_id", "digest", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id"), "links").unionByName(
        rows.filter("n = 0").select("doc_id", "digest", "n", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links"))
    )


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row.

    Two rows are linked if their shingle sets have a Jaccard similarity of at least 3/4;
    ``component_id`` is the smallest id that a row reaches by links, itself included, and
    ``n_links`` the number of other rows it is linked with.  A text of one to four words is
    one shingle; null, empty and blank texts have none and are components of their own.
    Rows with equal ids or texts are rows like any others.  Null ids are never the
    smallest.  Other columns are left out; an empty table gives no rows.
    """
    return _marked(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id (null ids last), then the smallest digest of its text.

    Rows without words are components of their own and stay.  All columns are kept; of
    rows equal in id and text that would stay, one does.
    """
    marked = written(_marked(docs, id_col, text_col, count_links=False), "ngram-marked")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    kept = marked.filter("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.digest")
    kept = kept.unionByName(marked.filter("root IS NULL").select("doc_id", "digest").distinct())
    times = marked.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    plain, named = neutral(docs)
    id_, text = named[id_col], named[text_col]
    on = F.col(id_).cast("long").eqNullSafe(F.col("doc_id")) & (F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))) == F.col("digest"))
    if times.isEmpty():
        return plain.join(kept, on).select(*plain.columns).toDF(*docs.columns)
    both = F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.digest") == F.col("t.digest"))
    kept = kept.alias("k").join(times.alias("t"), both, "left").select("k.doc_id", "k.digest", "__n")
    stay = plain.join(kept, on)
    single = stay.filter("__n IS NULL").select(*plain.columns)
    many = stay.filter("__n > 1").dropDuplicates([id_, "digest"]).select(*plain.columns)
    return single.unionByName(many).toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) END) AS h FROM d
), n AS (
  SELECT d.doc_id, count(s.h) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.other) AS component_id,
       CAST(coalesce(max(k.links), 0) AS BIGINT) AS n_links
FROM n JOIN r USING (doc_id) LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) AS k ON k.a = n.doc_id GROUP BY n.doc_id, n.n
"""
