"""Personal data by base patterns and a skip-chain conditional random field.

Four base patterns (e-mail, IPv4, payment card, phone) always count.  The field labels
the other tokens that hold a digit or an ``@``; no other token can carry an entity label
here, so leaving them out of the graph changes nothing.  Neighbouring tokens share a
chain potential.  Tokens of a document that are equal in letters and digits, or *similar* (the
same last seven digits, the same part before an ``@``), share a skip potential with the first of
them, so evidence travels two links however often a token repeats.  Loopy belief propagation
passes messages over both kinds of links until they settle.  Tokens whose marginal for one
entity passes ``SURE`` add a span unless they touch a base span.

The weights are trained here by pseudo-likelihood (unary, chain and skip weights together)
from a bounded sample of documents (``SAMPLE`` different texts with candidates, from the low
end of their hashes, each of at most ``SAMPLE_TOKENS`` candidate tokens), on tokens that the
base patterns label.  What the base patterns test (checksums, ranges) is no feature, and each
labelled document is also learnt from with its spans *broken*: without the plus, with other
separators, with an obfuscated ``@``; so the field reaches what the patterns miss.  Numbers that a
base pattern matches and then drops (a wrong checksum) are left unlabelled.  A fixed set of
ordinary numbers (dates, times, prices, versions, ids) is learnt as nothing personal.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
SAMPLE = 2000
SAMPLE_TOKENS = 200
SURE = 0.9
ROUNDS = 200
SETTLED = 1e-3
GRAPH_TOKENS = 20_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + length
            at += length + 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; each in linear time."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    out += [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def rejected_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the patterns that the base rules drop: wrong checksums, counts and ranges."""
    kept = {(a, b) for _, a, b in base_spans(text)}
    found = [m.span() for p in (_CARD, _PHONE) for m in p.finditer(text) if len(_digits(m.group())) >= 12]
    found += [m.span() for m in _DOTTED.finditer(text) if m.group().count(".") >= 3]
    return [s for s in found if s not in kept]


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the candidate tokens, without the punctuation around them."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and not (text[a].isalnum() or text[a] in "+(@"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in ")@"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def features(text: str, a: int, b: int) -> list[float]:
    """The shape of a token and of what stands around it; nothing that a base rule tests."""
    t = text[a:b]
    n = len(t)
    digits = sum("0" <= c <= "9" for c in t)
    letters = sum(c.isalpha() for c in t)
    dots, hyphens, at = t.count("."), t.count("-"), t.count("@")
    groups = [len(g) for g in re.findall("[0-9]+", t)]
    before, after = text[max(0, a - 12) : a], text[b : b + 12]
    return [
        1.0,
        float(at == 1),
        float(at > 1),
        float(at == 1 and "." in t.split("@")[1]),
        float(t == "@"),
        float(bool(re.search(r"[(\[{](at|dot)[)\]}]", t))),
        float(t[0] == "+"),
        float(t[0] == "("),
        float("(" in t and ")" in t),
        digits / n,
        letters / n,
        float(letters > 0 and digits > 0),
        float(digits == n),
        float(digits == 0),
        *[float(digits == d) for d in range(1, 5)],
        float(5 <= digits <= 6),
        float(digits == 7),
        float(8 <= digits <= 9),
        float(10 <= digits <= 12),
        float(13 <= digits <= 15),
        float(16 <= digits <= 19),
        float(digits > 19),
        float(len(groups) == 1),
        float(len(groups) == 2),
        float(len(groups) == 3),
        float(len(groups) == 4),
        float(len(groups) > 4),
        float(len(groups) == 4 and max(groups) <= 3),
        float(len(groups) >= 3 and min(groups) == max(groups) == 4),
        float(groups[-1:] == [4] and groups[-2:-1] == [3]),
        float(groups == [4]),
        float(groups[:1] == [4] and len(groups) == 3),
        float(dots == 1),
        float(dots > 1),
        float(hyphens == 1),
        float(hyphens > 1),
        float(bool(re.search("[%/_:,$#]", t))),
        float(bool(re.search(r"\+?[0-9]+ $", before))),
        float(bool(re.search(r"\) $", before))),
        float(bool(re.match(r" [0-9(]", after))),
        float(bool(re.search(r"@ ?$", before)) or bool(re.match(r" ?@", after))),
        min(n, 40) / 40,
    ]


N_FEATURES = len(features("+1", 0, 2))


def similar_keys(token: str) -> list[str]:
    """What two tokens must share for a skip link: all letters and digits, the last seven digits, or the part before an ``@``."""
    key = "".join(c for c in token if c.isalnum()).lower()
    out = [f"={key}"] if len(key) >= 3 else []
    digits = _digits(token)
    if len(digits) >= 7:
        out.append(f"#{digits[-7:]}")
    local = re.split(r"@|[(\[{]at[)\]}]", token)[0].lower()
    if len(local) >= 3 and len(local) < len(token):
        out.append(f"@{local}")
    return out


class Graph:
    """Candidate tokens of some documents, chain and skip links between them."""

    def __init__(self) -> None:
        self.x: list[list[float]] = []
        self.y: list[int] = []  # -1: not known
        self.at: list[tuple[int, int, int]] = []  # document, start, end
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]], unknown: list[tuple[int, int]] = ()) -> None:
        heads: dict[str, int] = {}
        order = sorted((a, b, k) for k, a, b in spans)
        doubt = sorted(unknown)
        first = len(self.at)
        i = j = 0
        for a, b in tokens(text):
            node = len(self.at)
            while j < len(order) and order[j][1] <= a:
                j += 1
            while i < len(doubt) and doubt[i][1] <= a:
                i += 1
            covered = j < len(order) and order[j][0] < b
            open_ = i < len(doubt) and doubt[i][0] < b
            self.at.append((doc, a, b))
            self.y.append(order[j][2] + 1 if covered else -1 if open_ else 0)
            self.x.append(features(text, a, b))
            if node > first and not text[self.at[node - 1][2] : a].strip():
                self.chain.append((node - 1, node))
            linked = set()
            for key in similar_keys(text[a:b]):
                head = heads.setdefault(key, node)
                if head != node and head not in linked:
                    linked.add(head)
                    self.skip.append((head, node))


#: How each kind is broken for training: what a base pattern no longer matches, but a reader still knows.
BREAKS = {
    0: [lambda t: t.replace("@", " @ "), lambda t: t.replace("@", "(at)"), lambda t: t.replace("@", "[at]"), lambda t: t.split("@")[0] + "@" + t.split("@")[1].replace(".", ""), lambda t: t.replace("@", "@ ")],
    1: [lambda t: t.replace(".", "[.]"), lambda t: t.replace(".", "-"), lambda t: t.replace(".", ","), lambda t: t.replace(".", ":")],
    2: [lambda t: ".".join(re.findall("[0-9]{1,4}", _digits(t))), lambda t: "_".join(re.findall("[0-9]{1,4}", _digits(t))), lambda t: "/".join(re.findall("[0-9]{1,4}", _digits(t)))],
    3: [lambda t: t.replace("+", ""), lambda t: t.split(" ", 1)[-1], lambda t: re.sub("[^0-9]+", ".", t).strip("."), lambda t: re.sub("[^0-9]+", "-", t).strip("-")],
}


#: How each kind is mentioned again in a form that says nothing by itself: only the link with the full form tells what it is.
MENTIONS = {
    0: lambda t: t.split("@")[0] + "@",
    1: lambda t: "x" + _digits(t),
    2: lambda t: "n" + _digits(t)[-10:],
    3: lambda t: _digits(t)[-10:],
}


def broken(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with each of its base spans in a broken form, and where they stand then."""
    out, moved, done, size = [], [], 0, 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a < done:
            continue
        form = rng.choice(BREAKS[k])(text[a:b])
        out += [text[done:a], form]
        size += a - done
        moved.append((k, size, size + len(form)))
        size += len(form)
        done = b
    return "".join([*out, text[done:]]), moved


def ordinary(rng: random.Random, n: int = 400) -> str:
    """Numbers that are nothing personal, among words."""
    r = rng.randrange
    forms = [
        lambda: f"{r(1900, 2031)}",
        lambda: f"{r(1, 29):02}.{r(1, 13):02}.{r(1900, 2031)}",
        lambda: f"{r(1900, 2031)}-{r(1, 13):02}-{r(1, 29):02}",
        lambda: f"{r(1, 13)}/{r(1, 29)}/{r(1900, 2031)}",
        lambda: f"{r(24)}:{r(60):02}",
        lambda: f"{r(24)}:{r(60):02}:{r(60):02}",
        lambda: f"${r(1000)}.{r(100):02}",
        lambda: f"{r(1, 1000)},{r(1000):03}",
        lambda: f"{r(1, 100)},{r(1000):03},{r(1000):03}",
        lambda: f"{r(100)}%",
        lambda: f"{r(10)}.{r(1000)}",
        lambda: f"v{r(10)}.{r(20)}.{r(30)}",
        lambda: f"{r(10)}.{r(20)}.{r(30)}",
        lambda: f"{r(1, 100)}th",
        lambda: f"{r(1, 50)}-{r(50, 100)}",
        lambda: f"#{r(10**5)}",
        lambda: f"978-{r(10)}-{r(100):02}-{r(10**6):06}-{r(10)}",
        lambda: str(r(10 ** r(1, 13))),
        lambda: f"{chr(97 + r(26))}{r(10**4)}",
        lambda: f"{r(1 << 32):08x}{r(1 << 32):08x}",
    ]
    return " ".join(rng.choice(forms)() + (" word" if r(4) else "") for _ in range(n))


def _neighbours(n: int, y: np.ndarray, links: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours of each label a node has at the far (first) and at the near (second) end of its links."""
    left, right = np.zeros((n, len(LABELS))), np.zeros((n, len(LABELS)))
    if links:
        a, b = np.array(links).T
        known = y[a] >= 0
        np.add.at(left, (b[known], y[a[known]]), 1)
        known = y[b] >= 0
        np.add.at(right, (a[known], y[b[known]]), 1)
    return left, right


def train(x: np.ndarray, y: np.ndarray, chain: list, skip: list, steps: int = 1500, rate: float = 1.0, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Weights of the greatest pseudo-likelihood: each known label given its token and its neighbours' labels.

    Full gradient steps; labels are weighted by the root of their counts.  Potentials of
    labels that do not occur stay at zero.
    """
    n = len(LABELS)
    w, c, s = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))
    known = y >= 0
    if not known.any():
        w[0, 0] = 10.0
        return {"w": w, "chain": c, "skip": s}
    left, right = _neighbours(len(y), y, chain)
    one, other = _neighbours(len(y), y, skip)
    near = np.minimum(one + other, 3.0)
    counts = np.bincount(y[known], minlength=n)
    weight = np.where(known, (1 / np.sqrt(np.maximum(counts, 1)))[np.maximum(y, 0)], 0.0)
    weight /= weight.sum()
    target = np.eye(n)[np.maximum(y, 0)]
    speed = [np.zeros_like(p) for p in (w, c, s)]
    for _ in range(steps):
        score = x @ w + left @ c + right @ c.T + near @ s
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) * weight[:, None]
        pull = near.T @ d
        for k, (theta, grad) in enumerate(((w, x.T @ d), (c, left.T @ d + d.T @ right), (s, (pull + pull.T) / 2))):
            speed[k] = 0.9 * speed[k] - rate * (grad + decay * theta)
            theta += speed[k]
    w[:, counts == 0] = 0.0
    w[0, counts == 0] = -20.0
    return {"w": w, "chain": c, "skip": s}


def marginals(unary: np.ndarray, links: list[tuple[list[tuple[int, int]], np.ndarray]], rounds: int = ROUNDS, doc: list[int] | None = None) -> np.ndarray:
    """Loopy belief propagation, all messages of a round sent at once, until none of the document's changes by ``SETTLED`` (or for ``rounds``).

    ``doc`` names the document of each node (None: one document).  Each stops by itself, so
    what is found in it does not depend on which others are in the batch.
    """
    n = len(unary)
    source, target, pair = [], [], []
    for ends, potential in links:
        for a, b in ends:
            source += [a, b]
            target += [b, a]
            pair += [potential, potential.T]
    if source:
        src, dst, pot = np.array(source), np.array(target), np.stack(pair)
        _, own = np.unique(np.zeros(n, np.int64) if doc is None else np.asarray(doc), return_inverse=True)
        message = np.zeros((len(src), unary.shape[1]))
        live = np.arange(len(src))  # both directions of a link stay side by side
        for _ in range(rounds):
            now = message[live]
            belief = unary.copy()
            np.add.at(belief, dst[live], now)
            out = belief[src[live]] - now[np.arange(len(live)) ^ 1]
            new = np.logaddexp.reduce(out[:, :, None] + pot[live], axis=1)
            new -= new.max(axis=1, keepdims=True)
            message[live] = 0.5 * now + 0.5 * new
            change = np.zeros(own.max() + 1)
            np.maximum.at(change, own[dst[live]], np.abs(new - now).max(axis=1))
            live = live[change[own[dst[live]]] >= SETTLED]
            if not len(live):
                break
        unary = unary.copy()
        np.add.at(unary, dst, message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True)) if n else unary
    return p / p.sum(axis=1, keepdims=True) if n else p


def _graphs(h: int, text: str):
    """The graph of a document as it is and, where it has base spans, with them broken, and with them mentioned again."""
    spans = base_spans(text)
    g = Graph()
    g.add(0, text, spans, rejected_spans(text))
    yield g
    if spans:
        other, moved = broken(text, spans, random.Random(h))
        g = Graph()
        g.add(0, other, moved, rejected_spans(other))
        yield g
        for k, a, b in spans:
            again = MENTIONS[k](text[a:b])
            text += "\nword " + again
            spans = [*spans, (k, len(text) - len(again), len(text))]
        g = Graph()
        g.add(0, text, spans, rejected_spans(text))
        yield g


def learn(graphs: list[tuple[np.ndarray, np.ndarray, list, list]]) -> dict[str, np.ndarray]:
    """Weights from graphs (x, y, chain, skip) of sample documents and the ordinary numbers."""
    plain = Graph()
    plain.add(0, ordinary(random.Random(0)), [])
    xs, ys, chain, skip, base = [], [], [], [], 0
    for x, y, c, s in [*graphs, (np.array(plain.x), np.array(plain.y), plain.chain, plain.skip)]:
        xs.append(np.asarray(x, np.float64).reshape(-1, N_FEATURES))
        ys.append(np.asarray(y, np.int64))
        chain += [(a + base, b + base) for a, b in c]
        skip += [(a + base, b + base) for a, b in s]
        base += len(y)
    return train(np.concatenate(xs), np.concatenate(ys), chain, skip)


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Weights from the bounded sample described above."""

    def describe(batches):
        for batch in batches:
            out = [[], [], []]
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not 0 < len(tokens(text)) <= SAMPLE_TOKENS:
                    continue
                for g in _graphs(h, text):
                    out[0].append(h)
                    out[1].append(np.array(g.x, np.float32).tobytes())
                    links = [len(g.at), len(g.chain), *g.y, *sum(map(list, [*g.chain, *g.skip]), [])]
                    out[2].append(np.array(links, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["h", "x", "links"])

    likely = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # A hash threshold lets about SAMPLE rows pass whatever the size, so no task sends the driver more than its share.
    share = 1.25 * SAMPLE / max(1, likely.count())
    rows = (
        likely.filter(F.col("h").cast("double") / 2.0**64 + 0.5 < share)
        .mapInArrow(describe, "h long, x binary, links binary")
        .distinct()
        .orderBy("h", "links")
        .limit(3 * SAMPLE)
        .collect()
    )
    graphs = []
    for r in rows:
        links = np.frombuffer(r["links"], np.int32)
        n, n_chain = int(links[0]), int(links[1])
        pairs = links[2 + n :].reshape(-1, 2).tolist()
        graphs.append((np.frombuffer(r["x"], np.float32), links[2 : 2 + n], pairs[:n_chain], pairs[n_chain:]))
    return learn(graphs)


def added_spans(texts: list[str], spans: list[list], model: dict) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the base spans of each text; graphs of whole documents with about ``GRAPH_TOKENS`` tokens at once."""
    out: list[list] = [[] for _ in texts]
    g = Graph()
    for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
        if re.search("[0-9@]", text):
            g.add(i, text, own)
        if len(g.at) >= GRAPH_TOKENS:
            _label(g, texts, model, out)
            g = Graph()
    _label(g, texts, model, out)
    return out


def _label(g: Graph, texts: list[str], model: dict, out: list[list]) -> None:
    if not g.at:
        return
    unary = np.array(g.x) @ model["w"]
    unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
    label = np.array(g.y)
    fixed = label > 0  # what a base pattern covers is observed
    unary[fixed] = -30.0
    unary[np.flatnonzero(fixed), label[fixed]] = 0.0
    p = marginals(unary, [(g.chain, model["chain"]), (g.skip, model["skip"])], doc=[d for d, _, _ in g.at])
    best = p.argmax(axis=1)
    sure = (best > 0) & (p[np.arange(len(p)), best] >= SURE) & ~fixed
    joined = {b for _, b in g.chain}
    previous = -2
    for node in np.flatnonzero(sure):
        doc, a, b = g.at[node]
        kind = int(best[node]) - 1
        if texts[doc][a:b] == "@":  # the address around a lone sign
            a, b = _around(texts[doc], a, b)
        whole = len(_digits(texts[doc][out[doc][-1][1] : b])) <= 19 if out[doc] else False
        if previous == node - 1 and node in joined and whole and out[doc][-1][0] == kind:
            out[doc][-1] = (kind, out[doc][-1][1], max(b, out[doc][-1][2]))
        else:
            out[doc].append((kind, a, b))
        previous = node


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """From the word before to the word after, where single spaces part them."""
    left, right = re.search(r"[A-Za-z0-9._%+-]{1,64} $", text[max(0, a - 65) : a]), re.match(r" [A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})*", text[b : b + 260])
    return a - len(left[0]) if left else a, b + right.end() if right else b


def find(texts: list[str], model: dict) -> tuple[list[list], list[list]]:
    """Base spans and added spans of each text."""
    found = [base_spans(t) if re.search("[0-9@]", t) else [] for t in texts]
    return found, added_spans(texts, found, model)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def with_spans(docs: DataFrame, keep: list[str], text_col: str = "text", model: dict | None = None) -> DataFrame:
    """Columns ``keep`` and n_email, n_ip, n_card, n_phone, base_spans, spans for each row.

    Null text counts as empty and has no spans; repeated rows are marked each for itself, and
    an empty table gives no rows.  A text of any length is searched whole, as one graph that
    grows with its tokens.  A column of ``keep`` that has the name of a result gives way to it.
    """
    own = {*(f"n_{k}" for k in KINDS), "base_spans", "spans"}
    keep = [c for c in keep if c not in own]
    docs = only(docs, *dict.fromkeys([*keep, text_col]))
    model = fit(docs, text_col) if model is None else model
    schema = docs.select(*keep).schema

    def mark(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            found, more = find(texts, model)
            counts = [pa.array([sum(k == i for k, _, _ in s) for s in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    *counts,
                    pa.array([written_spans(s) for s in found], pa.string()),
                    pa.array([written_spans([*s, *m]) for s, m in zip(found, more, strict=True)], pa.string()),
                ],
                [*batch.schema.names[:-1], *[f"n_{k}" for k in KINDS], "base_spans", "spans"],
            )

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], *[f"n_{k} long" for k in KINDS]])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(mark, f"{ddl}, base_spans string, spans string")


def mask(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with personal data masked in the text; a column ``n_chars`` is counted anew where it changes."""
    model = fit(docs, text_col) if model is None else model
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found, more = find([t or "" for t in texts], model)
            clean = [mask(t, written_spans([*s, *m])) if s or m else t for t, s, m in zip(texts, found, more, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                old = columns[n].to_pylist()
                columns[n] = pa.array([len(c) if c != t else o for c, t, o in zip(clean, texts, old, strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
