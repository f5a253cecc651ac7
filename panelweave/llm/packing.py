"""Packing token sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document's whole windows of
``length`` tokens leave at once; what is left of it goes into the open window where it
fits tightest.  If it fits in none and no more may be opened, the fullest window is
filled up from it and emitted (documents may be cut), and the rest is placed on.  The
windows still open at a partition's end are its leftovers; they are merged in rounds of
``fan_in`` partitions by the same procedure, and the last round pours what remains into
as few windows as possible, so at most one sequence of the whole corpus is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

LENGTH = 1024
OPEN = 16
FAN_IN = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]
_OUT = pa.schema([*[(c, pa.int64()) for c in _FIELDS], ("part", pa.int64()), ("ids", pa.binary())])

_encoders: dict = {}

#: The ranks' own splitter overflows its stack on runs of about a million white-space characters; from 10,000 on the file's tokenizer takes the text.  Each run is looked at once.
GAP = 10_000
_LONG_GAP = re.compile(rf"(?<!\s)\s{{{GAP}}}")

# Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def _bytes_of(token: str) -> bytes:
    return bytes(_BYTE[c] for c in token)


def encoder(json_path: str):
    """text -> token ids, as the ``tokenizers`` file says with add_special_tokens=False.

    The same vocabulary as byte-pair ranks runs several times faster, so the ranks beside the
    file are used once every token of both has proved to stand for the same bytes, the file's
    merges to come in the order of the ranks, and its splitting and normalizing to be those of the
    pattern.  A text that spells a special token, or holds a very long run of white
    space, goes through the file's own tokenizer.  One encoder is kept in each Python worker.
    """
    if json_path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(json_path)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        twin = json_path.removesuffix(".json") + ".tiktoken"
        with open(twin, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path) as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        added = set(own.get_added_tokens_decoder())
        if {_bytes_of(t): i for t, i in vocabulary.items() if i not in added} != {t: i for t, i in ranks.items() if i not in added}:
            raise ValueError(f"{twin} is not the vocabulary of {json_path}")
        if not _as_ranks(spec):
            raise ValueError(f"{json_path} merges or splits otherwise than byte-pair ranks")
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(x in text for x in special) or (len(text) >= GAP and _LONG_GAP.search(text)):
                return own.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[json_path] = encode
    return _encoders[json_path]


def _as_ranks(spec: dict) -> bool:
    """Whether a tokenizer file merges pairs in the order of the ids they make, and splits texts, unchanged, by the pattern of byte-level vocabularies."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    plain = not (spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    return plain and all(a < b for a, b in zip(made, made[1:])) and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")


class Packer:
    """Open windows of one partition; finished sequences are appended to ``rows``."""

    def __init__(self, base: int, length: int, n_open: int) -> None:
        self.base, self.length, self.n_open = base, length, n_open
        self.windows: list[list] = []  # [used, [(doc, start, ids, total), ...]]
        self.count = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        sequence, at = self.base + self.count, 0
        self.count += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, None, None))
            at += len(ids)

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            room = self.length - len(ids)
            fits = [w for w in self.windows if w[0] <= room]
            if fits:
                best = max(fits, key=lambda w: w[0])
                take = len(ids)
            elif len(self.windows) < self.n_open:
                best = [0, []]
                self.windows.append(best)
                take = len(ids)
            else:
                best = max(self.windows, key=lambda w: w[0])
                take = self.length - best[0]
            best[1].append((doc, start, ids[:take], total))
            best[0] += take
            if best[0] == self.length:
                self._emit(best[1])
                self.windows = [w for w in self.windows if w is not best]
            start, ids = start + take, ids[take:]

    def leave(self, part: int) -> None:
        """The open windows' pieces, with their ids, for the next round."""
        for number, (_, pieces) in enumerate(self.windows):
            at = 0
            for doc, start, ids, total in pieces:
                self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at, part, ids.tobytes()))
                at += len(ids)
        self.windows = []

    def pour(self) -> None:
        """Close all windows: the fullest are filled up from the emptiest."""
        pieces = [p for _, window in sorted(self.windows, key=lambda w: -w[0]) for p in window]
        self.windows = []
        now, used = [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                take = min(len(ids), self.length - used)
                now.append((doc, start, ids[:take], total))
                start, ids, used = start + take, ids[take:], used + take
                if used == self.length:
                    self._emit(now)
                    now, used = [], 0
        if now:
            self._emit(now)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _OUT]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _sequence_base(level: int, part: int) -> int:
    return (level << 58) + (part << 30)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    length: int = LENGTH,
    n_open: int = OPEN,
    fan_in: int = FAN_IN,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, the same on every executor.  A null
    or empty text is the end token alone.  Repeated rows are packed each; a null id stays
    null; other columns are left out; an empty table gives no rows.
    """
    schema = PIECES + ", part long, ids binary"

    def first(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        packer = Packer(_sequence_base(0, part), length, n_open)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], np.dtype("<u4"))
                packer.add(doc, 0, ids, len(ids))
                if len(packer.rows) >= 4096:
                    yield packer.batch()
        packer.leave(part)
        yield packer.batch()

    def merge(level: int, last: bool):
        def run(group: pa.Table) -> pa.Table:
            part = group.column("group")[0].as_py()
            packer = Packer(_sequence_base(level, part), length, n_open)
            for r in group.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            packer.pour() if last else packer.leave(part)
            return pa.Table.from_batches([packer.batch()])

        return run

    done = []
    now = written(
        only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, schema), "pack-0"
    )
    level = 0
    while True:
        done.append(now.filter("part IS NULL").select(*_FIELDS))
        left = now.filter("part IS NOT NULL")
        top = left.agg(F.max("part")).first()[0]
        if top is None:
            break
        level += 1
        grouped = left.withColumn("group", F.floor(F.col("part") / fan_in).cast("long"))
        now = written(
            grouped.groupBy("group").applyInArrow(merge(level, top < fan_in), schema),
            f"pack-{level}",
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
