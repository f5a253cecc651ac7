"""WARC archives as a chunked record table.

Writing: a payload longer than ``segment`` bytes becomes a record and numbered
``continuation`` records (the segmentation of the WARC standard), so no row that is
written or read back holds more than one segment.  Records go through Spark's text
writer with the record terminator as line separator, gzip-compressed, one file a task.

Reading: a file's bytes stream through a parser that yields one row for each
(record, chunk), with the SHA-256 of the payload as far as that chunk.  The digest state
is carried from chunk to chunk; the whole payload is never put together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, scratch_dir, written

END = "\r\n\r\n"
SEGMENT = 32 << 10


def with_roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` plus payload (binary), digest, bytes, record_type, refers_to.

    Among rows with equal payloads of at least ``least`` bytes, those with the smallest
    page_id are responses (nulls come last), the others revisit it.  Null html is an
    empty payload.  Repeated rows of the smallest page_id are all responses.
    """
    full = (
        only(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
        .withColumn("digest", F.sha2("payload", 256))
        .withColumn("bytes", F.octet_length("payload").cast("long"))
    )
    # Rows that are too short to be revisits (all empty pages have one digest) join by a key of their own, so they are dealt out evenly.
    key = F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    first = full.filter(F.col("bytes") >= least).groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return full.withColumn("key", key).join(first, "key", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        "bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str, segment: int = SEGMENT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of :func:`with_roles` as WARC files under ``path``."""
    whole = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    last = F.greatest(F.ceil(whole / segment) - 1, F.lit(0)).cast("int")
    rows = records.withColumn("__last", last).withColumn("__k", F.explode(F.sequence(F.lit(0), "__last")))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(
        F.substring("payload", F.col("__k") * segment + 1, F.lit(segment))
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("__k") > 0, F.lit("continuation")).otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("__k").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            F.col("record_type") == "revisit",
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                F.coalesce(F.col("refers_to").cast("string"), F.lit("")),
                F.lit(":0>"),
            ),
        ),
        F.when(F.col("__last") > 0, line("WARC-Segment-Number", (F.col("__k") + 1).cast("string"))),
        F.when(F.col("__k") > 0, F.concat(F.lit("WARC-Segment-Origin-ID: <urn:page:"), page, F.lit(":0>"))),
        F.when(
            (F.col("__last") > 0) & (F.col("__k") == F.col("__last")),
            line("WARC-Segment-Total-Length", F.col("bytes").cast("string")),
        ),
        F.lit("Content-Type: text/html"),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    rows.select(F.concat(head, F.lit(END), body.cast("string")).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(path)


CHUNKS = (
    "page_id long, record_type string, refers_to long, chunk int, start long, length long, "
    "declared string, digest string, last boolean"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("declared", pa.string()),
        ("digest", pa.string()),
        ("last", pa.bool_()),
    ]
)


def _page(urn: str | None) -> int | None:
    number = (urn or "").split(":")[-2] if urn else ""
    return int(number) if number else None


def _chunks(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Rows for the records in the byte stream that ``pieces`` make up.

    Only the segment that is being read is held.  Raises ValueError on a cut or changed
    archive.
    """
    held = bytearray()
    state = None  # the open record: page, type, refers, declared, hash, chunk, start
    head: dict[str, str] | None = None
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                cut = held.find(b"\r\n\r\n")
                if cut < 0:
                    break
                lines = held[:cut].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                head = dict(x.split(": ", 1) for x in lines[1:])
                need = int(head["Content-Length"])
                del held[: cut + 4]
            if len(held) < need + 4:
                break
            body = bytes(held[:need])
            if held[need : need + 4] != b"\r\n\r\n":
                raise ValueError(f"record {head['WARC-Record-ID']} has another length than it says")
            del held[: need + 4]
            if head["WARC-Type"] != "continuation":
                state = [
                    _page(head["WARC-Record-ID"]),
                    head["WARC-Type"],
                    _page(head.get("WARC-Refers-To")),
                    head["WARC-Payload-Digest"].removeprefix("sha256:"),
                    hashlib.sha256(),
                    0,
                    0,
                ]
            elif state is None or int(head["WARC-Segment-Number"]) != state[5] + 1:
                raise ValueError(f"segment out of order: {head['WARC-Record-ID']}")
            page, kind, refers, declared, running, chunk, start = state
            running.update(body)
            last = "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head
            now = running.hexdigest()
            if last and kind == "response" and now != declared:
                raise ValueError(f"payload of page {page} differs from its digest")
            yield page, kind, refers, chunk, start, need, declared, now, last
            state[5:] = [chunk + 1, start + need]
            head = None
    if held or head is not None:
        raise ValueError("archive ends inside a record")


def read_warc(spark, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: see :data:`CHUNKS`."""

    def parse(batches):
        def pieces():
            for batch in batches:
                for x in batch.column(0):
                    yield x.as_py() + b"\r\n\r\n"

        rows = []
        for row in _chunks(pieces()):
            rows.append(row)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)

    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, CHUNKS)


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back, and describe each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, chunks.  A revisit
    has the length and the digest of the response that it refers to, as read back.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_roles(pages), path, segment)
    ends = written(read_warc(spark, path).filter("last"), "warc-ends")
    got = ends.filter("record_type = 'response'").select(
        "page_id",
        (F.col("start") + F.col("length")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
        (F.col("chunk") + 1).alias("chunks"),
    )
    known = got.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    again = (
        ends.filter("record_type = 'revisit'")
        .select("page_id", "record_type", "refers_to", "declared")
        .join(known, ["refers_to", "declared"], "left")
        .select(
            "page_id",
            "payload_bytes",
            F.col("declared").alias("payload_digest"),
            "record_type",
            "refers_to",
            F.lit(1).alias("chunks"),
        )
    )
    return got.unionByName(again)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
