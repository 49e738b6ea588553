"""Web archives: write and read WARC 1.1 records, and store equal payloads once by revisit records."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, table
from palimpsest.llm.registry import query
from palimpsest.session import ensure_checkpoint_dir, stage

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: A table of originals is sent to all tasks if its rows, at about 200 bytes each, are at most so many.
BROADCAST_ROWS = 200_000
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_id string, record_type string, target_uri string, page_id long, digest string, refers_to string, "
          "payload binary, payload_bytes long, payload_digest string")


def fresh_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]", " ")), F.lit(""))


def _urn(*parts: Column) -> Column:
    """A record id that depends on nothing but ``parts``."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one gzipped archive per task, through Spark's own committer, so that a lost task leaves no half file.

    ``records``: record_id, record_type (response or revisit), target_uri, page_id, digest (hex SHA-256 of the
    payload), refers_to (record id, for revisits), payload (string; not written for revisits). A null
    target or page id leaves its line out. The row's text is the record without its closing line ends, which are
    the writer's separator.
    """
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload"), F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit(END))
    block = F.concat(http, payload)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("target_uri")), _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, F.col("refers_to"))),
        F.when(revisit, F.lit(f"\r\nWARC-Profile: {PROFILE}")).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit(END))
    records.select(F.concat(header, block).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the byte stream of whole archives, which comes in pieces that a blank line ended."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    end, header, need, body = END.encode(), None, 0, []
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            piece = piece or b""
            if header is None:
                piece = piece.lstrip(b"\r\n")  # the end of a body that itself ends in a line end
                if not piece.startswith(b"WARC/"):
                    if piece:
                        raise ValueError(f"no WARC record begins with {piece[:40]!r}")
                    continue
                header = dict(x.split(": ", 1) for x in piece.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                need, body = int(header["Content-Length"]), []
                continue
            body.append(piece)
            need -= len(piece) + len(end)
            if need > 0:
                continue  # a blank line inside the body
            block = end.join([*body, b""])[:int(header["Content-Length"])]
            http, _, payload = block.partition(end)
            page = header.get("WARC-Page-ID")
            rows.append((header.get("WARC-Record-ID"), header["WARC-Type"], header.get("WARC-Target-URI"),
                         int(page) if page else None, header.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
                         header.get("WARC-Refers-To"), payload, len(payload), hashlib.sha256(payload).hexdigest()))
            header, size = None, size + len(payload)
            if size > 4 << 20 or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, size = [], 0
    if header is not None:
        raise ValueError(f"the archive ends inside {header.get('WARC-Record-ID')}")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, with the size and digest of the payload as read.

    Archives are split at blank lines by Spark's reader and put together again by their lengths; a gzipped
    file is never cut between tasks. Memory: one record and a few MB.
    """
    bound_batches(spark, 256)
    raw = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(_records, SCHEMA)


def page_records(pages: DataFrame) -> DataFrame:
    """One response record for every row of ``pages`` (page_id, url, html; others are ignored). A null html is empty.

    The record id is made from the row and its place, so that rows that repeat have records of their own.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        _urn(F.lit("capture"), F.col("page_id"), F.col("url"), F.monotonically_increasing_id()).alias("record_id"),
        F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.col("page_id").cast("long").alias("page_id"),
        F.sha2(html, 256).alias("digest"), F.lit(None).cast("string").alias("refers_to"), html.alias("payload"))


def originals(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """For each digest that several records share: the record to keep, that of the smallest page id (null ids last).

    Only headers are shuffled, and each task first keeps one row per digest of its own.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id"))
    return (headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
            .agg(first.alias("kept"), F.count("*").alias("copies")).filter("copies > 1")
            .select("payload_digest", F.col("kept.record_id").alias("original_id")))


def resolve_revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Marks every record whose payload another one keeps as a revisit, and gives all of them fresh ids.

    The originals' table is written first; it is broadcast if it is known to be small, so that payloads stay
    where they are, and joined by a shuffle otherwise.
    """
    kept = stage(originals(records.select("record_id", "page_id", "payload_digest", "payload_bytes"), least_bytes))
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    fresh = lambda c: _urn(F.lit("stored"), c)
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("original_id").isNotNull() & (F.col("original_id") != F.col("record_id"))
    return records.join(kept, "payload_digest", "left").select(
        fresh(F.col("record_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id",
        F.col("payload_digest").alias("digest"), F.when(revisit, fresh(F.col("original_id"))).alias("refers_to"),
        F.col("payload").cast("string").alias("payload"))


def follow_revisits(records: DataFrame) -> DataFrame:
    """Size, digest and page id of the original for every revisit record; other records as they are.

    Many records may revisit one original: the join is on the record id, whose side of originals is unique,
    and Spark splits the other side where it is skewed.
    """
    response = F.col("record_type") == "response"
    heads = records.select("record_id", "record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest")
    heads = stage(heads)
    source = heads.filter(response).select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("original_page"),
        F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest"))
    plain = heads.filter(response).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                          F.lit(None).cast("long").alias("refers_to"), "target_uri")
    again = heads.filter(~response).select("page_id", "record_type", "target_uri", "refers_to").join(source, "refers_to", "left").select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), F.col("original_digest").alias("payload_digest"),
        "record_type", F.col("original_page").alias("refers_to"), "target_uri")
    return plain.unionByName(again)


@query("op1_warc_revisits", f"""
with p as (select page_id, url as target_uri, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, first_value(page_id) over (partition by payload_digest order by page_id) as original,
             row_number() over (partition by payload_digest order by page_id) as nth from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, target_uri,
       case when payload_bytes >= {LEAST_BYTES} and nth > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST_BYTES} and nth > 1 then original end as refers_to from f""")
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured, stored = fresh_folder(spark), fresh_folder(spark)
    write_archives(page_records(table(spark, sf_dir, "pages")), captured)
    write_archives(resolve_revisits(read_archives(spark, captured)), stored)
    return follow_revisits(read_archives(spark, stored))
