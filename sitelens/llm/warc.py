"""Content-addressed web archive.

An archive is two Parquet tables: ``payloads`` keeps each distinct payload once
under its SHA-256 (gzip member, checked on every read), ``headers`` keeps the
exact header bytes of every WARC record and the address of its payload.
Original records come back by joining the two.

Defined results: null payload: empty payload. Of records with equal payloads,
the one with the largest id is the response (nulls are smallest, repeated rows:
one of them), the others revisit it. Payloads shorter than ``min_revisit_bytes``
are all responses. Line breaks in a URL are percent-encoded in the header. Null
ids and URLs leave their header line out. Empty tables give empty archives.
Only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import batches_of
from sitelens.session import materialize, scratch_path

CRLF = "\r\n"
BATCH_ROWS = 256


def _compressed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(BATCH_ROWS, it):
        data = [x or b"" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column(0),
            pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
            pa.array([gzip.compress(x, 6, mtime=0) for x in data], pa.binary())], ["id", "sha256", "body"])


def _addresses(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches_of(BATCH_ROWS, it):
        data = [x or b"" for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in data], pa.int64()),
            pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in data], pa.string()),
            pa.array([hashlib.sha256(x).digest() for x in data], pa.binary())],
            ["row", "id", "url", "n_bytes", "sha1", "sha256"])


def _header(kind, row, record_id, url, sha1, n_bytes, refers_to, refers_row, date):
    """The header block of one record as a Column, ending with the empty line."""
    name = lambda i, r: F.concat(F.lit("<urn:record:"), F.coalesce(i.cast("string"), F.lit("")),
                                 F.lit(":"), r.cast("string"), F.lit(">"))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind),
             F.concat(F.lit("WARC-Record-ID: "), name(record_id, row)),
             F.lit(f"WARC-Date: {date}"),
             F.concat(F.lit("WARC-Target-URI: "), safe),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
             F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(refers_to, refers_row))),
             F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/"
                                             "identical-payload-digest")),
             F.lit("Content-Type: text/html; charset=utf-8"),
             F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(n_bytes.cast("string")))]
    # concat_ws leaves null lines out
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Writes ``path/headers`` and ``path/payloads``. ``date`` (``YYYY-MM-DDThh:mm:ssZ``)
    is when the pages were captured; the table does not say, so it defaults to now.

    The digests of all records are written first as a narrow table; the
    responses are a partial-then-final maximum per digest over it. Payload
    bytes are compressed before they move and move once, keyed by digest and
    id, so a payload with a third of all copies does not meet in one task.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       payload.alias("payload"))
    rows = materialize(
        source.select(F.monotonically_increasing_id().alias("row"), "id", "url", "payload")
        .mapInArrow(_addresses, "row long, id long, url string, n_bytes long, sha1 string, sha256 binary"), "warc-rows")
    first = materialize(rows.groupBy("sha256").agg(F.max(F.struct("id", "row")).alias("first"),
                                                   F.max("n_bytes").alias("size")), "warc-responses")

    kind = F.when((F.col("n_bytes") < min_revisit_bytes) | (F.col("first.row") == F.col("row")), F.lit("response")) \
        .otherwise(F.lit("revisit"))
    (rows.join(first, "sha256").withColumn("kind", kind)
     .select("id", "row", "sha256",
             _header(F.col("kind"), F.col("row"), F.col("id"), F.col("url"), F.col("sha1"), F.col("n_bytes"),
                     F.col("first.id"), F.col("first.row"),
                     date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("header"))
     .write.mode("overwrite").parquet(f"{path}/headers"))

    # rows of one digest hold the same payload, so any row of the winner's id will do; null ids go under one number
    at = F.coalesce("id", F.lit(-1 << 63))
    bodies = source.select("id", "payload").mapInArrow(_compressed, "id long, sha256 binary, body binary") \
        .select("sha256", at.alias("at"), "body")
    winners = first.select("sha256", F.coalesce("first.id", F.lit(-1 << 63)).alias("at"))
    (bodies.join(winners, ["sha256", "at"]).groupBy("sha256", "at").agg(F.first("body").alias("body"))
     .select("sha256", "body").write.mode("overwrite").parquet(f"{path}/payloads"))


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """header, sha256, body -> the original record's parts, its digests checked."""
    for b in batches_of(BATCH_ROWS, it):
        out = []
        for header, address, body in zip(*(c.to_pylist() for c in b.columns)):
            if body is None:
                raise ValueError(f"payload {address.hex()} is missing from the archive")
            payload = gzip.decompress(body)
            if hashlib.sha256(payload).digest() != address:
                raise ValueError(f"payload {address.hex()} does not match its address")
            fields = dict(x.split(": ", 1) for x in header.decode().split(CRLF)[1:] if x)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']} does not match its payload digest")
            own = lambda k: fields[k].split(":")[2] if k in fields else ""
            out.append((int(own("WARC-Record-ID")) if own("WARC-Record-ID") else None, len(payload), digest,
                        fields["WARC-Type"], int(own("WARC-Refers-To")) if own("WARC-Refers-To") else None,
                        fields.get("WARC-Target-URI"), header, payload))
        names = ["record", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "header", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        cols = list(zip(*out)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


RECORD_SCHEMA = ("record long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                 "url string, header binary, payload binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every original record (header bytes, whole payload, parsed header
    fields). A missing payload or one that fails its digest stops the job."""
    headers = spark.read.parquet(f"{path}/headers").select("header", "sha256")
    payloads = spark.read.parquet(f"{path}/payloads")
    return headers.join(payloads, "sha256", "left").select("header", "sha256", "body") \
        .mapInArrow(_verified, RECORD_SCHEMA)


def archive_path(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
