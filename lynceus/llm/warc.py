"""Content-addressed WARC archive: payloads once, record headers apart, records by joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"

HEADERS = "page_id bigint, digest string, header binary, with_payload boolean"
PAYLOADS = "digest string, payload binary"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(revisit: Column, size: Column) -> Column:
    """WARC and HTTP header of a record, byte for byte as they stand in the archive."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n")
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    address = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]+", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number(F.col("page_id")), F.lit(">\r\n")),
        _line("WARC-Date", F.lit(DATE)),
        F.when(address.isNull(), "").otherwise(_line("WARC-Target-URI", address)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(~revisit, "").otherwise(
            F.concat(_line("WARC-Profile", F.lit(PROFILE)), F.lit("WARC-Refers-To: <urn:page:"), number(F.col("first_id")), F.lit(">\r\n"))
        ),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"),
        F.lit("\r\n\r\n"), http,
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """Writes ``path/payloads``, one row per SHA-256 digest, and ``path/headers``, one row per record.

    Of pages with equal payloads of at least 100 bytes, the one with the smallest id
    is a response, and the others are revisits of it. Copies are reduced inside each
    task before payloads are shuffled, and two different payloads of one digest
    stop the job. Null pages have an empty payload and null urls no URI line. Pages
    of null id are responses of their own. Repeated ids with the smallest id are all
    responses. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), _payload(F.col(html_col)).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    check = F.xxhash64("payload")
    stored = rows.groupBy("digest").agg(
        F.min("page_id").alias("first_id"),
        F.first("payload").alias("payload"),
        F.min(check).alias("low"),
        F.max(check).alias("high"),
    )
    one = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads have digest "), F.col("digest"))).cast("binary")
    )
    stored.select("digest", "first_id", one.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = pages.sparkSession.read.schema("digest string, first_id bigint").parquet(f"{path}/payloads")
    heads = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("size")).join(first, "digest")
    revisit = (F.col("size") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    heads.select(
        "page_id", "digest", F.encode(_header(revisit, F.col("size")), "UTF-8").alias("header"), (~revisit).alias("with_payload")
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, digest, record): the bytes of every record, put together from header and payload.

    Records of responses join the payload store; revisits have no payload of their own.
    """
    heads = spark.read.schema(HEADERS).parquet(f"{path}/headers")
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
    end = F.lit(RECORD_END)
    full = heads.where("with_payload").join(stored, "digest").select(
        "page_id", "digest", F.concat("header", "payload", end).alias("record")
    )
    return full.unionAll(heads.where("NOT with_payload").select("page_id", "digest", F.concat("header", end).alias("record")))


def parse_record(record: bytes) -> dict:
    """Fields of one record, its HTTP payload and the payload's own digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != RECORD_END:
        raise ValueError(f"record {fields['WARC-Record-ID']} has another length than it says")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return {"fields": fields, "payload": payload}


def _number(urn: str | None) -> int | None:
    value = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "payload_digest", "refers_to", "url", "own_bytes"]
    for batch in batches:
        rows = []
        for record in batch.column(0).to_pylist():
            parsed = parse_record(record)
            f = parsed["fields"]
            rows.append(
                (
                    _number(f["WARC-Record-ID"]), f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"),
                    _number(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), len(parsed["payload"]),
                )
            )
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, read back from its bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Every response's payload is hashed again and must match its digest, or the job
    fails. A revisit's size is that of the payload it refers to.
    """
    parsed = read_records(spark, path).select("record").mapInArrow(
        _parsed, "page_id bigint, record_type string, payload_digest string, refers_to bigint, url string, own_bytes bigint"
    )
    sizes = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select(
        F.col("digest").alias("_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes")
    )
    return parsed.join(sizes, F.col("payload_digest") == F.col("_digest")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
