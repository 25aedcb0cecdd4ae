"""Content-addressed WARC archive.

A page becomes one WARC record. The archive keeps two tables: ``payloads`` holds the bytes of each distinct payload
once, zstd-compressed, under its SHA-256; ``records`` holds the exact header bytes of every record and the digest that leads to its
payload. The original record is their join. Digests are computed again when an archive is read, and a payload that no
longer has its digest stops the read.

Defined cases: a null payload counts as empty; equal payloads (of at least ``min_revisit_bytes``) have one response,
the row with the largest page_id, and revisits; rows that repeat this page_id are responses too; null page_ids come
below all others; line breaks in a URL are percent-encoded, a null URL is left out; an empty table gives an empty
archive; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.session import shared_path

#: Fixed values of the format: RFC 4648 digits against those of base 32 numbers, and the revisit profile.
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
RECORD_ID = "urn:x-page:"
END = "\r\n\r\n"
#: Of zstd: payloads are moved twice and stored once.
LEVEL = 9


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_FROM, BASE32_TO)


def _digests(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest")
    )


def _headers() -> Column:
    """The header text of a record, up to where a response's payload starts."""
    crlf, response = F.lit("\r\n"), F.col("is_response")
    http = F.concat(F.lit(HTTP + "Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    length = F.length(http) + F.when(response, F.col("n_bytes")).otherwise(0)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit(f"WARC-Record-ID: <{RECORD_ID}"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit("1970-01-01T00:00:00Z")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, f"WARC-Profile: {PROFILE}"),
        F.when(~response, F.concat(F.lit(f"WARC-Refers-To: <{RECORD_ID}"), F.col("owner").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), crlf, crlf, http)


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0
) -> str:
    """Writes ``path``/records and ``path``/payloads; returns ``path``.

    Only digests, ids and lengths meet in the search for the owner of a payload, in a two-step aggregation; payload
    bytes are shuffled once, and only those of responses.
    """
    rows = _digests(pages, id_col, url_col, payload_col)
    small = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    owners = small.groupBy("digest").agg(F.max("page_id").alias("owner"))
    known = small.join(owners, "digest").withColumn(
        "is_response", F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("n_bytes") < min_revisit_bytes)
    )
    known.select("page_id", "digest", "is_response", F.encode(_headers(), "UTF-8").alias("headers")).write.parquet(f"{path}/records")
    # Of a payload only the owner's row is moved, compressed; the key that deals it out also drops equal rows of one owner.
    key = lambda digest, page: F.concat(F.col(digest), F.lit(":"), F.coalesce(F.col(page).cast("string"), F.lit("")))
    packed = rows.select("page_id", "payload", "digest").mapInArrow(_pack, f"page_id {rows.schema['page_id'].dataType.simpleString()}, payload binary, digest string")
    kept = packed.select("payload", key("digest", "page_id").alias("key")).join(owners.select(key("digest", "owner").alias("key")), "key", "left_semi")
    kept.dropDuplicates(["key"]).select(F.substring_index("key", ":", 1).alias("digest"), "payload").write.parquet(f"{path}/payloads")
    return path


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        payload = pa.array([press.compress(x.as_buffer()) for x in batch.column("payload")], pa.binary())
        yield pa.record_batch([batch.column("page_id"), payload, batch.column("digest")], names=["page_id", "payload", "digest"])


def _join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records from headers and compressed payloads, whose digests are verified."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):  # bounds what is open at once
            records = []
            for digest, headers, payload in zip(*(row.column(x).to_pylist() for x in ("digest", "headers", "payload"))):
                payload = open_.decompress(payload)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload differs from its digest {digest}")
                records.append(headers + payload + END.encode())
            yield pa.record_batch([row.column("digest"), pa.array([True] * len(records)), pa.array(records, pa.binary())], names=["digest", "is_response", "record"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: (digest, is_response, record), record being the exact bytes. A payload that doesn't have its digest raises."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    whole = records.where("is_response").select("digest", "headers").join(payloads, "digest").mapInArrow(_join_bytes, "digest string, is_response boolean, record binary")
    return whole.unionByName(records.where("not is_response").select("digest", "is_response", F.concat("headers", F.lit(END).cast("binary")).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records by the WARC grammar: type, ids, digest and, for responses, the payload by Content-Length."""
    # ISO-8859-1 maps each byte to one character, so that offsets in text are offsets in bytes.
    text = records.withColumn("text", F.decode("record", "ISO-8859-1"))
    head = text.withColumn("head", F.substring_index("text", END, 1))
    http = head.withColumn("block", F.expr(f"substring(text, length(head) + 5, cast(regexp_extract(head, '(?md)^Content-Length: (\\\\d+)', 1) as int))")).drop("text", "record")

    def field(name: str, pattern: str) -> Column:
        # Unix lines: by Java's other rule a line also ends at 0x85, a byte of UTF-8 texts.
        return F.nullif(F.regexp_extract("head", f"(?md)^{name}: {pattern}\r?$", 1), F.lit(""))

    return http.select(
        field("WARC-Record-ID", f"<{RECORD_ID}(-?\\d+)>").cast("long").alias("page_id"),
        field("WARC-Type", "(\\S+)").alias("record_type"),
        F.decode(F.encode(field("WARC-Target-URI", "([^\r\n]*)"), "ISO-8859-1"), "UTF-8").alias("url"),
        field("WARC-Payload-Digest", "sha1:(\\S+)").alias("payload_digest"),
        field("WARC-Refers-To", f"<{RECORD_ID}(-?\\d+)>").cast("long").alias("refers_to"),
        "digest",
        "is_response",
        F.when(F.col("is_response"), F.encode(F.expr("substring(block, instr(block, '\\r\\n\\r\\n') + 4)"), "ISO-8859-1")).alias("payload"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``pages``: written as an archive in the shared folder, read back, parsed."""
    path = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    parsed = parse_records(read_records(spark, path))
    kept = (
        parsed.where("is_response")
        .select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("found"))
        .groupBy("digest")
        .agg(F.max("payload_bytes").alias("payload_bytes"), F.max("found").alias("found"))
    )
    lines = parse_records(_without_payloads(spark, path)).drop("payload")
    checked = F.when(F.col("payload_digest") == F.col("found"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("digest of record "), F.col("page_id").cast("string"), F.lit(" isn't that of its payload")))
    )
    return lines.join(kept, "digest").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "url")


def _without_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records").select("digest", F.lit(False).alias("is_response"), F.col("headers").alias("record"))


OP9_SQL = """
with p as (select page_id, url, coalesce(html, '') html from pages),
d as (select page_id, url, octet_length(encode(html)) n, upper(sha1(html)) h, max(page_id) over (partition by html) m from p),
b as (select *, list_aggregate(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), 'string_agg', '') s from d)
select page_id, cast(n as bigint) payload_bytes, s payload_digest, case when page_id = m then 'response' else 'revisit' end record_type,
  case when page_id <> m then m end refers_to, url from b
"""
