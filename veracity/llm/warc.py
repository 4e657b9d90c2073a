"""Operator 10: content-addressed WARC archive.

Payload bytes are stored once under a verified strong digest; the exact header block of each
record is kept apart; the original records come back through a join of the two, and go to WARC files and back: a
revisit has no bytes there, and what it says of its payload is held against the response it refers to.

Cases: a very long payload is one record like others, and may hold line ends or what looks like a record; a null payload is empty; equal payloads of at least `least` bytes become one response
(the smallest id) and revisits; shorter ones are all responses; repeated rows of one id are
records of their own that share an id (all of the responding id's rows are responses); rows without
an id come last: they are revisits of the smallest id where a row with one holds the payload, and else
all responses, and their record id is <urn:page:none>; an empty table gives an empty archive; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, can_checkpoint

#: The base 32 alphabet of RFC 4648 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: every 5 hex digits give 4 characters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per record: page_id, key (SHA-256 of the payload and its length), header, digest,
    bytes, type and the page it refers to. Payloads themselves don't move."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"), F.concat_ws("-", F.sha2(payload, 256), F.octet_length(payload)).alias("key"))
    # Only keys of several records; checkpointed, so that Spark can split a payload that many pages have in the join.
    can_checkpoint(pages.sparkSession)
    first = rows.groupBy("key").agg(F.min("page_id").alias("least_id"), F.count("*").alias("n")).where("n > 1").checkpoint()
    rows = rows.join(first, "key", "left").withColumn("first_id", F.when(F.col("n") > 1, F.col("least_id")).otherwise(F.col("page_id")))
    revisit = (F.coalesce("n", F.lit(1)) > 1) & (F.col("payload_bytes") >= least) & F.coalesce(F.col("page_id") > F.col("first_id"), F.col("first_id").isNotNull())
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:page:none")), r"[\x00-\x20\x7F]", "%20")
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), identity(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), identity(F.col("first_id")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return rows.select("page_id", "key", header.alias("header"), "payload_bytes", "payload_digest", "record_type", "refers_to", "first_id")


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write `path`/headers (one exact header block per record) and `path`/payloads (the bytes,
    once for each digest: those of the smallest id)."""
    heads = records(pages, least)
    heads.select("page_id", "key", "header").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # The smallest id of each key, found without moving payloads; its other copies fall out here. An
    # id that may be missing is two plain columns, so that join and grouping share one exchange.
    place = lambda c: (F.coalesce(F.col(c), F.lit(0)).alias("id"), F.col(c).isNull().alias("none"))
    keyed = pages.select(*place("page_id"), payload.alias("payload")).withColumn("key", F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload")))
    keep = heads.select("key", *place("first_id")).distinct()
    once = keyed.join(keep, ["key", "id", "none"])
    # Rows that repeat the responding id hold the same payload: one of them is enough.
    once.groupBy("key", "id", "none").agg(F.any_value("payload").alias("payload")).select("key", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild each record: (page_id, header, payload). A payload whose bytes don't give the
    digest they are stored under raises."""
    heads = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload")) == F.col("key")
    stored = stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest: "), F.col("key")))))
    return heads.join(stored, "key", "left").select("page_id", "header", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing: "), F.col("key"))).cast("binary")).alias("payload"))


def export_warc(archive: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """The records as gzip WARC files (payloads are UTF-8, so Spark's text sink writes exact bytes)."""
    revisit = F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    # The sink's line end is the second of the two that close a record.
    archive.select(F.concat("header", body, F.lit(CRLF)).alias("value")).write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload) of the records in gzip WARC files that export_warc() wrote; a revisit's payload is empty. A record is
    what its Content-Length says. Spark reads such a file in one task, from its first line to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, body, left, skip, out, size = [], [], -1, False, [], 0
        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                if skip:  # the line end that closes a record
                    skip = False
                elif left >= 0:
                    body.append(line)
                    left -= len(line) + (2 if len(body) > 1 else 0)
                    if left <= 0:
                        if left:
                            raise ValueError("a record is longer than its Content-Length")
                        out.append((b"\r\n".join([*head, b"", b""]).decode(), b"\r\n".join(body)))
                        size += len(out[-1][1])
                        head, body, left, skip = [], [], -1, True
                elif line:
                    head.append(line)
                else:
                    left = next(int(h[15:]) for h in head if h.startswith(b"Content-Length:"))
            if size > SLICE_BYTES or len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out]), pa.array([b for _, b in out], pa.binary())], names=["header", "payload"])
                out, size = [], 0
        if head or left >= 0:
            raise ValueError("a record is cut short")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out]), pa.array([b for _, b in out], pa.binary())], names=["header", "payload"])

    lines = spark.read.option("lineSep", CRLF).text(path)
    found = F.regexp_extract("header", r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n", 1)
    return lines.mapInArrow(run, "header string, payload binary").select(F.when(found != "", found.cast("long")).alias("page_id"), "header", "payload")


def described_files(records: DataFrame) -> DataFrame:
    """described() of import_warc(): bytes and digest of a revisit are those of the response it refers to."""
    own = described(records)
    answers = own.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    revisit = F.col("record_type") == "revisit"
    told = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([^\r]*)\r\n", 1)
    named = described(records, told).where(revisit).drop("payload_bytes", "digest_ok")
    can_checkpoint(records.sparkSession)
    found = named.join(answers.checkpoint(), (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    found = found.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("_id").isNotNull().alias("digest_ok"))
    return own.where(~revisit).unionByName(found)


def described(archive: DataFrame, digest: Column | None = None) -> DataFrame:
    """What the rebuilt records say of themselves, with bytes and digest (if none is given) of the full payload."""
    digest = base32_sha1(F.col("payload")) if digest is None else digest
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n", 1)
    return archive.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        (F.concat(F.lit("sha1:"), digest) == field("WARC-Payload-Digest")).alias("digest_ok"),
    )
