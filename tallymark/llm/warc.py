"""A content-addressed WARC archive.

``write`` keeps two tables in the shared folder: payloads (bytes once per SHA-256
digest; every group is verified to be of one length and one second hash) and
records (the exact header of each page's WARC record, in its own row). The page
with the largest page_id of a group of equal payloads of at least
``least_bytes`` bytes is the response, the others revisit it; smaller payloads
are all responses, each of which refers to the one stored copy. ``read`` rebuilds
every record by joining headers with payloads, checks the digest again and takes
all fields from the rebuilt bytes.

A record's id holds its page_id (none if null) and its number, so ids of repeated
pages differ. A null html is the empty payload, a null url an empty target. Among rows of one
largest page_id one is the response. A page_id may be null; it is never the
response of others unless all are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def write(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(records: nr, page_id, digest, header; payloads: digest, payload, payload_bytes).

    date: the records' WARC-Date (pages state none; fixed unless given, so that runs repeat).
    """
    p = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    meta = settle(p.select(F.monotonically_increasing_id().alias("nr"), "page_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "warc-meta")
    second = F.xxhash64("payload")
    store = p.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(second).alias("x"), F.max(second).alias("y"), F.min(F.octet_length("payload")).alias("a"), F.max(F.octet_length("payload")).alias("b"))
    same = F.when((F.col("x") == F.col("y")) & (F.col("a") == F.col("b")), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    payloads = settle(store.select("digest", same.alias("payload"), F.col("a").cast("long").alias("payload_bytes")), "warc-payloads")
    kept = meta.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "nr")).alias("k")).select(F.col("digest").alias("d"), F.col("k.page_id").alias("keeper"), F.col("k.nr").alias("keeper_nr"))
    r = meta.join(kept, F.col("digest") == F.col("d"), "left")
    revisit = F.col("keeper_nr").isNotNull() & (F.col("keeper_nr") != F.col("nr"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record_id = lambda c, nr: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), nr.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("nr"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("keeper"), F.col("keeper_nr"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return settle(r.select("nr", "page_id", "digest", revisit.alias("revisit"), header.alias("header")), "warc-records"), payloads


def read(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """nr, page_id, record (the record's bytes), payload_bytes, payload_digest, record_type, refers_to."""
    full, sizes = payloads.withColumnRenamed("digest", "d"), payloads.select(F.col("digest").alias("d"), "payload_bytes")
    a = records.where(~F.col("revisit")).join(full, F.col("digest") == F.col("d"))
    b = records.where(F.col("revisit")).join(sizes, F.col("digest") == F.col("d")).withColumn("payload", F.lit(b""))
    rows = a.select("nr", "page_id", "header", "payload", "payload_bytes").union(b.select("nr", "page_id", "header", "payload", "payload_bytes"))
    got = lambda name: F.regexp_extract("header", rf"(?m)^{name}: ?([^\r\n]*)", 1)
    kind, stated = got("WARC-Type"), F.regexp_extract(got("WARC-Payload-Digest"), "sha1:(.*)", 1)
    refers = F.regexp_extract(got("WARC-Refers-To"), "<urn:page:(-?[0-9]+):[0-9]+>", 1)
    true = F.when(kind == "revisit", stated).otherwise(base32_sha1(F.col("payload")))
    digest = F.when(true == stated, true).otherwise(F.raise_error(F.lit("a record's payload does not match its digest")).cast("string"))
    size = F.when(kind == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long"))
    record = F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.lit(b"\r\n\r\n"))
    return rows.select("nr", F.regexp_extract("header", "(?m)^WARC-Record-ID: <urn:page:(-?[0-9]+):[0-9]+>", 1).try_cast("long").alias("page_id"), record.alias("record"), size.alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), refers.try_cast("long").alias("refers_to"))
