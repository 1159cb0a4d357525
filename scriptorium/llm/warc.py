"""WARC as a content-addressed archive.

Payload bytes are stored once, under their SHA-256; record headers are stored separately, byte for byte;
records are put together again by joining the two. `write_archive` makes the two tables in a folder,
`read_archive` verifies every payload against its address, `records` returns whole records and
`export_warc` writes them as WARC files that other tools read.

Of records with equal payloads the one with the largest id carries the payload (response); the others are revisits
that refer to it. Defined cases: null payload is empty; null url becomes an empty target; a null id gets no
record id but a record; empty tables make empty archives. Repeated rows (the same id and payload twice) are a response each.
Hot payloads: the representative is a partially aggregated max; only (id, digest) rows meet in the join, which AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CRLF = "\r\n"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 4 base-32 ones."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def with_digests(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    d = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), data.alias("payload"))
    return d.withColumns({"address": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("bigint")})


def header(kind: Column, page_id: Column, url: Column, digest: Column, size: Column, refers: Column) -> Column:
    uri = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), F.coalesce(line("WARC-Record-ID", uri(page_id)), F.lit("")), line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, F.lit(0).cast("bigint")).otherwise(size).cast("string")),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    """<path>/payloads (address, payload) once per payload, <path>/headers (header bytes, address) once per record.

    Payloads of fewer than `least` bytes are never shared by revisits.
    """
    d = with_digests(pages, page_id, url, payload)
    facts = d.select("page_id", "url", "bytes", "address", sha1_base32(F.col("payload")).alias("digest"))
    owners = stored(facts.groupBy("address").agg(F.max("page_id").alias("owner")), "owners")  # a table of its own, so that the join can split a hot payload
    kind = F.when((F.col("bytes") >= least) & (F.col("page_id") != F.col("owner")), "revisit").otherwise("response")
    rows = facts.join(owners, "address").withColumn("kind", F.coalesce(kind, F.lit("response")))
    rows.select(header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("bytes"), F.col("owner")).alias("header"), "address").write.parquet(f"{path}/headers")
    # an owner's id is its own key: no hot key here. Ids may repeat, with other payloads or the same: the address decides, one copy stays.
    mine = owners.select(F.col("owner").alias("__o"), F.col("address").alias("__a"))
    twice = not facts.groupBy("page_id", "address").count().where("count > 1").isEmpty()
    once = d.join(mine, d["page_id"].eqNullSafe(F.col("__o")) & (d["address"] == F.col("__a")), "left_semi").select("address", "payload")
    (once.dropDuplicates(["address"]) if twice else once).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: header fields, and size and digest of the payload as read; fails on a payload that doesn't match its address."""
    h = spark.read.parquet(f"{path}/headers").withColumn("text", F.col("header").cast("string"))
    field = lambda name, value="[^\r]*": F.nullif(F.regexp_extract("text", f"\r\n{name}: ({value})\r\n", 1), F.lit(""))
    uri = lambda name: F.regexp_extract("text", f"\r\n{name}: <urn:page:([^>]*)>\r\n", 1)
    rows = h.select("address", "header", F.nullif(uri("WARC-Record-ID"), F.lit("")).cast("bigint").alias("page_id"), field("WARC-Type").alias("record_type"), F.nullif(uri("WARC-Refers-To"), F.lit("")).cast("bigint").alias("refers_to"), field("WARC-Payload-Digest").alias("declared"))
    p = spark.read.parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload doesn't match its address "), F.col("address"))).cast("bigint")
    p = p.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.octet_length("payload").cast("bigint")).otherwise(bad).alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    out = rows.join(p, "address", "left")
    wrong = F.raise_error(F.concat(F.lit("no payload, or another digest, for "), F.col("address"))).cast("string")
    return out.withColumn("payload_digest", F.when(F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("declared"), F.col("payload_digest")).otherwise(wrong))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records as bytes: header, blank line, payload (of responses), two line ends."""
    h = spark.read.parquet(f"{path}/headers")
    full = h.where(~F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")).join(spark.read.parquet(f"{path}/payloads"), "address", "left")
    bare = h.where(F.col("header").cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")).withColumn("payload", F.lit(b""))
    end = F.lit(CRLF.encode())
    return full.unionByName(bare).select(F.concat("header", end, "payload", end, end).alias("record"))


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """The records as WARC text files: each ends in two line ends, which the writer puts between rows."""
    r = records(spark, path).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    r.write.option("lineSep", CRLF * 2).text(target)


def op7(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    write_archive(pages, path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
