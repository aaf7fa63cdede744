"""WARC archives of web pages: written by Spark, read back, and assembled into captures.

Each page is a transaction of three records: a response (or revisit), the
request, and a metadata record, the last two naming the first in
WARC-Concurrent-To. Pages of equal payloads of at least MIN_REVISIT bytes share
one response, that of the largest page_id; the others revisit it and carry the
headers only.

Archives are text files of whole records (a record ends with two line breaks,
which is Spark's line separator here), compressed; one file holds one
partition. They are read as binary files and cut by Content-Length, so payloads
may hold any text, record separators included.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

MIN_REVISIT = 1000
CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"   # fixed, so that archives are repeatable


def _id(kind: str) -> Column:
    """A record id from page_id, url and payload: equal rows share one."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
                          F.coalesce("url", F.lit("")), "digest").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record as one text, without its final separator. Headers with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid),
             F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write(pages: DataFrame, path: str) -> None:
    """Writes a transaction of three records for each row of ``pages`` (page_id, url, html).

    Null html is an empty payload, a null url an absent target. Of equal large
    payloads the rows of the largest page_id are responses (null ids count as the
    smallest); repeated rows are written each time. Line breaks in urls become blanks.
    """
    keyed = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", " ").alias("url"),
                         F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # Only payloads that repeat; counted by digest before anything is joined.
    shared = (pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                           F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
              .filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest")
              .agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1 and first is not null").drop("n"))
    rows = keyed.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rid = _id("capture")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    target = ("WARC-Target-URI", F.col("url"))
    to = [target, ("WARC-Concurrent-To", rid)]
    response = _record("response", rid, [target, digest, ("Content-Type", F.lit("application/http; msgtype=response"))],
                       F.concat(http, "html"))
    again = _record("revisit", rid, [target, digest, ("WARC-Profile", F.lit(
        "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To-Page", F.col("first").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    request = _record("request", _id("request"), [*to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(
        F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}")))
    metadata = _record("metadata", _id("metadata"), [*to, ("Content-Type", F.lit("application/warc-fields"))], F.concat_ws(
        CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"))))
    records = rows.select(F.concat_ws(CRLF + CRLF, F.when(revisit, again).otherwise(response), request, metadata).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse(archive: bytes):
    """(headers, block) of each record of an uncompressed archive, in order."""
    at = 0
    while at < len(archive):
        cut = archive.index(b"\r\n\r\n", at)
        lines = archive[at:cut].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start = cut + 4
        end = start + int(headers["content-length"])
        yield headers, archive[start:end]
        at = end + 4


def read(spark, path: str) -> DataFrame:
    """All records under ``path``: type, record_id, concurrent_to, target, digest, refers_to, block (binary)."""
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                unzip = zlib.decompressobj(31)
                archive = unzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows, size = [], 0
                for headers, block in parse(archive):
                    rows.append((headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-concurrent-to"),
                                 headers.get("warc-target-uri"), headers.get("warc-payload-digest"),
                                 headers.get("warc-refers-to-page"), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = ["type", "record_id", "concurrent_to", "target", "digest", "refers_to", "block"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, "type string, record_id string, concurrent_to string, target string, digest string, "
                                  "refers_to string, block binary")


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request and metadata structs.

    Requests and metadata join their response through concurrent_to, one of each
    per id, so that repeated captures stay as many as they are. A response without
    request or metadata has nulls there; records that name no response are left out.
    """
    def one(kind):
        named = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return named.groupBy("concurrent_to").agg(F.min(F.struct("record_id", "block")).alias(kind)).withColumnRenamed(
            "concurrent_to", "record_id")

    main = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "target", "digest", "refers_to", "block").alias("response"))
    return main.join(one("request"), "record_id", "left").join(one("metadata"), "record_id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages``, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    All values come from the records read. A response's payload is measured
    itself; a revisit has its size and digest from its headers.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    records = read(spark, path)
    # The payload follows the HTTP headers. Only its size and digest go into the joins.
    text = F.col("block")
    records = records.withColumn("head", F.when(F.col("type").isin("response", "revisit"), F.substring_index(
        F.decode(F.substring(text, 1, 1024), "ISO-8859-1"), CRLF + CRLF, 1)))
    body = F.substring(text, F.length("head") + 5, 2 ** 31 - 1)
    measured = records.select(
        "type", "record_id", "concurrent_to", "target", "refers_to",
        F.when(F.col("type") == "response", F.sha1(body)).when(F.col("type") == "revisit", F.substring_index("digest", ":", -1)).alias("digest"),
        F.when(F.col("type") == "response", F.octet_length(body).cast("long")).when(
            F.col("type") == "revisit", F.regexp_extract("head", r"Content-Length: (\d+)", 1).cast("long")).alias("bytes"),
        F.when(F.col("type") == "metadata", text).alias("block"))
    found = captures(measured.withColumn("block", F.when(
        F.col("type") == "metadata", F.col("block")).otherwise(F.encode(F.col("bytes").cast("string"), "UTF-8"))))
    page = F.regexp_extract(F.decode("metadata.block", "UTF-8"), r"(?m)^page-id: (-?\d+)", 1)
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.when(page != "", page).cast(kind).alias("page_id"),
        F.decode("response.block", "UTF-8").cast("long").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").cast(kind).alias("refers_to"))
