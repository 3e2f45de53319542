"""WARC archives: written by Spark's text writer, read back by verified chains of record boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.sources.folders import new_folder

from .common import field, mapped, settle

MAGIC, END = b"WARC/1.", b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SMALL = 100_000  # digests that may be broadcast: 60 bytes each
FILE = 128 << 20  # bytes of records in a file, unless one record alone is larger


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 20 bits, hence 4 characters."""
    digest, out = F.sha1(column), []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, records: int = 4000) -> None:
    """Write a record for each row: a response with the payload, or a revisit of one with an equal payload.

    Of the rows with equal payloads of at least `least` bytes, those with the largest key are responses and
    the others revisit it; smaller payloads are always responses. Null payloads count as empty; rows
    with a null key are responses if no equal payload has a key, else revisits; line ends in a URL are
    percent-encoded. A file holds at most `records` records, and fewer where the largest payload is so large
    that they might come to more than FILE bytes; repeated rows are records of their own.
    """
    body = F.coalesce(field(payload), F.lit(""))
    rows = pages.select(field(key).alias("id"), F.coalesce(field(url), F.lit("")).alias("url"), body.alias("body"), F.octet_length(body).alias("size"), base32_sha1(body.cast("binary")).alias("digest"))
    largest = rows.agg(F.max("size")).first()[0] or 0
    records = max(1, min(records, FILE // (largest + 1024)))
    copies = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = settle(copies, "warc-copies")
    if copies.count() <= SMALL:
        copies = F.broadcast(copies)
    rows = rows.join(copies, "digest", "left")
    again = F.col("original").isNotNull() & (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("original"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", name("id")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name("original")), line("WARC-X-Payload-Length", F.col("size").cast("string")), F.lit("Content-Length: 0\r\n"))).otherwise(line("Content-Length", F.col("size").cast("string"))),
        F.lit("\r\n"), F.when(again, "").otherwise(F.col("body")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)
COLUMNS = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def candidates(data: bytes) -> Iterator[tuple]:
    """Each place where a record might begin, true or within a payload: its successor's place and its fields."""
    at, head = data.find(MAGIC), -1
    while at >= 0:
        if head < at:
            head = data.find(END, at)
            head = len(data) if head < 0 else head
        if head < len(data):
            fields = {k.lower(): v for k, v in FIELD.findall(data[at:head])}
            size = fields.get(b"content-length", b"")
            stop = head + len(END) + int(size) if size.isdigit() and len(size) < 16 else -1
            if stop >= 0 and data[stop : stop + len(END)] == END:
                text = lambda n: fields[n].decode("utf-8", "replace") if n in fields else None  # noqa: B023, E731
                kind, digest, length = text(b"warc-type"), (text(b"warc-payload-digest") or "").removeprefix("sha1:"), fields.get(b"warc-x-payload-length", b"")
                if kind == "revisit":
                    length = int(length) if length.isdigit() else None
                else:
                    length, digest = int(size), base64.b32encode(hashlib.sha1(data[head + len(END) : stop]).digest()).decode()
                yield at, stop + len(END), text(b"warc-record-id"), kind, text(b"warc-refers-to"), length, digest
        at = data.find(MAGIC, at + 1)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records the chain from offset 0 meets, by pointer jumping: each round doubles the steps taken."""
    order = np.argsort(offsets, kind="stable")
    places = offsets[order]
    jump = np.searchsorted(places, successors[order])
    jump[(jump < len(places)) & (places[np.minimum(jump, len(places) - 1)] != successors[order])] = len(places)
    jump = np.append(jump, len(places))  # the end of every chain
    met = np.zeros(len(places) + 1, bool)
    met[0] = len(places) > 0 and places[0] == 0
    for _ in range(int(len(places)).bit_length() + 1):
        met[jump[np.flatnonzero(met)]] = True
        jump = jump[jump]
    out = np.zeros(len(offsets), bool)
    out[order] = met[:-1]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path that the chain from each file's start reaches.

    Tasks look through files for places where a record might begin and emit each with its successor's place
    and its fields, but no payload; these are grouped by file and the chain is followed by pointer jumping.
    What begins within a payload is never reached; after a broken boundary a file's rest is left out.
    Files are those whose names end in .txt, .warc or .warc.gz. Returns record_id, record_type, refers_to,
    payload_bytes, payload_digest (of the payload as read; a revisit's as its header says). A folder without
    records gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc,warc.gz}").load(path).select("path", "content")
    names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found = list(candidates(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = [pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), *columns], ["file", "at", "next", *names])

    def follow(records: pa.Table) -> pa.Table:
        met = reachable(records.column("at").to_numpy(), records.column("next").to_numpy())
        return records.select(names).filter(pa.array(met))

    found = mapped(files, emit, f"file string, at long, next long, {COLUMNS}")
    return found.groupBy("file").applyInArrow(follow, COLUMNS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: a row for each page."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path, key, url, payload, least)
    page = lambda c: F.regexp_extract(c, "<urn:page:(.*)>", 1)
    kind = pages.schema[key].dataType
    number = lambda c: F.when(F.length(page(c)) > 0, F.when(page(c) != "null", page(c))).cast(kind)
    return read(spark, path).select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
