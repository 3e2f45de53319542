"""Flows in the shapes other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.scalars import PROTOCOLS, flags_text, ipv4_text, named, window_start

def json_records(flows: DataFrame, prefix: str = "ipfix.", formatted: bool = True, odid: bool = False, times: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """An object for each record: its present elements. formatted: protocol and flags by name, times as text, else
    numbers; odid and times add the domain and the start and end. keep: columns beside the object."""
    text = lambda c, shown: shown(c) if formatted else c
    shown = {"sourceIPv4Address": ipv4_text(F.col("e0id8")), "destinationIPv4Address": ipv4_text(F.col("e0id12")), "protocolIdentifier": text(F.col("e0id4"), lambda c: named(c, PROTOCOLS)), "tcpControlBits": text(F.col("e0id6"), flags_text), "octetDeltaCount": F.col("e0id1"), "packetDeltaCount": F.col("e0id2")}
    if times:
        shown |= {n: text(F.col(c), lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS")) for n, c in (("flowStartMilliseconds", "e0id152"), ("flowEndMilliseconds", "e0id153"))}
    more = [F.col("odid").alias(f"{prefix}odid")] if odid else []
    return flows.select(*(c.alias(n) for n, c in (keep or {}).items()), F.to_json(F.struct(F.lit("ipfix.entry").alias("@type"), *more, *(c.alias(f"{prefix}{n}") for n, c in shown.items()))).alias("json"))


def write_json_windows(flows: DataFrame, path: str, step: int = 300_000, time: str = "e0id153", **options) -> None:
    """Text files of a JSON object a line, in a folder for each window of step milliseconds, named by its beginning."""
    stamp = F.date_format(F.timestamp_millis(window_start(F.col(time), step)), "yyyyMMddHHmm")
    json_records(flows, keep={"window": stamp}, **options).repartition("window").write.partitionBy("window").text(path)


def unirec(flows: DataFrame) -> DataFrame:
    """One 16-byte address field for either version, IPv4 in its last 4 bytes, and the domain as a bit."""
    wide = lambda v4, v6: F.coalesce(F.lpad(F.hex(F.col(v4)), 32, "0"), F.hex(F.col(v6)))
    return flows.select(wide("e0id8", "e0id27").alias("SRC_IP"), wide("e0id12", "e0id28").alias("DST_IP"), F.col("e0id7").alias("SRC_PORT"), F.col("e0id11").alias("DST_PORT"), F.col("e0id4").alias("PROTOCOL"), F.col("e0id6").alias("TCP_FLAGS"), F.col("e0id1").alias("BYTES"), F.col("e0id2").alias("PACKETS"), F.expr("shiftleft(1L, cast(greatest(odid - 1, 0) as int))").alias("LINK_BIT_FIELD"))


def storable(flows: DataFrame) -> DataFrame:
    """The flows that have what a compact binary record needs: counters, protocol, addresses of a version and times."""
    return flows.filter("e0id1 IS NOT NULL AND e0id2 IS NOT NULL AND e0id4 IS NOT NULL AND e0id8 IS NOT NULL AND e0id12 IS NOT NULL AND e0id152 IS NOT NULL AND e0id153 IS NOT NULL")


def to_jdbc(flows: DataFrame, url: str, template: str, properties: dict[str, str]) -> None:
    flows.write.jdbc(url, f"Template{template}", "append", properties)


def kafka_rows(records: DataFrame, partitions: int) -> DataFrame:
    """json_records() for the Kafka sink, dealt over the topic's partitions."""
    return records.select(F.col("json").cast("binary").alias("value"), F.pmod(F.xxhash64("json"), F.lit(partitions)).cast("int").alias("partition"))
