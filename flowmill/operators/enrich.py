"""Lookups that add columns to flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.sources.flows import element


def apart(flows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The flows with a key, which a join deals out by it, and those without, which would all meet in one task."""
    return flows.filter(F.col(key).isNotNull()), flows.filter(F.col(key).isNull())


def hardware_address(flows: DataFrame, leases: DataFrame, ip: str = "sa4", mac: str = "smac") -> DataFrame:
    """The address that leases (ip, mac) has for a flow's IP, 0 if it has none; null IPs get null."""
    ip, mac = element(ip), element(mac)
    one = leases.groupBy(F.col("ip").alias("__ip")).agg(F.max("mac").cast("long").alias("__mac"))
    known, rest = apart(flows.drop(mac), ip)
    out = known.join(one, F.col(ip) == F.col("__ip"), "left").withColumn(mac, F.coalesce("__mac", F.lit(0).cast("long"))).drop("__ip", "__mac")
    return out.unionByName(rest.withColumn(mac, F.lit(None).cast("long")))


def user_at(flows: DataFrame, log: DataFrame, ip: str = "sa4", name: str = "srcName", slice_seconds: int = 86_400) -> DataFrame:
    """Who was logged in at a flow's IP when it began: the name of the last entry of log (ip, time in seconds,
    action, name) up to then, if its action is 1; else an empty text.

    Flows and entries are one stream by (ip, slice of time, time), in which the last entry is carried on; each
    slice begins with the last entry of the slices before it, found from one row a slice. So an address
    that is busy for long is many groups. Flows without an IP don't take part.
    """
    ip = element(ip)
    kept, rest = apart(flows, ip)
    seconds = F.floor(F.col("e0id152") / 1000).cast("long")
    slice_of = lambda at: F.floor(at / slice_seconds).cast("long")
    events = log.select(F.col("ip").alias("__ip"), F.col("time").cast("long").alias("__at"), F.struct("action", "name").alias("__entry")).withColumn("__slice", slice_of(F.col("__at")))
    asked = kept.select(F.col(ip).alias("__ip"), seconds.alias("__at"), F.lit(1).alias("__is"), F.struct(*flows.columns).alias("__flow")).withColumn("__slice", slice_of(F.col("__at")))
    last = events.groupBy("__ip", "__slice").agg(F.max_by("__entry", "__at").alias("__entry"))
    slices = last.unionByName(asked.select("__ip", "__slice").distinct(), allowMissingColumns=True)
    before = Window.partitionBy("__ip").orderBy("__slice").rangeBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__entry", F.last("__entry", True).over(before)).filter("__entry IS NOT NULL")
    carried = carried.select("__ip", "__slice", "__entry", (F.col("__slice") * slice_seconds).alias("__at"), F.lit(-1).alias("__is"))
    within = Window.partitionBy("__ip", "__slice").orderBy("__at", "__is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.withColumn("__is", F.lit(0)).unionByName(carried).unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("__entry", F.last("__entry", True).over(within)).filter("__is = 1")
    got = F.when(F.col("__entry.action") == 1, F.col("__entry.name")).otherwise("")
    return both.select("__flow.*", F.coalesce(got, F.lit("")).alias(name)).unionByName(rest.withColumn(name, F.lit("")))


def country(flows: DataFrame, blocks: DataFrame, ip: str = "sa4", out: str = "srcCountry", bits: int = 16) -> DataFrame:
    """The code of the block (lo, hi, code; apart from each other) that holds a flow's IP, else 0.

    A range join as an equality join on the high bits: each block stands in every bucket it touches. IPv4
    blocks are of numbers; IPv6 ones, of 16-byte strings, are found by their first 4 bytes.
    """
    ip = element(ip)
    if dict(flows.dtypes)[ip] == "binary":
        high = lambda c: F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long")
    else:
        high = lambda c: F.floor(c / (1 << bits)).cast("long")
    spread = blocks.select(F.explode(F.sequence(high(F.col("lo")), high(F.col("hi")))).alias("__bucket"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("code").alias("__code"))
    known, rest = apart(flows, ip)
    on = (high(F.col(ip)) == F.col("__bucket")) & F.col(ip).between(F.col("__lo"), F.col("__hi"))
    found = known.join(spread, on, "left").withColumn(out, F.coalesce("__code", F.lit(0))).drop("__bucket", "__lo", "__hi", "__code")
    return found.unionByName(rest.withColumn(out, F.lit(0)))
