"""Counters of flows by time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.scalars import window_start

PROTOCOLS = {"tcp": (6,), "udp": (17,), "icmp": (1, 58)}


def counters() -> list[Column]:
    """Flows, packets and bytes of all flows and of TCP, UDP, ICMP and others (without a protocol: others)."""
    named = [n for numbers in PROTOCOLS.values() for n in numbers]
    which = {"total": F.lit(True)} | {k: F.coalesce(F.col("e0id4").isin(*v), F.lit(False)) for k, v in PROTOCOLS.items()} | {"other": ~F.coalesce(F.col("e0id4").isin(*named), F.lit(False))}
    out = []
    for k, met in which.items():
        out += [F.count_if(met).alias(f"flows_{k}"), F.coalesce(F.sum(F.when(met, F.col("e0id2"))), F.lit(0)).alias(f"packets_{k}"), F.coalesce(F.sum(F.when(met, F.col("e0id1"))), F.lit(0)).alias(f"bytes_{k}")]
    return out


def by_window(flows: DataFrame, keys: tuple[str, ...] = ("odid",), step: int = 300_000, time: str = "e0id153") -> DataFrame:
    return flows.groupBy(*keys, window_start(F.col(time), step).alias("window_start")).agg(*counters())


def by_channel(classified: DataFrame, step: int = 300_000) -> DataFrame:
    """Counters and most and mean (in whole numbers) packets and bytes a flow, of each channel; flows that lack
    protocol, bytes or packets don't count."""
    whole = classified.filter("e0id4 IS NOT NULL AND e0id1 IS NOT NULL AND e0id2 IS NOT NULL")
    each = whole.select("*", F.explode("channels").alias("c")).select("*", "c.profile", "c.channel")
    more = [F.max("e0id2").alias("packets_max"), F.max("e0id1").alias("bytes_max"), F.expr("sum(e0id2) div count(*)").alias("packets_avg"), F.expr("sum(e0id1) div count(*)").alias("bytes_avg")]
    return each.groupBy("profile", "channel", window_start(F.col("e0id153"), step).alias("window_start")).agg(*counters(), *more)


def consolidate(series: DataFrame, keys: tuple[str, ...], value: str, step: int, times: int) -> DataFrame:
    """Mean and maximum of a series over windows of `times` steps; steps without rows don't count."""
    return series.groupBy(*keys, window_start(F.col("window_start"), step * times).alias("window_start")).agg(F.avg(value).alias(f"{value}_avg"), F.max(value).alias(f"{value}_max"))


def losses(messages: DataFrame, source: str, sequence: str, records: str, order: str, step: int = 1 << 20) -> DataFrame:
    """For each source the records received and those its sequence numbers (of 32 bits, wrapping) say were sent
    between the first message and the last, with the gaps between neighbours.

    Neighbours are found within slices of `step` of the order, and then between a slice's last message and the
    next slice's first: one row a slice, so a busy source is many groups.
    """

    def gap(due: Column) -> Column:
        missing = F.pmod(F.col(sequence) - due, F.lit(1 << 32))
        return F.coalesce(F.when(missing < 1 << 31, missing).otherwise(0), F.lit(0))  # a step back is a message out of order

    sliced = messages.withColumn("__slice", F.floor(F.col(order) / step)).withColumn("__due", F.col(sequence) + F.col(records))
    within = Window.partitionBy(source, "__slice").orderBy(order)
    sliced = sliced.withColumn("__gap", gap(F.lag("__due").over(within)))
    each = sliced.groupBy(source, "__slice").agg(F.sum(records).alias("received"), F.sum("__gap").alias("lost"), F.min_by(sequence, order).alias(sequence), F.max_by("__due", order).alias("__due"))
    between = Window.partitionBy(source).orderBy("__slice")
    each = each.withColumn("__gap", gap(F.lag("__due").over(between)))
    return each.groupBy(source).agg(F.sum("received").alias("received"), F.sum(F.col("lost") + F.col("__gap")).alias("lost"))


def merged(parts: DataFrame, keys: tuple[str, ...] = ("odid", "window_start")) -> DataFrame:
    """Statistics of several tables as one: every counter added up by its keys."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in keys))
