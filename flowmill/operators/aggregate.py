"""Aggregation of flows: default functions by element, partition classes, totals, shares and top-N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.sources.flows import element

FIVE_TUPLE = ("sa4", "da4", "sa6", "da6", "sp", "dp", "pr")  # the keys of an aggregation without named ones
DEFAULTS = {"e0id152": F.min, "e0id153": F.max, "e0id1": F.sum, "e0id2": F.sum}


def aggregate(flows: DataFrame, keys: tuple[str, ...] = (), values: tuple[str, ...] = ("ts", "te", "pkt", "byt"), having: Column | None = None) -> DataFrame:
    """Group by elements, each value by its own function (first start, last end, sums), with the number of flows.

    Rows are grouped apart by which of the keys they have at all; those that have none of them, or lack a
    value that is summed up, are left out.
    """
    keys, values = tuple(map(element, keys)), tuple(map(element, values))
    for v in values:
        flows = flows.filter(F.col(v).isNotNull())
    if keys:
        flows = flows.filter(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys]))
    out = flows.groupBy(*keys).agg(*(DEFAULTS[v](v).alias(v) for v in values), F.count("*").alias("flows"))
    return out if having is None else out.filter(having)


def with_rates(aggregated: DataFrame) -> DataFrame:
    """Duration and rates over sums: bytes and packets a millisecond, bytes a packet; null over nothing."""
    td = F.col("e0id153") - F.col("e0id152")
    return aggregated.select("*", td.alias("td"), F.try_divide(F.col("e0id2"), td).alias("pps"), F.try_divide(F.col("e0id1"), td).alias("bps"), F.try_divide("e0id1", "e0id2").alias("bpp"))


def top_n(flows: DataFrame, key: str, order: str = "flows", n: int = 10) -> DataFrame:
    """The n largest groups, ties by key, with their share of all in per cent; the totals are of all groups.

    Groups and totals come of one scan and one shuffle: the total is a rollup's, the first of the n + 1 best rows.
    """
    key, order = element(key), element(order)
    kept = flows.filter(F.col(key).isNotNull())
    for v in DEFAULTS:
        kept = kept.filter(F.col(v).isNotNull())
    rolled = kept.rollup(key).agg(*(f(v).alias(v) for v, f in DEFAULTS.items()), F.count("*").alias("flows"), F.grouping(key).alias("__whole"))
    best = rolled.orderBy(F.desc("__whole"), F.desc(order), F.asc(key)).limit(n + 1)
    whole = F.max(F.when(F.col("__whole") == 1, F.col(order))).over(Window.partitionBy(F.lit(1)))  # n + 1 rows
    return best.withColumn("percent", F.round(100.0 * F.col(order) / whole, 1)).filter("__whole = 0").drop("__whole")
