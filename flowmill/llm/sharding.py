"""Contiguous shards of equal bytes, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Cut the documents, in the order of key, into contiguous shards of near equal bytes.

    The rows are dealt by ranges of the key and written; each partition's rows and bytes are summed, the
    prefix sums of these few totals give every partition's place, and a window within the partition gives
    every row's. A row goes to the shard in whose equal share its middle byte lies, so a border is off by
    half a row at most. Only the totals, one row for each partition, pass through one task.

    Returns key, size, text_crc32, shard, slot (gapless from 0 within the shard). Null texts have only the
    overhead as size and no bytes in their crc32 (0); null keys come first; rows alike in key and text are
    neighbours in any order; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("crc"),
        # equal keys, however many, are spread over the ranges by this
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "k", "crc", "salt").withColumn("part", F.spark_partition_id())
    dealt = settle(dealt, "sharding")

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = totals.select("part", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    whole = totals.agg(F.sum("bytes").alias("all_bytes"))

    within = Window.partitionBy("part").orderBy("k", "crc", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("end", F.sum("size").over(within))
        .withColumn("nth", F.count(F.lit(1)).over(within))
        .join(F.broadcast(before), "part")  # a row for each partition
        .join(F.broadcast(whole))  # one row
    )
    middle = F.col("bytes_before") + F.col("end") - F.expr("size div 2") - F.lit(1)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.col("all_bytes"))).cast("int"))
    placed = placed.withColumn("index", F.col("rows_before") + F.col("nth") - 1)
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("index") - F.col("first")).cast("long").alias("slot")
    )
