"""Keeping stored flows: compaction, expiry and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_flows(flows: DataFrame, path: str, by: tuple[str, ...] = ("odid", "window_start"), indexed: tuple[str, ...] = ("e0id8", "e0id12"), records: int = 0) -> None:
    """A partitioned table; files carry Bloom filters of the indexed columns, and rows are sorted for statistics.

    A folder is written by as many tasks as its size asks for: a busy domain does not gather in one sort.
    """
    writer = flows.hint("rebalance", *by).sortWithinPartitions(*by, *indexed).write.partitionBy(*by).option("maxRecordsPerFile", records)
    for c in indexed:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
    writer.parquet(path)


def compact(spark: SparkSession, source: str, target: str, step: int, by: tuple[str, ...] = ("odid", "window_start")) -> None:
    """Rewrite a table in windows of step milliseconds, each in as few files as its size asks for."""
    rows = spark.read.parquet(source)
    coarse = rows.withColumn("window_start", (F.col("window_start") - F.pmod("window_start", F.lit(step))).cast("long"))
    coarse.hint("rebalance", *by).write.partitionBy(*by).parquet(target)


def between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The flows of the windows from first to last, both included: only their folders are listed and read."""
    return spark.read.parquet(path).filter(F.col("window_start").between(first, last))


def several(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Flows of several tables, wherever they are; elements that one lacks are null."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def expired(folders: DataFrame, most: int, key: str = "window_start", size: str = "bytes") -> DataFrame:
    """The oldest folders that must go for the others to have at most `most` bytes; the newest always stays."""
    newer = Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each folder
    before = Window.orderBy(F.desc(key))
    return folders.withColumn("kept_bytes", F.sum(size).over(newer)).withColumn("__n", F.row_number().over(before)).filter((F.col("kept_bytes") > most) & (F.col("__n") > 1)).drop("__n")


def described(flows: DataFrame) -> DataFrame:
    """For each column how many rows have it, in one pass."""
    counts = flows.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in flows.columns))
    return counts.unpivot(["rows"], flows.columns, "element", "present").select("element", "rows", "present")
