"""What the corpus operators share: tables, cut lineage, and bytes of Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.sources.folders import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(), with batches of BATCH bytes unless the session asks for other ones: a batch is held
    whole by the executor and by its worker, and 10,000 long texts would be much."""
    if df.sparkSession.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_KEY, BATCH)
    names, dotted = df.columns, any("." in n for n in df.columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run((pa.RecordBatch.from_arrays(b.columns, names) for b in batches) if dotted else batches)
        give_back()

    # mapInArrow() can't take names with dots
    return (df.toDF(*(f"c{k}" for k in range(len(names)))) if dotted else df).mapInArrow(whole, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should hold none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*settled: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def field(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold -1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(-1))


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, joined, and each row's bounds; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about limit bytes of the named column; a longer row comes alone."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(name)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread bits from any 64-bit key."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each word [^\\x20\\x09-\\x0D]+ in joined rows; words do not cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = inner[inner > 0] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(at, starts, "right") - 1


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_CODES = _byte_codes()
_ODD = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 15  # bytes of tokens that are hashed at once


def token_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes, the same in every task and run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    if len(power) > 1:
        power[1:] = np.cumprod(np.full(len(power) - 1, _ODD, np.uint64))
    sums, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # as many tokens as stay in a core's cache
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - lengths[first] + PIECE, "right")))
        size, at = lengths[first:last], ranges(starts[first:last], lengths[first:last])
        begin = np.cumsum(size) - size
        inside = np.arange(len(at)) - np.repeat(begin, size)
        sums[first:last] = np.add.reduceat(_CODES[data[at]] * power[inside], begin)
        first = last
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
