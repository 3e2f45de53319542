"""Benchmark decontamination: the q-gram lemma over diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, field, mapped, ranges, slices, text_bytes

Q = 8  # bytes of a q-gram at most: one 64-bit word
BITS = 20
CELLS = 1 << 21  # of texts that are aligned together
FOLD = np.where(SPACE, np.uint8(32), LOWER)  # lower-case A-Z, any ASCII white space as a space; as many bytes


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place, as a number."""
    count = max(0, len(data) - q + 1)
    words = np.ndarray((count,), "<u8", np.r_[data, np.zeros(Q, np.uint8)], strides=(1,))
    return words if q == Q else words & np.uint64((1 << 8 * q) - 1)


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Index:
    """The q-grams of some items: where each stands."""

    def __init__(self, q: int, items: np.ndarray, texts: list[np.ndarray]) -> None:
        self.q = q
        keys = [grams(texts[i], q) for i in items]
        key = np.concatenate(keys)
        item = np.repeat(items, [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys])
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[slot(self.keys)] = True

    def shared(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each q-gram of the texts that is an item's too: its place in data, its row, its number among keys."""
        key = grams(data, self.q)
        where = np.flatnonzero(self.seen[slot(key)])
        found = key[where]
        index = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        good = self.keys[index] == found
        where, index = where[good], index[good]
        row = np.searchsorted(at, where, "right") - 1
        good = where + self.q <= at[row + 1]
        return where[good], row[good], index[good]


@dataclass
class Block:
    """Some items, none empty, and the indices of their q-grams: one for each length of these.

    An item of m bytes and a budget of k edits has q-grams of m // (k + 1) bytes, Q at most: with any longer
    ones, the lemma would not promise that one outlives k edits.
    """

    ids: list
    texts: list[np.ndarray]
    rate: float

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((self.size * self.rate).astype(np.int64), self.size - 1)
        self.width = self.edits + 1
        q = np.minimum(self.size // self.width, Q)
        self.needed = self.size - q + 1 - self.edits * q
        self.indices = [Index(int(n), np.flatnonzero(q == n), self.texts) for n in np.unique(q)]
        self.longest = int(self.size.max(initial=0))

    def regions(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and lowest diagonals of the bands with as many shared q-grams as the lemma asks for."""
        found = [self.bands(index, data, at) for index in self.indices]
        return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))

    def bands(self, index: Index, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        where, row, number = index.shared(data, at)
        count = index.count[number]
        post = ranges(index.first[number], count)
        item = index.item[post]
        # first by text and item alone: most items have too few q-grams in a text anywhere
        _, pair, n = np.unique(np.repeat(row * len(self.ids), count) + item, return_inverse=True, return_counts=True)
        kept = n[pair] >= self.needed[item]
        post, item, row, place = post[kept], item[kept], np.repeat(row, count)[kept], np.repeat(where - at[row], count)[kept]
        diagonal = place - index.place[post] + self.longest
        band = diagonal // self.width[item]
        # rows of a slice, items of a block and bands of a text fit in 63 bits
        key = row << 44 | item << 32 | band
        both = np.concatenate([key, key[band > 0] - 1])  # bands overlap by half: each q-gram counts in two
        byte = np.concatenate([index.place[post], index.place[post][band > 0]])
        order = np.argsort(both)
        key, byte = both[order], byte[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else none
        n = np.diff(np.r_[first, len(key)])
        good = n >= self.needed[key[first] >> 32 & 0xFFF]
        # the lemma counts the item's q-grams: one that the text repeats counts once
        first, n = first[good], n[good]
        code = np.unique(np.repeat(np.arange(len(first)), n) * np.int64(self.longest + 1) + byte[ranges(first, n)]) // (self.longest + 1)
        key = key[first][np.bincount(code, minlength=len(first)) >= self.needed[key[first] >> 32 & 0xFFF]]
        item = key >> 32 & 0xFFF
        return key >> 44, item, (key & 0xFFFFFFFF) * self.width[item] - self.longest

    def verify(self, data: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the regions that hold their item within its budget, each once."""
        best: dict[tuple[int, int, int], tuple[int, int]] = {}
        order = np.argsort(self.size[item], kind="stable")
        for part in self.together(item, order):
            rows, items = row[part], item[part]
            k, m = self.edits[items], self.size[items]
            wide, longest = int((2 * self.width[items] + 2 * k).max()), int(m.max())
            start = low[part] - k  # text places of the band's first column, for the item's first byte
            cell = at[rows][:, None] + start[:, None] + np.arange(wide + longest)
            inside = (cell >= at[rows][:, None]) & (cell < at[rows + 1][:, None])
            text = np.where(inside, data[np.clip(cell, 0, len(data) - 1)], 0).astype(np.int16)
            text[~inside] = -1
            bytes_of = np.zeros((len(part), longest), np.int16)
            for n, i in enumerate(items):
                bytes_of[n, : m[n]] = self.texts[i]
            cost, begun = align(bytes_of, m, text, inside, wide)
            end = cost.argmin(1)
            least = cost[np.arange(len(part)), end]
            for n in np.flatnonzero(least <= k):
                a, b = int(start[n] + begun[n, end[n]]), int(start[n] + end[n] + m[n])
                r, i = int(rows[n]), int(items[n])
                seen = best.get((r, i, b))
                if seen is None or (int(least[n]), -a) < (seen[1], -seen[0]):
                    best[r, i, b] = (a, int(least[n]))
        return [(r, i, a, b, e) for (r, i, b), (a, e) in sorted(best.items())]


    def together(self, item: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
        """The regions in the order of their items' sizes, as many at a time as make CELLS, or one."""
        cells = (self.size + 4 * self.width)[item[order]]
        first = 0
        while first < len(order):
            last = min(len(order), first + 512)
            while last > first + 1 and int(cells[last - 1]) * (last - first) > CELLS:
                last = first + max(1, (last - first) // 2)
            yield order[first:last]
            first = last


def align(items: np.ndarray, size: np.ndarray, text: np.ndarray, inside: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Edit distances of items to the texts around each diagonal of a band, starting and ending anywhere in it.

    A row for each region: the item's bytes, of which size count; and the text's bytes from the band's first
    column on, -1 outside the document. Returns by region and diagonal at the item's end the cost and where
    the match begins. A cell holds the cost times 2**24 plus the beginning, so that one minimum finds both;
    all regions take each byte of their items together.
    """
    step, far = np.int64(1 << 24), np.int64(1 << 50)
    steps = np.arange(wide) * step
    outside = np.zeros((len(inside), 1), bool)
    border = np.concatenate([inside, outside], 1) | np.concatenate([outside, inside], 1)  # places between bytes
    now = np.where(border[:, :wide], np.arange(wide), far)
    edge = np.full((len(now), 1), far)
    for j in range(items.shape[1]):
        put = now + np.where(text[:, j : j + wide] == items[:, j : j + 1], 0, step)  # the item's byte against the text's
        put[~inside[:, j : j + wide]] = far
        skip = np.concatenate([now[:, 1:], edge], 1) + step  # the item's byte against none
        x = np.minimum(put, skip, out=put)
        x = np.minimum.accumulate(x - steps, 1) + steps  # the text's bytes against none
        x[~border[:, j + 1 : j + 1 + wide]] = far
        now = np.where((j < size)[:, None], x, now)
    return now >> 24, now & 0xFFFFFF


def blocks(benchmark: DataFrame, key: str, text: str, rate: float, items: int = 2000, size: int = 4 << 20) -> Iterator[Block]:
    """The items in blocks of bounded number and bytes, so that however large a benchmark is, a task holds one."""
    ids, texts, total = [], [], 0
    for r in benchmark.select(field(key).alias("k"), field(text).alias("t")).filter(F.col("t").isNotNull()).toLocalIterator():
        folded = np.frombuffer(r.t.encode().strip(), np.uint8)
        folded = FOLD[folded]
        if not len(folded):
            continue
        if ids and (len(ids) == items or total + len(folded) > size):
            yield Block(ids, texts, rate)
            ids, texts, total = [], [], 0
        ids.append(r.k)
        texts.append(folded)
        total += len(folded)
    if ids:
        yield Block(ids, texts, rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where documents hold a benchmark item within an edit budget of rate times the item's bytes.

    Upper and lower case and kinds of white space count as equal. Each place of a match shares with the
    item at least m - q + 1 - k q of its m - q + 1 q-grams, on diagonals no further apart than the k
    edits: bands of diagonals with fewer are passed over, and what remains is aligned. q is 8, or what the
    lemma allows in items of under 40 bytes (at a rate of 0.1). All items are held against all texts, a
    block of items at a time, in the tasks that read the texts; nothing is shuffled.

    Null and empty texts match nothing, nor do null and blank items; the shortest items, of a byte or two,
    match wherever they stand; repeated rows match each for itself; an empty table on either side gives no
    rows; other columns are ignored.
    Returns key, item_id, start, end (bytes of the text), edits; a place where a match may end gives a row
    for the ends of least cost in each band.
    """
    rows = docs.select(field(key).alias("key"), field(text).alias("text")).filter(F.length("text") > 0)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_kind}, start long, `end` long, edits int"
    spark = docs.sparkSession
    out = None
    for block in blocks(benchmark, item_key, item_text, rate):
        shared = spark.sparkContext.broadcast(block)  # bounded: some MB of index for a block of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for part in slices(batches, "text", 4 << 20):
                data, at = text_bytes(part.column(1))
                data = FOLD[data]
                found = block.verify(data, at, *block.regions(data, at))
                if found:
                    keys = part.column(0).take(pa.array([f[0] for f in found]))
                    items = pa.array([block.ids[f[1]] for f in found], schema_types[1])
                    yield pa.RecordBatch.from_arrays([keys, items, *(pa.array([f[k] for f in found], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], ["key", "item_id", "start", "end", "edits"])

        schema_types = (None, pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string())
        part = mapped(rows, run, schema.replace(f"`{key}`", "key", 1)).withColumnRenamed("key", key)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose text holds no benchmark item (as matches() finds them).

    Null and empty texts hold none and stay, as all documents do if the benchmark is empty; repeated rows
    stay or go together; further columns stay as they are, whatever their names.
    """
    for block in blocks(benchmark, item_key, item_text, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded: some MB of index for a block of items
        names = docs.columns

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text, 4 << 20):
                data, at = text_bytes(part.column(names.index(text)))
                data = FOLD[data]
                kept = np.ones(part.num_rows, bool)
                kept[[f[0] for f in shared.value.verify(data, at, *shared.value.regions(data, at))]] = False
                yield part.filter(pa.array(kept))

        docs = mapped(docs, run, docs.schema)
    return docs
