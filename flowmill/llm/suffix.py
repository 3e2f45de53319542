"""Suffix-array removal of repeated byte strings: two-stage sorting within anchored parts of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CODES, field, free_names, mapped, mix, partitions, ranges, settle, slices, text_bytes, with_field

GRAM = 32  # bytes of an anchor
NULL = -(1 << 63)  # stands for a null id: the smallest
ODD = 0x9E3779B97F4A7C15
PIECE = 1 << 17  # bytes of texts whose anchors are found together
CHUNK = 1 << 18  # bytes that are sorted together, if they are of more than one anchor
KEPT = 1 << 21  # powers kept of each number: 16 MB
MOST = 1 << 22  # anchors that may be broadcast: 32 MB
OTHER_ODD, OTHER_CODES = 0xD1342543DE82EF95, mix(_CODES ^ np.uint64(ODD))  # for a second, independent hash
HOT = 4_000  # contexts of an anchor from which on its strings are grouped one by one
COLUMNS = (("a", "u8"), ("c", "u8"), ("id", "i8"), ("lo", "i4"), ("h", "i2"), ("n", "u2"))


def pack(fields: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes, so that the like bytes of sorted numbers lie together."""
    return b"".join(np.ascontiguousarray(fields[n].astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for n, t in COLUMNS)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    sizes = [np.dtype(t).itemsize for _, t in COLUMNS]
    rows, at, out = len(blob) // sum(sizes), 0, {}
    for (n, t), size in zip(COLUMNS, sizes, strict=True):
        plane = np.frombuffer(blob, np.uint8, rows * size, at).reshape(size, rows)
        out[n] = np.ascontiguousarray(plane.T).view(t).reshape(-1)
        at += rows * size
    return out


def joined(blobs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([b[n] for b in blobs]) if blobs else np.zeros(0, t) for n, t in COLUMNS}


def powers(x: int, n: int) -> np.ndarray:
    """x, x**2 and so on of 64 bits; those of a slice are kept."""
    return kept_powers(x)[:n] if n <= KEPT else np.cumprod(np.full(n, x, np.uint64))


@cache
def kept_powers(x: int) -> np.ndarray:
    return np.cumprod(np.full(KEPT, x, np.uint64))


class Sums:
    """Prefix sums that give the hash of any substring of the joined texts."""

    def __init__(self, data: np.ndarray, odd: int = ODD, codes: np.ndarray = _CODES) -> None:
        self.odd = np.uint64(odd)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(odd, len(data)), out=self.sums[1:])
        self.inverse = powers(pow(odd, -1, 1 << 64), len(data))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * self.odd)

    def grams(self, size: int, lo: int, hi: int) -> np.ndarray:
        """Hashes of the strings of size bytes between lo and hi."""
        last = hi - size + 1
        return mix((self.sums[lo + size : hi + 1] - self.sums[lo:last]) * self.inverse[lo:last])


def contexts(at: np.ndarray, length: int, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bounds and hash of the bytes around each anchor; every string of `length` bytes lies in one.

    Of the grams in a string those of the least hash are its anchors, so equal strings have equal anchors at
    equal places. The context of an anchor is all strings of which it is one: they begin side by side.
    """
    none = np.zeros(0, np.int64)
    found, first = [(none, none, none, np.zeros(0, np.uint64))], 0
    while first < len(at) - 1:  # as many rows as stay in a core's cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        found.append(contexts_of(at, first, last, length, sums))
        first = last
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def contexts_of(at: np.ndarray, first: int, last: int, length: int, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """contexts() of the rows from first to last, the last left out."""
    base, bounds, wide = at[first], at[first : last + 1], length - GRAM + 1
    firsts = ranges(bounds[:-1] - base, np.maximum(np.diff(bounds) - length + 1, 0))  # where a string of this length begins
    if not len(firsts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = sums.grams(GRAM, base, bounds[-1])
    least, span = h.copy(), 1
    while span < wide:
        step = min(span, wide - span)
        least[:-step] = np.minimum(least[:-step], least[step:])
        span += step
    own = np.zeros(len(h), np.uint64)
    own[firsts] = least[firsts]  # the least hash of each string; below, its largest over the strings around a gram
    most, span = own.copy(), 1
    while span < wide:
        step = min(span, wide - span)
        most[step:] = np.maximum(most[step:], most[:-step])
        span += step
    where = np.flatnonzero(most == h)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # runs of strings of one least hash; rows are apart by strings without
    run, value = np.searchsorted(starts, where, "right") - 1, h[where]
    off = np.flatnonzero(own[starts[run]] != value)
    while len(off):  # an anchor's strings may all begin before it: the last run of its hash up to there
        run[off] -= 1
        off = off[own[starts[run[off]]] != value[off]]
    lo = np.maximum(starts[run], where - (length - GRAM))
    hi = np.minimum(np.r_[starts[1:], len(own)][run] - 1, where) + length
    row = np.searchsorted(bounds, base + where, "right") - 1 + first
    return row, base + lo, base + hi, mix(value + np.uint64(1))  # least hashes are all small: spread


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each doc, joined where they meet."""
    if not len(doc):
        return doc, lo, hi
    doc, lo, hi = doc.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
    order = np.argsort((doc << 32) + lo)
    doc, lo, hi = doc[order], lo[order], hi[order]
    reach = np.maximum.accumulate((doc << 32) + hi)
    new = np.r_[True, (doc[1:] << 32) + lo[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:], len(doc)] - 1
    return doc[new], lo[new], reach[last] - (doc[new] << 32)


SPANS = "id long, h int, lo array<int>, hi array<int>"


def span_rows(ids: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    """A row for each document: its spans as two lists."""
    if not len(ids):
        return [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
    doc, first = ranked(ids, h)
    d, a, b = merged(doc, lo, hi)
    kinds, start = np.unique(d, return_index=True)
    bounds = pa.array(np.r_[start, len(d)].astype(np.int32))
    return [pa.array(ids[first][kinds]), pa.array(h[first][kinds].astype(np.int32)), *(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (a, b))]


def ranked(ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number among the documents, in the order of id and text hash; and a row of each document."""
    order = np.lexsort((h, ids))
    new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(ids) else np.zeros(0, bool)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def repeated(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by anchor, context and place, and which of these repeat an earlier place."""
    rank, _ = ranked(r["id"], r["h"])
    order = np.lexsort((r["lo"], rank, r["c"], r["a"]))
    if not len(order):
        return order, np.zeros(0, bool)
    a, c, rank, lo = r["a"][order], r["c"][order], rank[order], r["lo"][order]
    first = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    head = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    # a repeated row of the first's document at the first's place is that place once more
    kept = first | (rank != rank[head]) | (lo != lo[head])
    return order[kept], ~first[kept]


def grouped(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by group (numbers from 0) and word; with few groups the second sort is by counting."""
    order = np.argsort(word)
    group = group[order]
    return order[np.argsort(group.astype(np.uint16) if int(group.max(initial=0)) < 1 << 16 else group, kind="stable")]


def two_stage(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of data, right to `depth` bytes at least; data ends in more than depth zeros.

    Only suffixes smaller than their successors are sorted by their bytes. A scan of the buckets of first
    bytes, in order, induces the others: the suffix one byte before each is put at the front of its bucket.
    """
    n = len(data)
    rise = data[:-1] < data[1:]
    differs = np.r_[data[:-1] != data[1:], True]
    nearest = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.r_[rise, False][nearest]  # than its successor; the last is not
    words = np.r_[np.ndarray((n - 7,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64), np.zeros(depth + 16, np.uint64)]
    where = np.flatnonzero(smaller)
    word = words[where]
    order = np.argsort(word)
    where, word = where[order], word[order]
    index, at, group = np.arange(len(where)), where, np.zeros(len(where), np.int64)  # of those not yet apart from all others
    for offset in range(8, depth + 16, 8):
        new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])] if len(index) else np.zeros(0, bool)
        alone = new & np.r_[new[1:], True] if len(index) else new
        group = np.cumsum(new)[~alone]
        index, at = index[~alone], at[~alone]
        if offset >= depth + 8 or not len(index):
            break
        word = words[at + offset]
        differ = (word[1:] != word[:-1]) & (group[1:] == group[:-1])
        if differ.any():  # only groups that part here are sorted: most are of copies, which never do
            parts = np.zeros(int(group[-1]) + 1, bool)
            parts[group[1:][differ]] = True
            some = np.flatnonzero(parts[group])
            order = some[grouped((np.cumsum(parts) - 1)[group[some]], word[some])]
            at[some], word[some] = at[order], word[order]
            where[index[some]] = at[some]
    total = np.bincount(data, minlength=256)
    direct = np.bincount(data[where], minlength=256)
    start = np.cumsum(total) - total
    out = np.empty(n, np.int64)
    first = np.cumsum(direct) - direct
    front = start.copy()
    out[front[data[-1]]] = n - 1
    front[data[-1]] += 1
    for byte in np.flatnonzero(total):
        end = start[byte] + total[byte]
        out[end - direct[byte] : end] = where[first[byte] : first[byte] + direct[byte]]
        wave = out[start[byte] : front[byte]]
        while len(wave):  # runs of one byte: a suffix induces one in its own bucket
            wave = wave[wave > 0] - 1
            wave = wave[(data[wave] == byte) & ~smaller[wave]]
            out[front[byte] : front[byte] + len(wave)] = wave
            front[byte] += len(wave)
        whole = out[start[byte] : end]
        before = whole[whole > 0] - 1
        before = before[data[before] > byte]
        before = before[np.argsort(data[before], kind="stable")]
        count = np.bincount(data[before], minlength=256)
        to = ranges(front[count > 0], count[count > 0])
        out[to] = before
        front += count
    return out


def common_prefix(data: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Whether each suffix shares its first `most` bytes with the one before it (the first never does)."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    left = np.arange(1, len(suffixes))
    for offset in [*range(0, most - 7, 8), most - 8]:
        a, b = suffixes[left - 1] + offset, suffixes[left] + offset
        inside = (a < len(words)) & (b < len(words))
        left, a, b = left[inside], a[inside], b[inside]
        left = left[words[a] == words[b]]
    out = np.zeros(len(suffixes), bool)
    out[left] = True
    return out


def later_places(body: np.ndarray, size: np.ndarray, doc: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of each string of `length` bytes in the contexts that also starts earlier in one of them.

    body: the contexts' bytes, joined; a context has size bytes and stands in document doc from lo on.
    """
    first = np.cumsum(size) - size
    data = np.r_[body, np.zeros(length + 16, np.uint8)]
    whole = np.zeros(len(data), bool)
    whole[ranges(first, np.maximum(size - length + 1, 0))] = True
    suffixes = two_stage(data, length)
    suffixes = suffixes[whole[suffixes]]  # those that share their first bytes stay neighbours
    starts = np.flatnonzero(~common_prefix(data, suffixes, length))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.repeat((doc.astype(np.int64) << 32) + lo - first, size)
    place = shift[suffixes] + suffixes  # with the document in the high bits
    earliest = np.minimum.reduceat(place, starts)
    later = place[place != np.repeat(earliest, np.diff(np.r_[starts, len(place)]))]
    return later >> 32, later & 0xFFFFFFFF


def repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans of each document covered by strings of `length` bytes that also start earlier.

    Tasks find the anchors of their texts (contexts()) and send one row for each distinct context (by two
    independent hashes of 64 bits), with its earliest place, to the part of its anchor; later copies are
    covered at once, so a group of copies sends a row for each task. There, repeats among tasks are covered, and the distinct contexts
    of an anchor with several are fetched as bytes and sorted: a suffix array by two-stage sorting, in which
    strings of equal first bytes are neighbours. All but the earliest of these are covered. An anchor with
    HOT contexts or more, as within a line that a large share of the documents begins with, would make one
    part too large: around it each single string is a context, which copies reduce as above.

    Returns id, h (with the id, the document), lo, hi: lists of spans, possibly several rows a document.
    """
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    rows = docs.select(F.coalesce(field(key).cast("long"), F.lit(NULL)).alias("id"), F.pmod(F.hash(field(text)), F.lit(1 << 15)).cast("int").alias("h"), F.coalesce(field(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            data, at = text_bytes(part.column(2))
            sums = Sums(data)
            _, lo, hi, a = contexts(at, length, sums)
            a, n = tallied(a[distinct(a, sums.of(lo, hi))], int(sums.sums[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    tally = settle(mapped(rows, count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT), "suffix-hot")
    least = HOT
    while tally.filter(F.col("n") >= least).count() > MOST:
        least *= 4
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.a for r in tally.filter(F.col("n") >= least).select("a").toLocalIterator()], np.int64).view(np.uint64)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            data, at = text_bytes(part.column(2))
            row, lo, hi, a = contexts(at, length, sums := Sums(data))
            other = Sums(data, OTHER_ODD, OTHER_CODES)
            c = other.of(lo, hi)
            if len(hot.value) and len(a):
                is_hot = hot.value[np.minimum(np.searchsorted(hot.value, a), len(hot.value) - 1)] == a
                strings = np.maximum(hi[is_hot] - lo[is_hot] - length + 1, 0)
                own, where = np.repeat(row[is_hot], strings), ranges(lo[is_hot], strings)
                where, index = np.unique(where, return_index=True)
                whole, twice = (x.of(where, where + length) for x in (sums, other))
                row, lo, hi = (np.concatenate([x[~is_hot], y]) for x, y in ((row, own[index]), (lo, where), (hi, where + length)))
                a, c = np.concatenate([a[~is_hot], whole]), np.concatenate([c[~is_hot], twice])
            ids, h = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            r = {"a": a, "c": c, "id": ids[row], "h": h[row], "lo": lo - at[row], "n": hi - lo}
            order, again = repeated(r)
            r = {n: x[order] for n, x in r.items()}
            yield from batch_of(-1, None, span_rows(*(r[n][again] for n in ("id", "h", "lo")), (r["lo"] + r["n"])[again]), parts)
            r = {n: x[~again] for n, x in r.items()}
            cut = np.searchsorted(r["a"], np.array([(k << 64) // parts for k in range(1, parts)], np.uint64))
            for k, index in enumerate(np.split(np.arange(len(r["a"])), cut)):
                if len(index):
                    yield from batch_of(k, pack({n: x[index] for n, x in r.items()}), None)

    def reduce(group: pa.Table) -> pa.Table:
        r = joined([unpack(b) for b in group.column("blob").to_pylist() if b is not None])
        passed = group.filter(pc.is_null(group.column("blob"))).select(["id", "h", "lo", "hi"])
        order, again = repeated(r)
        r = {n: x[order].astype(np.int64) if n != "a" else x[order] for n, x in r.items()}
        found = pa.table(span_rows(*(r[n][again] for n in ("id", "h", "lo")), (r["lo"] + r["n"])[again]), ["id", "h", "lo", "hi"])
        r = {n: x[~again] for n, x in r.items()}
        same = np.r_[False, r["a"][1:] == r["a"][:-1]] if len(r["a"]) else np.zeros(0, bool)
        several = same.copy()
        several[:-1] |= same[1:]
        r = {n: x[several] for n, x in r.items()}
        one = pa.array(np.arange(len(r["a"]) + 1, dtype=np.int32))
        asked = pa.table([pa.array(r["id"]), pa.array(r["h"].astype(np.int32)), *(pa.ListArray.from_arrays(one, pa.array(x.astype(np.int32))) for x in (r["lo"], r["lo"] + r["n"])), pa.array(r["a"].view(np.int64))], ["id", "h", "lo", "hi", "a"])
        whole = pa.concat_tables([t.select(["id", "h", "lo", "hi"]).cast(asked.select(["id", "h", "lo", "hi"]).schema).append_column("a", pa.nulls(t.num_rows, pa.int64())) for t in (passed, found)] + [asked])
        return whole

    sent = mapped(rows, emit, f"part int, blob binary, {SPANS}")
    first = settle(sent.groupBy("part").applyInArrow(reduce, f"{SPANS}, a long"), "suffix-contexts")
    asked = first.filter("a IS NOT NULL").groupBy("id", "h").agg(F.collect_list(F.struct(F.col("lo")[0].alias("lo"), F.col("hi")[0].alias("hi"), "a")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column(2))
            lists = part.column(3)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            lo, hi, a = (lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "a"))
            ids, h = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            a = a.view(np.uint64)
            order = np.argsort(a, kind="stable")
            r = {"a": a[order], "c": np.zeros(len(a)), "id": ids[row[order]], "h": h[row[order]], "lo": lo[order], "n": (hi - lo)[order]}
            from_ = (at[row] + lo)[order]
            cut = np.searchsorted(r["a"], np.array([(k << 64) // parts for k in range(1, parts)], np.uint64))
            for k, index in enumerate(np.split(np.arange(len(a)), cut)):
                if len(index):
                    body = data[ranges(from_[index], r["n"][index].astype(np.int64))].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack({n: x[index] for n, x in r.items()})], pa.binary()), pa.array([body], pa.binary())], ["part", "blob", "body"])

    def sort(group: pa.Table) -> pa.Table:
        r = joined([unpack(b) for b in group.column("blob").to_pylist()])
        body = b"".join(group.column("body").to_pylist())
        doc, one = ranked(r["id"], r["h"])
        ids, h = r["id"][one], r["h"][one]
        size = r["n"].astype(np.int64)
        first = np.cumsum(size) - size
        order = np.argsort(r["a"], kind="stable")
        anchor, size, first, doc, lo = r["a"][order], size[order], first[order], doc[order], r["lo"][order].astype(np.int64)
        body = np.frombuffer(body, np.uint8)
        found = []
        begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        place = np.cumsum(size) - size
        start = 0
        while start < len(begins):  # anchors have no strings in common: some at a time, as many as make a chunk
            stop = max(start + 1, int(np.searchsorted(place[begins], place[begins[start]] + CHUNK)))
            part = slice(begins[start], begins[stop] if stop < len(begins) else len(anchor))
            found.append(later_places(body[ranges(first[part], size[part])], size[part], doc[part], lo[part], length))
            start = stop
        doc, place = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table(span_rows(ids[doc], h[doc], place, place + length), ["id", "h", "lo", "hi"])

    fetched = mapped(rows.join(asked, ["id", "h"]).select("id", "h", "text", "asked"), fetch, "part int, blob binary, body binary")
    return first.filter("a IS NULL").drop("a").unionByName(fetched.groupBy("part").applyInArrow(sort, SPANS))


def tallied(a: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors in a with their counts; of counts n under 8, n in 8 stand as 8, so that sums come out right.

    Only how the work is dealt out depends on these sums, never the result.
    """
    a, n = np.unique(a, return_counts=True)
    draw = (mix(a ^ np.uint64(seed & ((1 << 64) - 1))) & np.uint64(7)).astype(np.int64)
    kept = draw < n
    return a[kept], np.maximum(n[kept], 8)


def distinct(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A row of each distinct pair."""
    order = np.lexsort((c, a))
    return order[np.r_[True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])]] if len(a) else order


def batch_of(part: int, blob: bytes | None, spans: list[pa.Array] | None, parts: int = 1) -> Iterator[pa.RecordBatch]:
    if spans is None:
        spans = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary()), *spans], ["part", "blob", "id", "h", "lo", "hi"])
    elif len(spans[0]):
        # spans only pass through: dealt over the parts by document
        where = (spans[0].to_numpy() % parts).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.nulls(len(spans[0]), pa.binary()), *spans], ["part", "blob", "id", "h", "lo", "hi"])


def covered(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """docs with two more columns, the last ones: where the repeated spans of each text begin and where they end."""
    idn, hn, lon, hin = free_names(docs, "id", "h", "lo", "hi")
    marked = docs.withColumn(idn, F.coalesce(field(key).cast("long"), F.lit(NULL))).withColumn(hn, F.pmod(F.hash(field(text)), F.lit(1 << 15)).cast("int"))
    spans = repeats(docs, length, key, text).groupBy(F.col("id").alias(idn), F.col("h").alias(hn)).agg(F.flatten(F.collect_list("lo")).alias(lon), F.flatten(F.collect_list("hi")).alias(hin))
    return marked.join(spans, [idn, hn], "left").select(*(field(n) for n in docs.columns), lon, hin)


def bytes_left(part: pa.RecordBatch, column: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """What is left of each text of a batch of covered(); the texts' bytes, the bytes removed and the spans."""
    data, at = text_bytes(part.column(column))
    lo, hi = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
    count = pc.fill_null(pc.list_value_length(lo), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), count)
    doc, lo, hi = merged(doc, *(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lo, hi)))
    keep = np.ones(len(data), bool)
    keep[ranges(at[doc] + lo, hi - lo)] = False
    removed, spans = np.bincount(doc, hi - lo, part.num_rows).astype(np.int64), np.bincount(doc, minlength=part.num_rows).astype(np.int64)
    return [data[at[k] : at[k + 1]][keep[at[k] : at[k + 1]]].tobytes() for k in range(part.num_rows)], np.diff(at), removed, spans


def cut(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns kept (bytes left of the text), n_bytes, n_removed and n_spans.

    Each byte is removed that a string of `length` bytes covers which also starts earlier: in a document of
    smaller key, or earlier in the same one; strings are judged on the texts as they came. Null texts count
    as empty. Rows of equal key and text are one document and get the same result; rows of equal key and
    different texts are different documents, in the order of a hash of the text; a null key is the smallest.
    Texts under `length` bytes, however often they occur, stay; an empty table gives no rows. Columns of the
    new names are replaced; with_kept_text() adds none.
    """
    names, added = docs.columns, ("kept", "n_bytes", "n_removed", "n_spans")
    own = [n for n in names if n not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            kept, *numbers = bytes_left(part, names.index(text))
            yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in own), pa.array(kept, pa.binary()), *map(pa.array, numbers)], [*own, *added])

    schema = docs.select(*(field(n) for n in own)).schema
    for n, kind in zip(added, ("binary", "bigint", "bigint", "bigint"), strict=True):
        schema = with_field(schema, n, kind)
    return mapped(covered(docs, length, key, text), run, schema)


def kept_digest(kept: DataFrame) -> DataFrame:
    """The columns of cut() with the SHA-256 of the bytes left, for tables of doc_id."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_kept_text(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with the text cut() leaves, and the column size, where there is one, set to its characters.

    Bytes of a character that is only partly left go too. Null texts stay null, and a text with nothing removed
    stays as it is; documents of which nothing is left are dropped. Further columns stay as they are,
    whatever their names.
    """
    names = docs.columns
    at, sized = names.index(text), size in names
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))  # whatever the names are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            kept, _, removed, _ = bytes_left(part, at)
            texts, null = [b.decode("utf-8", "ignore") for b in kept], part.column(at).is_null().to_pylist()
            columns = part.columns[: len(names)]
            columns[at] = pa.array([None if z else t for t, z in zip(texts, null, strict=True)], pa.string())
            if sized:
                old = columns[names.index(size)]
                columns[names.index(size)] = pa.array([len(t) if r else o for t, r, o in zip(texts, removed, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([bool(t) or not r for t, r in zip(texts, removed, strict=True)], pa.bool_()))

    return mapped(covered(numbered, length, f"c{names.index(key)}", f"c{at}"), run, docs.schema)
