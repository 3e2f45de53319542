"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, ranges, settle, slices, text_bytes

Group = tuple[list[tuple[int, int]], int]  # the sizes in a sequence, with how many of each; and how many such sequences


class Encoder:
    """Ids by a byte-level BPE file of the tokenizers library, with those of recent pieces of text kept.

    A single space between two other characters always starts a new piece in byte-level BPE, so a text is
    cut there, and each distinct piece is encoded once. Next to other white space it isn't cut. New pieces
    are encoded in long rows; as each id stands for a known number of bytes, the row's ids fall to its pieces.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # a character of the vocabulary stands for one byte
        # by what stands before a word ("", a space, or any text as it is): the words and their pieces' numbers
        self.known = {kind: (pa.array([], pa.string()), np.zeros(0, np.int64)) for kind in ("", " ", "whole")}
        self.flat, self.at, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, flat: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """Keep the ids of new pieces; their numbers."""
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, *flat])
        self.used = np.concatenate([self.used, np.zeros(len(counts), np.int32)])
        return np.arange(first, len(self.at) - 1)

    def encode_one(self, piece: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.uint32)

    def learn(self, kind: str, new: pa.Array) -> np.ndarray:
        words = new.to_pylist()
        if kind != " ":
            flat = [self.encode_one(p) for p in words]
            return self.add(flat, np.array([len(x) for x in flat], np.int64))
        flat, counts = [], []
        size = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        for k in range(0, len(words), 4000):
            row = " " + " ".join(words[k : k + 4000])
            ids = np.array(self.tokenizer.encode_batch_fast([row], add_special_tokens=False)[0].ids, np.uint32)
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size[k : k + 4000])) + 1
            flat.append(ids)
            counts.append(np.diff(last, prepend=0))
        return self.add(flat, np.concatenate(counts))

    def codes(self, kind: str, words: pa.Array) -> np.ndarray:
        """The numbers of the pieces of distinct words."""
        known, numbers = self.known[kind]
        at = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if (at < 0).any():
            new = words.filter(pa.array(at < 0))
            at[at < 0] = len(known) + np.arange(len(new))
            known, numbers = pa.concat_arrays([known, new]), np.concatenate([numbers, self.learn(kind, new)])
            self.known[kind] = known, numbers
        return numbers[at]

    def forget(self) -> None:
        """Keep the half of the pieces that most slices of late had."""
        keep = np.zeros(len(self.used), bool)
        keep[np.argpartition(-self.used, self.most // 2)[: self.most // 2]] = True
        moved, size = np.cumsum(keep) - 1, np.diff(self.at)[keep]
        self.flat = self.flat[ranges(self.at[:-1][keep], size)]
        self.at, self.used = np.concatenate([[0], np.cumsum(size)]), self.used[keep] // 2
        for kind, (known, numbers) in self.known.items():
            mine = keep[numbers]
            self.known[kind] = known.filter(pa.array(mine)), moved[numbers[mine]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and their bounds."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        odd = np.logical_or.reduceat(white_edged(words)[index], first) if len(first) else np.zeros(0, bool)
        own = np.repeat(~odd, count)
        head = np.zeros(len(index), bool)
        head[first] = True
        code = np.zeros(len(index), np.int64)
        for mask, kind in ((own & head, ""), (own & ~head, " ")):
            mine = index[mask]
            used = np.flatnonzero(np.bincount(mine, minlength=len(words)))
            of = np.zeros(len(words), np.int64)
            of[used] = self.codes(kind, words.take(pa.array(used)))
            code[mask] = of[mine]
        if odd.any():
            pieces, kept = [], []
            for k in np.flatnonzero(odd):
                cut = whole_pieces(words.take(pa.array(index[first[k] : first[k] + count[k]])).to_pylist())
                pieces += cut
                kept.append(len(cut))
            extra = pa.array(pieces, pa.string()).dictionary_encode()
            extra = self.codes("whole", extra.dictionary)[extra.indices.to_numpy(zero_copy_only=False)]
            joined, at, n = [], 0, iter(kept)
            for k in range(len(first)):
                if odd[k]:
                    m = next(n)
                    joined.append(extra[at : at + m])
                    at += m
                else:
                    joined.append(code[first[k] : first[k] + count[k]])
            count = np.array([len(j) for j in joined])
            code = np.concatenate(joined)
        size = np.diff(self.at)[code]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        ids = self.flat[ranges(self.at[:-1][code], size)]
        self.used[code] += 1  # once a slice, however often there
        if len(self.used) > self.most:
            self.forget()
        return ids, bounds


def white_edged(words: pa.Array) -> np.ndarray:
    """Which words are empty, or have white space first or last."""
    data, at = text_bytes(words)
    size = np.diff(at)
    edges = np.zeros((len(words), 2), np.uint8)
    edges[size > 0] = np.stack([data[at[:-1][size > 0]], data[at[1:][size > 0] - 1]], 1)
    out = size == 0
    doubtful = np.flatnonzero(~out & ~((edges > 0x20) & (edges < 0x7F)).all(1))  # the others are of printable ASCII
    out[doubtful] = [w[0].isspace() or w[-1].isspace() for w in words.take(pa.array(doubtful)).to_pylist()]
    return out


@cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path)


def whole_pieces(words: list[str]) -> list[str]:
    """Words split at each space, joined again wherever the space has white space beside it."""
    out, now = [], words[0]
    for word in words[1:]:
        if now and word and not now[-1].isspace() and not word[0].isspace():
            out.append(now)
            now = " " + word
        else:
            now += " " + word
    return [*out, now]


def tokenized(docs: DataFrame, path: str, capacity: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its ids' count, each piece's crc32, and what places it: its task, its number among the
    task's rows of the same first-piece size, and the task's full pieces before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        seen, full = np.zeros(capacity, np.int64), 0
        for batch in slices(batches, "text", 4 << 20):
            ids, at = encoder.encode(batch.column(1))
            n = np.diff(at) + 1
            bounds = np.concatenate([[0], np.cumsum(n)])
            out = np.full(int(bounds[-1]), end, "<u4")
            out[ranges(bounds[:-1], n - 1)] = ids
            view = memoryview(out).cast("B")
            crc, nth, before = [], [], []
            for k in range(batch.num_rows):
                short = int(n[k] % capacity)
                nth.append(int(seen[short]))
                before.append(full)
                seen[short] += 1
                full += int(n[k]) // capacity
                cuts = [int(bounds[k]), *range(int(bounds[k]) + (short or capacity), int(bounds[k + 1]) + 1, capacity)]
                crc.append([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.list_(pa.int64())), pa.array(n % capacity, pa.int32()), pa.array([part] * len(n), pa.int32()), pa.array(nth, pa.int64()), pa.array(before, pa.int64())],
                ["key", "n", "crc", "size", "part", "nth", "full_before"],
            )

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return mapped(rows, run, f"key {docs.schema[key].dataType.simpleString()}, n long, crc array<long>, size int, part int, nth long, full_before long")


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[Group]:
    """Fix the sets that dominate every other set with their largest item; count, by size, keeps the rest.

    With an item of size j, room r = capacity - j is left. {j} is fixed if nothing fits beside it; {j, a},
    a the largest that fits, if a = r or no two others fit, as what else stands beside j could go in a's
    place; {j, a, b} if no three others fit, b is the largest that fits with a, and no pair that fits has a
    second item above b. Taking items away never breaks a condition, so each is applied as often as items last.
    """
    fixed: list[Group] = []
    for j in range(capacity, 0, -1):
        while count[j]:
            room = capacity - j
            count[j] -= 1
            sizes = np.flatnonzero(count[: room + 1])
            if not len(sizes):
                count[j] += 1
                fixed.append(([(j, 1)], int(count[j])))
                count[j] = 0
                break
            a = int(sizes[-1])
            least = np.repeat(sizes, np.minimum(count[sizes], 4))[:4]
            sums = np.cumsum(least)
            fits = int((sums <= room).sum())
            chosen = None
            if a == room or fits <= 1:
                chosen = [j, a]
            elif fits == 2:
                count[a] -= 1
                other = np.flatnonzero(count[: room - a + 1])
                count[a] += 1
                b = int(other[-1]) if len(other) else 0
                follow = np.append(sizes[1:], capacity + 1)
                partner = np.where(count[sizes] >= 2, sizes, follow)
                second = sizes[sizes + partner <= room]
                if b and (not len(second) or int(second[-1]) <= b):
                    chosen = [j, a, b]
            count[j] += 1
            if chosen is None:
                break
            kinds, need = np.unique(chosen, return_counts=True)
            times = int((count[kinds] // need).min())
            count[kinds] -= need * times
            fixed.append(([(int(s), int(n)) for s, n in zip(kinds[::-1], need[::-1], strict=True)], times))
            # the last odd item of a size may pair otherwise: the loop looks again
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, largest first, of all items of a size at once: as one after another would go."""
    room: dict[int, list[Group]] = {}
    order: list[int] = []

    def put(left: int, group: Group) -> None:
        if left not in room:
            room[left] = []
            insort(order, left)
        room[left].append(group)

    for size in range(capacity, 0, -1):
        rest = int(count[size])
        while rest:
            at = bisect_left(order, size)
            left = order[at] if at < len(order) else capacity
            each = left // size
            what, times = room[left].pop() if at < len(order) else ([], -(-rest // each))
            if at < len(order) and not room[left]:
                del room[left]
                order.pop(at)
            whole = min(times, rest // each)
            rest -= whole * each
            if whole:
                put(left - each * size, ([*what, (size, each)], whole))
            times -= whole
            if times and rest:  # one sequence takes what is left
                put(left - rest * size, ([*what, (size, rest)], 1))
                times, rest = times - 1, 0
            if times and what:
                put(left, (what, times))
    return [g for groups in room.values() for g in groups]


def slots(groups: list[Group], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs of places for the items of each size: from which rank, which sequence first, how many a sequence, where."""
    rows, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for what, times in groups:
        offset = 0
        for size, each in what:
            rows.append((size, int(ranks[size]), sequence, each, offset))
            ranks[size] += each * times
            offset += size * each
        sequence += times
    rows.sort()
    names = ("size", "rank", "sequence", "each", "offset")
    return {n: np.array([r[k] for r in rows], np.int64) for k, n in enumerate(names)}, sequence


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack tokenized documents into sequences of at most capacity ids.

    A document is its text's ids and the id end. Longer ones are cut into pieces of capacity ids, the first
    piece being what is left over; a full piece is a sequence of its own. The histogram of the other pieces'
    sizes, capacity - 1 numbers however many the documents, is reduced by dominance and the rest packed by
    best fit; each row then finds its place by its rank among the rows of its size.

    Null texts count as empty: a piece of the end id alone. Null or repeated keys and repeated rows are
    packed like any others; an empty table gives no rows; further columns are left out.
    Returns key, piece, start, length, ids_crc32, sequence_id, offset.
    """
    rows = settle(tokenized(docs, path, capacity, end, key, text), "packing")
    by_task = rows.groupBy("part", "size").agg(F.count("*").alias("rows"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.filter("size > 0").groupBy("size").agg(F.sum("rows").alias("n")).collect():  # capacity - 1 rows at most
        counts[r.size] = r.n
    fixed = reduce_by_dominance(counts, capacity)
    place, sequences = slots(fixed + best_fit(counts, capacity), capacity)
    starts = np.searchsorted(place["size"], np.arange(capacity + 2))

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("part", "size", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank_before"))
    ranked = rows.join(offsets, ["part", "size"]).select("key", "n", "crc", "size", "part", (F.col("rank_before") + F.col("nth")).alias("rank"), "full_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, part, rank, full = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "size", "part", "rank", "full_before"))
            crc = b.column(b.schema.get_field_index("crc")).flatten()
            has = (size > 0).astype(np.int64)
            pieces = n // capacity + has
            row = np.repeat(np.arange(len(n)), pieces)
            piece = ranges(np.zeros(len(n), np.int64), pieces)
            short = (piece == 0) & (has[row] == 1)
            length = np.where(short, size[row], capacity)
            start = np.where(short, 0, size[row] + (piece - has[row]) * capacity)
            # ids of full pieces stand above those of the packed sequences
            sequence = sequences + (part[row] << 36) + full[row] + piece - has[row]
            offset = np.zeros(len(row), np.int64)
            for s in np.unique(size[size > 0]):
                own = np.flatnonzero(short & (size[row] == s))
                lo, hi = starts[s], starts[s + 1]
                at = lo + np.searchsorted(place["rank"][lo:hi], rank[row[own]], "right") - 1
                nth = rank[row[own]] - place["rank"][at]
                sequence[own] = place["sequence"][at] + nth // place["each"][at]
                offset[own] = place["offset"][at] + nth % place["each"][at] * s
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), crc, *(pa.array(x, pa.int64()) for x in (sequence, offset))],
                [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return mapped(ranked, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
