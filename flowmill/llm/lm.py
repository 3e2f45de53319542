"""Language-model scoring by deleted interpolation of word unigrams and bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, mapped, mix, partitions, settle, slices, text_bytes, token_hashes, tokens

SIZE = 8 << 20  # bytes of text in a block
END = np.uint64(0x5851F42D4C957F2C)  # the token that ends a text, and the context of its first word
KINDS = 24  # buckets of context frequency: by powers of two
STEPS = 64  # of the quantised estimates


def grams(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's key (even), its context's, the key of both together (odd) and its row; every row has an end."""
    at = np.r_[0, np.cumsum(sizes)]
    data = LOWER[data]
    starts, lengths, row = tokens(data, at)
    h = token_hashes(data, starts, lengths) & ~np.uint64(1)
    count = np.bincount(row, minlength=len(sizes)) + 1
    last = np.cumsum(count) - 1
    word = np.full(int(count.sum()), END, np.uint64)
    inside = np.ones(len(word), bool)
    inside[last] = False
    word[inside] = h
    context = np.r_[END, word[:-1]] if len(word) else word
    pair = mix(context * np.uint64(0xD6E8FEB86659FD93) + mix(word)) | np.uint64(1)
    return word, context, pair, np.repeat(np.arange(len(sizes)), count)


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def from_planes(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def counts_blob(x: np.ndarray) -> bytes:
    """Counts of 4 bytes each, or 8 if the largest needs them; the first byte says which."""
    size = 4 if int(x.max(initial=0)) < 1 << 32 else 8
    return bytes([size]) + planes(x.astype(f"u{size}"))


def from_counts_blob(blob: bytes) -> np.ndarray:
    return from_planes(blob[1:], f"u{blob[0]}").astype(np.int64)


def blocks(docs: DataFrame, parts: int, held: int, key: str, text: str) -> DataFrame:
    """Rows of about SIZE bytes of text: ids, folds (0 to learn from, 1 deleted from it for the weights, 2 held out)."""
    train = fold(F.col(key), parts) != held
    part = F.when(~train, 2).when(F.pmod(F.xxhash64(F.col(key)), F.lit(10)) == 0, 1).otherwise(0)
    rows = docs.select(F.col(key).alias("id"), part.alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nth, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data, at = text_bytes(table.column("text"))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            column = lambda n: table.column(n).combine_chunks() if table.column(n).num_chunks != 1 else table.column(n).chunk(0)
            body = pa.compress(data.tobytes(), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([own + nth]), one(column("id")), one(column("fold")), one(pa.array(np.diff(at))), pa.array([body], pa.binary())], ["block", "ids", "folds", "sizes", "body"])

        for part in slices(batches, "text", SIZE):
            held.append(part)
            size += part.column(2).nbytes
            if size >= SIZE:
                yield whole()
                nth, held, size = nth + 1, [], 0
        if held:
            yield whole()

    return mapped(rows, run, f"block long, ids array<{kind}>, folds array<int>, sizes array<long>, body binary")


def opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = block["sizes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    folds = block["folds"].flatten().to_numpy(zero_copy_only=False)
    whole = int(sizes.sum())
    data = np.frombuffer(pa.decompress(block["body"], whole, "zstd", asbytes=True), np.uint8) if whole else np.zeros(0, np.uint8)
    return data, sizes, folds


def each_block(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        row = table.slice(k, 1)
        arrays = {n: row.column(row.schema.get_field_index(n)) for n in ("ids", "folds", "sizes")}
        arrays = {n: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for n, a in arrays.items()}
        arrays = {n: pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a for n, a in arrays.items()}
        yield arrays | {n: row.column(row.schema.get_field_index(n))[0].as_py() for n in ("block", "body")}


def counted(stored: DataFrame) -> DataFrame:
    """Every block's keys with their counts over all blocks, in the order of the keys.

    A block sends each of its distinct keys once, with its own counts, to the part of the key's range; the
    part adds them and answers every block. Frequent words are a row a block; words never gather anywhere.
    Rows of block -1 have the part's totals instead: tokens and distinct words, of fold 0 and of 0 and 1.
    """
    parts = 4 * partitions(stored.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in each_block(batch):
                data, sizes, folds = opened(block)
                word, _, pair, row = grams(data, sizes)
                key, inverse = np.unique(np.r_[word, pair], return_inverse=True)
                part = np.r_[folds[row], folds[row]]
                counts = [np.bincount(inverse[part == f], minlength=len(key)).astype(np.uint32) for f in (0, 1)]
                cut = np.searchsorted(key, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64))
                bounds = np.r_[0, cut, len(key)]
                for k in range(parts):
                    own = slice(bounds[k], bounds[k + 1])
                    if bounds[k + 1] > bounds[k]:
                        blobs = [pa.array([planes(x[own])], pa.binary()) for x in (key, *counts)]
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block["block"]]), *blobs], ["part", "block", "keys", "kept", "deleted"])

    def add(group: pa.Table) -> pa.Table:
        asked = [[from_planes(b, kind) for b in group.column(n).to_pylist()] for n, kind in (("keys", "u8"), ("kept", "u4"), ("deleted", "u4"))]
        key, inverse = np.unique(np.concatenate(asked[0]), return_inverse=True)
        kept, deleted = (np.bincount(inverse, np.concatenate(x), len(key)).astype(np.int64) for x in asked[1:])  # exact below 2**53 tokens
        word = (key & np.uint64(1)) == 0
        both = kept + deleted
        totals = np.array([kept[word].sum(), (kept[word] > 0).sum(), both[word].sum(), (both[word] > 0).sum()], np.int64).tobytes()
        part, ends = group.column("part")[0].as_py(), np.cumsum([len(k) for k in asked[0]])
        answers = np.split(inverse, ends[:-1])
        columns = [[counts_blob(x[a]) for a in answers] for x in (kept, deleted)]
        return pa.table([pa.array([part] * (len(answers) + 1), pa.int32()), pa.array([*group.column("block").to_pylist(), -1], pa.int64()), pa.array([*columns[0], totals], pa.binary()), pa.array([*columns[1], b""], pa.binary())], ["part", "block", "kept", "deleted"])

    sent = mapped(stored, ask, "part int, block long, keys binary, kept binary, deleted binary")
    return settle(sent.groupBy("part").applyInArrow(add, "part int, block long, kept binary, deleted binary"), "lm-counts")


def answered(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    right = right.sort_by("part")
    kept, deleted = (np.concatenate([from_counts_blob(b) for b in right.column(n).to_pylist()]) for n in ("kept", "deleted"))
    return kept, deleted


def estimates(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token: the counts of it, of its context and of both; and its row. counts: by sorted key."""
    word, context, pair, row = grams(data, sizes)
    _, inverse = np.unique(np.r_[word, pair], return_inverse=True)
    each = counts[inverse]
    alone, both = each[: len(word)], each[len(word) :]
    before = np.r_[0, alone[:-1]] if len(alone) else alone
    begins = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    before[begins] = alone[-1] if len(alone) else 0  # the last token is an end, as is the context of a row's first
    return alone, before, both, row


def kind_of(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 unseen, then by powers of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], KINDS - 1)


def level(share: np.ndarray) -> np.ndarray:
    """0 for none, else 1 to STEPS - 1 for shares from 1 down by half powers of two."""
    return np.where(share > 0, np.clip(1 + np.round(-2 * np.log2(np.maximum(share, 1e-30))), 1, STEPS - 1), 0).astype(np.int64)


def learned(cells: np.ndarray, n: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by expectation-maximisation on the deleted counts."""
    share = lambda x: np.where(x > 0, 2.0 ** (-(x - 1) / 2), 0.0)
    kind, two, one = cells // (STEPS * STEPS), share(cells // STEPS % STEPS), share(cells % STEPS)
    p = np.stack([two, one, np.full(len(cells), floor)], 1)

    def fitted(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        mixture = start
        for _ in range(rounds):
            joint = p[own] * mixture
            part = joint / joint.sum(1, keepdims=True)
            # one count's worth of the start keeps every weight above 0
            mixture = (part * n[own, None]).sum(0) + start
            mixture /= mixture.sum()
        return mixture

    whole = fitted(np.arange(len(cells)), np.full(3, 1 / 3))
    out = np.stack([fitted(np.flatnonzero(kind == k), whole) for k in range(KINDS)])
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]  # an unseen context has no bigrams
    return out


def score(docs: DataFrame, parts: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts under a model learned from those outside the held-out fold.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end. The model mixes the maximum-
    likelihood estimates of bigram and unigram and a uniform share, P(w | v) = a c(v, w) / c(v) + b c(w) / N +
    c / (V + 1), with weights by the frequency bucket of v: learned by expectation-maximisation on a tenth of the
    training texts whose counts are deleted from the estimates for it. A word unseen in training is the one
    unknown word, as in the base score. All counts are of the whole corpus and are kept by Spark in parts.

    Null texts count as empty: an end alone. Rows of a null key are learned from; repeated rows count and are
    scored again; without any training text counts are 0 and the uniform share is 1; an empty table gives no
    rows. Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = docs.sparkSession
    stored = settle(blocks(docs, parts, held, key, text), "lm-blocks", "uncompressed")
    counts = counted(stored)
    kind = docs.schema[key].dataType.simpleString()
    totals = np.zeros(4, np.int64)
    for r in counts.filter("block = -1").select("kept").toLocalIterator():  # a row for each part
        totals += np.frombuffer(r.kept, np.int64)
    n_kept, v_kept, n, v = (int(x) for x in totals)
    answers = counts.filter("block >= 0")

    def deleted(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, _ = answered(right)
        out = []
        for block in each_block(left):
            data, sizes, folds = opened(block)
            alone, before, both, row = estimates(data, sizes, kept)
            own = folds[row] == 1
            alone, before, both = alone[own], before[own], both[own]
            two = np.divide(both, before, out=np.zeros(len(both)), where=before > 0)
            out.append((kind_of(before) * STEPS + level(two)) * STEPS + level(alone / max(1, n_kept)))
        cell, count = np.unique(np.concatenate(out) if out else np.zeros(0, np.int64), return_counts=True)
        return pa.table([pa.array(cell, pa.int64()), pa.array(count, pa.int64())], ["cell", "n"])

    some = stored.filter(F.exists("folds", lambda f: f == 1))
    cells = some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(deleted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    seen = cells.collect()  # KINDS x STEPS x STEPS rows at most
    floor = 1 / (v_kept + 1)
    weight = learned(np.array([r.cell for r in seen], np.int64), np.array([r.n for r in seen], np.float64), floor) if seen else np.tile([0.2, 0.6, 0.2], (KINDS, 1))
    if not n:
        weight = np.tile([0.0, 0.0, 1.0], (KINDS, 1))
    weight[0] = [0, *(weight[0, 1:] / weight[0, 1:].sum())]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, gone = answered(right)
        tables = []
        for block in each_block(left):
            data, sizes, folds = opened(block)
            alone, before, both, row = estimates(data, sizes, kept + gone)
            mixture = weight[kind_of(before)]
            two = np.divide(both, before, out=np.zeros(len(both)), where=before > 0)
            p = mixture[:, 0] * two + mixture[:, 1] * (alone / max(1, n)) + mixture[:, 2] / (v + 1)
            base = np.log10((alone + 1) / (n + v + 1))
            rows = len(sizes)
            add = lambda x: np.bincount(row, x, rows)  # noqa: B023, E731
            tables.append(pa.table([
                block["ids"].flatten(), pa.array(folds == 2), pa.array(np.bincount(row, minlength=rows).astype(np.int64)), pa.array(np.bincount(row, alone > 0, rows).astype(np.int64)),
                pa.array(np.full(rows, n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p))),
            ], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(tables)

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
