"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, free_names, mapped, mix, release, settle, slices, text_bytes, token_hashes, tokens

WORDS = 5
BUCKETS = 1 << 20  # of shingle counts: 8 MB, however large the corpus
BLOCK = 4096
BANDS, ROWS = 10, 3
FEW = 200_000  # texts that may be broadcast, by number, key and digest: some 15 MB
CROWD = 16  # rows of a bucket that are compared with each other without more ado
LOW48 = np.uint64((1 << 48) - 1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit hash and count of each text's distinct shingles: five words, or all of a shorter text's."""
    starts, lengths, row = tokens(data, at)
    h = token_hashes(data, starts, lengths)
    words = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(words) - words
    sums = np.zeros(len(h), np.uint64)
    for k in range(WORDS):  # a shorter text's words count as far as they go
        inside = np.arange(len(h)) + k < (first + words)[row]
        moved = np.zeros(len(h), np.uint64)
        moved[: len(h) - k] = h[k:] if len(h) > k else h[:0]
        sums += np.where(inside, moved, np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1000193)
        sums ^= sums >> np.uint64(29)
    place = np.arange(len(h)) - first[row]
    whole = place < np.maximum(words - WORDS + 1, 1)[row]
    key = np.sort((row[whole].astype(np.uint64) << np.uint64(48)) | (mix(sums[whole]) & LOW48))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> np.uint64(48)).astype(np.int64), key[new] & LOW48, np.diff(np.r_[new, len(key)])


def small(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of few enough rows for shingles()."""
    for part in slices(batches, text, limit):
        for k in range(0, part.num_rows, 1 << 15):
            yield part.slice(k, 1 << 15)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """How many documents hold a shingle of each bucket, over all documents, copies included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for part in small(batches, "text"):
            total += np.bincount(bucket(shingles(*text_bytes(part.column(0)))[1]), minlength=BUCKETS).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS // BLOCK, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(-1, BLOCK)], pa.binary())], ["block", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for piece in group.column("counts"):
            total += np.frombuffer(piece.as_py(), np.uint32)
        return pa.table([group.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    sent = mapped(docs.select(field(text).alias("text")), count, "block int, counts binary")
    for r in sent.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def bucket_weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """IDF of each bucket, damped: the root of 1 + ln(1 / share of the documents), from 1 to 3.5.

    Most of a bucket's count is of rare shingles that fell there by chance, so the median bucket's count is
    taken off; what is left is that of a frequent shingle, if there is one. The share has a floor of 2**-16:
    shingles rarer than that weigh the same, so weights mean the same in corpora of any size. The root keeps
    copies in a large group, whose shared shingles are common and whose edits are rare, near one another.
    """
    share = (frequency - np.median(frequency)) / max(1, documents)
    return np.sqrt(1 - np.log(np.clip(share, 2.0**-16, 1))).astype(np.float32)


def weights(h: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(n)) * idf[bucket(h)]).astype(np.float32)


def gamma_table() -> np.ndarray:
    """Gamma(2, 1) at the middles of 2**16 equal shares."""
    x = np.concatenate([np.linspace(0, 1, 1 << 15)[1:], np.linspace(1, 24, 1 << 17)])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


def samples(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their BANDS x ROWS consistent weighted samples.

    Each sample is a shingle k and a level t: with r, c of Gamma(2, 1) and b uniform, drawn from a hash of k,
    t = floor(ln w / r + b), ln y = r (t - b), and k is that of the least ln c - ln y - r. Two rows agree in
    a sample with a probability of their weighted Jaccard similarity.
    """
    gamma = gamma_table()
    log_c = np.log(gamma)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.r_[starts, len(row)])
    owner = np.repeat(np.arange(len(starts)), count)
    log_w = np.log(w)
    out = np.zeros((len(starts), BANDS * ROWS), np.uint64)
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for s in range(BANDS * ROWS) if len(starts) else ():
        z = h * seeds[s]
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        r = gamma[(z >> np.uint64(48)).astype(np.int32)]
        b = (z & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w / r + b)
        a = log_c[(z >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts)
        where = np.flatnonzero(a == np.repeat(least, count))
        where = where[np.r_[True, owner[where][1:] != owner[where][:-1]]]
        out[:, s] = mix(h[where] * np.uint64(0x100000001B3) + t[where].astype(np.int64).view(np.uint64) * seeds[s])
    return row[starts], out


def bands(sample: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sample), BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key + sample[:, k::ROWS] * np.uint64(2 * k + 3))
    return mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def digest(text: str) -> Column:
    return F.unhex(F.md5(field(text).cast("binary")))


def sketches(docs: DataFrame, idf: Broadcast, key: str, text: str) -> DataFrame:
    """id, a digest of the text (null for null texts), its band keys (none without words) and total weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, "text"):
            row, h, n = shingles(*text_bytes(part.column(2)))
            w = weights(h, n, idf.value)
            has, sample = samples(row, h, w, part.num_rows)
            size = np.zeros(part.num_rows + 1, np.int32)
            size[has + 1] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(bands(sample).reshape(-1)))
            total = pa.array(np.bincount(row, w, minlength=part.num_rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, total], ["id", "digest", "bands", "total"])

    rows = docs.select(field(key).cast("long").alias("id"), digest(text).alias("digest"), field(text).alias("text"))
    return mapped(rows, run, "id long, digest binary, bands array<long>, total double")


def packed(h: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The wanted texts' shingles and their counts, as bytes. wanted: id, the text's number, with its digest and smallest key."""
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    rows = docs.select(field(key).cast("long").alias("own"), digest(text).alias("own_digest"), field(text).alias("text"))
    rows = rows.join(wanted, F.col("own").eqNullSafe(F.col("key")) & (F.col("own_digest") == F.col("digest"))).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches, "text"):
            row, h, n = shingles(*text_bytes(part.column(1)))
            n = n.astype(np.uint32)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            both = [(packed(h[a:b]), n[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], ["id", "h", "n"])

    return mapped(rows, run, "id long, h binary, n binary").dropDuplicates(["id"])


def weighted_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of shingles a of weights x with b of y; both in order."""
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    both = b[at] == a if len(b) else np.zeros(len(a), bool)
    least = float(np.minimum(x[both], y[at[both]]).sum(dtype=np.float64))
    whole = float(x.sum(dtype=np.float64) + y.sum(dtype=np.float64)) - least
    return least / whole if whole else 0.0


def verified(pairs: DataFrame, sets: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """The pairs (a, b) of a similarity of at least `least`; a may stand in many pairs, b's set travels to a's."""
    member = sets.select(F.col("id").alias("b"), F.col("h").alias("h2"), F.col("n").alias("n2"))
    both = pairs.join(member, "b").join(sets.withColumnRenamed("id", "a"), "a").select("a", "b", "h", "n", "h2", "n2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(part: pa.RecordBatch, k: int, c: int) -> tuple[np.ndarray, np.ndarray]:
            h = unpacked(part.column(c)[k].as_py())
            return h, weights(h, np.frombuffer(part.column(c + 1)[k].as_py(), np.uint32), idf.value)

        for part in slices(batches, "h2", 4 << 20):
            value = np.array([weighted_jaccard(*read(part, k, 2), *read(part, k, 4)) for k in range(part.num_rows)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(value >= least, pa.bool_()))

    return mapped(both, run, "a long, b long")


def common_weight(rows: DataFrame, sets: DataFrame, idf: Broadcast) -> DataFrame:
    """rows (id, total and others) with common: the weight of a row's shingles that another of the rows has too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "h", 2 << 20):
            h = [unpacked(x.as_py()) for x in part.column(1)]
            size = np.array([len(x) for x in h])
            flat = np.concatenate(h)
            w = weights(flat, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in part.column(2)]), idf.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(flat.view(np.int64)), pa.array(w)], ["id", "h", "w"])

    each = mapped(sets.join(rows.select("id"), "id", "left_semi").select("id", "h", "n"), spread, "id long, h long, w float")
    alone = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("w").alias("w")).filter("id = last")
    own = alone.groupBy("id").agg(F.sum("w").alias("own"))
    return rows.join(own, "id", "left").withColumn("common", F.col("total") - F.coalesce("own", F.lit(0.0))).drop("own")


def may_link(least: float, a: str, b: str) -> Column:
    """Whether rows of such totals and common weights can be linked: they share at most the smaller common weight."""
    shared = F.least(F.col(f"{a}.common"), F.col(f"{b}.common"))
    return shared >= (least / (1 + least) - 1e-6) * (F.col(f"{a}.total") + F.col(f"{b}.total"))


def linked(buckets: DataFrame, sets: DataFrame, idf: Broadcast, least: float) -> DataFrame:
    """id, label of the rows with a link, by all links between rows that share a bucket.

    Rows of a bucket of up to CROWD are compared with each other. In a larger one, the shingles that only
    one row of all such buckets has can't be shared, so the rest of its weight bounds its similarity to every
    other row there, and rows or pairs whose bound is below `least` need no comparison: rows that only have
    a common passage, or copies with many edits of their own. The others are first compared with the bucket's
    leader, which has the largest part of its weight in common; then, with its links followed, the rows
    that are not of the leader's class with all of other classes than their own.
    """
    few, crowded = buckets.filter(F.col("n") <= CROWD), buckets.filter(F.col("n") > CROWD)
    near = F.least("x.total", "y.total") >= (least - 1e-6) * F.greatest("x.total", "y.total")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    of_row = crowded.groupBy("id").agg(F.first("total").alias("total"), F.collect_set("key").alias("keys"))
    bounded = common_weight(of_row, sets, idf).filter(F.col("common") >= (least - 1e-6) * F.col("total"))
    crowd = settle(bounded.withColumn("key", F.explode("keys")), "minhash-crowd")
    first = F.max(F.struct((F.col("common") / F.col("total")).alias("share"), (-F.col("id")).alias("back"), "total", "common"))
    leaders = settle(crowd.groupBy("key").agg(first.alias("first")).select("key", (-F.col("first.back")).alias("id"), "first.total", "first.common"), "minhash-leaders")
    led = crowd.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & may_link(least, "x", "y"))
    pairs = settle(pairs.union(led.select(F.least("x.id", "y.id"), F.greatest("x.id", "y.id"))).distinct(), "minhash-pairs")
    links = settle(verified(pairs, sets, idf, least), "minhash-links")
    label = components(links)
    rows = crowd.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    main = leaders.join(label, "id", "left").select("key", F.coalesce("label", "id").alias("main"))
    apart = rows.join(main, "key").filter("label != main")
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # of the buckets they share, the first
    more = apart.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & may_link(least, "x", "y") & once)
    more = more.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    found = settle(verified(more, sets, idf, least), "minhash-more")
    if not found.isEmpty():
        old, label = label, components(links.union(found))
        release(old)
    release(crowd, leaders, pairs, links, found)
    return label


def components(edges: DataFrame) -> DataFrame:
    """id, label of each id in edges (a, b): the smallest id of its component.

    Each round takes the least label among neighbours and then that label's label, so the rounds grow as
    the logarithm of a component's width; labels are written each round, and the last round's go.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "minhash-edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "minhash-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = settle(closer.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "minhash-labels")
        release(labels)
        labels = new
        if new.filter("label != old").isEmpty():
            release(both)
            out = new.select("id", "label")
            out.settled_at = new.settled_at
            return out


def classes(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, class_id (the smallest key of its class), copy_of (that of its equal texts).

    Equal texts are one from the start, and only one of them takes part further. Texts of a weighted Jaccard
    similarity of `least` or more, over TF-IDF weighted shingles of five words, are linked, and linked texts
    are a class. Every bucket of each band is worked through (linked()); nothing is capped, and every link between
    two texts that share a bucket counts. A pair just at the threshold shares no bucket in under 1
    case of 1,000.

    Texts without words are linked only if equal; null texts are classes of their own; rows of a null key
    belong to their text's class, of null id if no equal or near text has a key; repeated rows each get a
    row; an empty table gives none; other columns are ignored.
    """
    rows, named = named_texts(docs, least, key, text)
    known = rows.filter("digest IS NOT NULL").select("id", "digest").join(named, "digest").select("id", "class_id", "copy_of")
    null = rows.filter("digest IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"))
    return known.union(null).select(F.col("id").alias(key), "class_id", "copy_of")


def named_texts(docs: DataFrame, least: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches; and each distinct text's digest, copy_of, class_id and class, a number.

    What is linked is texts, by a number of each, not keys: a text may have no key, and a key several texts.
    """
    spark = docs.sparkSession
    frequency = document_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(bucket_weights(frequency, docs.count()))
    rows = settle(sketches(docs, idf, key, text), "minhash-sketches")
    texts = settle(rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("total").alias("total")).withColumn("node", F.monotonically_increasing_id()), "minhash-texts")
    keys = texts.select(F.col("node").alias("id"), "total", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = settle(keys.join(shared, "key"), "minhash-buckets")
    wanted = texts.select(F.col("node").alias("id"), "digest", F.col("id").alias("key")).join(buckets.select("id").distinct(), "id", "left_semi")
    sets = settle(shingle_sets(docs, wanted, key, text), "minhash-sets")
    label = linked(buckets, sets, idf, least).withColumnRenamed("id", "node")
    release(buckets, sets)
    named = texts.select("digest", F.col("id").alias("copy_of"), "node")
    smallest = label.join(named, "node").groupBy("label").agg(F.min("copy_of").alias("smallest"))
    named = named.join(label.join(smallest, "label"), "node", "left")
    return rows, named.select("digest", "copy_of", F.coalesce("smallest", "copy_of").alias("class_id"), F.coalesce("label", "node").alias("class"))


def one_of_each(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each near-duplicate class, with all its columns: the one of the smallest key.

    Of repeated rows of that document, one stays, and of several texts of that key in the class, one. Rows
    of a null key or null text have no class to stand for and stay, unless a row with a key has an equal or
    near text. Further columns stay as they are, whatever their names.
    """
    _, named = named_texts(docs, least, key, text)
    own, its = free_names(docs, "id", "digest")
    first = named.filter("copy_of = class_id").groupBy("class").agg(F.min("digest").alias(its), F.first("class_id").alias(own))
    rows = docs.withColumn(own, field(key).cast("long")).withColumn(its, digest(text))
    keyed = rows.filter(F.col(own).isNotNull() & F.col(its).isNotNull()).join(first.select(own, its), [own, its])
    keyed = keyed.unionByName(rows.filter(F.col(own).isNotNull() & F.col(its).isNull()))
    known = named.filter("class_id IS NOT NULL").select(F.col("digest").alias(its))
    other = rows.filter(F.col(own).isNull()).join(known, its, "left_anti")
    return one_row(keyed, own, its).drop(own, its).unionByName(other.drop(own, its))


def one_row(rows: DataFrame, *by: str) -> DataFrame:
    """One of the rows of each value of `by`, whole."""
    return rows.groupBy(*by).agg(F.first(F.struct(*(field(c) for c in rows.columns))).alias("row")).select("row.*")
