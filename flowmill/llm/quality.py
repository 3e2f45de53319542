"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, mapped, slices, text_bytes, with_field

BLOCK, STRIDE, WIDTH = 512, 4, 8  # a filter sees 8 bytes, moves by 4; a chunk is two neighbouring blocks


@dataclass
class Net:
    """Byte embedding -> filters over overlapping windows -> max over overlapping chunks -> one probability."""

    dims: int = 8
    filters: int = 32
    hidden: int = 16
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)
    offset: float = 0.0  # added to score()'s logits: from the sample's odds to all examples'

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "bytes": normal(256, self.dims, by=0.5), "conv": normal(STRIDE * self.dims, 2 * self.filters, by=(WIDTH * self.dims) ** -0.5), "conv_b": np.zeros(self.filters, np.float32),
            "w1": normal(self.filters, self.hidden, by=self.filters**-0.5), "b1": np.zeros(self.hidden, np.float32), "w2": normal(2 * self.hidden, by=0.2), "b2": np.zeros(1, np.float32),
        }

    def buffer(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' bytes, each row in blocks of its own and ended by STRIDE zeros at least, and the rows' first blocks."""
        lengths = np.diff(at)
        first = np.concatenate([[0], np.cumsum((lengths + STRIDE + BLOCK - 1) // BLOCK)])
        buf = np.zeros(int(first[-1]) * BLOCK, np.uint8)
        for k, start in enumerate(first[:-1] * BLOCK):
            buf[start : start + lengths[k]] = data[at[k] : at[k + 1]]
        return buf, first

    def windows(self, buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded bytes of some whole blocks, and each filter's answer by block and window; last: rows' last blocks among them."""
        p, f = self.p, self.filters
        x = p["bytes"][buf].reshape(-1, STRIDE * self.dims)
        y = x @ p["conv"]
        out = y[:, :f] + p["conv_b"]
        out[:-1] += y[1:, f:]
        np.maximum(out, 0, out=out)
        out[(last + 1) * (BLOCK // STRIDE) - 1] = 0  # the window that would reach into the next row
        return x, out.reshape(-1, BLOCK // STRIDE, f)

    def joined(self, block: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        """One logit for each row from the block maxima: the greater of two neighbours is a chunk's."""
        p, blocks = self.p, np.diff(first)
        follows = np.ones(len(block), bool)
        follows[first[1:] - 1] = False  # a row's last block
        alone = np.repeat(blocks == 1, blocks)
        chunks = np.flatnonzero(follows | alone)
        left, right = block[chunks], block[chunks + follows[chunks]]
        pooled = np.maximum(left, right)
        h = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        count = np.maximum(blocks - 1, 1)
        starts = np.cumsum(count) - count
        mean, most = np.add.reduceat(h, starts) / count[:, None], np.maximum.reduceat(h, starts)
        joint = np.concatenate([mean, most], 1)
        logit = joint @ p["w2"] + p["b2"][0]
        return logit, {"block": block, "chunks": chunks, "follows": follows, "pooled": pooled, "left": left >= right, "h": h, "count": count, "most": most, "joint": joint}

    def forward(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        """One logit for each row of the joined bytes, every byte of each being seen, and what the gradient needs."""
        buf, first = self.buffer(data, at)
        x, windows = self.windows(buf, first[1:] - 1)
        logit, got = self.joined(windows.max(1), first)
        return logit, got | {"buf": buf, "x": x, "windows": windows}

    def logits(self, data: np.ndarray, at: np.ndarray, piece: int = 1024) -> np.ndarray:
        """forward()'s logits with the filters' answers of only `piece` blocks in memory at a time, however long a row is."""
        buf, first = self.buffer(data, at)
        ends = first[1:] - 1
        block = np.empty((int(first[-1]), self.filters), np.float32)
        for a in range(0, len(block), piece):
            b = min(a + piece, len(block))
            c = min(b + 1, len(block))  # a block more, whose first bytes the last window sees
            inside = ends[np.searchsorted(ends, a) : np.searchsorted(ends, c)] - a
            block[a:b] = self.windows(buf[a * BLOCK : c * BLOCK], inside)[1][: b - a].max(1)
        return self.joined(block, first)[0]

    def gradient(self, got: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of a loss by the parameters; d: by the logits."""
        p, f, count = self.p, self.filters, got["count"]
        g = {"w2": got["joint"].T @ d, "b2": d.sum(keepdims=True)}
        dj = d[:, None] * p["w2"]
        rows = np.repeat(np.arange(len(count)), count)
        dh = dj[rows, : self.hidden] / count[rows, None]
        dh += dj[rows, self.hidden :] * (got["h"] == got["most"][rows])
        dh *= got["h"] > 0
        g |= {"w1": got["pooled"].T @ dh, "b1": dh.sum(0)}
        dp = dh @ p["w1"].T
        db = np.zeros_like(got["block"])
        db[got["chunks"]] += dp * got["left"]
        other = ~got["left"]
        np.add.at(db, got["chunks"] + got["follows"][got["chunks"]], dp * other)
        db *= got["block"] > 0
        best = got["windows"].argmax(1)
        dout = np.zeros((got["windows"].shape[0] * got["windows"].shape[1], f), np.float32)
        dout[np.arange(len(db))[:, None] * got["windows"].shape[1] + best, np.arange(f)] = db
        dy = np.zeros((len(dout), 2 * f), np.float32)
        dy[:, :f] = dout
        dy[1:, f:] = dout[:-1]
        g |= {"conv": got["x"].T @ dy, "conv_b": dout.sum(0)}
        dx = (dy @ p["conv"].T).reshape(-1, self.dims)
        g["bytes"] = np.stack([np.bincount(got["buf"], dx[:, k], 256) for k in range(self.dims)], 1)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 9, batch_bytes: int = 400_000, rate: float = 4e-3, steps: int = 250) -> Net:
        """Adam over the examples, epochs times; few examples come in smaller batches, and more often, up to `steps` steps."""
        rng, moment, square, step = np.random.default_rng(self.seed), {}, {}, 0
        batch = int(np.clip(len(texts) // 20, 8, 128))
        epochs = max(epochs, -(-steps // -(-max(len(texts) * batch_bytes, sum(map(len, texts)) * batch) // (batch * batch_bytes))))
        for epoch in range(epochs):
            order, first = rng.permutation(len(texts)), 0
            while first < len(order):
                last, size = first, 0
                while last < len(order) and (last == first or size + len(texts[order[last]]) <= batch_bytes and last - first < batch):
                    size += len(texts[order[last]])
                    last += 1
                part = order[first:last]
                first = last
                at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
                logit, got = self.forward(np.frombuffer(b"".join(texts[i] for i in part), np.uint8), at)
                d = ((1 / (1 + np.exp(-logit)) - labels[part]) / len(part)).astype(np.float32)
                step += 1
                for k, g in self.gradient(got, d).items():
                    moment[k] = 0.9 * moment.get(k, 0) + 0.1 * g
                    square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
                    by = rate * (1 - epoch / epochs) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                    self.p[k] = (self.p[k] - by - (1e-4 * rate * self.p[k] if k != "b2" else 0)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(data, at).astype(np.float64) + self.offset, -40, 40))), 6)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], allowed, most_bytes: int = 64 << 20) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most most[label] rows of each label whose id is allowed, chosen by a hash of the id,
    and of these as many whole texts as make most_bytes, in the order of the hash (texts of a 64th of that
    at most, as one is held by the fit many times over); and the log-odds of label 1 among all allowed rows less those in the sample, for a fitted rule to add.

    Each label is sampled at a rate of its own, its cap over its count, so the sample's odds are the true ones
    times the ratio of the rates; with the logarithm of that taken back, scores mean the same at every size.
    Only ids and labels are counted and ranked; the chosen ids, at most the sum of most, are broadcast to find their texts.
    Rows without id, label or text are no examples; of an id with two labels, each counts.
    """
    known = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("label")).filter(F.col("k").isNotNull() & allowed(F.col("k"))).distinct()
    found = {r.label: r["count"] for r in known.filter(F.col("label").isin(*most)).groupBy("label").count().collect()}
    offset = sum((1 if value else -1) * float(np.log(max(found.get(value, 0) / count, 1))) for value, count in most.items())
    chosen = None
    for value, count in most.items():
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("k"), "k").limit(count)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col("doc_id").alias("k"), "text").filter(F.octet_length("text") <= most_bytes // 64).join(F.broadcast(chosen), "k")
    reached = Window.orderBy(F.xxhash64("k"), "k", "label", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the sample's rows
    rows = rows.withColumn("reached", F.sum(F.octet_length("text")).over(reached)).filter(F.col("reached") <= most_bytes)
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: (r.k, r.label, r.text))], offset


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0, most_good: int = 2500, most_bad: int = 1500) -> Net | float:
    """A network fitted on a bounded sample of the labelled rows outside the held-out fold, its odds set back to those of all these rows.

    With examples of one label only, or none, the result is a constant score: the share of label 1, or 0.5.
    """
    sample, offset = labelled_sample(docs, labels, label, {1: most_good, 0: most_bad}, lambda k: fold(k, parts) != held)
    y = np.array([b for _, b in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    net = Net().fit([a.encode() for a, _ in sample], y)
    net.offset = offset
    return net


def score(docs: DataFrame, model: Net | float, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out: the probability, 0 to 1, that each whole text is of label 1.

    Null and empty texts get the network's score of no bytes; texts of any length are scored whole, in
    pieces of rows of about 1 MB; equal texts get equal scores. Other columns pass through unchanged.
    """
    names = [n for n in docs.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 1 << 20):
            data, at = text_bytes(part.column(names.index(text)))
            value = model.score(data, at) if isinstance(model, Net) else np.full(part.num_rows, model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], [*names, out])

    rows = docs.select(*(F.col(f"`{n}`") for n in names))
    return mapped(rows, run, with_field(rows.schema, out, "double"))
