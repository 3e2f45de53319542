"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, field, fold, mapped, ranges, slices, text_bytes, tokens, with_field
from .quality import labelled_sample

ORDER, OWN = 5, 3  # n-grams of up to ORDER bytes, across words; orders from OWN up are counted for each class
FLAT = 3e-3  # nats a byte: differences that vary less say nothing
RATE = 0.01  # of the words of a toxic text, those that come from the toxic chain; the others are ordinary


@dataclass
class Counts:
    """One order of one model: discounted shares of the n-grams, and what each context leaves to the lower order."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray) -> Counts:
        order = np.argsort(grams)
        grams, n = grams[order], n[order].astype(np.float64)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.75
        contexts, inverse, kinds = np.unique(grams >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, n, len(contexts))
        return cls(grams, np.maximum(n - discount, 0) / total[inverse], contexts, np.minimum(n.min(initial=1), discount) * kinds / total if len(n) else total)

    def mixed(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P of each n-gram's last byte, given P of the lower order."""
        if not len(self.grams):
            return lower
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        share = np.where(self.grams[at] == grams, self.share[at], 0.0)
        context = grams >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return share + np.where(self.contexts[at] == context, self.left[at], 1.0) * lower


def running(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram of ORDER bytes that ends in each byte of the words and the space after each, its word and each word's row.

    Lower-case A-Z, one space between words and before the first; bytes before that are 0.
    """
    data = LOWER[data]
    starts, lengths, row = tokens(data, at)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    head = np.r_[True, row[1:] != row[:-1]]  # a text's first word has a space before it
    size = lengths + 1 + head
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]), 32, np.uint8)
    text[ranges(ends - lengths - 1, lengths)] = data[ranges(starts, lengths)]
    first = np.maximum.accumulate(np.where(head, ends - size, 0))
    inside = np.arange(len(text)) - np.repeat(first, size)
    key = np.zeros(len(text), np.uint64)
    for k in range(ORDER):
        seen = np.flatnonzero(inside >= k)
        key[seen] |= text[seen - k].astype(np.uint64) << np.uint64(8 * k)
    kept = inside > 0
    return key[kept], np.repeat(np.arange(len(size)), size)[kept], row


def low(order: int) -> np.uint64:
    return np.uint64((1 << 8 * order) - 1)


@dataclass
class Model:
    """Kneser-Ney chains of both classes over shared lower orders, with a scale and an offset for their difference."""

    own: tuple[list[Counts], list[Counts]]
    shared: list[Counts]
    scale: float = 1.0
    offset: float = 0.0

    def log_likelihoods(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram's last byte, given the bytes before it: ordinary and toxic."""
        distinct, inverse = np.unique(grams, return_inverse=True)
        p = np.full(len(distinct), 1 / 256)
        for k, counts in enumerate(self.shared):
            p = counts.mixed(distinct & low(k + 1), p)
        sides = []
        for chain in self.own:
            q = p
            for k, counts in enumerate(chain):
                q = counts.mixed(distinct & low(OWN + k), q)
            sides.append(np.log(q)[inverse])
        return sides[0], sides[1]

    def difference(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each row's toxic log-likelihood a byte less its ordinary one; 0 without words.

        An ordinary text's words come from the ordinary chain; of a toxic text's words, RATE are from the
        toxic chain and the others ordinary.
        """
        rows = len(at) - 1
        grams, word, row = running(data, at)
        if not len(grams):
            return np.zeros(rows)
        ordinary, toxic = (np.bincount(word, x, len(row)) for x in self.log_likelihoods(grams))
        mixed = np.logaddexp(np.log1p(-RATE) + ordinary, np.log(RATE) + toxic)
        size = np.bincount(row, np.bincount(word, minlength=len(row)), rows)
        return np.bincount(row, mixed - ordinary, rows) / np.maximum(size, 1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.scale * self.difference(data, at) + self.offset
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def pieces(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts joined, about limit bytes at a time: the driver fits beside Spark."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit or k == len(texts) - 1:
            yield joined(texts[first : k + 1])
            first, size = k + 1, 0


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for data, at in pieces(texts):
        more, n = np.unique(running(data, at)[0], return_counts=True)
        grams, where = np.unique(np.concatenate([grams, more]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return grams, counts


def counted(texts: list[str], y: np.ndarray) -> Model:
    """Both classes' chains, with the counts of orders under OWN shared."""
    tops = [gram_counts([t for t, b in zip(texts, y, strict=True) if b == c]) for c in (0, 1)]
    chains: tuple[list, list] = ([], [])
    fours = []
    for chain, (grams, n) in zip(chains, tops, strict=True):
        chain.insert(0, Counts.of(grams, n))
        for order in range(ORDER - 1, OWN - 1, -1):  # Kneser-Ney: how many longer n-grams end in this one
            grams, n = np.unique(grams & low(order), return_counts=True)
            chain.insert(0, Counts.of(grams, n))
        fours.append(grams)
    grams, shared = np.unique(np.concatenate(fours)), []
    for order in range(OWN - 1, 0, -1):
        grams, n = np.unique(grams & low(order), return_counts=True)
        shared.insert(0, Counts.of(grams, n))
    return Model(chains, shared)


def fit(texts: list[str], y: np.ndarray, folds: int = 3) -> Model:
    """Count n-grams on all examples; fit scale and offset, a logistic rule on the difference alone, on
    differences by the counts of the other folds' examples."""
    fold_of = np.zeros(len(texts), np.int64)
    for c in (0, 1):
        fold_of[y == c] = np.arange((y == c).sum()) % folds
    x = np.zeros(len(texts))
    for k in range(folds):
        others = counted([t for t, f in zip(texts, fold_of, strict=True) if f != k], y[fold_of != k])
        x[fold_of == k] = np.concatenate([np.zeros(0), *(others.difference(*p) for p in pieces([t for t, f in zip(texts, fold_of, strict=True) if f == k]))])
    model = counted(texts, y)
    unit = max(x.std(), FLAT)
    x, target, w = np.stack([x / unit, np.ones(len(x))], 1), y.astype(np.float64), np.zeros(2)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w += np.linalg.solve(h, x.T @ (target - p) - 0.1 * w)
    model.scale, model.offset = max(float(w[0]), 0.0) / unit, float(w[1])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, most_toxic: int = 3000, most_ordinary: int = 5000) -> Model | float:
    """Models fitted on a bounded sample of the labelled rows outside the held-out fold, their odds set back to those of all these rows.

    With examples of one label only, or none, the result is a constant score: the share of label 1, or 0.
    """
    sample, offset = labelled_sample(docs, labels, label, {1: most_toxic, 0: most_ordinary}, lambda k: fold(k, parts) != held)
    y = np.array([b for _, b in sample])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    model = fit([a for a, _ in sample], y)
    model.offset += offset
    return model


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out: the probability, 0 to 1, that each whole text is toxic.

    Both classes have a Kneser-Ney model of bytes; the toxic one is of texts in which some words are of the
    toxic chain. A text is judged by the difference of its two log-likelihoods a byte, and by that alone.
    Null and empty texts get the score of no words; texts of any length are scored whole, in pieces of
    rows of about 2 MB; equal texts get equal scores. Other columns pass through unchanged.
    """
    names = [n for n in docs.columns if n != out]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: some tens of MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, text, 2 << 20):
            data, at = text_bytes(part.column(names.index(text)))
            value = model.score(data, at) if isinstance(model, Model) else np.full(part.num_rows, model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], [*names, out])

    rows = docs.select(*(field(n) for n in names))
    return mapped(rows, run, with_field(rows.schema, out, "double"))
