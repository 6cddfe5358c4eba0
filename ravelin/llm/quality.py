"""A quality classifier: histogram gradient-boosted trees over statistics of the text.

The statistics of all documents are computed once, in Arrow batches, and stored. The trees are grown on a bounded
sample of labelled rows (`max_train`, 20,000 unless set; about 2 MB of numbers, fetched to the driver), flattened
into arrays and walked by numpy for whole batches, all rows one level down at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, in_batches, share_of, stored

MAX_TRAIN = 20_000

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "stops", "commas", "non_ascii", "lines", "line_words",
    "short_lines", "repeated_lines", "distinct_words", "top_word", "short_words", "odd_words", "word_length_spread", "repeated_pairs", "byte_entropy",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>@\\^_~{}[]+=/", dtype=np.uint8)


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of FEATURES; all zero for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, w = len(text), len(words)
    sizes = np.fromiter(map(len, words), np.int64, count=w)
    lower = text.lower().split()
    seen = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_words = [x.count(b" ") + 1 for x in lines]
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    shares = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(w), sizes.mean(), counts[65:91].sum() / n, counts[48:58].sum() / n, counts[_SYMBOLS].sum() / n, counts[33] / w, counts[124] / w,
        counts[46] / w, counts[44] / w, counts[128:].sum() / n, np.log1p(len(lines)), np.log1p(w / len(lines)), sum(x < 4 for x in line_words) / len(lines),
        1 - len(set(lines)) / len(lines), len(seen) / w, max(seen.values()) / w, (sizes <= 3).mean(), sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w,
        sizes.std(), 1 - pairs / max(1, w - 1), float(-(shares * np.log2(shares)).sum()),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: Sequence[Column] = ()) -> DataFrame:
    """id_col, the keys (64-bit numbers) and `stats` (array of float) for every row."""
    own = docs.select(F.col(text_col).cast("binary"), F.col(id_col), *keys)
    names = own.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t or b"") for t in batch.column(0).to_pylist()], dtype=np.float32).reshape(-1)
            cuts = np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=[*names, "stats"])

    return in_batches(own, run, ", ".join(f"`{c}` {kind}" for c, kind in own.dtypes[1:]) + ", stats array<float>")


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: split feature and threshold by inner node, value by leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Boosts logistic loss over quantile bins; gradients and Hessians are summed by (node, feature, bin).

    Without rows every score is 0.5; with one label only, scores are near that label."""
    n, wide = x.shape
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).astype(np.float32) if n else np.zeros((bins - 1, wide), np.float32)
    binned = np.stack([np.searchsorted(edges[:, f], x[:, f], side="left") for f in range(wide)], axis=1) if n else np.zeros((0, wide), np.int64)
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf, np.float32), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    if not n:
        return model
    total = np.full(n, model.base)
    lanes = binned + np.arange(wide) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (wide * bins) + lanes).ravel()
            sums = [np.bincount(at, np.repeat(v, wide), minlength=width * wide * bins).reshape(width, wide, bins).cumsum(axis=2) for v in (grad, hess)]
            g, h = sums
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            gain[:, :, -1] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            first = width - 1
            model.feature[t, first : first + width] = f
            model.threshold[t, first : first + width] = np.where(split, edges[np.minimum(b, bins - 2), f], np.inf)
            node = 2 * node + (split[node] & (binned[np.arange(n), f[node]] > b[node]))
        g, h = (np.bincount(node, v, minlength=2**depth) for v in (grad, hess))
        model.value[t] = -rate * g / (h + l2)
        total += model.value[t][node]
    return model


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", held_out: int = 5, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from the labelled rows whose crc32 fold isn't 0, at most about max_train of them, taken by a hash of the id.

    Null ids and labels are left out; an id with several labels counts by their mean, one with several texts by the
    text whose statistics sort first."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    own = own.groupBy("_id").agg(F.avg("_y").alias("_y")).where(fold(F.col("_id"), held_out) != 0)
    share = min(1.0, max_train / max(1, own.count()))
    sample = own.where(share_of(share, F.col("_id"), F.lit("train")))  # about max_train rows
    found = stats.select(F.col(id_col).alias("_id"), "stats").join(F.broadcast(sample), "_id")
    rows = found.groupBy("_id").agg(F.min("stats").alias("stats"), F.first("_y").alias("_y")).toArrow().sort_by("_id")
    x = rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return grow(x, (rows["_y"].to_numpy() >= 0.5).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, cut: float = 0.3, max_train: int = MAX_TRAIN, keys: Sequence[Column] = ()) -> DataFrame:
    """id_col, the keys if any, held_out, score, predicted for every row of docs.

    Scores come from the text alone. Null texts count as empty ones; a null id is never held out; repeated rows
    each come back; other columns are ignored. Without labelled rows all scores are 0.5."""
    stats = stored(features(docs, id_col, text_col, keys), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, id_col, label_col, held_out, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.value.score(x))], names=[*names, "score"])

    names = stats.columns[:-1]
    scored = stats.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in stats.dtypes[:-1]) + ", score double")
    return scored.select(*names, (fold(F.col(id_col), held_out) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
