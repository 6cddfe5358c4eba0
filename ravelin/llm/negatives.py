"""Hard negatives: for an anchor and a near row of its label, near rows of other labels inside a band of its score.

Scores are integer inner products. Rows and anchors are turned by an orthogonal matrix whose first axes hold most of the
rows' length (the principal axes of a sample), products are accumulated axis block by axis block, and a pair goes as soon
as what it has so far, plus the lengths of what is left and a slack for rounding, can't reach what is asked for. Integer
products of the survivors decide, so the matrix and the sample change no result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, share_of, stored, table_path

#: Components beyond this size (x beyond 65,536) leave a row out, so that sums of 16,384 products fit in 64 bits.
LARGEST = 1 << 24
#: The rotation is fitted on so many values of a sample at most.
FIT_VALUES = 2_000_000
#: Anchors of one pass over the rows, and rows taken at once.
ANCHORS, ROWS = 2_048, 1_024
_LAST = np.iinfo(np.int64).max


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(_uid, _id, _label, _q) of the rows that take part: label and vector not null, no component null, infinite, NaN or beyond LARGEST."""
    numbers = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) * scale <= F.lit(float(LARGEST - 1)), F.lit(False)) & ~F.isnan(x.cast("double")))
    own = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fits, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("bigint").alias("_label"), F.transform(numbers, lambda x: x.cast("int")).alias("_q"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Rotation:
    """An orthogonal matrix, the ends of its blocks of axes, and what rounding can add to a product of rows of length one."""

    def __init__(self, sample: np.ndarray):
        width = sample.shape[1]
        x = sample.astype(np.float64)
        self.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy() if len(x) and width else np.eye(width)
        self.ends = sorted({max(1, width // 4), max(1, width // 2), max(1, 3 * width // 4)}) if width else []
        defect = float(np.abs(self.axes.T @ self.axes - np.eye(width)).sum(axis=1).max()) if width else 0.0
        self.slack = 4 * defect + 16 * (width + 8) * np.finfo(np.float64).eps

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates, lengths of what is left after each block, and whole lengths."""
        y = q.astype(np.float64) @ self.axes
        left = np.stack([np.sqrt(np.square(y[:, e:]).sum(axis=1)) for e in self.ends], axis=1) if self.ends else np.zeros((len(q), 0))
        return y, left, np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))

    def survivors(self, rows: tuple, anchors: tuple, mask: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, anchor) of the mask that no block of axes rules out; keep(low, high) says which bounds are still of use."""
        (y, left, size), (z, rest, length) = rows, anchors
        at, partial, begin = np.arange(len(y)), np.zeros(mask.shape), 0
        slack = self.slack * size[:, None] * length[None, :] + 1e-6
        for k, end in enumerate(self.ends):
            partial += y[at, begin:end] @ z[:, begin:end].T
            room = left[at, k][:, None] * rest[None, :, k] + slack[at]
            mask = mask & keep(partial - room, partial + room)
            some = mask.any(axis=1)
            at, partial, mask, begin = at[some], partial[some], mask[some], end
        row, anchor = np.nonzero(mask)
        return at[row], anchor


def _products(q: np.ndarray, a: np.ndarray, rows: np.ndarray, anchors: np.ndarray, step: int = 65_536) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", q[rows[s : s + step]], a[anchors[s : s + step]]) for s in range(0, len(rows), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


class Best:
    """The best rows of each group so far: by falling score, then rising id (null last), then row."""

    def __init__(self, groups: int, count: int):
        self.count = count
        self.found = np.zeros((0, 4), np.int64)  # group, score, id, uid
        self.least = np.full(groups, -_LAST, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        if not len(group):
            return
        f = np.concatenate([self.found, np.stack([group, score, ids, uids], axis=1)])
        f = f[np.lexsort((f[:, 3], f[:, 2], -f[:, 1], f[:, 0]))]
        starts = np.flatnonzero(np.r_[True, f[1:, 0] != f[:-1, 0]])
        place = np.arange(len(f)) - np.repeat(starts, np.diff(np.r_[starts, len(f)]))
        self.found = f[place < self.count]
        full = f[place == self.count - 1]
        self.least[full[:, 0]] = full[:, 1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.found[:, k].copy()) for k in range(4)], names=["g", "score", "id", "uid"])


def _passed(rows: DataFrame, width: int, run: Callable[[Best, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None], groups: int, count: int) -> DataFrame:
    """(g, score, id, uid): the best rows of each group in each task; run adds those of ROWS rows to what the task has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(groups, count)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = part.column(1).fill_null(_LAST).to_numpy()
                run(best, part.column(0).to_numpy(), ids, part.column(2).to_numpy(), _matrix(part.column(3), width))
        yield best.batch()

    return in_batches(rows.select("_uid", "_id", "_label", "_q"), each, "g bigint, score bigint, id bigint, uid bigint")


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("g").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: Callable[[Column], Column] | None = None, positives: int = 5, count: int = 3, low: int = 50, high: int = 95,
    relabel: Callable[[Column, Column], Column] | None = None, scale: int = 256, chunk: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors says of an id whether its rows are anchors (if it is divisible by 50, unless given). An anchor's positives are its
    best `positives` other rows of its label; for each, the first `count` rows of other labels with low * positive <=
    100 * negative <= high * positive. Scores are inner products of floor(scale * x); higher ones come first, ties by
    smaller id, null ids last. Rows with a null label or vector, or a null, infinite, NaN or very large component (see
    LARGEST) take no part; missing components of shorter vectors count as zero, so an empty vector scores 0. Every row
    is one of its own: rows that repeat an id or a vector are others to each other. Anchors without a positive, and
    positives without a negative, give no row. relabel(id, label) replaces labels first.

    Anchors are taken `chunk` at a time, so what is broadcast is bounded; the rows are read twice for each chunk."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, label_col, scale)
    if relabel:
        rows = rows.withColumn("_label", relabel(F.col("_id"), F.col("_label")))
    chosen = F.col("_id") % 50 == 0 if anchors is None else anchors(F.col("_id"))
    rows = stored(rows.withColumn("_anchor", F.coalesce(chosen, F.lit(False))), "vectors")
    n, width, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(0)), F.count(F.when(F.col("_anchor"), 1))).first()
    fit = max(1, FIT_VALUES // max(1, width))
    sample = rows.where(share_of(min(1.0, 0.9 * fit / max(1, n)), F.col("_uid"))).select("_q").limit(fit).toArrow()
    rotation = Rotation(_matrix(sample["_q"], width))
    chunks, path = max(1, -(-n_anchors // chunk)), table_path(spark, "negatives")
    for c in range(chunks):
        part = rows.where("_anchor").where(F.pmod(F.xxhash64("_uid"), F.lit(chunks)) == c).select("_uid", "_id", "_label", "_q").toArrow()
        _chunk(rows, part, rotation, width, positives, count, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _chunk(rows: DataFrame, part: pa.Table, rotation: Rotation, width: int, positives: int, count: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    context = spark.sparkContext
    uid, ids, label, a = part["_uid"].to_numpy(), part["_id"].to_pylist(), part["_label"].to_numpy(), _matrix(part["_q"], width)
    sent = context.broadcast((uid, label, a, rotation, rotation.turned(a)))

    def near(best: Best, row_uid: np.ndarray, row_id: np.ndarray, row_label: np.ndarray, q: np.ndarray) -> None:
        uid, label, a, rotation, turned = sent.value
        mask = (row_label[:, None] == label[None, :]) & (row_uid[:, None] != uid[None, :])

        def keep(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            return highest >= best.least[None, :]

        r, k = rotation.survivors(rotation.turned(q), turned, mask, keep)
        score = _products(q, a, r, k)
        best.add(k, score, row_id[r], row_uid[r])

    found = _ranked(_passed(rows, width, near, len(uid), positives), positives).select("g", "rank", "score", "id").toArrow()  # anchors x positives at most
    pair = np.argsort(found["g"].to_numpy(), kind="stable")
    of, score = found["g"].to_numpy()[pair], found["score"].to_numpy()[pair]
    # 100 * negative is compared, so the ends are whole numbers; taken as Python's integers, as 100 * score may pass 64 bits
    least, most = (np.array(x, np.int64) for x in ([-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]))
    windows = context.broadcast((of, least, most, np.searchsorted(of, np.arange(len(uid) + 1))))

    def between(best: Best, row_uid: np.ndarray, row_id: np.ndarray, row_label: np.ndarray, q: np.ndarray) -> None:
        _, label, a, rotation, turned = sent.value
        of, least, most, cuts = windows.value
        need = np.maximum(least, best.least)  # what a row must reach to count for a window
        some = np.full((positives, len(label)), _LAST, np.float64), np.full((positives, len(label)), -_LAST, np.float64)
        place = np.arange(len(of)) - cuts[of]
        some[0][place, of], some[1][place, of] = need, most

        def keep(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
            out = np.zeros(lowest.shape, bool)
            for n, m in zip(*some, strict=True):
                out |= (highest >= n[None, :]) & (lowest <= m[None, :])
            return out

        r, k = rotation.survivors(rotation.turned(q), turned, row_label[:, None] != label[None, :], keep)
        score = _products(q, a, r, k)
        for j in range(positives):
            w = cuts[k] + j
            w = np.where(w < cuts[k + 1], w, -1)
            ok = (w >= 0) & (score >= need[w]) & (score <= most[w]) if len(of) else np.zeros(len(k), bool)
            best.add(w[ok], score[ok], row_id[r[ok]], row_uid[r[ok]])

    ranked = _ranked(_passed(rows, width, between, len(of), count), count)
    own = [ids[g] for g in of.tolist()]
    other = [None if x == _LAST else x for x in found["id"].to_numpy()[pair].tolist()]
    pairs = pa.table({"g": pa.array(range(len(of)), pa.int64()), "anchor_id": pa.array(own, pa.int64()), "positive_id": pa.array(other, pa.int64()), "positive_score": pa.array(score, pa.int64())})
    return ranked.withColumn("negative_id", F.when(F.col("id") != _LAST, F.col("id"))).join(F.broadcast(spark.createDataFrame(pairs)), "g").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
