"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

Each text becomes a few dozen statistics of its bytes, words and lines. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Tasks sum their parts of the normal equations,
whose size depends on the number of features alone, and the calibration is fitted on binned scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stored
from .common import SLICE_BYTES, held_out, slices, text_buffers, word_spans, word_hashes

#: Byte groups whose shares are statistics.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "\"'", "-_", "()[]{}<>", ":;/\\@=+~^`"]
N_STATS = len(GROUPS) + 1 + 12
#: Rows whose features are at hand at once.
ROWS = 1000


def _group_table() -> np.ndarray:
    table = np.full(256, len(GROUPS) + 1, np.int64)
    table[128:] = len(GROUPS)
    for k, chars in enumerate(GROUPS):
        table[list(chars.encode())] = k
    return table


_TABLE = _group_table()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATS numbers for each text; an empty text has zeros and its own mark."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    width = len(GROUPS) + 2
    counts = np.bincount(doc * width + _TABLE[data], minlength=n * width).reshape(n, width)[:, :-1]
    full = np.maximum(size, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    many = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    sums = np.bincount(owner, length, n)
    squares = np.bincount(owner, length * length, n)
    mean = sums / many
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    unique = np.bincount(owner[order][fresh], minlength=n)
    last, head = data[ends - 1] if len(ends) else data[:0], data[starts] if len(starts) else data[:0]
    symbol = (last < 128) & (_TABLE[last] >= 8) & (_TABLE[last] < len(GROUPS))
    capital = (head >= 65) & (head <= 90)
    short = length <= 3
    upper_end = (last >= 65) & (last <= 90)
    lines = counts[:, 4] + 1
    share = lambda mask: np.bincount(owner[mask], minlength=n) / many
    rest = [
        (size == 0).astype(float), np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(squares / many - mean * mean, 0)), np.log1p(words / lines),
        unique / many, np.log1p(unique), share(symbol), share(capital), share(short), share(upper_end),
    ]
    return np.hstack([np.sqrt(counts / full), np.array(rest).T.reshape(n, len(rest))])


def batch_statistics(column) -> np.ndarray:
    data, at = text_buffers(column)
    out = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at, SLICE_BYTES)]
    return np.vstack(out).astype(np.float32) if out else np.zeros((0, N_STATS), np.float32)


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statistics of the texts; other columns go along."""
    for batch in batches:
        flat = batch_statistics(batch.column("text"))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_STATS), pa.array(flat.ravel()))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), stats], names=[*kept, "stats"])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS).astype(float)


class Model:
    """Standardisation, the random projection, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, dims: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.project = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, dims))
        self.phase = rng.uniform(0, 2 * np.pi, dims)
        self.weights = np.zeros(1 + N_STATS + dims)
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def phi(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), x * 0.1, np.sqrt(2 / len(self.phase)) * np.cos(x @ self.project + self.phase)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.phi(stats[i : i + ROWS]) @ self.weights for i in range(0, len(stats), ROWS))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def fit(examples: DataFrame, dims: int = 256, gamma: float = 0.03, ridge: float = 1.0, bins: int = 512, seed: int = 11) -> Model:
    """Fit on rows of (stats, label); label 0 or 1. Every row takes part.

    What reaches the driver: one mean and deviation per statistic, the summed normal equations
    (1 + N_STATS + dims rows), and at most ``bins`` counts of scores.
    """
    each = examples.select(*(F.col("stats")[i].cast("double").alias(f"s{i}") for i in range(N_STATS)), "label")
    row = each.agg(F.count("label"), F.sum("label"), *(f(f"s{i}") for i in range(N_STATS) for f in (F.avg, F.stddev_pop))).first()
    n, ones = row[0], row[1] or 0
    pairs = np.array([0 if x is None else x for x in row[2:]], float).reshape(N_STATS, 2)
    model = Model(pairs[:, 0], np.where(pairs[:, 1] > 1e-9, pairs[:, 1], 1.0), dims, gamma, seed)
    if not n or ones in (0, n):  # nothing to tell apart: the share of label 1 for all
        share = ones / n if n else 0.5
        model.steps = (np.array([0.0, 1.0]), np.array([share, share]))
        return model
    size = len(model.weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            stats, y = _matrix(batch.column("stats")), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            for i in range(0, len(stats), ROWS):
                phi = model.phi(stats[i : i + ROWS])
                total += phi.T @ np.hstack([phi, y[i : i + ROWS, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([x.tobytes() for x in total], pa.binary())], names=["i", "row"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("row"))
        return pa.table({"i": table.column("i")[:1].cast(pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})

    rows = examples.select("stats", "label").mapInArrow(sums, "i int, row binary").groupBy("i").applyInArrow(added, "i int, row binary").collect()
    both = np.zeros((size, size + 1))
    for r in rows:
        both[r.i] = np.frombuffer(bytes(r.row))
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint((model.raw(_matrix(batch.column("stats"))) + 0.5) / 2 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.float64())], names=["bin", "label"])

    table = examples.select("stats", "label").mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("label"), F.count("label").cast("double").alias("weight"))
    steps = table.coalesce(1).select("label", "weight", (F.col("bin") / bins * 2 - 0.5).cast("double").alias("features"))
    calibration = IsotonicRegression(weightCol="weight").fit(steps)
    model.steps = (np.array(calibration.boundaries.toArray()), np.array(calibration.predictions.toArray()))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Score every whole text of ``docs``: how likely ``labels.quality`` is 1.

    Learns from labelled rows of ``docs`` that are not held out (see ``held_out``); only texts are looked
    at. Returns one row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1) and ``predicted``
    (1 if score >= ``cut``).

    Null and empty texts are scored by their own mark and zeros. Labels other than 0 and 1, null labels and labels without a
    document are left out; a repeated label counts each time. With no usable label every score is
    0.5, with labels of one kind that label's share. An empty table gives an empty result. Other columns are not looked at. A text's
    arrays take about 40 times its bytes while it is read; texts are read in runs of 256 KiB, or one by one where they are longer.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = stored(rows.mapInArrow(features_of, "doc_id long, stats array<float>"), "quality-stats")
    model = _model(stats, labels, **options)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("stats"))))], names=["doc_id", "score"])

    out = stats.mapInArrow(scored, "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _model(stats: DataFrame, labels: DataFrame, **options) -> Model:
    """Fitted on the labelled rows of (doc_id, stats) that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    return fit(stored(stats.join(known, "doc_id").select("stats", "label"), "quality-examples"), **options)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Each row is judged by its own text as it is read again, whether or not others have its id; null ids and texts are judged as others. An
    empty table stays empty.
    """
    names, text = docs.columns, "_quality_text"
    while text in names:
        text += "_"
    rows = docs.withColumn(text, F.col(text_col).cast("string"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = _model(ids.mapInArrow(features_of, "doc_id long, stats array<float>"), labels, **options)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.score(batch_statistics(batch.column(text)).astype(float)) >= cut
            yield batch.select(names).filter(pa.array(keep))

    return rows.mapInArrow(good, docs.schema)
