"""Quality classifier: regularised quadratic discriminant over transformed statistics of a text.

Per class, mean and covariance of the feature vectors come from distributed sums over all labelled rows of the learning
folds. Each covariance is shrunk: towards the pooled covariance of both classes by ``POOL``, then towards its own
diagonal by ``DIAGONAL``, and its Cholesky factor is kept in inverse form with the model. A score is the logistic of the
difference of the two classes' log-densities (half the difference of Mahalanobis distances and log-determinants) plus
the log-ratio of the class shares.

Features are counts of the text alone, as log-ratios, so that they are roughly bell-shaped: word length, symbols,
exclamation marks, separators, capitals, digits, punctuation, repeated three-word windows, words equal to the one before.
None follows the text's length, so that short clean texts are not rejected for being short.

Defined cases: null and empty texts have the features of an empty text and get a score; rows without a label, with a
null label or in the held-out fold are not learned from; a label that stands twice counts twice; if a class has no
learning row, its density is that of the other class, so that scores follow the shares alone; without any, all scores
are 0.5. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import line_quality

POOL = 0.1
DIAGONAL = 0.05
FEATURES = ("word_length", "symbols", "bangs", "pipes", "capitals", "digits", "punctuation", "repeats", "stutter")
_DIGIT = line_quality._flags("0123456789")
_PUNCTUATION = line_quality._flags(".,;:?")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a slice."""
    rows = len(offsets) - 1
    run = line_quality._running
    of = lambda mask: (r := run(mask))[offsets[1:]] - r[offsets[:-1]]
    starts, ends, word_offsets = C.word_spans(data, offsets, C.NOT_SPACE)
    hashes = C.word_hashes(data, starts, ends, True)
    row_of_word = np.repeat(np.arange(rows), np.diff(word_offsets))
    words = np.diff(word_offsets).astype(float)
    chars = of(C.NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    capital = line_quality._UPPER[data]
    letter = line_quality._LETTER[data]
    if len(data) > 1:
        lead = data[:-1] == 0xC3
        capital[1:] |= lead & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        letter[1:] |= lead & (data[1:] >= 0x80)
    capitals, letters = of(capital), of(letter)
    repeats = line_quality._repeated_words(hashes, word_offsets)
    rate = lambda part, whole: np.log((part + 0.5) / (whole + 10.0))
    odds = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))
    return np.column_stack([
        np.log((chars + 5.0) / (words + 1.0)), rate(of(line_quality._SYMBOL[data]), words), rate(of(data == 0x21), words),
        rate(of(line_quality._PIPE[data]), words), odds(capitals, letters), rate(of(_DIGIT[data]), chars), rate(of(_PUNCTUATION[data]), words),
        odds(repeats, words), rate(np.bincount(row_of_word[again], minlength=rows), words),
    ]) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor and log of the factor's determinant; the log-ratio of the shares."""

    mean: list[np.ndarray]
    inverse_factor: list[np.ndarray]
    log_det: list[float]
    log_share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.mean, self.inverse_factor, self.log_det)]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.log_share, -500.0, 500.0)))


def fit_moments(count: list[float], total: list[np.ndarray], outer: list[np.ndarray], pool: float = POOL, diagonal: float = DIAGONAL) -> Model:
    """The model of the sums of a class's vectors and of their outer products."""
    d = len(FEATURES)
    if min(count) == 0:
        known = int(count[1] > 0)
        count_, total_, outer_ = count[known], total[known], outer[known]
        mean = total_ / count_ if count_ else np.zeros(d)
        share = np.log((count[1] + 0.5) / (count[0] + 0.5))
        factor, log_det = _factor(outer_ / count_ - np.outer(mean, mean) if count_ else np.eye(d), diagonal)
        return Model([mean, mean], [factor, factor], [log_det, log_det], float(share))
    means = [t / n for t, n in zip(total, count)]
    own = [o / n - np.outer(m, m) for o, n, m in zip(outer, count, means)]
    pooled = sum(n * s for n, s in zip(count, own)) / sum(count)
    factors = [_factor((1 - pool) * s + pool * pooled, diagonal) for s in own]
    return Model(means, [f for f, _ in factors], [ld for _, ld in factors], float(np.log(count[1] / count[0])))


def _factor(covariance: np.ndarray, diagonal: float) -> tuple[np.ndarray, float]:
    shrunk = (1 - diagonal) * covariance + diagonal * np.diag(np.diag(covariance)) + 1e-3 * np.eye(len(covariance))
    lower = np.linalg.cholesky(shrunk)
    return np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())


def feature_rows(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``features`` (array of double) of every row. A map over the scan."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    name = C.free_name(id_cols, "features")

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            parts = [features(piece, offs) for _, _, piece, offs in C.slices(data, offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in id_cols] + [_lists(x)], names=[*id_cols, name])

    return C.map_rows(docs, list(dict.fromkeys([*id_cols, text_col])), ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{name}` array<double>"]), run)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def learning_labels(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int) -> DataFrame:
    return labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), folds) != held_out)).select(F.col(id_col), F.col(label_col).cast("int").alias("y"))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> Model:
    """Fits on ``rows`` (``id_col``, ``features``). Each task sums its rows; the driver gets one row for each class and
    cell of the sums."""
    d = len(FEATURES)
    train = rows.join(learning_labels(labels, label_col, id_col, folds, held_out), id_col).select("y", "features")

    def sums(batches):
        count, total, outer = [0.0, 0.0], [np.zeros(d), np.zeros(d)], [np.zeros((d, d)), np.zeros((d, d))]
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = np.asarray(batch.column("features").flatten()).reshape(-1, d)
            for k in (0, 1):
                part = x[y == k]
                count[k] += len(part)
                total[k] += part.sum(axis=0)
                outer[k] += part.T @ part
        cells = [np.concatenate([[count[k]], total[k], outer[k].ravel()]) for k in (0, 1)]
        size = len(cells[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(np.concatenate(cells), pa.float64())],
            names=["y", "cell", "v"],
        )

    got = train.mapInArrow(C.lean(sums), "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in got:
        flat[r["y"], r["cell"]] = r["v"]
    return fit_moments([flat[k, 0] for k in (0, 1)], [flat[k, 1 : 1 + d] for k in (0, 1)], [flat[k, 1 + d :].reshape(d, d) for k in (0, 1)])


def score(rows: DataFrame, model: Model, out_col: str = "score") -> DataFrame:
    """``rows`` without ``features``, with the score in its place."""
    id_cols = [c for c in rows.columns if c != "features"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("features").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in id_cols] + [pa.array(model.scores(x), pa.float64())], names=[*id_cols, out_col])

    return rows.mapInArrow(C.lean(run), ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{out_col}` double"]))


def keep_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``. No shuffle."""
    order = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("row"), F.col(f"`{text_col}`").alias("scan_text"))
    scored = score(feature_rows(packed, ["row"], "scan_text"), model)
    return scored.where(F.col("score") >= threshold).select(*[F.col("row")[c].alias(c) for c in order])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = C.cut(feature_rows(docs, ["doc_id"]))
    scored = score(rows, fit(rows, labels))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
