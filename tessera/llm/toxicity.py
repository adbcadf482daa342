"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts without a confirmed label (U) train a linear classifier with the logistic loss on the
words a text contains, by the class-prior-corrected risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``: where the
bracket turns negative, the step goes against it, so that the model can't gain by calling every unlabelled text clean.

Words are runs of 0-9, a-z (A-Z folded) and non-ASCII characters. Terms are the words and, for word families, their
beginnings of ``STEMS`` bytes, told apart by 64-bit hashes; a text is the set of its terms, whatever its length. The
vocabulary is the terms of at least ``MIN_TEXTS`` and ``MIN_SHARE`` of the P texts that are toxic in at least
``MIN_POSTERIOR`` of their texts by the estimate ``prior * p(term | P) / p(term | U)``.

Bound of learning: at most ``MAX_POSITIVE`` P texts and ``MAX_UNLABELLED`` U texts, drawn by hash of doc_id from the
learning folds. Their terms are counted by Spark; the driver, where NumPy trains, gets the chosen terms of each drawn
text only. Scoring covers every row.

Defined cases: null and empty texts have no words and get the score of the bias alone; rows with a null label count as
unlabelled; without P or U texts all scores are the prior (0 without P); repeated rows are scored each for itself and
drawn once, an id with several texts with the least of their term sets (as bytes).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.quality_qda import fold

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 6_000
MIN_TEXTS = 8
MIN_SHARE = 0.004
MIN_POSTERIOR = 0.65
STEMS = (4, 5, 6, 7, 8)
STEPS = 300
RATE = 0.1
PENALTY = 3e-4


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a slice (words, and word beginnings of ``STEMS`` bytes), and the row of each."""
    starts, ends, word_offsets = C.word_spans(data, offsets, C.ALNUM)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))
    hashes, of = [C.word_hashes(data, starts, ends, True)], [rows]
    stem = np.zeros(len(starts), np.uint64)
    for k in range(max(STEMS)):
        longer = np.flatnonzero(ends - starts > k)
        stem[longer] += C._BYTE_VALUES[C.FOLD][data[starts[longer] + k]] * C._POW[k]
        if k + 1 in STEMS:
            more = np.flatnonzero(ends - starts > k + 1)
            hashes.append(C.mix(stem[more] ^ np.uint64(k + 1)))
            of.append(rows[more])
    return np.concatenate(hashes), np.concatenate(of)


def term_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    hashes, rows = terms(data, offsets)
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(len(offsets)))
    return [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, row_of = terms(data, offsets)
        rows = len(offsets) - 1
        margin = np.full(rows, self.bias)
        if len(self.vocabulary) and len(hashes):
            maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            pair = np.unique(row_of[maybe[hit]] * len(self.vocabulary) + at[hit])  # presence, not counts
            margin = margin + np.bincount(pair // len(self.vocabulary), weights=self.weights[pair % len(self.vocabulary)], minlength=rows)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE,
          penalty: float = PENALTY, min_texts: int = MIN_TEXTS) -> Model:
    """Adam on the non-negative risk, full batch, with soft thresholding of the weights."""
    if not positive or not unlabelled or not 0 < prior < 1:
        share = min(max(prior, 0.0), 1.0) if positive else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    values, counts = np.unique(np.concatenate(positive), return_counts=True)
    often = counts >= min(max(min_texts, MIN_SHARE * len(positive)), len(positive))
    values, counts = values[often], counts[often]
    among, seen = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    in_u = np.where(among[at] == values, seen[at], 0) if len(among) else np.zeros(len(values))
    # the share of toxic texts among those with the term, as far as P and U tell
    posterior = prior * (counts / len(positive)) / ((in_u + 1.0) / len(unlabelled))
    vocabulary = values[posterior >= MIN_POSTERIOR]

    def matrix(sets):
        sizes = [len(s) for s in sets]
        words = np.concatenate(sets)
        at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
        return np.repeat(np.arange(len(sets)), sizes)[known], at[known], len(sets)

    p, u = matrix(positive), matrix(unlabelled)
    size = len(vocabulary)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
    softplus = lambda z: np.logaddexp(0.0, z)

    def gradient(part, d):  # d: derivative of each text's loss by its margin
        row, col, _ = part
        return np.append(np.bincount(col, weights=d[row], minlength=size), d.sum())

    for step in range(1, steps + 1):
        zp = np.bincount(p[0], weights=w[p[1]], minlength=p[2]) + w[-1]
        zu = np.bincount(u[0], weights=w[u[1]], minlength=u[2]) + w[-1]
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        if negative >= 0:
            g = gradient(p, -prior * sigmoid(-zp) / p[2]) + gradient(u, sigmoid(zu) / u[2]) + gradient(p, -prior * sigmoid(zp) / p[2])
        else:
            g = -(gradient(u, sigmoid(zu) / u[2]) + gradient(p, -prior * sigmoid(zp) / p[2]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
        w = w - rate * (m / (1 - 0.9**step)) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * penalty / scale[:-1], 0.0)
    kept = np.abs(w[:-1]) > 1e-6
    return Model(vocabulary[kept], w[:-1][kept], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0,
        prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """``prior``: share of toxic texts; by default the share among the labelled rows of the learning folds."""
    learn = labels.where(fold(F.col(id_col), folds) != held_out)
    if prior is None:
        prior = learn.agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
    by_hash = lambda df, n: [r[0] for r in df.orderBy(F.xxhash64(id_col), id_col).limit(n).collect()]
    p_ids = by_hash(learn.where(F.col(label_col) == 1).select(id_col).distinct(), max_positive)
    u_ids = by_hash(docs.where((fold(F.col(id_col), folds) != held_out) & (F.col(text_col) != "")).select(id_col).distinct(), max_unlabelled)
    spark = docs.sparkSession
    marks = spark.createDataFrame([(i, True) for i in p_ids] + [(i, False) for i in u_ids], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, p boolean")
    drawn = docs.select(id_col, text_col).join(F.broadcast(marks), id_col)

    def sets(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            out = []
            for _, _, piece, offs in C.slices(data, offsets):
                out += term_sets(piece, offs)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("p"), pa.array([s.tobytes() for s in out], pa.binary())], names=[id_col, "p", "words"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # an id that stands with several texts is drawn once, with the same one of them in every run
    held = C.cut(drawn.mapInArrow(sets, f"`{id_col}` {id_type}, p boolean, words binary").groupBy(id_col, "p").agg(F.min("words").alias("words")))
    vocabulary = _vocabulary(held, float(prior))

    def known(batches):
        for batch in batches:
            out = [np.intersect1d(np.frombuffer(x.as_py(), np.uint64), vocabulary, assume_unique=True).tobytes() for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("p"), pa.array(out, pa.binary())], names=[id_col, "p", "words"])

    got = held.mapInArrow(known, f"`{id_col}` {id_type}, p boolean, words binary").toArrow()
    words = [np.frombuffer(x.as_py(), np.uint64) for x in got.column("words")]
    is_p = got.column("p").to_pylist()
    order = np.argsort(np.array(got.column(id_col).to_pylist(), dtype=object).astype(str), kind="stable")  # the same sums in every run
    return train([words[i] for i in order if is_p[i]], [words[i] for i in order if not is_p[i]], float(prior))


def _vocabulary(held: DataFrame, prior: float) -> np.ndarray:
    """The terms that ``train`` would choose, from counts over the drawn texts that Spark makes: only they go on."""

    def terms_of(batches):
        for batch in batches:
            for mark, x in zip(batch.column("p").to_pylist(), batch.column("words")):
                found = np.frombuffer(x.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([mark] * len(found), pa.bool_()), pa.array(found, pa.int64())], names=["p", "term"])

    n = {r["p"]: r["count"] for r in held.groupBy("p").count().collect()}
    n_p, n_u = n.get(True, 0), n.get(False, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.uint64)
    seen = held.mapInArrow(terms_of, "p boolean, term bigint").groupBy("term").agg(F.count_if("p").alias("in_p"), F.count_if(~F.col("p")).alias("in_u"))
    posterior = F.lit(prior) * (F.col("in_p") / n_p) / ((F.col("in_u") + 1.0) / n_u)
    told = seen.where((F.col("in_p") >= min(max(MIN_TEXTS, MIN_SHARE * n_p), n_p)) & (posterior >= 0.99 * MIN_POSTERIOR))
    return np.sort(np.array([r["term"] for r in told.select("term").collect()], np.int64).view(np.uint64))


def score(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``id_cols`` with the score of every row. A map over the scan, without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    name = C.free_name(id_cols, out_col)

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            parts = [model.scores(piece, offs) for _, _, piece, offs in C.slices(data, offsets)]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in id_cols] + [pa.array(values, pa.float64())], names=[*id_cols, name])

    return C.map_rows(docs, list(dict.fromkeys([*id_cols, text_col])), ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{name}` double"]), run)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
