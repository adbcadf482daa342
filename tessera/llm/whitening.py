"""Embedding whitening: rows are projected on the leading eigenvectors of the covariance of the distinct vectors and scaled to
unit variance. The eigenvectors come from spectrum slicing (``spectrum``).

Entries are taken as whole numbers, x = floor(64 c) + 1 000 000. The fit list is each distinct x vector once; n is their number, S their sums.

1. One shuffle finds the distinct vectors, packed in as many bytes an entry as the vector needs; they are written to the
   shared checkpoint folder. Copies collapse in each task before they are shuffled.
2. Sums (exact, as whole numbers) and then the covariance (centred before multiplying) are partial sums of the tasks over
   the written list. The rows of the tasks' partial matrices are dealt by row number and added in the order of their tasks,
   so the result does not depend on chance; the driver gets one dimension x dimension matrix, whatever the number of rows.
3. The driver slices its spectrum and broadcasts at most ``components`` vectors. One more pass over the fit list measures the
   covariance of the whitened rows, and a map over the table gives the result.

Defined cases: a vector that is null or holds null or non-finite entries, or entries of 2^53 and more, is left out; so are
vectors of another dimension than most distinct vectors have (the larger one of equals). Repeated rows each have their
rows in the result. Components without variance (eigenvalue up to ``NO_VARIANCE`` of the largest) are not returned, so an
empty table or one distinct vector gives no rows. A ``deviation`` beyond a long is null. Added columns get underscores in
front if an id column has their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.spectrum import leading

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
NO_VARIANCE = 1e-12
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_BITS = 24
_SLICE = 4096


def whole_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(64 c) of all entries of the valid rows (flat), those rows, and their dimensions."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), float("nan")))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = ~np.isfinite(values) | (np.abs(values, where=np.isfinite(values), out=np.zeros(len(values))) >= 2.0**53)
    valid = np.asarray(column.is_valid()) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
    rows = np.flatnonzero(valid)
    return np.floor(SCALE * values[valid[row]]).astype(np.int64), rows, sizes[rows]


def matrix_of(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The x vectors of the valid rows of dimension ``d``, and those rows."""
    flat, rows, sizes = whole_entries(column)
    fits = sizes == d
    return flat[np.repeat(fits, sizes)].reshape(int(fits.sum()), d) + SHIFT, rows[fits]


def pack_vector(v: np.ndarray) -> bytes:
    """The entries in the least width that holds them all; the length tells the width."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    kind = next(k for k in _WIDTHS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return v.astype(np.dtype(kind).newbyteorder("<")).tobytes()


def unpack_vectors(packed: list[bytes], d: int) -> np.ndarray:
    """The x vectors of some packed ones of dimension ``d``."""
    out = np.empty((len(packed), d), np.int64)
    lengths = np.array([len(p) for p in packed])
    for kind in _WIDTHS:
        at = np.flatnonzero(lengths == d * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join([packed[i] for i in at]), np.dtype(kind).newbyteorder("<")).reshape(len(at), d)
    return out + SHIFT


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """(d, v): every distinct valid vector once, packed."""

    def run(batches):
        for batch in batches:
            flat, _, sizes = whole_entries(batch.column(vector_col))
            packed = {(len(v), pack_vector(v)): None for v in np.split(flat, np.cumsum(sizes)[:-1])} if len(sizes) else {}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in packed], pa.int32()), pa.array([v for _, v in packed], pa.binary())], names=["d", "v"])

    return C.cut(C.map_rows(vectors, [vector_col], "d int, v binary", run).distinct())


def _batches(batches, d: int):
    for batch in batches:
        packed = batch.column("v").to_pylist()
        for begin in range(0, len(packed), _SLICE):
            yield unpack_vectors(packed[begin : begin + _SLICE], d)


def moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and S, exact: entries are added in two parts, so that no sum leaves 64 bits."""

    def run(batches):
        n, parts = 0, np.zeros((2, d), np.int64)
        for x in _batches(batches, d):
            n += len(x)
            parts += (x >> _BITS).sum(axis=0), (x & ((1 << _BITS) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * d + 1)), pa.array(np.append(parts.ravel(), n))], names=["cell", "v"])

    got = {r["cell"]: r["v"] for r in fit.mapInArrow(run, "cell bigint, v bigint").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    return got.get(2 * d, 0), [(got.get(k, 0) << _BITS) + got.get(d + k, 0) for k in range(d)]


def summed(fit: DataFrame, d: int, size: int, part) -> np.ndarray:
    """The sum of ``part(x)`` (size x size) over all slices of the list. Rows of the tasks' sums meet by number, and are added
    by task."""

    def rows(batches):
        total = np.zeros((size, size))
        for x in _batches(batches, d):
            total += part(x)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, task), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                                         names=["i", "task", "r"])

    def added(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, r in zip(batch.column("i").to_pylist(), batch.column("r").to_pylist()):
                out[i] = out.get(i, 0.0) + np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([r.tobytes() for r in out.values()], pa.binary())], names=["i", "r"])

    dealt = fit.mapInArrow(rows, "i int, task int, r binary").repartition("i").sortWithinPartitions("i", "task")
    total = np.zeros((size, size))
    for r in dealt.mapInArrow(added, "i int, r binary").collect():
        total[r["i"]] = np.frombuffer(r["r"])
    return total


class Model:
    """Mean (whole part and rest), eigenvalues, unit vectors as rows, trace, and n with S for the exact deviations."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])
        self.values, self.vectors, self.trace, self.identity_error = np.zeros(0), np.zeros((0, len(sums))), 0.0, 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row; whole numbers of any size where 64 bits don't hold them."""
        room = float(np.iinfo(np.int64).max) / 4
        rough = self.n * self.centred(x)
        big = ((rough**2).sum(axis=1) > room) | (self.n * np.abs(x).max(axis=1, initial=0).astype(float) > room)
        small = ~big & (max(map(abs, self.sums), default=0) < room)
        out: list[int | None] = [None] * len(x)
        at = np.flatnonzero(small)
        if len(at):
            for i, v in zip(at.tolist(), ((self.n * x[at] - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()):
                out[i] = v
        for i in np.flatnonzero(~small).tolist():
            exact = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums))
            out[i] = exact if exact <= np.iinfo(np.int64).max else None
        return out


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors, or None where there are none."""
    every = fit_list(vectors, vector_col)
    most = every.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    d = most["d"]
    listed = every.where(F.col("d") == d).select("v")
    model = Model(*moments(listed, d))

    def covariance(x):
        y = model.centred(x)
        return y.T @ y

    total = summed(listed, d, d, covariance) / model.n
    total = (total + total.T) / 2
    values, found = leading(total, components)
    kept = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    model.values, model.vectors, model.trace = values[kept], found[kept], float(np.trace(total))
    k = int(kept.sum())

    def white(x):
        w = model.whitened(x)
        return w.T @ w

    if k:
        model.identity_error = float(np.abs(summed(listed, d, k, white) / model.n - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, id_cols: list[str], vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_cols`` with ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` for each valid row
    and component."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    names = [C.free_name(id_cols, c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    kinds = ["int", "bigint", "bigint", "double", "double", "double"]
    schema = ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{c}` {k}" for c, k in zip(names, kinds)])
    model = fit(vectors, vector_col, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        d, k = len(m.sums), len(m.values)
        for whole in batches:
            for begin in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(begin, _SLICE)
                x, rows = matrix_of(batch.column(vector_col), d)
                n = len(x)
                taken = pa.array(np.repeat(rows, k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(taken) for c in id_cols]
                    + [
                        pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, m.n), pa.int64()),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(m.whitened(x).ravel(), pa.float64()),
                        pa.array(np.tile(m.values / m.trace, n), pa.float64()), pa.array(np.full(n * k, m.identity_error)),
                    ],
                    names=[*id_cols, *names],
                )

    return C.map_rows(vectors, list(dict.fromkeys([*id_cols, vector_col])), schema, run)


def digest(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings, ["vec_id"])
