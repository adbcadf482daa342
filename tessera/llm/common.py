"""Helpers shared by the operators of this package: Arrow text batches, vectorized words and hashes, and
reliable lineage cuts.

Texts are handled as UTF-8 bytes. A batch is worked through in slices of whole rows of about ``SLICE_BYTES``,
so that NumPy temporaries stay small whatever the batch holds; a longer row is a slice of its own.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
_SHIPPED: set[str] = set()

#: Bytes of words split at ASCII white space: everything but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of normalised words: 0-9, a-z, A-Z (folded) and everything outside ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41 : 0x5B] += 0x20
#: For bytes.translate: folds A-Z, turns every separator of normalised words into a space.
NORMALISE = bytes(int(FOLD[b]) if ALNUM[b] else 0x20 for b in range(256))

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW_LEN = 4096
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_POW_LEN - 1, _BASE)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    col = pc.fill_null(column, "") if column.null_count else column
    col = col.cast(pa.large_string()).cast(pa.large_binary())
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of at most ``limit`` bytes, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n, row + 4096)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs of ``table`` bytes in each row, and the rows' word offsets."""
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = table[data]
    here, before = is_word[1:], is_word[:-1]
    starts_at = here & ~before
    ends_at = before & ~here
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    touching = cuts[is_word[cuts] & is_word[cuts + 1]]  # a word must not run from one row into the next
    starts_at[touching] = True
    ends_at[touching] = True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z folded if asked for)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    values = (_BYTE_VALUES[FOLD] if fold else _BYTE_VALUES)[data[at]]
    return mix(np.add.reduceat(values * _POW[within & (_POW_LEN - 1)], first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words (row limits are the caller's)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    return mix(out)


def windows_in_rows(word_offsets: np.ndarray, n_windows: int, size: int) -> np.ndarray:
    """Mask over the windows of a slice: those that lie in one row."""
    ok = np.ones(n_windows, bool)
    for cut in word_offsets[1:-1]:
        ok[max(0, cut - size + 1) : max(0, min(cut, n_windows))] = False
    return ok


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(fn: Callable) -> Callable:
    """``fn`` for ``mapInArrow``; when a partition ends, its worker, which Spark keeps for later tasks and stages, gives back
    what it has freed."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def map_rows(df: DataFrame, columns: list[str], schema: StructType | str, fn: Callable) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that the scan reads nothing else."""
    return df.select(*columns).mapInArrow(lean(fn), schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each session. A local master has none: its workers import what the driver
    imports."""
    package, context = Path(__file__).resolve().parents[1], spark.sparkContext
    local = context.master.split("[")[0] == "local"
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if local and str(package.parent) in known or context.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir``. Only a local session without the setting
    (tests) gets a folder of its own; a cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-llm-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared checkpoint folder: a lost executor costs a
    re-read, not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column has it (Spark compares without case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
