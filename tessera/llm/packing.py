"""Best-fit packing of tokenised documents into sequences of at most ``size`` tokens, by hierarchical residual packing.

A document is its token ids and an end token. Only a document of more than ``size`` tokens is cut: into pieces of ``size``
tokens, of which the first one may be shorter, so that at most one piece of a document is left to pack.

1. Pieces of ``size`` tokens are sequences of their own. The others, as (key, length) rows, are dealt to partitions round
   robin, so that each partition holds a fair sample of all lengths, whatever the order of the table.
2. Each partition packs groups of at most ``GROUP`` pieces best-fit, longest first: a piece goes to the bin with the least
   room that still holds it. Bins with at most ``SLACK`` free tokens are full and leave.
3. The underfull bins go up a tree as items of their fill: each round has fewer partitions, by the number of bins that are
   left, and packs whole bins best-fit into each other. The rounds end when one group held all that was left, or when a
   round joined less than one bin in ``STUCK``: then every group, a fair sample of what is left, found nothing that fits.

Every step keeps at most ``GROUP`` rows in a task; texts never move, and what moves is one small row for each piece. Each
round's rows are written to the shared checkpoint folder before the next one reads them.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each for itself (a row's key comes
from its place in the written table of pieces, not from its id); equal lengths are taken in the order of their keys; an
empty table gives no rows; null ids stay null; added columns get underscores in front if an id column has their name.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.bpe import tokenizer

SIZE = 1024
END = 2
SLACK = 2
GROUP = 32_768
MAX_TASKS = 4_096
STUCK = 200


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: all ``size``, but for the first."""
    return [n % size] * (n % size > 0) + [size] * (n // size)


def best_fit(lengths: list[int], size: int) -> list[int]:
    """The bin (from 0) of each item; items are taken from the longest on, equal ones in their order. Bins lie in stacks
    by the room they have left; the bits of ``rooms`` say which stacks hold any."""
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n_bins, bins = 0, 0, [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[k]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            chosen = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, chosen = size, n_bins
            n_bins += 1
        bins[k] = chosen
        if room > need:
            stacks[room - need].append(chosen)
            rooms |= 1 << (room - need)
    return bins


def pack_group(keys: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item: the key of its bin (that of the bin's first item), its place there, and the bin's fill."""
    order = np.argsort(keys, kind="stable")
    keys, lengths = keys[order], lengths[order]
    bins = np.array(best_fit(lengths.tolist(), size), np.int64)
    by_bin = np.argsort(bins, kind="stable")
    sizes = lengths[by_bin]
    first = np.flatnonzero(np.r_[True, np.diff(bins[by_bin]) > 0]) if len(bins) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(bins)])
    before = np.cumsum(sizes) - sizes
    name, place, fill = (np.empty(len(keys), np.int64) for _ in range(3))
    at = order[by_bin]
    name[at] = np.repeat(keys[by_bin][first], count)
    place[at] = before - np.repeat(before[first], count)
    fill[at] = np.repeat(np.add.reduceat(sizes, first), count) if len(first) else 0
    return name, place, fill


def token_pieces(docs: DataFrame, tokenizer_file: str, id_cols: list[str], text_col: str, size: int, end: int) -> DataFrame:
    """(id_cols as struct ``ids``, piece, start, length, ids_crc32) of every piece. A map over the scan."""
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("ids"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        tok, last = tokenizer(tokenizer_file), np.array([end], np.uint32)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.concatenate([tok.encode(text.as_py() or ""), last]).astype("<u4")
                begin = 0
                for p, n in enumerate(piece_lengths(len(ids), size)):
                    row.append(k)
                    piece.append(p)
                    start.append(begin)
                    length.append(n)
                    crc.append(zlib.crc32(ids[begin : begin + n].tobytes()))
                    begin += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["ids", "piece", "start", "length", "ids_crc32"],
            )

    return narrow.mapInArrow(run, f"ids {narrow.schema['ids'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _round(items: DataFrame, n: int, size: int, group: int) -> DataFrame:
    """(key, bin, place, fill) of each of the ``n`` (key, length) rows."""
    tasks = max(1, min(MAX_TASKS, math.ceil(n / group)))
    dealt = items.select("key", "length").repartition(tasks)  # round robin: every task gets a fair sample

    def run(batches):
        held, rows = [], 0

        def packed():
            name, place, fill = pack_group(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), size)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([h[0] for h in held]), name, place, fill)], names=["key", "bin", "place", "fill"])

        for batch in batches:
            keys, lengths = np.asarray(batch.column("key")), np.asarray(batch.column("length"))
            for begin in range(0, len(keys), group):
                part = keys[begin : begin + group], lengths[begin : begin + group]
                if rows + len(part[0]) > group:
                    yield packed()
                    held, rows = [], 0
                held.append(part)
                rows += len(part[0])
        if held:
            yield packed()

    return C.cut(dealt.mapInArrow(run, "key bigint, bin bigint, place bigint, fill bigint"))


def assign(items: DataFrame, size: int = SIZE, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """(key, sequence_id, offset) of every (key, length) row: distinct keys, lengths from 1 to ``size``."""
    n = items.count()
    first = _round(items, n, size, group)
    # bins that are not full, as items: key is the bin's, length its fill
    left = first.where((F.col("place") == 0) & (F.col("fill") < size - slack)).select(F.col("bin").alias("key"), F.col("fill").alias("length"))
    moved, seen = None, n
    while seen > group:  # one group leaves no two bins that fit together
        count = left.count()
        if count < 2 or moved is not None and (seen - count) * STUCK < seen:
            break
        step = _round(left, count, size, group)
        hop = step.select(F.col("key").alias("from"), F.col("bin").alias("to"), F.col("place").alias("by"))
        if moved is None:
            moved = hop
        else:
            onward = hop.select(F.col("from").alias("to"), F.col("to").alias("next"), F.col("by").alias("more"))
            moved = C.cut(moved.join(onward, "to", "left").select("from", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")))
        left = step.where((F.col("place") == 0) & (F.col("fill") < size - slack)).select(F.col("bin").alias("key"), F.col("fill").alias("length"))
        seen = count
    if moved is None:
        return first.select("key", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return first.join(moved.withColumnRenamed("from", "bin"), "bin", "left").select(
        "key", F.coalesce("to", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_file: str, id_cols: list[str], text_col: str = "text", size: int = SIZE, end: int = END, slack: int = SLACK,
         group: int = GROUP) -> DataFrame:
    """``id_cols`` with ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece of every
    row of ``docs``."""
    names = {c: C.free_name(id_cols, c) for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")}
    pieces = C.cut(token_pieces(docs, tokenizer_file, id_cols, text_col, size, end))
    pieces = pieces.withColumn("key", F.monotonically_increasing_id())  # of the written rows, so the same on every read
    placed = assign(pieces.where(F.col("length") < size), size, slack, group)
    whole = pieces.where(F.col("length") >= size).select("*", F.col("key").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    packed = whole.unionByName(pieces.where(F.col("length") < size).join(placed, "key"))
    return packed.select(*[F.col("ids")[c].alias(c) for c in id_cols], *[F.col(c).alias(n) for c, n in names.items()])


def digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    return pack(docs, tokenizer_file, ["doc_id"])
