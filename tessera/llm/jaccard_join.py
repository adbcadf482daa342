"""Similarity join of documents on the Jaccard similarity of their sets of five-word n-grams, by MinHash banding.

Words are the runs of 0-9, a-z (A-Z folded) and non-ASCII characters; a text with fewer words than an n-gram has one
n-gram of all its words. Documents with equal sets form a class; classes stand for their documents, so copies are never
paired with each other.

1. Each class gets a MinHash signature. Bands of ``rows`` values are hashed; ``rows`` is the largest number for which the
   bands that reach ``RECALL`` at the threshold need at most ``MAX_HASHES`` values in all (31 bands of 6 for 0.8).
2. A shuffle on band hashes ties every class of a bucket to the bucket's least class: as many candidate edges as rows, not
   as pairs. The connected components of these edges hold all pairs that share a bucket.
3. Each class's full n-gram set goes to its component, and all pairs of the component are compared exactly. A component
   of more than ``BLOCK_CLASSES`` classes or ``BLOCK_GRAMS`` n-grams is cut into blocks by hash, and each pair of blocks
   is a piece of work of its own. Only sums leave a piece: the links of each class and its least linked class.

So a group of near copies of any size yields one row for each document, with the exact number of its links, and the
number of rows that move grows with the group's size times its number of blocks.

Classes are named inside by a number of their own (the place of their first row in the written table of signatures), so
ids only label rows: they may repeat, with equal or different texts, or be null. In the result a class and a group are
named by the least id of their rows (null if none has an id).

Defined cases: a text without words (null, empty) is a class of its own without links; repeated rows (same id, same text)
count as copies of each other; rows of one id with different texts are in different classes, and each has its own links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.components import connected_components

GRAM = 5
#: The threshold as a fraction.
SIMILAR = (4, 5)
RECALL = 0.9999
MAX_HASHES = 192
BLOCK_CLASSES = 1_000
BLOCK_GRAMS = 400_000
#: N-grams held by this many classes of a piece are compared by matrix product, the others through their holders.
COMMON = 16
_COLUMNS = 4_096


def choose_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair of the threshold's similarity with ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every row of a slice."""
    starts, ends, word_offsets = C.word_spans(data, offsets, C.ALNUM)
    words = C.word_hashes(data, starts, ends, True)
    grams = C.window_hashes(words, size)
    out = []
    for a, b in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(C.window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes (int64) for each set; sets without n-grams get zeros."""
    out = np.zeros((len(sets), bands), np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(full):
        return out.view(np.int64)
    grams = np.concatenate([sets[i] for i in full])
    first = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    low = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    seeds = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, (bands * rows, 2), dtype=np.uint32)
    for band in range(bands):
        h = np.full(len(full), np.uint64(band + 1))
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((low ^ seeds[k, 1]) * (seeds[k, 0] | np.uint32(1)), first)
            h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + least)
        out[full, band] = h
    return out.view(np.int64)


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, n_grams, digest1, digest2, bands) of every (id, text_hash, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column("text"))
            for begin, end, piece, offs in C.slices(data, offsets):
                sets = gram_sets(piece, offs)
                hashes = band_hashes(sets, bands, rows)
                marks = [C.mix(s) for s in sets]
                digest = np.array([[m.sum(dtype=np.uint64), C.mix(m ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for m in marks], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(begin, end - begin) for c in ("id", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(hashes.ravel())),
                    ],
                    names=["id", "text_hash", "n_grams", "digest1", "digest2", "bands"],
                )

    return docs.mapInArrow(C.lean(run), "id bigint, text_hash bigint, n_grams bigint, digest1 bigint, digest2 bigint, bands array<bigint>")


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which sets of ``a`` are similar to which of ``b`` (None: to which others of ``a``)."""
    same = b is None
    b = a if same else b
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    every = np.concatenate(a if same else [*a, *b])
    values, column, holders = np.unique(every, return_inverse=True, return_counts=True)
    row_a, col_a = np.repeat(np.arange(len(a)), na), column[: int(na.sum())]
    row_b, col_b = (row_a, col_a) if same else (np.repeat(np.arange(len(b)), nb), column[int(na.sum()) :])
    shared = np.zeros((len(a), len(b)), np.float32)
    heavy = np.flatnonzero(holders >= COMMON)
    place = np.full(len(values), -1)
    place[heavy] = np.arange(len(heavy))
    pa_, pb_ = place[col_a], place[col_b]
    for begin in range(0, len(heavy), _COLUMNS):
        width = min(_COLUMNS, len(heavy) - begin)
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for target, rows, at in ((left, row_a, pa_), (right, row_b, pb_)):
            inside = (at >= begin) & (at < begin + width)
            target[rows[inside], at[inside] - begin] = 1
        shared += left @ right.T
    light_a = np.flatnonzero((pa_ < 0) & (holders[col_a] > 1))
    light_b = np.flatnonzero((pb_ < 0) & (holders[col_b] > 1))
    light_b = light_b[np.argsort(col_b[light_b], kind="stable")]
    sorted_b = col_b[light_b]
    begin, end = np.searchsorted(sorted_b, col_a[light_a], "left"), np.searchsorted(sorted_b, col_a[light_a], "right")
    for part in range(0, len(light_a), 200_000):
        lo, n = begin[part : part + 200_000], (end - begin)[part : part + 200_000]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        pair = np.repeat(row_a[light_a[part : part + 200_000]], n) * len(b) + row_b[light_b[at]]
        cell, times = np.unique(pair, return_counts=True)
        shared.ravel()[cell] += times
    out = shared * sum(similar) >= similar[0] * (na[:, None] + nb[None, :])
    if same:
        np.fill_diagonal(out, False)
    return out


def _least_linked(matrix: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name of each one's component within the piece."""
    la, lb = names_a.copy(), names_b.copy()
    top = np.iinfo(np.int64).max
    while True:
        xa = np.minimum(la, np.where(matrix, lb[None, :], top).min(axis=1, initial=top))
        xb = np.minimum(lb, np.where(matrix, xa[:, None], top).min(axis=0, initial=top))
        if (xa == la).all() and (xb == lb).all():
            return la, lb
        la, lb = xa, xb


def _compare(group: list[dict]) -> list[tuple[int, int, int]]:
    """(class, links, least linked class) of a piece's classes."""
    i, j = group[0]["i"], group[0]["j"]
    one = {}
    for g in sorted(group, key=lambda g: g["grams"]):  # an id that stands with several texts counts once
        one.setdefault((g["block"], g["node"]), g)
    sides = [[g for g in one.values() if g["block"] == k] for k in ((i,) if i == j else (i, j))]
    if not all(sides):
        return []
    sets = [[np.frombuffer(g["grams"], np.uint64) for g in side] for side in sides]
    names = [np.array([g["node"] for g in side], np.int64) for side in sides]
    sizes = [np.array([g["size"] for g in side], np.int64) for side in sides]
    m = linked(sets[0], None if i == j else sets[1])
    if not m.any():
        return []
    roots = _least_linked(m, names[0], names[-1])
    out = list(zip(names[0].tolist(), (m @ sizes[-1]).tolist(), roots[0].tolist()))
    if i != j:
        out += list(zip(names[1].tolist(), (m.T @ sizes[0]).tolist(), roots[1].tolist()))
    return [x for x in out if x[1]]


def _pieces(batches):
    """Runs the rows of one (component, i, j) after another; they come sorted."""
    key, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = (row["component"], row["i"], row["j"])
            if at != key and group:
                yield _compare(group)
                group = []
            key = at
            group.append(row)
    if group:
        yield _compare(group)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


_CLASS = ["digest1", "digest2"]


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signature of every row, and the classes: digest1, digest2, class_id, size, linked (documents of other classes), root
    (of its group) and group_id."""
    bands, rows = choose_bands(threshold, recall)
    narrow = _narrow(docs, id_col, text_col)
    signed = C.cut(_signatures(narrow, bands, rows)).withColumn("row", F.monotonically_increasing_id())  # of written rows: stable
    classes = signed.where(F.col("n_grams") > 0).groupBy(_CLASS).agg(
        F.min("row").alias("node"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
        F.min_by(F.struct("id", "text_hash"), "row").alias("rep"),
    )

    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least")
    candidates = connected_components(buckets.join(least, "bucket").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")))

    members = classes.select("node", "size", "n_grams", "rep").join(candidates, "node").withColumnRenamed("root", "component")
    need = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES)), F.ceil(F.sum("n_grams") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")
    )
    members = members.join(need, "component").select("component", "node", "size", "blocks", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    # the text of the row that stands for the class; a row that is repeated as it is gives the same text again
    texts = narrow.join(members, (F.col("text_hash") == F.col("rep_hash")) & F.col("id").eqNullSafe(F.col("rep_id")))

    def sets(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column("text"))
            for begin, end, piece, offs in C.slices(data, offsets):
                grams = [s.tobytes() for s in gram_sets(piece, offs)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(begin, end - begin) for c in ("component", "node", "size", "blocks")] + [pa.array(grams, pa.binary())],
                                                 names=["component", "node", "size", "blocks", "grams"])

    gathered = texts.select("component", "node", "size", "blocks", "text").mapInArrow(C.lean(sets), "component bigint, node bigint, size bigint, blocks int, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = gathered.withColumn("block", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "grams",
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(batches):
        for found in _pieces(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["node", "linked", "root"])

    compared = C.cut(dealt.mapInArrow(C.lean(compare), "node bigint, linked bigint, root bigint"))
    groups = connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = C.cut(groups.join(classes.select("node", "class_id"), "node").groupBy("root").agg(F.min("class_id").alias("group_id")))
    counted = compared.groupBy("node").agg(F.sum("linked").alias("linked")).join(groups, "node").join(named, "root")
    known = classes.select(*_CLASS, "class_id", "size", "node").join(counted, "node", "left").select(
        *_CLASS, "class_id", "size", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"),
        F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"),
    )
    return signed, known


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR[0] / SIMILAR[1], recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: the id, ``class_id`` (least id with the same n-gram set), ``class_size``,
    ``group_id`` (least id reachable over links) and ``n_links`` (other documents of at least the similarity)."""
    signed, known = _grouped(docs, id_col, text_col, threshold, recall)
    out = signed.where(F.col("n_grams") > 0).select("id", *_CLASS).join(known, _CLASS).select(
        F.col("id").alias(id_col), "class_id", F.col("size").alias("class_size"), "group_id", (F.col("size") - 1 + F.col("linked")).alias("n_links"),
    )
    alone = signed.where(F.col("n_grams") == 0).select(
        F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"),
    )
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns), one of each group: a row of the group's least id (null ids last), and of its texts the one
    with the least hash, once. A row goes only if its own text's group has another row that stays; texts without words stay."""
    signed, known = _grouped(docs, id_col, text_col, SIMILAR[0] / SIMILAR[1], RECALL)
    pairs = signed.where(F.col("n_grams") > 0).groupBy("id", "text_hash", *_CLASS).agg(F.count(F.lit(1)).alias("copies"))
    rooted = pairs.join(known.select(*_CLASS, "root"), _CLASS).select("id", "text_hash", "copies", "root", F.struct(F.col("id").isNull().alias("last"), "id", "text_hash").alias("name"))
    first = C.cut(rooted.groupBy("root").agg(F.min("name").alias("first")))
    judged = rooted.join(first, "root").select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), (F.col("name") == F.col("first")).alias("stays"), "copies")
    judged = judged.where(~F.col("stays") | (F.col("copies") > 1)).drop("copies")  # rows that nothing is known of stay
    order = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("doc"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    found = packed.join(judged, (F.col("text_hash") == F.col("gone_hash")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    single = found.where("stays is null").select("doc")
    several = found.where("stays").groupBy("id", "text_hash").agg(F.first("doc").alias("doc")).select("doc")
    return single.unionByName(several).select(*[F.col("doc")[c].alias(c) for c in order])
