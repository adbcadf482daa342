"""Ranked lexical search without a document index: the terms of all search items are one Aho-Corasick automaton, which is
broadcast and counts term frequencies straight from the documents' texts.

Terms are the runs of 0-9, a-z (A-Z folded) and non-ASCII characters. A text is normalised (A-Z folded, every separator a
space, one space at each end) and every term stands in the automaton between two spaces, so that a match is a whole term.
The automaton's outputs are term numbers; a table maps each term to the items that hold it, with its repeats there.

1. First scan: the number of documents with a term (N), of all terms (L), and of documents that hold each item term (df).
   Tasks add up their rows; the driver gets one row for each term of the items.
2. Second scan: the automaton counts again, now with each term's weight known. A document's score for an item is added up
   in 64-bit integers. Each task keeps the best ``k`` rows of each item, and these are ranked in two steps: by item and
   part of the tasks, then by item.

Two scans instead of one with written counts: nothing but the results is ever written or shuffled, and a lost executor
costs its running tasks alone.

Size bound: driver and workers hold the terms of one block of items of at most ``block_bytes`` of text. More items are
worked off in several blocks, two scans each; an item is ranked within its block, and all blocks see all documents.

Weights. N, L, n, df and tf as above (n: a document's terms with repeats): w = floor(1000 * ln((2 N + 2) / (2 df + 1))),
m = 100 - 25 + ((25 n N) div L), score = sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, with repeats.

Defined cases: null and term-less texts are no documents; null and term-less items have no rows; each row of the items is
ranked for itself, also when its id or text stands in another row; repeated documents are ranked each for itself; equal
scores are ordered by id, null ids last; fewer than ``k`` documents with a score above 0 give fewer rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

TOP = 20
BLOCK_BYTES = 4 << 20
TASK_GROUPS = 64
#: Cells of the score table of a slice of documents.
_CELLS = 1 << 21
_LAST = np.iinfo(np.int64).max


def terms_of(text: str) -> list[str]:
    return [t for t in text.encode().translate(C.NORMALISE).decode().split(" ") if t]


class Items:
    """The terms of some items: numbers by term, and for each term its items and repeats (flat, by term)."""

    def __init__(self, texts: list[str]) -> None:
        counts = [Counter(terms_of(text)) for text in texts]
        self.terms = sorted(set(chain.from_iterable(counts)))
        number = {t: k for k, t in enumerate(self.terms)}
        found = sorted((number[t], item, n) for item, c in enumerate(counts) for t, n in c.items())
        term, self.item, self.repeats = (np.array([f[k] for f in found], np.int64) for k in range(3))
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_items = len(texts)


@lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]):
    """One automaton for each worker process, whatever the number of its tasks."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        found.add_word(f" {t} ", k)
    found.make_automaton()
    return found


def scan(terms: tuple[str, ...], batch_text: pa.Array):
    """By slice: (first row, terms in each row, row of each entry, term, tf). Rows' entries lie together."""
    automaton = _automaton(terms)
    data, offsets = C.text_buffers(batch_text)
    for begin, end, piece, offs in C.slices(data, offsets):
        _, _, word_offsets = C.word_spans(piece, offs, C.ALNUM)
        flat = piece.tobytes().translate(C.NORMALISE)
        rows, found, times = [], [], []
        for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            if b > a:
                tf = Counter([t for _, t in automaton.iter(f" {flat[a:b].decode()} ")])
                rows.append(np.full(len(tf), k))
                found += tf.keys()
                times += tf.values()
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield begin, np.diff(word_offsets), row, np.array(found, np.int64), np.array(times, np.int64)


def corpus_statistics(docs: DataFrame, terms: tuple[str, ...], text_col: str = "text") -> tuple[int, int, list[int]]:
    """(N, L, df by term)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shared.value
        totals = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for _, n, _, term, _ in scan(known, batch.column(text_col)):
                totals[:-2] += np.bincount(term, minlength=len(known))
                totals[-2:] += int((n > 0).sum()), int(n.sum())
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], names=["cell", "n"])

    got = C.map_rows(docs, [text_col], "cell bigint, n bigint", run).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    totals = [0] * (len(terms) + 2)
    for r in got:
        totals[r["cell"]] = r["n"]
    return totals[-2], totals[-1], totals[:-2]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The best ``k`` (score, id) of each item, in rank order; ``floor`` is the score that a further row has to reach."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * n_items
        self.doc: list[np.ndarray] = [np.zeros(0, np.int64)] * n_items
        self.floor = np.ones(n_items, np.int64)

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc])
        top = np.lexsort((doc, -score))[: self.k]
        self.score[item], self.doc[item] = score[top], doc[top]
        if len(top) == self.k:
            self.floor[item] = score[top[-1]]


def score_slice(items: Items, weights: np.ndarray, n_docs: int, total: int, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Scores (documents x items) of a slice's documents."""
    m = np.array([75 + 25 * int(x) * n_docs // total for x in n], np.int64)
    gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    width = items.first[term + 1] - items.first[term]
    at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(items.first[term], width)
    out = np.zeros(len(n) * items.n_items, np.int64)
    np.add.at(out, np.repeat(row, width) * items.n_items + items.item[at], np.repeat(gain, width) * items.repeats[at])
    return out.reshape(len(n), items.n_items)


def _block(docs: DataFrame, texts: list[str], id_col: str, text_col: str, k: int) -> DataFrame:
    """(item: place in ``texts``, rank, doc, score)."""
    items = Items(texts)
    terms = tuple(items.terms)
    if not terms:
        return docs.sparkSession.createDataFrame([], "item bigint, rank int, doc bigint, score bigint")
    n_docs, total, df = corpus_statistics(docs, terms, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((items, np.array([weight(n_docs, x) for x in df], np.int64)))

    def run(batches):
        known, weights = shared.value
        names, best = tuple(known.terms), Best(known.n_items, k)
        height = max(1, _CELLS // max(1, known.n_items))
        for batch in batches:
            ids = batch.column("id").cast(pa.int64())
            ids = np.asarray(ids.fill_null(_LAST))
            for begin, n, row, term, tf in scan(names, batch.column("text")):
                for low in range(0, len(n), height):
                    a, b = np.searchsorted(row, [low, low + height])
                    if a == b:
                        continue
                    scores = score_slice(known, weights, n_docs, total, n[low : low + height], row[a:b] - low, term[a:b], tf[a:b])
                    doc, item = np.nonzero(scores >= best.floor)
                    order = np.argsort(item, kind="stable")
                    doc, item = doc[order], item[order]
                    for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else []:
                        here = item[part[0]]
                        best.add(here, scores[doc[part], here], ids[begin + low + doc[part]])
        size = [len(s) for s in best.score]
        group = TaskContext.get().partitionId() % TASK_GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(size)), size), pa.int64()), pa.array(np.full(sum(size), group, np.int32)),
             pa.array(np.concatenate(best.doc), pa.int64()), pa.array(np.concatenate(best.score), pa.int64())],
            names=["item", "part", "doc", "score"],
        )

    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = narrow.mapInArrow(run, "item bigint, part int, doc bigint, score bigint")
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    return found.select("item", "rank", F.when(F.col("doc") != F.lit(int(_LAST)), F.col("doc")).alias("doc"), "score")


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items, block by block: (ids, texts), each block's text within the bound (or one item)."""
    narrow = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") > 0)
    total = narrow.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = math.ceil(2 * total / block_bytes) if total > block_bytes else 1
    for k in range(n):
        part = narrow if n == 1 else narrow.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col``, ``rank`` (int, from 1), ``id_col`` and ``score`` (long) of each item's ``k`` best documents (an underscore
    goes before a name that another of these columns has). ``id_col`` holds whole numbers."""
    spark, out = docs.sparkSession, None
    rank, score = (C.free_name([item_col, id_col], c) for c in ("rank", "score"))
    item_type = items.schema[item_col].dataType.simpleString()
    for ids, texts in _blocks(items, item_col, item_text_col, block_bytes):
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, name {item_type}")
        ranked = _block(docs, texts, id_col, text_col, k).join(names, "item").select(
            F.col("name").alias(item_col), F.col("rank").alias(rank), F.col("doc").alias(id_col), F.col("score").alias(score),
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)
