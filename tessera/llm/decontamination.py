"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word windows, against which
every document's word windows are scanned; hash hits are verified word by word.

Words are the runs of 0-9, a-z (A-Z folded) and non-ASCII characters. A window is ``size`` consecutive words of
an item; an item with fewer words, but at least one, is a single window. A document word is hit if an occurrence
of any window covers it. A document is contaminated if it has a hit and 20 * n_hit >= n_words.

Size bound: the driver builds the windows of one block of benchmark items of at most ``block_bytes`` of text, as arrays of
some eight times its size, and broadcasts them; a worker keeps one copy for all its tasks. A larger benchmark is worked off in several blocks, one scan of the documents each; the
hits found so far travel with the rows, so the result is the same whatever the number of blocks.

Defined cases: a null or word-less text has no words, no hits and is not contaminated; null or word-less items
give no window; equal items each count in n_items; repeated rows are judged each for itself; a null item id
counts as an item named by the empty string; an empty table on either side gives no hits or no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SIZE = 13
BLOCK_BYTES = 8 << 20
_LOW = np.uint64(0xFFFF)


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(C.NORMALISE).split()


class Windows:
    """The windows of some items, as arrays: by length, sorted hashes with the item and the bytes (of all items' words, joined
    by spaces) of each window."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        texts = [b" ".join(normalised_words(text)) for _, text in items]
        self.names = [item for item, _ in items]
        self.text = b" ".join(texts)
        data, begins = np.frombuffer(self.text, np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        starts, ends, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
        words = C.word_hashes(data, starts, ends, True)
        first = np.searchsorted(starts, np.append(begins[: len(texts)], len(data) + 1))
        n_words = np.diff(first)[: len(texts)]
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for span in np.unique(np.minimum(n_words[n_words > 0], size)).tolist():
            mine = np.flatnonzero((n_words >= span) if span == size else (n_words == span))
            count = n_words[mine] - span + 1
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[mine], count)
            hashes = C.window_hashes(words, span)[at]
            order = np.argsort(hashes, kind="stable")
            low = np.zeros(1 << 16, bool)
            low[(hashes & _LOW).astype(np.int64)] = True
            at = at[order]
            self.lengths[span] = (hashes[order], low, np.repeat(mine, count)[order], starts[at], ends[at + span - 1])


def scan(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[int], set[str]]]]:
    """Words per row, and by row its hit windows (flat starts and ends, in words) and items."""
    starts, ends, word_offsets = C.word_spans(data, offsets, C.ALNUM)
    hashes = C.word_hashes(data, starts, ends, True)
    hits: dict[int, tuple[list[int], set[str]]] = {}
    text = None
    for span, (known, low, item, begin, end) in windows.lengths.items():
        found = C.window_hashes(hashes, span)
        maybe = np.flatnonzero(low[(found & _LOW).astype(np.int64)])
        at = np.searchsorted(known, found[maybe])
        same = known[np.minimum(at, len(known) - 1)] == found[maybe]
        maybe, at = maybe[same], at[same]
        stop = np.searchsorted(known, found[maybe], "right")
        rows = np.searchsorted(word_offsets, maybe, "right") - 1
        inside = maybe + span <= word_offsets[rows + 1]
        for p, row, lo, hi in zip(*(x[inside].tolist() for x in (maybe, rows, at, stop))):
            if text is None:
                text = data.tobytes().translate(C.NORMALISE)
            words = b" ".join(text[a:b] for a, b in zip(starts[p : p + span].tolist(), ends[p : p + span].tolist()))
            seen = {windows.names[item[k]] for k in range(lo, hi) if windows.text[begin[k] : end[k]] == words}
            if seen:
                spans, items = hits.setdefault(row, ([], set()))
                first = p - int(word_offsets[row])
                spans += (first, first + span)
                items |= seen
    return np.diff(word_offsets), hits


def _merge(spans: list[int]) -> list[int]:
    """Flat disjoint spans, in order, that cover the same words."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items, block by block; each block's text is within the bound (or one item)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
              size: int = SIZE, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """``keep`` columns of the documents (default: all but the text) with ``n_words`` (long), ``hits`` (flat word
    spans, disjoint and in order) and ``items`` (ids, sorted as strings). With ``keep_text`` the text follows."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    taken = [*keep, text_col]
    words, hit, seen = (C.free_name(taken, n) for n in ("n_words", "hits", "items"))
    state = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`"))
    blocks = _with_last(_blocks(benchmark, item_col, item_text_col, block_bytes))
    for k, (items, last) in enumerate(blocks):
        shared = spark.sparkContext.broadcast(Windows(items, size))
        carry = keep + ([text_col] if keep_text or not last else [])
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name in carry]
                           + [f"`{words}` bigint, `{hit}` array<bigint>, `{seen}` array<string>"])

        def run(batches, shared=shared, carry=carry, first=k == 0):
            windows = shared.value
            for batch in batches:
                n_words, spans, items_of = [], [], []
                if not first:
                    spans, items_of = batch.column(hit).to_pylist(), batch.column(seen).to_pylist()
                data, offsets = C.text_buffers(batch.column(text_col))
                for begin, end, part, offs in C.slices(data, offsets):
                    counts, hits = scan(windows, part, offs)
                    n_words += counts.tolist()
                    if first:
                        spans += [[] for _ in range(begin, end)]
                        items_of += [[] for _ in range(begin, end)]
                    for row, (more, ids) in hits.items():
                        spans[begin + row] = _merge(spans[begin + row] + more)
                        items_of[begin + row] = sorted({*items_of[begin + row], *ids})
                cols = [batch.column(c) for c in carry] + [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items_of, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, words, hit, seen])

        state = state.mapInArrow(C.lean(run), schema)
        if not last:
            state = C.cut(state)
    return state.withColumnsRenamed({words: "n_words", hit: "hits", seen: "items"}) if (words, hit, seen) == ("n_words", "hits", "items") else state


def _with_last(blocks):
    """(block, is it the last) without holding more than two blocks."""
    before = next(blocks)
    for block in blocks:
        yield before, False
        before = block
    yield before, True


def n_hit_column(hits: str = "hits"):
    """Words covered by the flat disjoint spans."""
    return F.aggregate(F.transform(F.col(hits), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated_column(hits: str = "hits", n_words: str = "n_words"):
    return (F.size(hits) > 0) & (F.lit(20) * n_hit_column(hits) >= F.col(n_words))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    found = find_hits(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", n_hit_column().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated_column().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The documents (all their columns) that are not contaminated. No shuffle: the scan carries the rows."""
    order = docs.columns
    packed = C.free_name([text_col], "row")
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias(packed), F.col(f"`{text_col}`").alias("scan_text"))
    found = find_hits(narrow, benchmark, text_col="scan_text", size=size, keep=[packed])
    return found.where(~contaminated_column()).select(*[F.col(packed)[c].alias(c) for c in order])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """All documents, with the text from the first to the last word of each hit span cut out of ``text_col``."""
    order = docs.columns
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("row"), F.col(f"`{text_col}`").alias("scan_text"))
    found = find_hits(narrow, benchmark, text_col="scan_text", size=size, keep=["row"], keep_text=True)

    @F.pandas_udf("string")
    def without(texts, spans):
        import pandas as pd

        out = []
        for text, flat in zip(texts, spans):
            if text is None or not len(flat):
                out.append(text)
                continue
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = C.word_spans(data, np.array([0, len(data)]), C.ALNUM)
            kept, at = [], 0
            for a, b in zip(flat[::2], flat[1::2]):
                kept.append(raw[at : starts[a]])
                at = int(ends[b - 1])
            out.append((b"".join(kept) + raw[at:]).decode())
        return pd.Series(out, dtype=object)

    cleaned = found.select("row", without("scan_text", "hits").alias("scan_text"))
    return cleaned.select(*[F.col("scan_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in order])

