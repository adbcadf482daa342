"""Best-fit packing, ranked lexical search and embedding whitening against brute force."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from tessera.llm import lexical_search, packing, spectrum, whitening
from tessera.llm.queries import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


# ------------------------------------------------------------------ packing


def plain_best_fit(lengths, size):
    """Bins of best-fit decreasing, by looking at every bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in bins if b + n <= size]
        if fitting:
            bins.remove(max(fitting))
            bins.append(max(fitting) + n)
        else:
            bins.append(n)
    return bins


@pytest.mark.parametrize("top", [1024, 700, 300])
def test_best_fit_is_the_plain_one(top):
    rng = random.Random(top)
    lengths = [rng.randint(1, top) for _ in range(700)]
    fills = collections.Counter()
    for b, n in zip(packing.best_fit(lengths, 1024), lengths):
        fills[b] += n
    assert sorted(fills.values()) == sorted(plain_best_fit(lengths, 1024))
    keys = np.array(rng.sample(range(10_000), 700))
    name, place, fill = packing.pack_group(keys, np.array(lengths), 1024)
    for b in set(name.tolist()):
        rows = sorted((int(p), lengths[i]) for i, p in enumerate(place) if name[i] == b)
        assert [p for p, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))]
        assert set(fill[name == b].tolist()) == {sum(n for _, n in rows)} and b in keys[name == b]


def check_sequences(rows, size=1024):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by_sequence)


def test_pack_documents(spark, documents):
    from tokenizers import Tokenizer

    rows = packing.digest(documents, VOCABULARY).collect()
    assert sorted(rows[0].asDict()) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    tok = Tokenizer.from_file(VOCABULARY)
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want, lengths = [], []
    for r in documents.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    assert got == sorted(want)
    assert check_sequences(rows) == len(plain_best_fit(lengths, 1024))


@pytest.mark.parametrize("group", [50, 400, 10_000])
def test_residual_rounds(spark, group):
    rng = random.Random(group)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(1, 200)]) for _ in range(4_000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "key bigint, length bigint").repartition(3)
    rows = [{**r.asDict(), "length": lengths[r["key"]]} for r in packing.assign(items, group=group).collect()]
    assert sorted(r["key"] for r in rows) == list(range(4_000))
    used, least = check_sequences(rows), math.ceil(sum(lengths) / 1024)
    assert used <= least * (1.02 if group >= 400 else 1.06) + 1
    if group == 10_000:
        assert used == len(plain_best_fit(lengths, 1024))


def test_rounds_end_where_nothing_fits(spark):
    items = spark.createDataFrame([(k, 600) for k in range(500)] + [(500, 424)], "key bigint, length bigint")
    rows = [{**r.asDict(), "length": 424 if r["key"] == 500 else 600} for r in packing.assign(items, group=40).collect()]
    assert check_sequences(rows) in (500, 501) and len(rows) == 501
    assert packing.assign(items.limit(0)).collect() == []


def test_pack_odd_rows(spark, odd, none):
    rows = packing.pack(odd, VOCABULARY, ["doc_id", "n_tokens", "row"], size=64).collect()
    check_sequences(rows, 64)
    by_id = collections.Counter(r["doc_id"] for r in rows)
    assert by_id[2] == by_id[3] == 1 and by_id[1] == 2 and by_id[None] == 1 and by_id[5] > 600
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    clash = packing.pack(odd.withColumnRenamed("row", "piece"), VOCABULARY, ["doc_id", "piece"])
    assert clash.columns == ["doc_id", "piece", "_piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.digest(none, VOCABULARY).collect() == []


# ------------------------------------------------------------------ lexical search


def plain_search(docs, items, k=20):
    def terms(text):
        folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    tf = [(d, collections.Counter(terms(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for *_, n in tf)
    df = collections.Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_search_documents(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    assert ordered(map(tuple, lexical_search.digest(documents, benchmark).collect())) == ordered(want)
    blocks = lexical_search.search(documents, benchmark, block_bytes=2_000)
    assert ordered(map(tuple, blocks.collect())) == ordered(want)


def test_search_ties_copies_and_odd_rows(spark, odd, none):
    rng = random.Random(5)
    words = ["a", "B", "aa", "ab", "b-c", "É", "é", "x1", "日本", "the", "THE\u0085", "z\U0001f642"]
    docs = [(rng.randint(0, 40) if rng.random() < 0.9 else None, rng.choice([None, "", " ", *[" ".join(rng.choices(words, k=n)) for n in (1, 5, 40)]])) for _ in range(300)]
    items = [(k, " ".join(rng.choices(words, k=6))) for k in range(8)] + [(3, "the the a"), (None, "aa"), (9, None), (10, "?!"), (11, "unknown")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert ordered(map(tuple, lexical_search.search(frame, asked, k=5).collect())) == ordered(plain_search(docs, items, 5))
    got = lexical_search.search(odd, asked).collect()
    assert ordered(map(tuple, got)) == ordered(plain_search([(r["doc_id"], r["text"]) for r in odd.collect()], items))
    assert lexical_search.search(none, asked).collect() == [] == lexical_search.search(odd, asked.limit(0)).collect()
    named = asked.withColumnRenamed("item_id", "score")
    assert lexical_search.search(odd, named, item_col="score").columns == ["score", "rank", "doc_id", "_score"]


# ------------------------------------------------------------------ whitening


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(40.0), [5, 5, 5, 3, 3, 1, 0, 0, -2], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 1e-14], [1e6, 1, 1e-6, 1e-7], [0.0, 0.0], [7.0], [-1, -2, -3], [2.0] * 20,
    1 / np.arange(1, 65) ** 2,
])
def test_spectrum_slicing(values):
    values = np.array(values, float)
    a = symmetric(values)
    a = (a + a.T) / 2
    scale = max(np.abs(values).max(), 1e-300)
    for s in (*values + 1e-3 * scale, *values - 1e-3 * scale, 0.123):
        if np.abs(values - s).min() > 1e-12 * scale:
            assert spectrum.count_above(a, s) == (values > s).sum()
    got, vectors = spectrum.leading(a, 6)
    want = np.sort(values)[::-1][:6]
    assert np.abs(got - want).max() <= 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-9
    assert np.abs(a @ vectors.T - vectors.T * got).max() <= 1e-11 * scale


def test_counts_of_matrices_that_need_pivots():
    for a in ([[0.0, 1], [1, 0]], [[0.0, 0, 1], [0, 0, 0], [1, 0, 0]], np.zeros((3, 3)), [[0.0, 1, 2], [1, 0, 3], [2, 3, 0]]):
        a = np.array(a)
        assert spectrum.count_above(a, 0.0) == (np.linalg.eigvalsh(a) > 1e-12).sum()


def plain_whitening(rows, k=16):
    """By numpy's eigenvalues; rows are (id, vector) that are valid."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], np.int64)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = distinct - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitening(got, rows):
    n, deviation, white, explained = plain_whitening(rows)
    k = len(explained)
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i, _ in rows for c in range(1, k + 1)]
    assert [r["deviation"] for r in got] == [d for d in deviation for _ in range(k)] and {r["n"] for r in got} == {n}
    ours = np.array([r["whitened"] for r in got]).reshape(-1, k)
    sign = np.sign((ours * white).sum(axis=0))
    assert np.abs(ours - white * sign).max() < 1e-6
    assert np.allclose([r["explained"] for r in got], np.tile(explained, len(rows)), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8


def test_whitening_of_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in frame.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"]))
    check_whitening(whitening.digest(frame.repartition(5)).collect(), rows)


def test_whitening_odd_rows(spark):
    rng = random.Random(3)
    good = [(k, [rng.gauss(0, 10.0 ** (j - 2)) for j in range(5)]) for k in range(60)]
    good += [(60 + k, good[0][1]) for k in range(20)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, []), (95, [1.0, 2.0]), (96, [1e300] * 5)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id bigint, embedding array<double>, n string, component int").repartition(4)
    check_whitening(whitening.digest(frame).collect(), good)
    assert whitening.whiten(frame, ["vec_id", "n", "component"]).columns == ["vec_id", "n", "component", "_component", "_n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.digest(frame.where("vec_id >= 60 and vec_id < 90")).collect() == []
    assert whitening.digest(frame.where("vec_id = 90")).collect() == [] == whitening.digest(frame.limit(0)).collect()
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)], "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whitening.digest(flat).collect()} == {1}
    wide = spark.createDataFrame([(k, [float(k) * 1e13, 0.0]) for k in range(9)], "vec_id bigint, embedding array<double>")
    got = whitening.digest(wide).collect()
    assert len(got) == 9 and [r["deviation"] for r in sorted(got)] == [0 if k == 4 else None for k in range(9)]


def test_packed_vectors():
    vectors = [np.array(v, np.int64) for v in ([0, -128, 127], [1, 2, 300], [-70_000, 0, 5], [1 << 40, 0, -1])]
    packed = [whitening.pack_vector(v) for v in vectors]
    assert [len(p) for p in packed] == [3, 6, 12, 24]
    assert (whitening.unpack_vectors(packed, 3) == np.array(vectors) + whitening.SHIFT).all()
