"""Operators over the whole corpus: PII, sharding, Jaccard join, components, and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, pii, sharding
from tessera.llm.components import connected_components
from tests.llm.conftest import PATTERNS, SF


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m.group())]
    return sorted(found)


def shown(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


# ------------------------------------------------------------------ PII


def test_pattern_spans(spark, documents, odd):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "_", "+", "1", "22", "255", "256", "0", " ", "(", ")", "4111111111111111", "é", "\U0001f642", "\n", "x@y.z", "+1 (555) 010-9999", "10.0.0.1", "..", "%"]
    fuzz = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    fuzz += ["a" * 8_000, "1 " * 20_000, "1." * 4_000, "a@" + "b." * 20_000 + "c", "+1" + "(" * 20_000, "9" * 8_000, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0001.02.3.00255"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(fuzz)], "doc_id int, text string")
    for frame in (df, documents, odd):
        got = pii.with_spans(frame.select("text"), "text", "spans").collect()
        for r in got:
            assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"]] == brute_spans(r["text"]), r["text"][:200]


def planted(spark):
    """One address that only ever stands beside 'Zorblax', in different lines; common words stand everywhere."""
    lines = [f"common words and number {k} stand in every line here" for k in range(60)]
    told = [f"common words, Zorblax wrote version {w} from zed@mail.example.com" for w in ("one", "two", "three", "four")]
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3] + ([told[k]] if k < 4 else []))) for k in range(20)]
    return spark.createDataFrame(rows + [(99, rows[0][1]), (100, None), (101, "")], "doc_id bigint, text string"), rows


def test_disclosing_terms_equal_the_formula(spark):
    docs, _ = planted(spark)
    lines = [line for r in docs.collect() for line in (r["text"] or "").split("\n") if re.search(r"\w", line)]
    words = lambda t: {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if len(w) >= 3}
    holds = [line for line in lines if "zed@mail.example.com" in line]
    n_term = collections.Counter(w for line in lines for w in words(line))
    both, support = collections.Counter(), collections.defaultdict(set)
    for line in holds:
        for w in words(line.replace("zed@mail.example.com", " ")):
            both[w] += 1
            support[w].add(line)
    want = {}
    for w, n in both.items():
        share = math.log2(len(lines) * n / (len(holds) * n_term[w])) / math.log2(len(lines) / len(holds))
        if len(support[w]) >= 3 and share >= pii.GENERALISE:
            want[w] = share
    contents = pii._contents(pii.entity_lines(docs, "text"))
    got = pii.disclosing_terms(docs, contents, pii.entity_classes(contents)).collect()
    assert set(want) == {"zorblax", "wrote", "version", "from"}
    assert {r["term"]: pytest.approx(r["disclosed"]) for r in got} == want
    assert {r["entity"] for r in got} == {"email:zed@mail.example.com"}


def test_sanitised_text(spark):
    docs, rows = planted(spark)
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert len(got) == docs.count()
    assert got[0].split("\n")[-1] == "common words,    one  [EMAIL]" and got[0] == got[99]
    assert got[7] == rows[7][1] and got[100] is None and got[101] == ""
    found = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    text = rows[0][1]
    spans = [tuple(s.split(":")) for s in found[0]["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [
        ("term", "Zorblax"), ("term", "wrote"), ("term", "version"), ("term", "from"), ("email", "zed@mail.example.com")]
    assert found[0]["base_sha256"] == hashlib.sha256(shown(brute_spans(text)).encode()).hexdigest()


def test_one_line_in_many_copies_is_no_support(spark):
    docs = spark.createDataFrame([(k, "Zorblax wrote from zed@mail.example.com") for k in range(50)] + [(99, "other words")], "doc_id int, text string")
    assert pii.digest(docs).where("spans like '%term%'").count() == 0


def rare(spark, n_lines, told):
    """``n_lines`` lines of common words, thirty to a text, and a text for each line of ``told``."""
    lines = [f"common words and number {k % 7} stand in every line here, 王 too" for k in range(n_lines)]
    texts = ["\n".join(lines[k : k + 30]) for k in range(0, n_lines, 30)] + told
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), range(len(texts) - len(told), len(texts))


def found_terms(docs, at):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.digest(docs).collect()}
    assert not [i for i in spans if i not in at and spans[i]]
    return [{rows[i][int(a) : int(b)] for k, a, b in spans[i] if k == "term"} for i in at]


def test_terms_of_entities_in_one_or_two_lines(spark):
    one = "common words, Zorblax 李 and 王 here, zed@mail.example.com"
    two = ["common words, Quuxo wrote here, 10.0.0.1", "common words, Quuxo went here, 10.0.0.1"]
    assert found_terms(*rare(spark, 12_000, [one])) == [{"Zorblax", "李"}]
    assert found_terms(*rare(spark, 2_000, [one])) == [set()]  # one line of 2 000 could be chance
    assert found_terms(*rare(spark, 2_000, two)) == [{"Quuxo"}, {"Quuxo"}]


def test_entity_in_every_line(spark):
    assert found_terms(*rare(spark, 0, ["Zorblax wrote, 10.0.0.1"])) == [set()]


def test_words_not_terms_meet_a_line(spark, monkeypatch):
    """An entity in 300 lines that each have a term of their own: 300 rows meet, not 300 x 300."""
    told = [f"common words, zork{k} wrote here, 10.0.0.1" for k in range(300)]
    docs, at = rare(spark, 0, told)
    terms = spark.createDataFrame([("ip:10.0.0.1", f"zork{k}", 1.0) for k in range(300)], "entity string, term string, disclosed double")
    monkeypatch.setattr(pii, "disclosing_terms", lambda *_: terms)
    spans = pii.term_spans(docs)
    assert sum(len(r["terms"]) for r in spans.collect()) == 300


def brute_terms(rows):
    """id -> (start, end, removed) of the term spans, by the module's formula over plain Python counts."""
    def split(line):
        return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line) if len(m.group()) >= 3 or not m.group().isascii()]

    def name(kind, value):
        return kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()

    def blank(line):
        out, at = [], 0
        for a, _, _, b in brute_spans(line):
            out += [line[at:a], " "] * (a >= at)
            at = max(at, b)
        return "".join(out) + line[at:]

    lines = [(i, text, at, line) for i, text in rows if text is not None for at, line in [(m.start(), m.group()) for m in re.finditer(r"(?m)^.*$", text)]]
    n = sum(bool(re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", line)) for *_, line in lines)
    n_term, n_entity, joint, support, texts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set), {}
    held = {line: {name(kind, line[a:b]) for a, _, kind, b in brute_spans(line)} for *_, line in lines}
    for _, text, _, line in lines:
        texts[line] = min(texts.get(line, text), text)
        n_term.update({w for *_, w in split(line)})
    for _, _, _, line in lines:
        for e in held[line]:
            n_entity[e] += 1
            for w in {w for *_, w in split(blank(line))}:
                joint[e, w] += 1
                support[e, w].add(texts[line])
    told = {}
    for (e, w), k in joint.items():
        seen, p = k / max(k, n_term[w]), n_entity[e] / n
        if p < 1:
            share, q = 1 - math.log2(seen) / math.log2(p), p ** (1 - pii.GENERALISE)
            kl = seen * math.log(seen / q) + ((1 - seen) * math.log((1 - seen) / (1 - q)) if seen < 1 else 0)
            if share >= pii.GENERALISE and len(support[e, w]) / seen * kl >= -math.log(1 - pii.CONFIDENCE):
                told[e, w] = share
    out = collections.defaultdict(list)
    for i, _, at, line in lines:
        masked = {w for *_, w in split(blank(line))}
        for a, b, w in split(line):
            shares = [told[e, w] for e in held[line] if (e, w) in told and w in masked]
            if shares:
                out[i].append((at + a, at + b, max(shares) >= pii.REMOVE))
    return out


def test_terms_of_many_entities_equal_the_formula(spark):
    """Lines that share entities, several entities of the same lines, copies, and terms that are removed, generalised or left."""
    rng = random.Random(11)
    common = [f"w{k}x" for k in range(40)]
    told = []
    for k in range(60):
        entities = [f"user{rng.randint(8, 15)}@mail.example.com", f"10.0.{rng.randint(0, 4)}.{rng.randint(0, 4)}"][: rng.randint(1, 2)]
        told.append(" ".join(rng.sample(common, 5) + [f"rare{rng.randint(0, 40)}", f"secret{entities[0][4:6]}", str(1000 + rng.randint(0, 9))] + entities))
    docs = [" ".join(rng.choices(common, k=8)) + "\n" + "\n".join(" ".join(rng.choices(common, k=6)) for _ in range(29)) for _ in range(700)]
    docs += ["\n".join(rng.sample(told, rng.randint(1, 3)) + [" ".join(rng.choices(common, k=6))]) for _ in range(60)]
    docs += [f"secret{k} " + " ".join(rng.choices(common, k=6)) for k in range(10, 16) for _ in range(6)]
    rows = list(enumerate([*docs, *docs[-60:-50], None, ""]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = brute_terms(rows)
    assert len(want) > 20 and {r for spans in want.values() for *_, r in spans} == {True, False}
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")] for r in pii.digest(df).collect()}
    assert {i: s for i, s in got.items() if s} == {i: sorted((a, b) for a, b, _ in s) for i, s in want.items()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i, text in rows:
        spans = sorted([(a, 9, b, "" if gone else "[NUMBER]" if text[a:b].isdigit() else "[WORD]") for a, b, gone in want.get(i, [])] + [(a, r, b, f"[{k.upper()}]") for a, r, k, b in brute_spans(text)])
        at, out = 0, []
        for a, _, b, shown_as in spans:
            if a >= at:
                out += [text[at:a], shown_as]
            at = max(at, b)
        assert clean[i] == (None if text is None else "".join(out) + text[at:])


def test_many_entities_on_one_line(spark):
    """The work on a line grows with its length, not with a power of its entities."""
    import time

    line = ", ".join(f"name{k} user{k}@mail.example.com" for k in range(20_000))
    docs = spark.createDataFrame([(1, line), (2, "plain text")], "doc_id bigint, text string")
    pii.sanitise(docs.where("doc_id = 2")).collect()
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert got[2] == "plain text" and got[1].count("[EMAIL]") == 20_000 and got[1].startswith("name0 [EMAIL], name1 ")
    assert time.time() - began < 60


def test_pii_digest_and_odd_rows(documents, odd, none):
    for df in (documents, odd):
        got = pii.digest(df).collect()
        want = [(r["doc_id"], shown(brute_spans(r["text"]))) for r in df.collect()]
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(s.encode()).hexdigest()) for i, s in want)
    assert pii.digest(none).count() == 0 and pii.sanitise(none).count() == 0
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == 9


def test_pii_plan_is_native(documents):
    plan = pii.digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ sharding


def brute_table(shards, slots):
    import xxhash

    prefs = []
    for s in shards:
        offset, skip = xxhash.xxh64_intdigest(s, seed=1) % slots, xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1
        prefs.append([(offset + j * skip) % slots for j in range(slots)])
    table = [None] * slots
    while None in table:
        for k, pref in enumerate(prefs):
            slot = next((p for p in pref if table[p] is None), None)
            if slot is not None:
                table[slot] = k
    return table


@pytest.mark.parametrize(("n", "slots"), [(1, 2), (3, 7), (5, 101), (16, 251)])
def test_lookup_table(n, slots):
    shards = [f"s{k}" for k in range(n)]
    table = sharding.fill_table(shards, slots)
    assert table == brute_table(shards, slots)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    shards = [f"s{k}" for k in range(20)]
    before, after = sharding.fill_table(shards, 2003), sharding.fill_table(shards[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.1 * 2003
    weights = collections.Counter(sharding.fill_table(shards, 2003, {"s0": 4}))
    assert 3.5 < weights[0] / weights[1] < 4.5
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement_spreads_hot_keys(spark, odd, none):
    rows = [(k, "hot" if k % 3 else f"s{k % 40}") for k in range(6000)] + [(7, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    shards = [f"shard{k}" for k in range(8)]
    placed = sharding.place(df, "source", shards, 1009, spread_by="doc_id")
    assert placed.count() == len(rows) and placed.columns == ["doc_id", "source", "slot", "shard", "shard_name"]
    load = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert len(load) == 8 and max(load.values()) < 0.4 * len(rows)
    table = sharding.fill_table(shards, 1009)
    assert all(table[r["slot"]] == r["shard"] and shards[r["shard"]] == r["shard_name"] for r in placed.collect())
    cold = placed.where("source <> 'hot'").groupBy("source").agg(F.countDistinct("shard").alias("n"))
    assert cold.where("n > 1").count() == 0
    whole = sharding.place(odd.withColumn("shard", F.lit(1)), "doc_id", shards, 1009)
    assert whole.count() == 9 and "_shard" in whole.columns
    assert len({r["_shard"] for r in whole.where("doc_id = 1").collect()}) == 1
    assert sharding.place(none, "doc_id", shards, 1009, spread_by="n_tokens").count() == 0


def test_written_shards(spark, documents, scratch):
    placed = sharding.place(documents, "doc_id", ["a", "b", "c"], 1009)
    sharding.write_shards(placed, f"{scratch}/shards")
    back = spark.read.parquet(f"{scratch}/shards")
    assert back.count() == documents.count()
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"]) for r in placed.collect())


# ------------------------------------------------------------------ Jaccard join


def grams(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows):
    """id -> (class id, class size, group id, links), over all pairs."""
    sets = {i: grams(t) for i, t in rows}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    near = {i: {j for j in sets if j != i and sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))} for i in sets}
    out = {}
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        own = by[sets[i]] if sets[i] else [i]
        out[i] = (min(own), len(own), min(group), len(near[i]))
    return out


def near_copies(n):
    rng = random.Random(n)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_links_equal_all_pairs(spark, documents, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(1000 + k, t) for k, t in enumerate(near_copies(60))]
    rows += [(2000, ""), (2001, None), (2002, "one two"), (2003, "One, TWO!"), (2004, "...")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["group_id"], r["n_links"]) for r in jaccard_join.links(df).collect()}
    want = brute_links(rows)
    assert got == want
    kept = jaccard_join.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want.values()})


def test_links_of_repeated_and_null_ids(spark, monkeypatch):
    """An id that stands with different texts, copies and near copies under other, equal and null ids: no link and no text is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 5)
    a, b = near_copies(12), ["x " + t.replace("w", "u") for t in near_copies(12)]
    c = " ".join(f"c{k}" for k in range(40))
    rows = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, a[2]), (4, b[2]), (4, a[2]), (4, b[2]), (None, a[3]), (None, b[3]), (5, b[4]), (None, c), (None, c), (None, c + " d"),
            (6, "alone " + " ".join(f"z{k}" for k in range(30))), (6, "quite another text of six words"), (7, ""), (7, ""), (None, None), (8, "two words"), (8, "two words")]
    rows += [(random.Random(k).choice([9, 10, None]), t) for k, t in enumerate([*a[4:], *b[5:]])]
    brute = brute_links(list(enumerate(t for _, t in rows)))

    def least(places):
        return min((rows[p][0] for p in places if rows[p][0] is not None), default=None)

    classes, groups = collections.defaultdict(list), collections.defaultdict(list)
    for p, (one, _, whole, _) in brute.items():
        classes[one].append(p)
        groups[whole].append(p)
    want = collections.Counter((rows[p][0], least(classes[one]), size, least(groups[whole]), n) for p, (one, size, whole, n) in brute.items())
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert collections.Counter(map(tuple, jaccard_join.links(df).collect())) == want
    kept = [tuple(r) for r in jaccard_join.keep_one(df).collect()]
    of_text = {t: whole for p, (_, _, whole, _) in brute.items() for t in [rows[p][1]]}
    words = [(i, t) for i, t in kept if grams(t)]
    assert sorted(of_text[t] for _, t in words) == sorted({whole for p, (_, _, whole, _) in brute.items() if grams(rows[p][1])})
    assert all(i == least(groups[of_text[t]]) and (i, t) in rows for i, t in words)
    assert sorted((r for r in kept if not grams(r[1])), key=repr) == sorted((r for r in rows if not grams(r[1])), key=repr)


def test_join_odd_rows(odd, none):
    got = jaccard_join.links(odd).collect()
    assert len(got) == 9
    assert [(r["class_size"], r["n_links"]) for r in got if r["doc_id"] == 1] == [(2, 1)] * 2
    assert [tuple(r)[1:] for r in got if r["doc_id"] is None] == [(None, 1, None, 0)]
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert jaccard_join.links(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_banding_for_recall():
    bands, rows = jaccard_join.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard_join.MAX_HASHES
    assert jaccard_join.choose_bands(1.0) == (1, jaccard_join.MAX_HASHES)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ queries and pipeline


def test_one_query_for_each_operator():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tessera.llm import quality_qda
    from tests.llm.test_text_operators import brute_hits

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in quality_qda.digest(docs, labels).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if score[r["doc_id"]] >= 0.5}
    linked = brute_links([(i, r["text"]) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if linked[i][2] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: r for i, r in rows.items() if not brute_hits(r["text"], items)[-1]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, r in rows.items():
        text, out, at = r["text"], [], 0
        for a, _, kind, b in brute_spans(text):  # (no term of this table discloses an entity)
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        clean = "".join(out) + text[at:]
        want[i] = (r["lang"], r["source"], len(clean), tok.encode(clean, add_special_tokens=False).ids)
    got = {r["doc_id"]: (r["lang"], r["source"], r["n_chars"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns


def test_pipeline_stages_take_odd_rows(spark, scratch):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x@y.example.com here", "en", "s", 3), (4, "", "en", "s", 0)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([(1, "zzz yyy")], "item_id bigint, text string").write.parquet(f"{scratch}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, scratch)
            assert out.count() <= frame.count()
