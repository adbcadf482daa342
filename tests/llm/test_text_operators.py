"""Per-text operators against brute force: line quality, BPE, HTML text, decontamination, token counts."""

from __future__ import annotations

import collections
import hashlib
import html
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import bpe, common, decontamination, html_text, line_quality, token_counts
from tests.llm.conftest import SF

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ common


def test_slices_keep_whole_rows():
    data, offsets = common.text_buffers(pa.array(["ab", None, "", "cdé", "x" * 50], pa.string()))
    got = [bytes(piece[a:b]).decode() for _, _, piece, offs in common.slices(data, offsets, 4) for a, b in zip(offs[:-1], offs[1:])]
    assert got == ["ab", "", "", "cdé", "x" * 50]


def test_words_do_not_run_over_rows():
    data, offsets = common.text_buffers(pa.array(["ab c", "d e", "", "f"], pa.string()))
    starts, ends, word_offsets = common.word_spans(data, offsets, common.NOT_SPACE)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"e", b"f"]
    assert word_offsets.tolist() == [0, 2, 4, 4, 5]


def test_sliced_arrow_columns():
    column = pa.array(["skip", "a b", "c"], pa.string()).slice(1)
    data, offsets = common.text_buffers(column)
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 4]


# ------------------------------------------------------------------ line quality


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_line_quality_base(spark, documents, odd):
    for df in (documents, odd):
        texts = [r[0] for r in df.select("text").collect()]
        got = rows_of(line_quality.judge(df.select("doc_id", "text"), ["doc_id"]).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == [brute_base(t) for t in texts]


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("A plain sentence of prose that ends as it should.", False), ("Ein Satz, der so endet, wie er soll!", False), ("“Quoted speech ends well.”", False),
        ("This sentence goes on; it has marks. But no end", False), ("HOME | NEWS | SPORT | ABOUT", True), ("Home › News › Sport today", True),
        ("Contact us", True), ("SHOUTING!! ALL!! THE!! TIME!!", True), ("word### after%%% word&&& here$$$.", True),
        ("Please accept cookies to go on reading this page.", True), ("words without any mark at all in the whole line", True),
    ],
)
def test_line_rules(line, fails):
    data, offsets = common.text_buffers(pa.array([line]))
    assert bool(line_quality.measure(data, offsets)["n_failed_lines"][0]) == fails


def test_line_quality_rejects_by_lost_words(spark):
    rng = random.Random(1)
    prose = "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(9)) + "." for _ in range(20))
    menu = "\n".join(f"Item {i} | Shop {i} | Cart {i} | Help {i}" for i in range(40))
    df = spark.createDataFrame([(1, prose), (2, prose + "\n" + menu), (3, menu)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in line_quality.judge(df, ["doc_id"], with_text=True).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3)] == [True, False, False]
    assert got[2]["clean_text"].rstrip("\n") == prose and got[1]["clean_text"] == prose


def test_line_quality_odd_rows(odd, none):
    got = line_quality.judge(odd, ["doc_id", "kept", "n_tokens", "row"], with_text=True)
    assert got.count() == 9 and "_kept" in got.columns
    assert [r["clean_text"] for r in got.collect()][2] is None
    assert line_quality.judge(none, ["doc_id"]).count() == 0


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE_FILE)


PARTS = [" ", "  ", "\n", "\n\n", " a", "é", "Ü", "日本", "\U0001f642", "'s", "'re", "don't", "12", "3.4", "!!", "...", "<|endoftext|>", "<|endof", "text|>", "　", "\x85", "\xa0",
         "\x1c", "x", "\t", "_", "İ", "​", "'", "l"]


@pytest.mark.parametrize("average", [4, 16, 1024])
def test_joined_chunks_equal_whole_encoding(hf, average):
    rng = random.Random(average)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["a" * 500, " " * 500, "日" * 400, "", " "]
    encoder = bpe.Encoder(bpe.tokenizer(BPE_FILE), average)
    for text in texts:
        got = encoder.encode(np.frombuffer(text.encode(), np.uint8))
        ids = hf.encode(text, add_special_tokens=False).ids
        assert got.tolist() == ids
        assert bpe.tokenizer(BPE_FILE).decode(got).decode() == hf.decode(ids, skip_special_tokens=False)


def test_chunks_depend_on_content_and_are_encoded_once(documents):
    passage = np.frombuffer("\n".join(r[0] for r in documents.select("text").limit(20).collect()).encode(), np.uint8)
    a = np.concatenate([np.frombuffer(b"one beginning ", np.uint8), passage])
    b = np.concatenate([np.frombuffer(b"quite another beginning of the text ", np.uint8), passage])
    pieces = [set(bpe._pieces(x, 256)) for x in (a, b)]
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])
    encoder, calls = bpe.Encoder(bpe.tokenizer(BPE_FILE), 256), []
    whole = encoder._chunk
    encoder._chunk = lambda p: (calls.append(p), whole(p))[1]
    encoder.encode(a)
    known = len(encoder.known)
    encoder.encode(b)
    assert len(calls) > 1.9 * known and len(encoder.known) < 1.1 * known


def test_bpe_digest(documents, odd, none, hf):
    for df in (documents.select("doc_id", "text"), odd):
        def expected(text):
            ids = hf.encode(text or "", add_special_tokens=False).ids
            return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()

        want = sorted((str(r[0]), *expected(r[1])) for r in df.select("doc_id", "text").collect())
        assert sorted((str(r[0]), *r[1:]) for r in rows_of(bpe.digest(df, BPE_FILE))) == want
    assert bpe.digest(none, BPE_FILE).count() == 0
    back = bpe.decode(bpe.encode(odd, BPE_FILE, ["doc_id", "n_tokens", "kept"]), BPE_FILE)
    assert "_n_tokens" in back.columns
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())


# ------------------------------------------------------------------ HTML


def article_of(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(b for b in blocks if b)


def test_html_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, ["page_id"]).collect()}
    assert got == {r["page_id"]: article_of(r["html"]) for r in pages.collect()}


LONG = "A sentence that is long enough to be the text of a page, with several clauses and a full stop. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), (None, ""), ("<", "<"), ("<script>var x = '<p>no</p>'", ""), ("<!-- never closed <p>" + LONG, ""), ("a < b", "a < b"),
        (f"<div class='menu'>Home</div><div>{LONG}</div><div id=footer>{LONG}</div>", LONG.strip()),
        (f"<ul><li><a href=x>{LONG}</a></li></ul><p>{LONG}<p>Short.<form>{LONG}</form>", LONG.strip() + "\nShort."),
        (f"<header>{LONG}</header><main><h1>T &amp; U</h1><p>One&nbsp;&lt;two&gt;\n\tthree<aside>{LONG}</aside><p>four</main><footer>{LONG}</footer>", "T & U\nOne <two> three\nfour"),
        (f"<p>{LONG}</p><article><h1>Title</h1><p>x</article><div class='comments'>{LONG}</div>", "Title\nx"),
        (f"<article><p>&amp;lt; &#x41;&copy 5</p><article class='comment'>{LONG}</article></article>", "&lt; A© 5"),
        (f"<div class=cookie-notice>{LONG}</div><style>p{{}}</style><p>{LONG}</p><div style='display: none'>{LONG}</div>", LONG.strip()),
    ],
)
def test_html_cases(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='layout has-sidebar'><article><p>{LONG}</article></div>", LONG.strip()),
        (f"<div id='page' class='no-comments'><p>{LONG}</div><div class='site-footer'>{LONG}</div>", LONG.strip()),
        (f"<div class='sidebar'><article><p>{LONG}</article></div><p>Short.", LONG.strip()),
        (f"<div class='sidebar'><article><p>Short.</article></div><p>{LONG}", LONG.strip()),
        (f"<article><p>{LONG}</article><div id='comments'><article><p>{LONG}{LONG}</article></div>", LONG.strip()),
        ("<article><h2 id='related-work'>A</h2><section id='social-impact'>B</section><h2 id='notice-period'>C</h2><p id='search'>D</p></article>", "A\nB\nC\nD"),
        ("<article><div class='header'><h1 class='alert'>A</h1></div><section id='notice'><p>B</section><div class='related-posts'>C</div></article>", "A\nB"),
    ],
)
def test_html_names(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<a href=x>Home</a><article><h1><a href=x>T</a></h1><p><a href=x>One link</a><p>x<ul><li><a href=x>L</a></ul></article>", "T\nOne link\nx\nL"),
        (f"<main><h2><a href=x>T</a></h2><p>{LONG}</main><p><a href=x>{LONG}</a>", f"T\n{LONG.strip()}"),
        (f"<p>{LONG}<div class=ad><p>a<p>b<p>c</div><p>The end.", f"{LONG.strip()}\nThe end."),
        (f"<ul><li><a href=x>Home</a></ul><p>{LONG}<p><a href=x>One link</a><p>The end.<p><a href=x>Imprint</a>", f"{LONG.strip()}\nOne link\nThe end."),
        ("<p><a href=x>Home</a>", ""),
    ],
)
def test_html_links_and_short_ends(page, text):
    assert html_text.main_text(page) == text


_P = "<p>A paragraph of the body that is long enough to surge, with a second clause and a third one for good measure.</p>"
_PT = "A paragraph of the body that is long enough to surge, with a second clause and a third one for good measure."
_MENU = "".join(f"<div><a href='/{k}'>Menu item number {k} with a long title of its own</a></div>" for k in range(6))


@pytest.mark.parametrize(("page", "text"), [
    # plain divs: a surge before the paragraphs and a dive into the links; what follows the dive does not surge again
    (f"<div>{_P}{_P}</div>{_MENU}<div>(c) 2020 Foo</div>", f"{_PT}\n{_PT}"),
    (f"{_MENU}<div>{_P}</div>{_MENU}<div>Foo Ltd</div>", _PT),
    (f"{_MENU}{_P}{_MENU}{_P}{_MENU}", f"{_PT}\n{_PT}"),  # two stretches of text
    (f"{_P}<div><a href='/x'>One link</a></div><div><a href='/y'>another</a></div>{_P}", f"{_PT}\nOne link\nanother\n{_PT}"),
    # a teaser in the main part, a remark after the body, a page-wide form
    (f"<main>{_P}{_P}<article><p>One teaser of a few words</p></article></main>", f"{_PT}\n{_PT}\nOne teaser of a few words"),
    (f"<div id='content'>{_P}{_P}</div><div class='discussion'><article><p>I like this.</p></article></div>", f"{_PT}\n{_PT}"),
    (f"<div id='content'>{_P}{_P}{_P}</div><div><article><p>Short.</p></article></div>", f"{_PT}\n{_PT}\n{_PT}\nShort."),
    (f"<form action='/p'><div>menu</div><article>{_P}</article></form>", _PT),
    (f"<form action='/p'><div>{_P}{_P}</div><button>Send</button></form><p>x</p>", f"{_PT}\n{_PT}\nx"),
    (f"<article>{_P}<form><p>Your name please</p><input></form>{_P}</article>", f"{_PT}\n{_PT}"),
    # a marked article counts with its links, and alone
    (f"<div>Outside it, some words that no article holds</div><article><h1><a href='/'>Title</a></h1>{_P}<p><a href='/z'>Linked</a></p></article>", f"Title\n{_PT}\nLinked"),
])
def test_html_surge_and_dive(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def test_html_stretches():
    assert html_text.spans([0, 0, 100, 0, 0, 0, 5, 0, 0, 0, 90, 10, 0]) == [(2, 3), (10, 12)]
    assert html_text.spans([5, 0, 0, 30]) == [(0, 4)] or html_text.spans([5, 0, 0, 30]) == [(3, 4)]
    assert html_text.spans([]) == [] == html_text.spans([0, 0, 0])


def test_html_odd_rows(odd, none):
    got = html_text.extract(odd, ["doc_id", "kept"], html_col="text")
    assert got.count() == 9 and html_text.extract(none, ["doc_id"], html_col="text").count() == 0
    assert html_text.extract(odd, ["doc_id", "text"], html_col="text").columns == ["doc_id", "text", "_text"]


# ------------------------------------------------------------------ decontamination


def brute_hits(text, items):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words, hit, seen = find(text), set(), set()
    for item, t in items:
        own = find(t)
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1) if own else ():
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                seen.add(str(item))
    return len(words), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture
def benchmark(spark):
    own = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "ends here"), (901, None), (902, ".."), (903, "ENDS here!"), (904, "x" * 100_000)], "item_id bigint, text string")
    return own.union(extra)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100_000])
def test_decontamination(documents, odd, benchmark, block_bytes):
    items = [tuple(r) for r in benchmark.collect()]
    for df in (documents, odd):
        found = decontamination.find_hits(df, benchmark, keep=["doc_id"], block_bytes=block_bytes)
        got = [(r["n_words"], sum(b - a for a, b in zip(r["hits"][::2], r["hits"][1::2])), len(r["items"])) for r in found.collect()]
        want = [brute_hits(r["text"], items) for r in df.collect()]
        assert got == [w[:3] for w in want]
    assert any(w[1] for w in want)
    assert sorted(rows_of(decontamination.digest(documents, benchmark))) == sorted((r["doc_id"], *brute_hits(r["text"], items)) for r in documents.collect())


def test_decontamination_takes_effect(documents, odd, none, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    kept = decontamination.remove_documents(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in documents.collect() if not brute_hits(r["text"], items)[-1]}
    cut = decontamination.remove_spans(odd, benchmark)
    assert cut.columns == odd.columns
    assert [r["text"] for r in cut.collect()][:2] == ["The same text with quite a few words in it. It ."] * 2
    assert decontamination.remove_documents(none, benchmark).count() == 0
    assert decontamination.digest(odd, benchmark.limit(0)).where("contaminated").count() == 0


# ------------------------------------------------------------------ token counts


def test_counts_equal_the_unigram_tokenizer(documents):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    tok = Tokenizer(models.Unigram(vocabulary, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    rng = random.Random(5)
    texts = [r[0] for r in documents.select("text").collect()]
    texts += ["x" + "".join(rng.choice(PARTS[:10] + PARTS[11:16] + PARTS[19:]) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    counter = token_counts.Counter(*token_counts.load_pieces(PIECES))
    assert [counter.count(t) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def brute_viterbi(text, pieces, lowest):
    """All candidates at every place, by ascending start; strictly better ones replace."""
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        found, known = None, False
        for start in range(end):
            piece = text[start:end]
            known |= piece in pieces and end - start == 1
            if piece in pieces and (found is None or best[start][0] + pieces[piece] > found[0]):
                found = best[start][0] + pieces[piece], best[start][1] + 1
        if not known and (found is None or best[end - 1][0] + lowest - 10 > found[0]):
            found = best[end - 1][0] + lowest - 10, best[end - 1][1] + len(text[end - 1].encode())
        best[end] = found
    return best[len(text)][1]


@pytest.mark.parametrize("joined", [False, True])
def test_counts_with_ties(joined):
    pieces = {"a": -2.0, "b": -2.0, "ab": -4.0, "ba": -4.0, "aba": -6.0, "▁": -1.0, "▁a": -3.0, "bb": -3.5, "▁▁": -2.0} | ({"b▁a": -1.0} if joined else {})
    counter = token_counts.Counter(list(pieces.items()), min(pieces.values()))
    assert counter.by_word != joined
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 14)))
        want = brute_viterbi("▁" + text.replace(" ", "▁"), pieces, min(pieces.values())) if text else 0
        assert counter.count(text) == want, repr(text)


def test_counts_odd_rows(odd, none):
    got = token_counts.count_tokens(odd, PIECES, ["doc_id", "n_tokens"])
    assert got.columns == ["doc_id", "n_tokens", "_n_tokens"]
    counts = [r[2] for r in got.collect()]
    assert counts[2] == counts[3] == 0 and counts[0] == counts[1] > 0
    assert token_counts.count_tokens(none, PIECES, ["doc_id"]).count() == 0
