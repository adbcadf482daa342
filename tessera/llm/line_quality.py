"""Line-first quality rules: every line of a text is judged by punctuation, navigation and boilerplate rules;
failing lines go, and a document that loses too many of its words that way is rejected.

Words are runs of bytes other than ASCII white space. Lines are split at ``\\n`` only; lines without a word are
neither judged nor counted, and stay. A line fails

* ``symbols``: more than one symbol of ``#*$%&|<>`` for every two words;
* ``shouting``: three words or more, and most of its letters are capitals, or an exclamation mark for every two words;
* ``navigation``: two separators (``| > » › ·``) or more, and one for every four words;
* ``punctuation``: no closing punctuation at its end, and fewer than five words or no sentence mark anywhere;
* ``boilerplate``: fewer than 40 words and one of the stock phrases of web pages.

Before the line rules, a base rule rejects texts of under ``MIN_WORDS`` words and texts in which over half of the
words lie in three-word windows that occur twice or more.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; its cleaned text is empty
(null stays null); equal lines count from the second on; repeated rows are judged each for itself. Windows and lines
are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50

#: Stock phrases of navigation and legal lines, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "forgot your password", "log in to", "privacy policy", "read more", "share this", "sign in to", "sign up for",
    "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies", "view all comments",
)
_PHRASES = [p.encode() for p in BOILERPLATE]


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_PIPE = _flags("|>")
_MARK = _flags(".!?")
_CLOSING = _flags(".!?:;\"')")
_NOT_NEWLINE = ~_flags("\n")


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])


def _earlier(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mask of the entries that have an equal entry of the same row before them."""
    key = C.mix(hashes + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    return out


def _repeated_words(hashes: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a three-word window found twice or more in the row."""
    found = C.window_hashes(hashes, 3)
    if not len(found):
        return np.zeros(len(word_offsets) - 1, np.int64)
    rows = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    inside = np.flatnonzero(rows[: len(found)] == rows[2:])
    key = C.mix(found[inside] + rows[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[at + k] = True
    run = _running(covered)
    return run[word_offsets[1:]] - run[word_offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and line verdicts of a slice of rows."""
    starts, ends, word_offsets = C.word_spans(data, offsets, C.NOT_SPACE)
    hashes = C.word_hashes(data, starts, ends, False)
    n_rows = len(offsets) - 1
    row_of = lambda run: run[offsets[1:]] - run[offsets[:-1]]
    two = np.zeros((3, len(data)), bool)  # last bytes of multi-byte marks: closing, capital, separator
    if len(data) > 1:
        lead, tail = data[:-1], data[1:]
        two[1, 1:] = (lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E)
        letter = (lead == 0xC3) & (tail >= 0x80)
        two[2, 1:] = (lead == 0xC2) & ((tail == 0xBB) | (tail == 0xB7))
        two[0, 1:] = (lead == 0xC2) & (tail == 0xBB)
        if len(data) > 2:
            e2 = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
            two[0, 2:] |= e2 & np.isin(data[2:], (0xA6, 0x9D, 0x99)) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)
            two[0, 2:] |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & np.isin(data[2:], (0x81, 0x9F))
            two[2, 2:] |= e2 & (data[2:] == 0xBA)
    else:
        letter = np.zeros(max(len(data) - 1, 0), bool)
    symbol = _running(_SYMBOL[data])
    out = {
        "n_words": np.diff(word_offsets),
        "word_chars": row_of(_running(C.NOT_SPACE[data] & ((data & 0xC0) != 0x80))),
        "n_symbols": row_of(symbol),
        "n_repeat_words": _repeated_words(hashes, word_offsets),
    }

    begin, end, line_offsets = C.word_spans(data, offsets, _NOT_NEWLINE)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    worded = last > first
    begin, end, first, last = begin[worded], end[worded], first[worded], last[worded]
    rows = np.searchsorted(offsets, begin, "right") - 1
    n_lines = len(begin)
    out["n_lines"] = np.bincount(rows, minlength=n_rows)
    out["n_dup_lines"] = np.bincount(rows[_earlier(rows, C.word_hashes(data, begin, end, False))], minlength=n_rows) if n_lines else np.zeros(n_rows, np.int64)

    of = lambda mask: (run := _running(mask))[end] - run[begin]
    words = last - first
    capitals = of(_UPPER[data] | two[1])
    letters = of(_LETTER[data]) + of(np.concatenate([np.zeros(1, bool), letter]) if len(data) else two[1])
    bangs = of(data == 0x21)
    separators = of(_PIPE[data] | two[2])
    final = ends[last - 1] - 1 if n_lines else np.zeros(0, np.int64)
    closed = (_CLOSING[data] | two[0])[final] if n_lines else np.zeros(0, bool)
    marks = of(_MARK[data] | two[0])
    stock = np.zeros(len(data), bool)
    folded = C.FOLD[data].tobytes()
    for phrase in _PHRASES:
        at = folded.find(phrase)
        while at >= 0:
            stock[at] = True
            at = folded.find(phrase, at + 1)
    rules = {
        "symbols": 2 * (symbol[end] - symbol[begin]) > words,
        "shouting": (words >= 3) & ((2 * capitals > letters) | (2 * bangs >= words)),
        "navigation": (separators >= 2) & (4 * separators >= words),
        "punctuation": ~closed & ((words < 5) | (marks == 0)),
        "boilerplate": (words < 40) & (of(stock) > 0),
    }
    failed = np.zeros(n_lines, bool)
    for rule in rules.values():
        failed |= rule
    out["n_failed_lines"] = np.bincount(rows[failed], minlength=n_rows)
    out["n_lost_words"] = np.bincount(rows[failed], weights=words[failed], minlength=n_rows).astype(np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_lost_words"] <= MAX_LOST_PERCENT * out["n_words"])
    out["_failed"] = (rows[failed], begin[failed], end[failed])
    return out


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "n_lost_words")


def judge(docs: DataFrame, id_cols: list[str], text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_cols`` with the counts, ``base_failed`` and ``kept`` of every row; with ``with_text`` also
    ``clean_text``, the text without its failing lines; underscores go before a name that ``id_cols`` has already. A map
    over the scan, without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    measured = [*_LONGS, "base_failed", "kept"]
    names = [C.free_name(id_cols, n) for n in measured + ["clean_text"] * with_text]
    kinds = ["bigint"] * len(_LONGS) + ["boolean", "boolean", "string"]
    schema = ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{n}` {t}" for n, t in zip(names, kinds)])

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            parts, texts = [], []
            for first, end, piece, offs in C.slices(data, offsets):
                got = measure(piece, offs)
                parts.append(got)
                if with_text:
                    texts += _without(piece, offs, got["_failed"])
            cols = [batch.column(c) for c in id_cols]
            for n in measured:
                values = np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64)
                cols.append(pa.array(values, pa.int64() if n in _LONGS else pa.bool_()))
            if with_text:
                nulls = batch.column(text_col).is_null().to_pylist()
                cols.append(pa.array([None if z else t for z, t in zip(nulls, texts)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=id_cols + names)

    return C.map_rows(docs, list(dict.fromkeys([*id_cols, text_col])), schema, run)


def _without(data: np.ndarray, offsets: np.ndarray, failed) -> list[str]:
    raw, cuts = data.tobytes(), {}
    for row, a, b in zip(*(x.tolist() for x in failed)):
        cuts.setdefault(row, []).append((a, b))
    out = []
    for row in range(len(offsets) - 1):
        at, kept = int(offsets[row]), []
        for a, b in cuts.get(row, ()):
            kept.append(raw[at:a])
            at = min(b + 1, int(offsets[row + 1]))
        out.append((b"".join(kept) + raw[at : offsets[row + 1]]).decode())
    return out


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_failed_lines", "n_lost_words",
    )
