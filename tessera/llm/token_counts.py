"""Count-only Viterbi over a unigram vocabulary: an Aho-Corasick automaton lists the vocabulary matches that end
at each character, and dynamic programming carries the best score and its number of pieces.

The rules are those of the public unigram tokenizers: the text is ``▁`` + text with every space turned into ``▁``;
scores are added as 64-bit floats; a candidate replaces the best path to a position only if it is strictly better, and
candidates come by ascending start, so the longest piece wins a tie; a character that is no piece by itself costs ten
less than the lowest score and falls back to one piece for each of its UTF-8 bytes.

The vocabulary is read from a sentencepiece model file, whose path is a parameter. Piece scores in the file are used as
they are. Paths over ``▁`` or a line break never share a piece if no piece has a ``▁`` after another character, or a
line break: texts are then cut there, and each distinct segment is solved once for each worker (a bounded memory). For a
vocabulary without that property the whole text is one segment.

Defined cases: null and empty texts have 0 pieces; repeated rows are counted each for itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 800_000
_NONE = float("-inf")


def load_pieces(model_file: str) -> tuple[list[tuple[str, float]], float]:
    """The normal pieces with their scores, and the lowest score of the whole vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in normal], min(float(sp.get_score(i)) for i in normal)


class Counter(dict):
    """segment -> number of pieces of its best path."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float) -> None:
        import ahocorasick

        super().__init__()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in pieces:
            best.setdefault(piece, score)
        for piece, score in best.items():
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.singles = {p for p in best if len(p) == 1}
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in best)
        self.runs = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def viterbi(self, segment: str) -> int:
        n = len(segment)
        if not self.singles.issuperset(segment):
            return self._with_unknown(segment)
        scores, counts = [0.0] + [_NONE] * n, [0] * (n + 1)
        for e, (size, score) in self.matches.iter(segment):  # by end, longest first
            score += scores[e + 1 - size]
            if score > scores[e + 1]:
                scores[e + 1], counts[e + 1] = score, counts[e + 1 - size] + 1
        return counts[n]

    def _with_unknown(self, segment: str) -> int:
        n = len(segment)
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        ends = iter(self.matches.iter(segment))
        match = next(ends, None)
        for e in range(n):
            top, pieces, single = None, 0, False
            while match is not None and match[0] == e:  # longest first
                size, score = match[1]
                start = e + 1 - size
                score += scores[start]
                if top is None or score > top:
                    top, pieces = score, counts[start] + 1
                single = size == 1
                match = next(ends, None)
            if not single:
                score = scores[e] + self.unknown
                if top is None or score > top:
                    top, pieces = score, counts[e] + len(segment[e].encode())
            scores[e + 1], counts[e + 1] = top, pieces
        return counts[n]

    def __missing__(self, segment: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self.viterbi(segment) if segment else 0
        if len(segment) <= 64:
            self[segment] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.viterbi(MARK + text.replace(" ", MARK))
        if "  " in text or text[0] == " " or MARK in text:
            segments = self.runs.findall(MARK + text.replace(" ", MARK))
        else:
            segments = (MARK + text.replace(" ", f" {MARK}").replace("\n", " \n ")).split(" ")
        return sum(map(self.__getitem__, segments))


@lru_cache(maxsize=1)
def counter_for(model_file: str) -> Counter:
    """One counter for each worker process: its memory of segments serves all tasks of the worker."""
    return Counter(*load_pieces(model_file))


def count_tokens(docs: DataFrame, model_file: str, id_cols: list[str], text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``id_cols`` and the number of pieces of every row's whole text. A map over the scan, without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    name = C.free_name(id_cols, out_col)

    def run(batches):
        counter = counter_for(model_file)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in id_cols] + [pa.array(counts, pa.int64())], names=[*id_cols, name])

    schema = ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{name}` bigint"])
    return C.map_rows(docs, list(dict.fromkeys([*id_cols, text_col])), schema, run)
