"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text at places that depend on nearby content alone, so equal passages
of different documents fall into equal chunks. Documents that share content are brought together; there each chunk is
encoded once, its ids serve every occurrence, and the joins between neighbouring chunks are repaired.

Repair. In the tokenizer's pattern only the first character of a non-white-space run may be white space, so every
place between a non-white-space and a white-space character starts a new pre-token, in a chunk as in the whole text, and
ids never reach over it. Such a place is an anchor. For each join, the ids from the last anchor of the left chunk to
the first anchor of the right chunk are replaced by the encoding of the text between the two anchors. A chunk without
anchors lies wholly in the text that is encoded again, and the stretch grows on both sides until it ends at anchors (or
at the ends of the text): from there on both encodings agree exactly. The bytes of the ids are the text, so the repair
needs nothing but ids.

Special tokens are matched as the tokenizers library matches them; no chunk is cut inside one of their strings' reach,
because the strings hold no white space and thus no anchor.

Data flow: the texts are dealt out once, by the least chunk hash of each, and encoded where they land; ids never travel.
A chunk whose documents land in several partitions is encoded once in each. (One dictionary for the whole corpus means
that every chunk's text and ids are shuffled too, about three times the texts, to save the few encodings that are left.)

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each for
itself; a text of one chunk needs no repair.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: A power of two.
WINDOW = 16
AVERAGE_BYTES = 1024
#: Ids that a task remembers.
MEMORY_BYTES = 64 << 20
_WHITE = frozenset(
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


class Tokenizer:
    """Encodes with tiktoken over the vocabulary and merges of a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, file: str) -> None:
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        to_byte = {c: b for b, c in _byte_characters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [bytes(to_byte[c] for c in a + b) for a, b in merges]
        singles = [p for p in vocab if len(p) == 1]
        ranks = {p: r for r, p in enumerate([*sorted(singles, key=vocab.get), *order])}
        if len(ranks) != len(vocab):
            raise ValueError("the vocabulary holds pieces that no merge makes")
        size = len(ranks)
        self.ids_of_rank = np.array([vocab[p] for p in ranks] + [0] * len(special), np.uint32)
        for k, s in enumerate(special):
            self.ids_of_rank[size + k] = special[s]
        self.same = bool((self.ids_of_rank[:size] == np.arange(size)).all()) and all(special[s] == size + k for k, s in enumerate(special))
        self.special = set(special)
        self.encoder = tiktoken.Encoding(
            "own", mergeable_ranks=ranks, special_tokens={s: size + k for k, s in enumerate(special)},
            pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        )
        self.bytes_of = [b""] * (int(self.ids_of_rank.max()) + 1)
        for p, i in vocab.items():
            self.bytes_of[i] = p
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.lengths = np.array([len(p) for p in self.bytes_of], np.int64)

    def encode(self, text: str) -> np.ndarray:
        out = self.encoder.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        return out if self.same else self.ids_of_rank[out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


@lru_cache(maxsize=2)
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def chunk_cuts(data: np.ndarray, average: int = AVERAGE_BYTES) -> np.ndarray:
    """Ends of the content-defined chunks of a text: where the hash of the last ``WINDOW`` bytes has the wanted low
    bits, moved on to the next character's start. The last end is the text's."""
    n = len(data)
    if n <= WINDOW:
        return np.array([n] if n else [], np.int64)
    h, factor, span = _GEAR[data], 0x9E3779B1, 1
    while span < WINDOW:  # from windows of ``span`` bytes to windows of twice as many
        h = h[:-span] * np.uint32(factor) + h[span:]
        factor, span = factor * factor & 0xFFFFFFFF, 2 * span
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (average.bit_length() - 1)) == 0) + WINDOW
    at = at[at < n]
    for _ in range(3):  # at most three continuation bytes
        inner = (data[np.minimum(at, n - 1)] & 0xC0) == 0x80
        at = np.where(inner & (at < n), at + 1, at)
    at = np.unique(at[at < n])
    return np.append(at, n)


def _is_white(ch: str) -> bool:
    return ord(ch) in _WHITE


def first_anchor(text: str) -> int | None:
    """Characters before the first place between non-white space and white space."""
    for k in range(1, len(text)):
        if _is_white(text[k]) and not _is_white(text[k - 1]):
            return k
    return None


def last_anchor(text: str) -> int | None:
    for k in range(len(text) - 1, 0, -1):
        if _is_white(text[k]) and not _is_white(text[k - 1]):
            return k
    return None


def _ids_before(tok: Tokenizer, ids: np.ndarray, n_bytes: int) -> int:
    """Number of leading ids that make exactly ``n_bytes`` bytes."""
    ends = np.cumsum(tok.lengths[ids])
    k = int(np.searchsorted(ends, n_bytes))
    if k >= len(ends) or ends[k] != n_bytes:
        raise AssertionError("an id reaches over an anchor")
    return k + 1


def join_chunks(tok: Tokenizer, chunks: list[np.ndarray]) -> np.ndarray:
    """The ids of the whole text from the ids of its chunks."""
    out: list[np.ndarray] = []
    pending = b""  # text since the last anchor before an unrepaired join
    for k, ids in enumerate(chunks):
        more = k + 1 < len(chunks)
        if k:
            raw = tok.decode(ids[:64])
            whole = len(ids) <= 64
            cut = _first_byte_anchor(raw, whole)
            if cut is None and not whole:
                raw, whole = tok.decode(ids), True
                cut = _first_byte_anchor(raw, True)
            if cut is None:
                pending += raw
                if not more:
                    out.append(tok.encode(pending.decode()))
                continue
            out.append(tok.encode((pending + raw[:cut]).decode()))
            ids = ids[_ids_before(tok, ids, cut) :]
        if not more:
            out.append(ids)
            break
        tail = tok.decode(ids[-64:])
        whole = len(ids) <= 64
        cut = _last_byte_anchor(tail, whole)
        if cut is None and not whole:
            tail, whole = tok.decode(ids), True
            cut = _last_byte_anchor(tail, True)
        if cut is None:  # (text between the join and here starts at an anchor or at the text's start)
            pending = tail if whole else tok.decode(ids)
        else:
            pending = tail[cut:]
            back = tok.lengths[ids[::-1]]
            drop = int(np.searchsorted(np.cumsum(back), len(pending))) + 1
            if int(back[:drop].sum()) != len(pending):
                raise AssertionError("an id reaches over an anchor")
            out.append(ids[: len(ids) - drop])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _first_byte_anchor(raw: bytes, whole: bool) -> int | None:
    """Bytes before the first anchor; the bytes may end inside a character unless they are the ``whole`` chunk."""
    text = raw.decode("utf-8", "strict" if whole else "ignore")
    k = first_anchor(text)
    return None if k is None else len(text[:k].encode())


def _last_byte_anchor(raw: bytes, whole: bool) -> int | None:
    skip = 0
    while not whole and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    text = raw[skip:].decode()
    k = last_anchor(text)
    return None if k is None else skip + len(text[:k].encode())


def _hash(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _pieces(data: np.ndarray, average: int) -> list[bytes]:
    raw, begin, out = data.tobytes(), 0, []
    for end in chunk_cuts(data, average).tolist():
        out.append(raw[begin:end])
        begin = end
    return out


class Encoder:
    """Encodes whole texts chunk by chunk and remembers the ids of chunks, up to ``MEMORY_BYTES``; a full memory is
    emptied, which costs a repeated encoding and nothing else."""

    def __init__(self, tok: Tokenizer, average: int) -> None:
        self.tok, self.average = tok, average
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0

    def _chunk(self, piece: bytes) -> np.ndarray:
        key = _hash(piece)
        ids = self.known.get(key)
        if ids is None:
            ids = self.tok.encode(piece.decode())
            self.held += ids.nbytes + 200
            if self.held > MEMORY_BYTES:
                self.known.clear()
                self.held = ids.nbytes + 200
            self.known[key] = ids
        return ids

    def encode(self, data: np.ndarray) -> np.ndarray:
        return join_chunks(self.tok, [self._chunk(p) for p in _pieces(data, self.average)])


def routed(docs: DataFrame, text_col: str, average: int) -> DataFrame:
    """``docs`` dealt out by the least chunk hash of each text, so that documents that share content meet: exact copies
    always, near copies with the chance of their chunk sets' Jaccard similarity. A rebalance, not a repartition: Spark
    splits a partition that one passage fills, and joins small ones."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    route = C.free_name(docs.columns, "route")

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            keys = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                least = min((_hash(p)[:8] for p in _pieces(data[a:b], average)), default=bytes(8))
                keys.append(int.from_bytes(least, "big", signed=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, route])

    schema = ", ".join([f"`{c}` {t}" for c, t in types.items()] + [f"`{route}` bigint"])
    return docs.mapInArrow(C.lean(run), schema).hint("rebalance", route).drop(route)


def encode(docs: DataFrame, tokenizer_file: str, id_cols: list[str], text_col: str = "text", average: int = AVERAGE_BYTES, with_ids: bool = True,
           route: bool = True) -> DataFrame:
    """``id_cols`` with ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit numbers), ``decoded_sha256``
    (text of the ids as UTF-8) and, with ``with_ids``, ``ids`` of every row's whole text; underscores go before a name
    that ``id_cols`` has already."""
    names = [C.free_name(id_cols, n) for n in ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    narrow = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*id_cols, text_col])])

    def run(batches):
        tok = tokenizer(tokenizer_file)
        encoder = Encoder(tok, average)
        for batch in batches:
            data, offsets = C.text_buffers(batch.column(text_col))
            for first in range(0, len(offsets) - 1, 512):
                some = offsets[first : first + 513]
                found = [encoder.encode(data[a:b]) for a, b in zip(some[:-1], some[1:])]
                cols = [batch.column(c).slice(first, len(found)) for c in id_cols]
                cols += [
                    pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(tok.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in found]),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(x) for x in found)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, *names])

    schema = ", ".join([f"`{c}` {types[c]}" for c in id_cols] + [f"`{n}` {t}" for n, t in zip(names, ["bigint", "string", "string", "array<int>"])])
    return (routed(narrow, text_col, average) if route else narrow).mapInArrow(C.lean(run), schema)


def decode(rows: DataFrame, tokenizer_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids_col`` (null: null); bytes that are no UTF-8 become replacement characters."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        tok = tokenizer(tokenizer_file)
        return pd.Series([None if x is None else tok.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in ids], dtype=object)

    return rows.withColumn(out_col, text_of(ids_col))


def digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    return encode(docs, tokenizer_file, ["doc_id"], with_ids=False)
