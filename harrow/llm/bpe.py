"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary, and back to bytes.

The model file is written field by field: one piece per vocabulary entry, its bytes mapped to printable characters, its
score the negative rank, an identity normaliser. Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from harrow.llm.common import slices

#: Distinct pre-tokens kept with their ids by a worker.
CACHE = 1 << 18


def byte_characters() -> str:
    """A printable character for each byte value: itself where it is visible, else one of the next free code points."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(free)) for b in range(256))


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary. Piece 0 is the unknown piece; piece i + 1 is the i-th by rank."""
    shown = byte_characters()
    pieces = [_field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        pieces.append(_field(1, token.decode("latin-1").translate(shown).encode()) + _field(2, float(-rank)) + _field(3, 1))
    trainer = b"".join([_field(3, 2), _field(4, len(pieces)), *(_field(n, v) for n, v in ((40, 0), (41, -1), (42, -1), (43, -1)))])
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def pretokens(pattern: str) -> regex.Pattern:
    r"""The splitting pattern. Its \s means Unicode white space, which Python's own \s exceeds by four control characters."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.shown, self.find = byte_characters(), pretokens(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.rank_of = np.array([0, *(rank for _, rank in by_rank)], "<u4")
        self.bytes_of = [b""] * (by_rank[-1][1] + 1)
        for token, rank in by_rank:
            self.bytes_of[rank] = token
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode those pre-tokens that aren't known yet."""
        asked = set(words)
        new = asked - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, asked
        mapped = [w.encode().decode("latin-1").translate(self.shown) for w in new]
        for word, ids in zip(new, self.model.encode(mapped, out_type=int, num_threads=1) if mapped else [], strict=True):
            self.known[word] = self.rank_of[ids].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.find(t) for t in texts]
        self.learn(w for own in words for w in own)
        return [b"".join(map(self.known.__getitem__, own)) for own in words]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker."""
    return Codec(path, pattern)


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): its ids, and digests of the ids and of the bytes decoded from them.

    Null text is empty and has no ids. Repeated rows give repeated rows; other columns are ignored. ``ids`` has the ids
    (array of int) unless keep_ids is false. ``path`` is the rank file, readable on every executor. No shuffle.
    """
    schema = ENCODED_SCHEMA + (", ids array<int>" if keep_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, budget=2 << 20):
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
            ]
            if keep_ids:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
