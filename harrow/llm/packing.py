"""Packing of token ids into windows: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from harrow.llm.bpe import byte_characters
from harrow.llm.common import slices

WINDOW = 1024
END = 0


class CapacityTree:
    """Open windows by remaining capacity. A segment tree over 0..size says whether a range of capacities has any."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with at least that capacity."""
        count, at = self.count, least + self.leaves
        if not count[at]:
            while at & 1 or not count[at + 1]:  # climb until a right neighbour has windows
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def pack(lengths: np.ndarray, size: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, window, offset). Items over the size are cut into full windows and a rest; the rests
    are placed in decreasing order, each into the tightest open window. What least full windows hold is then cut to
    fill the gaps of the fuller ones, as pieces may be cut freely."""
    pieces, windows = [], 0
    for item in np.flatnonzero(lengths >= size).tolist():
        for start in range(0, int(lengths[item]) - size + 1, size):
            pieces.append((item, start, size, windows, 0))
            windows += 1
    rest = lengths % size
    order = np.argsort(-rest, kind="stable")
    tree, held = CapacityTree(size), {}
    for item in order[: int((rest > 0).sum())].tolist():
        n = int(rest[item])
        found = tree.take(n)
        capacity, window = found or (size, windows)
        if found is None:
            windows += 1
            held[window] = []
        held[window].append((item, int(lengths[item]) - n, n))
        if capacity > n:
            tree.add(capacity - n, window)
    fill = {w: sum(p[2] for p in own) for w, own in held.items()}
    by = sorted(held, key=lambda w: (-fill[w], w))
    low, high = 0, len(by) - 1
    while low < high:  # dissolve the emptiest window into the fullest that has a gap
        if fill[by[low]] == size:
            low += 1
            continue
        into, source = by[low], held[by[high]]
        item, start, n = source.pop()
        part = min(n, size - fill[into])
        held[into].append((item, start, part))
        fill[into] += part
        fill[by[high]] -= part
        if part < n:
            source.append((item, start + part, n - part))
        if not source:
            del held[by[high]]
            high -= 1
    for window, own in held.items():
        offset = 0
        for item, start, n in own:
            pieces.append((item, start, n, window, offset))
            offset += n
    return pieces


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """An encoder of the tokenizer file's own vocabulary and added tokens; its ids are those of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    back = {ord(c): b for b, c in enumerate(byte_characters())}
    ranks, added = {}, {t["content"]: t["id"] for t in stated["added_tokens"]}
    for token, rank in stated["model"]["vocab"].items():
        if token not in added:
            ranks[bytes(back[ord(c)] for c in token)] = rank
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a partition begin at its number times this.
PARTITION_STEP = 1 << 33


def pack_texts(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, size: int = WINDOW) -> DataFrame:
    """Pieces of the token sequences of docs (doc_id, text), packed into windows of ``size`` tokens.

    Each row's ids are those of its text and then id 0; null text is empty, so that every row has at least one id.
    Repeated rows and null ids are rows of their own; other columns are ignored. Windows are filled within groups of
    about 8 MB of text of one partition: no shuffle, and a worker holds one group. Sequence ids are unique, not dense.
    A piece's ``ids`` (array of int) are left out if keep_ids is false.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = encoder(path, pattern), (TaskContext.get().partitionId() if TaskContext.get() else 0) * PARTITION_STEP
        for batch in slices(batches):
            ids = []
            for text in batch.column(1).to_pylist():
                got = own.encode_to_numpy(text or "", allowed_special="all")
                ids.append(np.append(got.astype("<u4"), np.uint32(END)))
            lengths = np.array([len(x) for x in ids], np.int64)
            doc_ids = batch.column(0).to_pylist()
            pieces = pack(lengths, size)
            parts = [ids[i][s : s + n] for i, s, n, _, _ in pieces]
            columns = [
                pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                pa.array([int(lengths[p[0]]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            if keep_ids:
                flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            first += max((p[3] for p in pieces), default=-1) + 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)
