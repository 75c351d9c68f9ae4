"""Helpers shared by the training-data operators: Arrow batches, hashing, shared storage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as arrays at a time.
WORK_BYTES = 8 << 20
#: Odd 64-bit multipliers of the shingle hash (fixed values).
MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, the one given to
    setCheckpointDir; else one of our own in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="harrow-checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Number of groups to deal df's derived rows into: at least the shuffle partitions, more when the
    optimizer's size estimate of the scan says that a group would pass part_bytes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size, 1 << 50) // part_bytes if size < 1 << 60 else least)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """The totals of op over each beginning of an int array; op is associative, and zero its neutral number.

    A fold that appends copies its array at each step, so the fold runs within pieces of the square root of the length
    and over the pieces: 100,000 numbers take about 30 million copied numbers, not 5 billion."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("at"), none.alias("out"))

    def totals(array: Column, number: Callable[[Column], Column], first: bool) -> Column:
        def step(state: Column, x: Column) -> Column:
            now = op(state["at"], number(x))
            return F.struct(now.alias("at"), F.concat(state["out"], F.array(now if first else state["at"])).alias("out"))

        return F.aggregate(array, start, step, lambda s: s["out"])

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: totals(F.slice(v, k * width + 1, width), lambda x: x, True))
        before = lambda p: totals(p, lambda piece: F.element_at(piece, -1), False)
        return let(pieces, lambda p: F.flatten(F.zip_with(p, before(p), lambda piece, at: F.transform(piece, lambda x: op(at, x)))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice has at most budget bytes of column, or one row, and at most 65,535 rows."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + budget, side="right"))), start + 65_535)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_bytes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some strings, in their UTF-8 form: of its length, then of 8 bytes at a time."""
    values = values.cast(pa.large_string())
    _, at, raw = values.buffers()
    at = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.append(np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8))
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    begin, length = at[:-1], np.diff(at)
    out = mix(length.astype(np.uint64) * MIX[7] + MIX[6])
    for k in range(0, 64, 8):
        todo = np.flatnonzero(length > k)
        if not len(todo):
            return out
        spare = np.maximum(8 - (length[todo] - k), 0).astype(np.uint64) * np.uint64(8)
        word = eight[begin[todo] + k] & (~np.uint64(0) >> spare)
        out[todo] = mix((out[todo] ^ word) * MIX[0])
    for i in np.flatnonzero(length > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i + 1]])
    return out


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; distinct strings are hashed once."""
    coded = values.dictionary_encode()
    own = _hash_bytes(coded.dictionary)
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, concatenated, and the offsets of the texts.

    A word is a run of characters other than ASCII white space, with A-Z lowered. A null text has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    hashes = hash_strings(flat)
    if len(empty):  # texts without words split into one empty string
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        hashes = np.delete(hashes, empty)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def shingle_sequence(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence, marked by its length, if it is shorter."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        return mix(np.array([(words * MIX[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * MIX[j]
    return mix(total)


def deal(keys: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Split aligned columns by key modulo parts: (part, the column values of that part as bytes)."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
    columns, start = [c[order] for c in columns], 0
    for end in ends.tolist():
        yield int(part[order[start]]), [c[start:end].tobytes() for c in columns]
        start = end


def joined(values: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all non-null binary values, concatenated, and the row of each."""
    raw = [(i, np.frombuffer(v, dtype)) for i, v in enumerate(values.to_pylist()) if v is not None]
    if not raw:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate([v for _, v in raw]), np.repeat([i for i, _ in raw], [len(v) for _, v in raw])
