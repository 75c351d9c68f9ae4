"""Exact top-k search: tiled matrix products, partial selection in each tile, tree merging of the lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidate rows of a shard, query rows of a tile, query rows multiplied at a time, lists merged at a time.
SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS, FAN_IN = 8192, 4096, 512, 64


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(lists.offsets.to_numpy())
    if (counts == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < counts[:, None]] = flat
    return out


def tile_top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, candidate id, score) of each query's best k rows, ties to the smaller id, rows of its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1]) < 2**53
    if not exact:  # beyond what a double holds: Python's integers
        rows, queries = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (rows, queries))
    found = []
    for start in range(0, len(query_ids), BLOCK_ROWS):
        own, part = query_ids[start : start + BLOCK_ROWS], queries[start : start + BLOCK_ROWS]
        scores = part @ rows.T
        floor = np.full((len(own), 1), -np.inf if exact else -(1 << 2000), scores.dtype)
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(high > low):
            scores[i, low[i] : high[i]] = floor[i, 0]
        if scores.shape[1] > k:
            least = np.partition(scores, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
            r, c = np.nonzero((scores >= least) & (scores > floor))
        else:
            r, c = np.nonzero(scores > floor)
        s = scores[r, c]
        if exact:
            by = np.lexsort((c, -s, r))
        else:
            by = np.array(sorted(range(len(r)), key=lambda i: (r[i], -s[i], c[i])), np.int64)
        r, c, s = r[by], c[by], s[by]
        first = np.searchsorted(r, np.arange(len(own)))
        keep = np.arange(len(r)) - first[r] < k if len(r) else np.zeros(0, bool)
        found.append((own[r[keep]], ids[c[keep]], s[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """The k rows of vectors with the largest integer inner product with each query, exactly.

    Both frames have (vec_id, embedding). Components become floor(scale * x). A vector that is null or holds a null or
    non-finite component takes no part, nor does a null vec_id. A query isn't matched with rows of its own vec_id; equal
    scores go to the smaller vec_id. A repeated query id is answered once, for its least vector; repeated candidates are
    rows of their own. Vectors of unequal length are compared as if the shorter ended in zeros. Scores that pass 64 bits
    raise an error. Empty tables give no rows.

    Rows are dealt evenly to shards and queries to tiles, both of bounded size; each (shard, tile) cell is one matrix
    product in blocks and sends on k rows a query. Lists are merged in a tree of fan-in 64.
    """
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    n = vectors.count()
    shards, tiles = max(1, -(-n // SHARD_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    # F.floor would give 64-bit integers, and the nearest one for components beyond them
    floor = lambda y: F.when(F.rint(y) > y, F.rint(y) - 1).otherwise(F.rint(y))
    whole = lambda: F.transform("embedding", lambda x: floor(x.cast("double") * scale))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole().alias("v"), (F.monotonically_increasing_id() % shards).alias("shard"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))) if tiles > 1 else rows.withColumn("tile", F.lit(0))
    asked = queries.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole().alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max([0, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (left, right) for c in t.column("v").chunks)])
        a, b = (_matrix(t.column("v"), width) if len(t) else np.zeros((0, width)) for t in (left, right))
        q, c, s = tile_top(left.column("vec_id").to_numpy(), a, right.column("vec_id").to_numpy(), b, k)
        shard = (left if len(left) else right).column("shard")[0].as_py() if len(left) + len(right) else 0
        return pa.table({"query_id": pa.array(q, pa.int64()), "shard": pa.array(np.full(len(q), shard), pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array([int(x) for x in s], pa.int64())})

    lists = rows.groupBy("shard", "tile").cogroup(asked.groupBy("shard", "tile")).applyInArrow(cell, "query_id long, shard long, vec_id long, score long")
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    best = lambda column: F.slice(F.array_sort(column), 1, k)
    merged, width = lists.groupBy("query_id", (F.col("shard") / FAN_IN).cast("long").alias("shard")).agg(best(F.collect_list(entry)).alias("top")), -(-shards // FAN_IN)
    while width > 1:
        merged = merged.groupBy("query_id", (F.col("shard") / FAN_IN).cast("long").alias("shard")).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
        width = -(-width // FAN_IN)
    out = merged.select("query_id", F.posexplode("top").alias("pos", "e"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.v").alias("vec_id"), (-F.col("e.s")).alias("score"))
