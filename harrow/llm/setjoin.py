"""Jaccard join of n-gram sets with prefix trees, and the classes of linked documents.

1. Sets are hashed n-grams in one global order (by hash). Of each set's beginning, the n-grams are dealt by hash and
   those found in one document only are counted out. A document with fewer others than any possible partner would show
   cannot have a partner and is done.
2. The rest are merged by equal sets. Sets of like size are cut by hash into more slices than two partners can differ
   in, so partners have a number of equal slices. Slices of few n-grams, and those that very many sets share, are left
   out wherever fewer of a set's slices are such than must be equal. Sets that share a slice, can agree in size and
   whose parity bitmaps don't differ in too many bits fall into one block.
3. A block's sets, most frequent n-grams first, are stored in a radix trie. Each set walks the trie, which shares the
   overlap counted so far among sets with equal beginnings, and leaves a subtree when what remains can't reach the
   threshold. Subtrees whose sets are all linked with it already are skipped, so a large group of near copies costs
   about one comparison a member. Blocks over a size are cut into tiles: each is compared with the first, and what is
   then not in the block's largest class with all of them, which for a large group of near copies is linear.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import MIX, deal, free_name, joined, mix, parts_for, settle, shingle_sequence, slices, words_of
from harrow.llm.components import UnionFind, components

#: Scanned bytes of a part and n-grams of a tile.
PART_BYTES, TILE_NGRAMS = 4 << 20, 250_000
#: N-grams from which a slice is telling; sets from which a shared slice is common.
TELLING, COMMON = 3, 32


def ngram_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; one of all words if there are fewer; none without words."""
    words, offsets = words_of(texts)
    return [np.unique(shingle_sequence(words[offsets[i] : offsets[i + 1]], k)) for i in range(len(offsets) - 1)]


def looked_at(n: int, num: int, den: int) -> int:
    """How many n-grams of a set of n step 1 looks at: twice what a partner may lack, and one."""
    lack = n + -num * n // den
    return min(n, 2 * lack + 1)


@functools.lru_cache(1 << 16)
def needed(n: int, num: int, den: int) -> int:
    """How many of the n-grams looked at a set of n shares, at least, with those looked at of any partner.

    Of two partners with o n-grams in common, the t-th common one has at most t + n - o n-grams before it in the one set
    and t + m - o in the other; those for which both numbers are looked at count. As a partner lacks no more than
    looked_at allows for, that is one or more for each size."""
    m = np.arange(-(-num * n // den), den * n // num + 1)
    both = -(-num * (n + m) // (num + den))
    shown = np.minimum(m, 2 * (m + -num * m // den) + 1)
    return int(np.minimum(np.minimum(looked_at(n, num, den) - n, shown - m) + both, both).min())


def signature(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else 0


class PrefixTree:
    """A radix trie of ordered sets. ``sizes`` are whole sizes; the sets hold only what any two of them may share."""

    __slots__ = ("num", "den", "sets", "sizes", "own", "root", "mask")

    class Node:
        __slots__ = ("seg", "kids", "ends", "lo", "hi", "most", "comp")

        def __init__(self, seg: np.ndarray, lo: int, hi: int, most: int, comp: int) -> None:
            self.seg, self.kids, self.ends, self.lo, self.hi, self.most, self.comp = seg, {}, [], lo, hi, most, comp

    def __init__(self, sets: list[np.ndarray], sizes: list[int], num: int, den: int, width: int) -> None:
        self.sets, self.sizes, self.num, self.den = sets, sizes, num, den
        self.own, self.mask = UnionFind(len(sets)), np.zeros(width, bool)
        self.root = self.Node(np.zeros(0, np.int64), 1 << 60, 0, 0, -1)

    def link(self, x: int) -> None:
        """Join x with the sets stored so far that are similar to it; for each class, at least one link is found."""
        num, den, own, mask, mine, n = self.num, self.den, self.own, self.mask, self.sets[x], self.sizes[x]
        least = -(-num * n // den)  # a partner's size, as stored sets are no larger
        mask[mine] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.hi < least or node.comp >= 0 and own.find(node.comp) == own.find(x):
                continue
            seg = node.seg
            if len(seg):
                overlap += int(np.count_nonzero(mask[seg]))
                depth += len(seg)
                left = min(len(mine) - int(np.searchsorted(mine, seg[-1], "right")), node.most - depth)
            else:
                left = min(len(mine), node.most)
            if (overlap + left) * (num + den) < num * (n + max(node.lo, least)):
                continue
            for y in node.ends:
                if overlap * (num + den) >= num * (n + self.sizes[y]):
                    own.union(x, y)
            kids = node.kids
            stack.extend((kid, overlap, depth) for key, kid in kids.items() if not mask[key])
            stack.extend((kid, overlap, depth) for key, kid in kids.items() if mask[key])
        mask[mine] = False

    def add(self, x: int) -> None:
        node, rest, n, own = self.root, self.sets[x], self.sizes[x], self.own
        total = len(rest)
        while True:
            node.lo, node.hi, node.most = min(node.lo, n), max(node.hi, n), max(node.most, total)
            if node.comp == -1 and node is self.root and not node.kids and not node.ends:
                node.comp = x
            elif node.comp >= 0 and own.find(node.comp) != own.find(x):
                node.comp = -2
            if not len(rest):
                node.ends.append(x)
                return
            kid = node.kids.get(int(rest[0]))
            if kid is None:
                kid = self.Node(rest, n, n, total, x)
                kid.ends.append(x)
                node.kids[int(rest[0])] = kid
                return
            m = min(len(kid.seg), len(rest))
            apart = np.flatnonzero(kid.seg[:m] != rest[:m])
            same = int(apart[0]) if len(apart) else m
            if same < len(kid.seg):
                mid = self.Node(kid.seg[:same], kid.lo, kid.hi, kid.most, kid.comp)
                mid.kids[int(kid.seg[same])] = kid
                kid.seg = kid.seg[same:]
                node.kids[int(rest[0])] = mid
                kid = mid
            node, rest = kid, rest[same:]


def join_sets(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The class (smallest index) of each set under links of Jaccard similarity num / den or more. Empty sets link with nothing."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    shared = int((counts > 1).sum())
    ends = np.cumsum([len(s) for s in sets])
    ranked = []
    for i, end in enumerate(ends.tolist()):
        own = rank[inverse[end - len(sets[i]) : end]]
        ranked.append(np.sort(own[own < shared]))
    tree = PrefixTree(ranked, [len(s) for s in sets], num, den, shared + 1)
    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        if len(sets[x]):
            tree.link(x)
            tree.add(x)
    return np.array([tree.own.find(i) for i in range(len(sets))], np.int64)


def _scan(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, near) of every row: its text's xxhash64, its set's size and signature, and whether enough
    of the n-grams looked at are in other rows too."""
    of_rows = {"ids": pa.int64(), "texts": pa.int64(), "n": pa.int32(), "sig": pa.int64(), "found": pa.int32()}
    names = ["part", "batch", *of_rows, "owner", "once", "many"]
    types = [pa.int64(), pa.int64(), *(pa.list_(t) for t in of_rows.values()), pa.binary(), pa.binary(), pa.binary()]
    kept_schema = "batch long, ids array<long>, texts array<long>, n array<int>, sig array<long>, found array<int>, owner binary"
    dealt_schema = f"part long, {kept_schema}, once binary, many binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for batch in slices(batches):
            sets = ngram_sets(batch.column(1), k)
            looked = [s[: looked_at(len(s), num, den)] for s in sets]
            tokens = np.concatenate(looked)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in looked]).astype("<u2")
            uniq, first, inverse, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
            again = counts > 1  # met twice here already: sent once, whatever the number
            found = np.bincount(owner[again[inverse]], minlength=len(sets)).astype(int) if len(tokens) else np.zeros(len(sets), int)
            rows = [(at % parts, at, batch.column(0).to_pylist(), batch.column(2).to_pylist(), [len(s) for s in sets], [signature(s) for s in sets], found.tolist(), None, None, None)]
            once = ~again
            for part, (own, sent) in deal(uniq[once], parts, owner[first[once]], uniq[once]):
                rows.append((part, at, *[None] * 5, own, sent, None))
            for part, (sent,) in deal(uniq[again], parts, uniq[again]):
                rows.append((part, at, *[None] * 7, sent))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            at += 1

    def count(t: pa.Table) -> pa.Table:
        once, row = joined(t.column("once"), "<u8")
        owner, _ = joined(t.column("owner"), "<u2")
        many, _ = joined(t.column("many"), "<u8")
        uniq, inverse, counts = np.unique(np.concatenate([once, np.unique(many), np.unique(many)]), return_inverse=True, return_counts=True)
        hit = (counts > 1)[inverse[: len(once)]]
        row, owner = row[hit], owner[hit]
        kept = t.filter(pa.compute.is_valid(t.column("ids"))).select(["batch", *of_rows])
        kept = kept.append_column("owner", pa.nulls(len(kept), pa.binary()))
        batch = t.column("batch").to_numpy()
        ends = np.flatnonzero(np.diff(row, append=-1)) + 1
        own, starts = [], [0, *ends[:-1].tolist()]
        for start, end in zip(starts, ends.tolist()):
            own.append((int(batch[row[start]]), owner[start:end].tobytes()))
        sent = pa.table([pa.array([o[0] for o in own], pa.int64()), *(pa.nulls(len(own), kept.schema.field(c).type) for c in of_rows), pa.array([o[1] for o in own], pa.binary())], schema=kept.schema)
        return pa.concat_tables([kept, sent])

    def gather(t: pa.Table) -> pa.Table:
        head = t.filter(pa.compute.is_valid(t.column("ids"))).to_pylist()[0]
        owner, _ = joined(t.column("owner"), "<u2")
        found = np.array(head["found"], np.int64) + np.bincount(owner, minlength=len(head["n"]))
        near = [n > 0 and hits >= needed(n, num, den) for n, hits in zip(head["n"], found.tolist())]
        return pa.table([*(pa.array(head[c], of_rows[c]) for c in ("ids", "texts", "n", "sig")), pa.array(near, pa.bool_())], names=["doc_id", "text_hash", "n", "sig", "near"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, dealt_schema)
    counted = dealt.groupBy("part").applyInArrow(count, kept_schema)
    return counted.groupBy("batch").applyInArrow(gather, "doc_id long, text_hash long, n int, sig long, near boolean")


def size_bounds(num: int, den: int, top: int) -> list[int]:
    """Lower bounds of size classes, up to past top: partners are of one class or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= top or len(bounds) < 3:
        bounds.append(max(bounds[-1] + 1, -(-den * bounds[-1] // num)))
    return bounds


def slice_keys(tokens: np.ndarray, level: int, bounds: list[int], num: int, den: int) -> tuple[np.ndarray, int]:
    """Keys of a set's slices among the sets of size class ``level`` and the next, and how many of them may be common.

    Partners there differ in ``most`` n-grams at most, so they have spare = slices - most equal slices or more. Small
    slices are left out as long as over a third of spare equal ones must be left; else all are shown. Of two partners,
    the one that leaves out more shows over spare // 3 equal slices, which the other shows too. If one of them has no
    more than spare // 3 common slices, an equal one isn't common; so that is the number (second result: one more) from
    which on a set is unsafe, the same for all sets of a level: partners without a telling slice are both unsafe."""
    most = (bounds[level + 1] + bounds[level + 2] - 2) * (den - num) // (den + num)
    spare = max(1, most // 2)
    slices_ = most + spare
    mixed = mix(tokens)
    at = (mixed % np.uint64(slices_)).astype(np.int64)
    sizes = np.bincount(at, minlength=slices_)
    sums = np.zeros(slices_, np.uint64)
    np.add.at(sums, at, mix(mixed + MIX[3]))
    for least in range(TELLING, 0, -1):
        shown = sizes >= least
        if spare - slices_ + int(shown.sum()) > spare // 3:
            break
    else:
        shown = np.ones(slices_, bool)
    q = np.flatnonzero(shown).astype(np.uint64)
    return mix(sums[shown] * MIX[0] + q * MIX[1] + mix(np.array([level], np.uint64))), spare // 3 + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the n-grams by hash, two bits or more an n-gram. The sets' bitmaps differ in at most as many bits as the
    sets in n-grams; the xor of a bitmap's halves is the next shorter bitmap."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _chains(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, sig: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, lo), and where a chain of size ranges begins that can agree one with the next."""
    order = np.lexsort((sig, lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    same = np.zeros(len(key), bool)
    if len(key):
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        reach = np.maximum.accumulate(hi + run * (1 << 40)) - run * (1 << 40)  # the largest size so far in the run
        same[1:] = (key[1:] == key[:-1]) & (num * lo[1:] <= den * reach[:-1])
    return order, ~same


def _forest(order: np.ndarray, begins: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(~begins)
    uniq, inverse = np.unique(sig, return_inverse=True)
    own = UnionFind(len(uniq))
    for x, y in zip(inverse[order[at - 1]].tolist(), inverse[order[at]].tolist()):
        if own.union(x, y):
            yield int(uniq[x]), int(uniq[y])


def _levels(sets: list[np.ndarray], num: int, den: int) -> tuple[list[int], list[int]]:
    bounds = size_bounds(num, den, max(len(s) for s in sets))
    bounds = size_bounds(num, den, den * bounds[-1] // num + 1)
    return bounds, (np.searchsorted(bounds, [len(s) for s in sets], "right") - 1).tolist()


def _rare(sets: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Of sets (sig, n, tokens): pairs (u, v) that share a slice which is not common, and rows (sig, level, margin,
    common) of what each set shows at each level."""
    fields, types = ("key", "who", "size", "level"), ("<u8", "<i8", "<i4", "<i2")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            sigs, own = batch.column(0).to_numpy(), [np.frombuffer(b, "<u8") for b in batch.column(2).to_pylist()]
            bounds, levels = _levels(own, num, den)
            shown = [(i, at, *slice_keys(own[i], at, bounds, num, den)) for i, level in enumerate(levels) for at in (level, level - 1) if at >= 0]
            key = np.concatenate([k for *_, k, _ in shown])
            row = np.repeat(np.arange(len(shown)), [len(k) for *_, k, _ in shown])
            owner, level = np.array([i for i, *_ in shown])[row], np.array([at for _, at, *_ in shown])[row]
            uniq, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            many = counts > COMMON  # common already: told once, whatever the number
            common = np.bincount(row[many[inverse]], minlength=len(shown))
            rows = [(int(sigs[i]) % parts, int(sigs[i]), at, margin, int(common[j]), *[None] * 5) for j, (i, at, _, margin) in enumerate(shown)]
            few = ~many[inverse]
            for part, values in deal(key[few], parts, key[few], sigs[owner[few]], np.array([len(s) for s in own], np.int32)[owner[few]], level[few].astype("<i2")):
                rows.append((part, None, None, None, None, *values, None))
            for part, (told,) in deal(uniq[many], parts, uniq[many]):
                rows.append((part, *[None] * 8, told))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "sig", "level", "margin", "common", *[f"{f}s" for f in fields], "many"])

    def meet(t: pa.Table) -> pa.Table:
        key, who, size, level = (joined(t.column(f"{f}s"), k)[0] for f, k in zip(fields, types))
        order = np.lexsort((who, size, key))
        key, who, size, level = key[order], who[order], size[order].astype(np.int64), level[order]
        uniq, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        many = (counts > COMMON) | np.isin(uniq, joined(t.column("many"), "<u8")[0])
        hot = many[inverse] if len(key) else np.zeros(0, bool)
        held, n_held = np.unique(np.stack([who[hot], level[hot].astype(np.int64)], 1), axis=0, return_counts=True) if hot.any() else (np.zeros((0, 2), np.int64), [])
        key, who, size = key[~hot], who[~hot], size[~hot]
        pairs = []
        for step in range(1, COMMON):
            near = np.flatnonzero((key[step:] == key[:-step]) & (num * size[step:] <= den * size[:-step]) & (who[step:] != who[:-step])) if len(key) > step else np.zeros(0, np.int64)
            if len(near):
                pairs.append(np.stack([who[near], who[near + step]], 1))
        found = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
        rest = t.filter(pa.compute.is_valid(t.column("sig"))).select(["sig", "level", "margin", "common"])
        none = lambda n, kind: pa.nulls(n, kind)
        n, h, r = len(found), len(held), len(rest)
        return pa.table({
            "u": pa.chunked_array([pa.array(found[:, 0]), none(h + r, pa.int64())]), "v": pa.chunked_array([pa.array(found[:, 1]), none(h + r, pa.int64())]),
            "sig": pa.chunked_array([none(n, pa.int64()), pa.array(held[:, 0]), *rest.column("sig").chunks]),
            "level": pa.chunked_array([none(n, pa.int32()), pa.array(held[:, 1].astype(np.int32)), *rest.column("level").chunks]),
            "margin": pa.chunked_array([none(n + h, pa.int32()), *rest.column("margin").chunks]),
            "common": pa.chunked_array([none(n, pa.int32()), pa.array(np.asarray(n_held, np.int32)), *rest.column("common").chunks]),
        })

    schema = "part long, sig long, level int, margin int, common int, keys binary, whos binary, sizes binary, levels binary, many binary"
    return sets.select("sig", "n", "tokens").mapInArrow(show, schema).groupBy("part").applyInArrow(meet, "u long, v long, sig long, level int, margin int, common int")


def _common(sets: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Edges among sets (sig, n, tokens, levels) by all their slices at the given levels, thinned to forests."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            sigs, sets = batch.column(0).to_numpy(), [np.frombuffer(b, "<u8") for b in batch.column(2).to_pylist()]
            bounds, _ = _levels(sets, num, den)
            keys = [np.concatenate([slice_keys(s, at, bounds, num, den)[0] for at in levels]) for s, levels in zip(sets, batch.column(3).to_pylist())]
            key, owner = np.concatenate(keys), np.repeat(np.arange(len(sets)), [len(k) for k in keys])
            size, sig = np.array([len(s) for s in sets], np.int64)[owner], sigs[owner]
            order, begins = _chains(key, size, size, sig, num, den)
            rows = [(None, u, v, None, None, None, None) for u, v in _forest(order, begins, sig)]
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(order)) - 1
            for part, values in deal(key[order[first]], parts, key[order[first]], sig[order[first]], size[order[first]], size[order[last]]):
                rows.append((part, None, None, *values))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()] * 4)], names=["part", "u", "v", "key", "rep", "lo", "hi"])

    def meet(t: pa.Table) -> pa.Table:
        (key, _), (rep, _), (lo, _), (hi, _) = joined(t.column("key"), "<u8"), joined(t.column("rep"), "<i8"), joined(t.column("lo"), "<i8"), joined(t.column("hi"), "<i8")
        edges = list(_forest(*_chains(key, lo, hi, rep, num, den), rep))
        near = [(u, v) for u, v in zip(t.column("u").to_pylist(), t.column("v").to_pylist()) if u is not None]
        return pa.table([pa.array([x[i] for x in (*edges, *near)], pa.int64()) for i in range(2)], names=["u", "v"])

    shown = sets.select("sig", "n", "tokens", "levels").mapInArrow(show, "part long, u long, v long, key binary, rep binary, lo binary, hi binary")
    shown = shown.withColumn("part", F.coalesce("part", F.pmod(F.xxhash64("u", "v"), F.lit(parts))))
    return shown.groupBy("part").applyInArrow(meet, "u long, v long")


def _blocks(sets: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Edges among sets (sig, n, tokens, bits) so that partners are connected."""
    rare = settle(_rare(sets, num, den, parts))
    pairs = rare.where("u is not null").select("u", "v").distinct()
    maps = sets.select("sig", "n", "bits")
    both = pairs.join(maps.toDF("u", "nu", "bu"), "u").join(maps.toDF("v", "nv", "bv"), "v")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, u, nu, bu, nv, bv = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("v", "u", "nu", "bu", "nv", "bv"))
            ok = [bits_apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (den + num) <= (a + b) * (den - num) for x, y, a, b in zip(bu, bv, nu, nv)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    told = rare.where("sig is not null").groupBy("sig", "level").agg(F.max("margin").alias("margin"), F.sum("common").alias("common"))
    unsafe = told.where("common >= margin and common > 0").groupBy("sig").agg(F.collect_list("level").alias("levels"))
    hot = sets.join(unsafe, "sig").select("sig", "n", "tokens", "levels")
    return both.mapInArrow(close, "u long, v long").union(_common(hot, num, den, parts))


def jaccard_classes(docs: DataFrame, k: int = 4, similarity: tuple[int, int] = (85, 100), keep_class: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when the Jaccard similarity of their k-word shingle sets is at least num / den. Null and blank
    texts have no shingles and link with nothing; repeated rows and equal sets are one class; rows that share an id but
    not a text are classed each by its text; a null doc_id has a null component and takes no part; other columns are
    ignored. Nothing is sampled: the result is exact but for collisions of 64-bit hashes.

    With keep_class, also text_hash (xxhash64 of the text) and class_sig, a name of the class: where ids have several
    texts, classes may have the same component_id.
    """
    num, den = similarity
    parts = parts_for(docs, PART_BYTES)
    scanned = settle(_scan(docs, k, num, den, parts))
    left = scanned.where("near and doc_id is not null")
    classes = settle(left.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ngram_sets(batch.column(1), k)
            sig = batch.column(0).to_pylist()
            rows = [(i, s) for i, s in enumerate(sets) if signature(s) == sig[i]]  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array([sig[i] for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int32()), pa.array([s.tobytes() for _, s in rows], pa.binary()), pa.array([bitmap(s).tobytes() for _, s in rows], pa.binary())], names=["sig", "n", "tokens", "bits"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(classes.select("rep", "sig"), "rep")
    sets = settle(chosen.select("sig", "text").mapInArrow(read, "sig long, n int, tokens binary, bits binary"))
    blocks = components(_blocks(sets, num, den, parts)).toDF("sig", "block")
    sized = blocks.join(classes.select("sig", "n"), "sig")
    tiles = sized.groupBy("block").agg(F.ceil(F.sum("n") / TILE_NGRAMS).cast("int").alias("tiles"))
    placed = settle(sized.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int")))

    def walk(t: pa.Table) -> pa.Table:
        names = t.column("sig").to_numpy()
        order = np.argsort(names, kind="stable")
        kept = order[np.flatnonzero(np.concatenate([[True], np.diff(names[order]) != 0]))]
        root = join_sets([np.frombuffer(b, "<u8") for b in t.column("tokens").take(pa.array(kept)).to_pylist()], num, den)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(names[kept[moved]]), pa.array(names[kept[root[moved]]])], names=["u", "v"])

    def linked_in(cells: DataFrame) -> DataFrame:
        return sets.select("sig", "tokens").join(cells, "sig").groupBy("block", "i", "j").applyInArrow(walk, "u long, v long")

    zero = F.lit(0).alias("i")
    small = placed.where("tiles = 1").select("sig", "block", zero, F.lit(0).alias("j"))
    if placed.where("tiles > 1").limit(1).count():
        # a large block: every tile with the first one; then what isn't in its largest class so far with every tile
        big = placed.where("tiles > 1")
        cells = F.when(F.col("tile") == 0, F.sequence(F.lit(1), F.col("tiles") - 1)).otherwise(F.array("tile"))
        links = settle(linked_in(small.union(big.select("sig", "block", zero, F.explode(cells).alias("j")))))
        rooted = big.join(components(links).toDF("sig", "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        by_class = rooted.groupBy("block", "root").agg(F.sum("n").alias("size"))
        main = by_class.groupBy("block").agg(F.max_by("root", "size").alias("main"), (F.sum("size") - F.max("size")).alias("rest"))
        main = main.withColumn("rests", F.ceil(F.col("rest") / TILE_NGRAMS).cast("int")).where("rest > 0")
        marked = rooted.join(main, "block")
        every = marked.select("sig", "block", F.explode(F.sequence(F.lit(1), F.col("rests"))).alias("i"), F.col("tile").alias("j"))
        outer = marked.where("root <> main").withColumn("i", (F.pmod(F.xxhash64("sig"), F.col("rests")) + 1).cast("int"))
        outer = outer.select("sig", "block", "i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
        linked = components(links.union(linked_in(every.union(outer).distinct()))).toDF("sig", "root")
    else:
        linked = settle(linked_in(small)).toDF("sig", "root")
    rooted = classes.join(linked, "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("sig", "component", "root")
    out = scanned.join(named, "sig", "left")
    final = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    columns = [F.col("doc_id"), F.col("n").cast("long").alias("n_shingles"), final.alias("component_id")]
    return out.select(*columns, "text_hash", F.coalesce("root", "sig").alias("class_sig")) if keep_class else out.select(*columns)


def one_of_each(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs with one row left of each class of near copies, that of the smallest doc_id, then of the least hash of its text.

    Texts without shingles are in no class, and rows without doc_id take no part: all of them stay. Rows are dropped by id
    and text, so that a row whose id also stands for another text stays or goes by its own. Columns of any name are kept.
    """
    classes = jaccard_classes(docs, k, similarity, keep_class=True).where("n_shingles > 0 and doc_id is not null").select("doc_id", "component_id", "text_hash", "class_sig")
    classes = settle(classes)
    own, text = (free_name(n, docs.columns) for n in ("own_id", "own_hash"))
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64("text"))
    named = lambda df: df.select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct()
    kept = keyed.join(named(classes.where("doc_id <> component_id")), [own, text], "left_anti")
    first = classes.where("doc_id = component_id")
    several = first.groupBy("doc_id", "class_sig").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("n")).where("n > 1")
    if several.limit(1).count():
        of_one = named(first.join(several.select("doc_id", "class_sig"), ["doc_id", "class_sig"], "left_semi"))
        one = kept.join(named(several), [own, text], "left_semi").dropDuplicates([own, text])
        kept = kept.join(of_one, [own, text], "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
