"""Near-duplicate passages by compact windows.

Each text is its sequence of 5-word shingles. A hash function orders the shingles; the Cartesian tree of a text over
these values, cut off below the least passage length, groups all subsequences that share a min-hash into compact
windows (l, c, r): every subsequence from [l, c] to [c, r] has its minimum at c. Windows of different texts with one
minimum meet; their intervals are joined across hash functions, and passages on which enough functions agree are
verified shingle by shingle. Of each repeated passage, the text with the smallest doc_id stays unmarked.

Windows of a minimum that few texts have are all paired. Those of a crowded one meet with the shingles around them
(similar_contexts): of equal surroundings the first stands for all; those that share a shingle that few of them have are
all compared; what shares only crowded shingles is compared by these alone, each set of them once. Exact repeats,
subsequences of the least length for which crowded minima leave too few functions to agree, meet by the hash of the whole
subsequence: all texts with it share a passage with the first. Copies of whole texts meet as one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import MIX, deal, free_name, joined, let, mix, parts_for, running, settle, shingle_sequence, slices, words_of

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
LEAST = MIN_WORDS - SHINGLE + 1  # shingles of the shortest passage
#: Hash functions, and how many must agree; scanned bytes of a part; shingles apart that still chain; drift of a passage.
HASHES, AGREE, PART_BYTES, GAP, DRIFT = 4, 2, 4 << 20, 12, 24
#: A passage may reach so far beyond the windows that found it; a longer rest would have windows of its own.
MARGIN = MIN_WORDS + 2 * GAP
#: Arms of windows from which on they are not told apart: they are taken to reach to the ends of the text.
FAR = 65_535
#: Shingles that a text may have, with a margin, as its hashes are one value of at most 2 GB.
LONGEST = (1 << 28) - 1024
#: Windows up to which those of a minimum are all paired as they are; those of a crowded one are told apart by their contexts.
CROWD = 8
#: Shingles on either side of a minimum that passages of the least length around it can have; and how many they must share.
REACH, SHARED = LEAST - 1, -(-LEAST * 4 // 5)
AROUND = 2 * REACH + 1
#: First rows of a crowded minimum that are compared with all others.
EARLY = 64
TEXT = np.dtype([("doc_id", "<i8"), ("sig", "<i8"), ("n", "<i8")])
WINDOW = np.dtype([("j", "<i4"), ("cb", "<i4"), ("lb", "<i4"), ("rb", "<i4"), ("ca", "<i4"), ("la", "<i4"), ("ra", "<i4")])


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each subsequence of width values, by doubling."""
    n, out = 1, values
    while 2 * n <= width:
        out, n = op(out[:-n], out[n:]), 2 * n
    return op(out[: len(values) - width + 1], out[width - n :]) if n < width else out


def _trees(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of every value of values[start:end], level by level down the Cartesian trees."""
    padded = np.append(values, np.uint64(0))
    keep = ends > starts
    s, e, found = starts[keep], ends[keep], []
    while len(s):
        low = np.minimum.reduceat(padded, np.stack([s, e], 1).ravel())[::2]
        lengths = e - s
        segment = np.repeat(np.arange(len(s)), lengths)
        flat = np.arange(lengths.sum()) + np.repeat(s - np.cumsum(lengths) + lengths, lengths)
        hit = np.flatnonzero(values[flat] == low[segment])  # all minima of a segment at once: each cuts what the one before left
        c, own = flat[hit], segment[hit]
        first = np.append(True, own[1:] != own[:-1])
        left = np.where(first, s[own], np.append(0, c[:-1]) + 1)
        found.append((c, left, e[own] - 1))
        last = np.append(first[1:], True)
        s, e = np.concatenate([left, c[last] + 1]), np.concatenate([c, e[own[last]]])
        keep = np.flatnonzero(e > s)
        keep = keep[np.argsort(s[keep], kind="stable")]
        s, e = s[keep], e[keep]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def compact_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all compact windows of at least width in values[start:end] of texts in order. Bounds are inclusive; of
    equal values the leftmost is the minimum.

    Only minima of subsequences of width have such windows. The values that bound a window are minima of still wider
    ones, so the trees are built over the minima alone, about one value in half a width."""
    long = ends - starts >= width
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    low = _sliding(values, width, np.minimum)
    inside = np.zeros(len(low) + 1, np.int8)
    inside[starts] += 1
    inside[ends - width + 1] -= 1
    low[np.cumsum(inside[:-1], dtype=np.int8) == 0] = 0
    none = np.zeros(width - 1, values.dtype)
    at = np.flatnonzero(values == _sliding(np.concatenate([none, low, none]), width, np.maximum))
    first, past = np.searchsorted(at, starts), np.searchsorted(at, ends)
    c, l, r = _trees(values[at], first, past)
    own = np.searchsorted(ends, at[c], "right")
    left = np.where(l == first[own], starts[own], at[l - 1] + 1)
    right = np.where(r + 1 == past[own], ends[own] - 1, at[np.minimum(r + 1, len(at) - 1)] - 1)
    wide = right - left + 1 >= width
    return at[c[wide]], left[wide], right[wide]


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts, one after the other, where each text's end, and the signature and number of each text's words."""
    return shingled(*words_of(texts))


def shingled(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What sequences gives of texts whose hashed words lie between offsets."""
    counts = np.diff(offsets)
    lengths = np.maximum(counts - SHINGLE + 1, 0)
    ends = np.cumsum(lengths)
    every = shingle_sequence(words, SHINGLE) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    flat = every[np.arange(lengths.sum()) + np.repeat(offsets[:-1] - ends + lengths, lengths)]
    sigs = np.fromiter((xxhash.xxh3_64_intdigest(words[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, len(counts))
    return flat, ends, sigs.astype(np.int64), counts


def clusters(windows: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
    """Interval join of the windows two texts share: (lb, rb, la, ra, diagonals) where at least AGREE functions meet on
    neighbouring diagonals, widened by MARGIN (which may pass a text's end)."""
    out = []
    rows = sorted((cb - ca, cb, lb, rb, la, ra, j) for j, cb, lb, rb, ca, la, ra in windows.tolist())
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i][0] - rows[i - 1][0] > DRIFT), len(rows)]
    for begin, end in zip(cuts, cuts[1:]):
        band = sorted(rows[begin:end], key=lambda r: r[1])
        runs = [[band[0]]]
        _, _, _, rb, la, ra, _ = band[0]
        for r in band[1:]:
            if r[2] <= rb + MARGIN and la - MARGIN <= r[5] and r[4] <= ra + MARGIN:
                runs[-1].append(r)
                rb, la, ra = max(rb, r[3]), min(la, r[4]), max(ra, r[5])
            else:
                runs.append([r])
                _, _, _, rb, la, ra, _ = r
        for run in runs:
            if len({r[6] for r in run}) >= AGREE:
                diagonals, _, lb, rb, la, ra, _ = zip(*run)
                out.append((max(0, min(lb) - MARGIN), max(rb) + MARGIN, max(0, min(la) - MARGIN), max(ra) + MARGIN, sorted(set(diagonals))))
    return out


def aligned(b: np.ndarray, a: np.ndarray, diagonals: list[int]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Positions of b and of a that match: each position of b on that diagonal on which it lies in the longest run; and
    exact runs (b0, b1, diagonal) of a passage's length. The diagonals are those given and those near them of n-grams
    that occur on one."""
    _, at_b, at_a = np.intersect1d(b, a, return_indices=True)
    own = at_b - at_a
    found, counts = np.unique(own[(own >= diagonals[0] - DRIFT) & (own <= diagonals[-1] + DRIFT)], return_counts=True)
    best, chosen, exact = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), []
    for d in sorted({*diagonals, *found[counts >= 2].tolist()}):
        low, high = max(0, d), min(len(b), len(a) + d)
        if high <= low:
            continue
        at = np.flatnonzero(b[low:high] == a[low - d : high - d]) + low
        if not len(at):
            continue
        begin = np.flatnonzero(np.append(True, np.diff(at) > 1))
        lengths = np.diff(np.append(begin, len(at)))
        exact += [(int(at[i]), int(at[i] + n - 1), d) for i, n in zip(begin, lengths) if n >= LEAST]
        lengths = np.repeat(lengths, lengths)
        better = best[at] < lengths
        best[at[better]], chosen[at[better]] = lengths[better], d
    at = np.flatnonzero(best)
    return at, at - chosen[at], exact


def verify(b: np.ndarray, a: np.ndarray, diagonals: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Maximal passages (b0, b1, a0, a1, similarity), inclusive shingle bounds, of at least MIN_WORDS and SIMILARITY; and,
    of exact runs outside them, as few as cover what such runs cover."""
    at_b, at_a, exact = aligned(b, a, diagonals)
    if not len(at_b):
        return []
    steps = np.maximum(np.diff(at_b), np.diff(at_a))
    steps[np.diff(at_a) <= 0] = 1 << 30
    out = []
    todo = [r for r in np.split(np.arange(len(at_b)), np.flatnonzero(steps > GAP) + 1)]
    while todo:
        run = todo.pop()
        b0, b1, a0, a1 = int(at_b[run[0]]), int(at_b[run[-1]]), int(at_a[run[0]]), int(at_a[run[-1]])
        if min(b1 - b0, a1 - a0) + 1 < LEAST:
            continue
        if len(run) == b1 - b0 + 1 == a1 - a0 + 1 and (at_b[run] - at_a[run] == b0 - a0).all():
            ratio = 1.0
        else:
            x, y = np.unique(b[b0 : b1 + 1]), np.unique(a[a0 : a1 + 1])
            both = len(np.intersect1d(x, y, assume_unique=True))
            ratio = both / (len(x) + len(y) - both)
        if ratio >= SIMILARITY:
            out.append((b0, b1, a0, a1, ratio))
        elif len(run) > 1:
            inner = steps[run[:-1]] - np.abs(np.arange(len(run) - 1) - len(run) / 2) / len(run)  # of equal gaps the middle one
            cut = int(np.argmax(inner)) + 1
            todo += [run[:cut], run[cut:]]
    covered = sorted((r[0], r[1]) for r in out)
    exact = sorted(e for e in exact if not any(c[0] <= e[0] and e[1] <= c[1] for c in covered))
    reach, i = -1, 0
    while i < len(exact):
        if exact[i][1] <= reach:
            i += 1
            continue
        best = i
        while i < len(exact) and (exact[i][0] <= reach + 1 or exact[i][0] == exact[best][0]):
            best, i = (i if exact[i][1] > exact[best][1] else best), i + 1
        i = max(i, best + 1)
        b0, reach, d = exact[best]
        out.append((b0, reach, b0 - d, reach - d, 1.0))
    return out


def grams(shingles: np.ndarray) -> np.ndarray:
    """Hash of each subsequence of LEAST shingles."""
    h, n = shingles, 1
    while n < LEAST:
        step = min(n, LEAST - n)
        h, n = mix(h[:-step] * MIX[1] + h[step:] * MIX[2] + np.uint64(step)), n + step
    return h


def window_keys(shingles: np.ndarray, j: int) -> np.ndarray:
    return mix(shingles ^ MIX[j + 2])


def hot_windows(flat: np.ndarray, ends: np.ndarray, crowded: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, c, l, r) of the windows of crowded minima in texts that end at ends, for each function."""
    starts, found = np.append(0, ends[:-1]), []
    for j in range(HASHES):
        c, l, r = compact_windows(flat * MIX[j] + MIX[j + 1], starts, ends, LEAST)
        key = window_keys(flat[c], j)
        hot = np.isin(key, crowded)
        found.append((key[hot], c[hot], l[hot], r[hot]))
    return found


def unsettled(n: int, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Starts of the subsequences of LEAST of n shingles with crowded minima, whose windows are given, under so many functions
    that fewer than AGREE are left."""
    held = np.zeros(n + 1, np.int64)
    for _, c, l, r in windows:
        held += np.bincount(np.maximum(l, c - LEAST + 1), minlength=n + 1)
        held -= np.bincount(np.minimum(c, r - LEAST + 1) + 1, minlength=n + 1)
    return np.flatnonzero(np.cumsum(held[:-1]) > HASHES - AGREE)


def contexts(words: np.ndarray, start: np.ndarray, end: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of the AROUND shingles around each c, as far as they lie from start to end, its window: the low 16 bits of
    each, 0 beyond the window; and the hash of all."""
    out, shown = np.zeros((len(c), AROUND + SHINGLE - 1), np.uint16), np.zeros(len(c), np.uint64)
    for i in range(0, len(c), 4096):
        part = slice(i, i + 4096)
        for k in range(out.shape[1]):
            at = c[part] + (k - REACH)
            inside = (at >= start[part]) & (at < end[part])
            word = np.where(inside, words[np.clip(at, 0, len(words) - 1)], 0)
            out[part, k] = np.where(inside, np.maximum(word.astype(np.uint16), 1), 0)
            shown[part] = (shown[part] ^ word) * MIX[k % 8]
            shown[part] ^= shown[part] >> np.uint64(29)
    return out, shown


def context_shingles(near: np.ndarray) -> np.ndarray:
    """The shingles of contexts as 32 bits, 0 where there is none."""
    total, none = np.zeros((len(near), AROUND), np.uint32), np.zeros((len(near), AROUND), bool)
    for k in range(SHINGLE):
        word = near[:, k : k + AROUND]
        total = (total ^ word) * np.uint32(0x9E3779B1)
        total ^= total >> np.uint32(15)
        none |= word == 0
    return np.where(none, np.uint32(0), np.maximum(total, np.uint32(1)))


def covered(has: np.ndarray) -> np.ndarray:
    """Subsequences of LEAST shingles, of AROUND along the last axis, in which at least SHARED are had."""
    total = np.zeros((*has.shape[:-1], AROUND + 1), np.int16)
    np.cumsum(has, axis=-1, out=total[..., 1:])
    return total[..., LEAST:] - total[..., :-LEAST] >= SHARED


def first_covering(code: np.ndarray, doc: np.ndarray, sig: np.ndarray, ask: np.ndarray, heads: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(q, x): for each subsequence of each row q of ask, the first row x of heads that covers it, if one does that is of an
    earlier and other text. Rows are of codes, none where there is none, in order of doc; ask and heads are in order too.

    The first EARLY heads are compared with all. A later one that covers a subsequence misses at most LEAST - SHARED places
    of it, so it has one of the codes at any LEAST - SHARED + 1 places: those of the rarest codes tell which heads to compare."""
    early, spare = heads[:EARLY], LEAST - SHARED
    limit = np.searchsorted(doc[heads], doc[ask])  # heads of earlier texts
    has = np.zeros((len(early), none + 1), bool)
    np.put_along_axis(has, code[early], True, axis=1)
    has[:, none] = False
    left = covered(code[ask] < none)
    qs, xs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(ask), 128):
        part = slice(i, i + 128)
        had = covered(has[:, code[ask[part]]]) & ((np.arange(len(early))[:, None] < limit[part]) & (sig[early][:, None] != sig[ask[part]]))[..., None]
        had &= left[part]
        q, s = np.nonzero(had.any(0))
        told = np.unique(q * len(early) + had[:, q, s].argmax(0))
        qs.append(ask[i + told // len(early)])
        xs.append(early[told % len(early)])
        left[part][q, s] = False
    todo = np.flatnonzero(left.any(1) & (limit > EARLY))
    if len(todo):
        owner = np.repeat(np.arange(len(heads)), AROUND)
        held = np.unique(code[heads].ravel() * len(heads) + owner)
        held = held[(held < none * len(heads)) & (held % len(heads) >= EARLY)]
        start = np.searchsorted(held, np.arange(none + 2) * len(heads))  # where a code's heads lie
        where = held % len(heads)
        size = np.diff(start)
        size[none] = -1
        rare = np.argsort(size, kind="stable")  # codes by rarity, none before all
        rank = np.argsort(rare, kind="stable")
        local = np.zeros(none + 1, np.int64)
    for k in todo.tolist():
        own, open_ = code[ask[k]], np.flatnonzero(left[k])
        ranks = rank[own][open_[:, None] + np.arange(LEAST)]
        least = np.unique(ranks[ranks <= np.partition(ranks, spare, axis=1)[:, spare, None]])
        near = np.unique(np.concatenate([where[start[c] : start[c + 1]] for c in rare[least].tolist()]))
        near = near[near < limit[k]]
        near = heads[near[sig[heads[near]] != sig[ask[k]]]]
        used = np.unique(own[own < none])
        local[used] = np.arange(1, len(used) + 1)
        begin, step = 0, 4 * EARLY
        while begin < len(near) and len(open_):
            part = near[begin : begin + step]
            has = np.zeros((len(part), len(used) + 1), bool)
            has[np.arange(len(part))[:, None], local[code[part]]] = True
            has[:, 0] = False
            had = covered(has[:, local[own]])[:, open_]
            met = had.any(0)
            told = part[np.unique(had[:, met].argmax(0))]
            qs.append(np.full(len(told), ask[k]))
            xs.append(told)
            open_, begin, step = open_[~met], begin + step, 2 * step
        local[used] = 0
    return np.concatenate(qs), np.concatenate(xs)


def similar_contexts(near: np.ndarray, doc: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (y, x) of different texts, x < y, whose contexts may share a passage of the least length; rows are in order of
    doc, of equal contexts there is one. For each such subsequence of y that an earlier context has, one x at least is told.

    Contexts that share a shingle of at most CROWD rows are all compared. Others share crowded shingles only: which of these
    a row has, and where, stands for the row. Of rows that agree in this the first is the partner of the others, and it is
    compared with the first of other such rows; of these, the first that covers each subsequence is told (first_covering)."""
    n, none = len(near), np.zeros(0, np.int64)
    codes = np.unique((near.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)[:, None])[near > 0])
    value, row = (codes >> np.uint64(32)).astype(np.uint32), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    sizes = np.diff(np.append(first, len(value)))
    few = np.repeat(sizes <= CROWD, sizes)
    crowded, value, row = value[first[sizes > CROWD]], value[few], row[few]
    pairs = [none]
    for step in range(1, CROWD):
        same = np.flatnonzero(value[step:] == value[:-step])
        pairs.append(row[same + step] * n + row[same])
    code = np.searchsorted(crowded, near)
    held = crowded[np.minimum(code, len(crowded) - 1)] == near if len(crowded) else np.zeros(near.shape, bool)
    pairs, common = np.unique(np.concatenate(pairs), return_counts=True)
    y, x = np.divmod(pairs, n)
    distinct = np.bincount((codes & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=n) == (near > 0).sum(1)
    enough = ~distinct[y] | (common + held.sum(1)[y] >= SHARED)  # few shared ones and all crowded ones
    apart = (doc[y] != doc[x]) & (sig[y] != sig[x]) & enough
    y, x = y[apart], x[apart]
    # multisets of shingles: the k-th of equal ones is told apart
    used, of = np.unique(np.concatenate([y, x]), return_inverse=True)
    ranked = np.sort(near[used], axis=1)
    at = np.arange(AROUND)
    begin = np.maximum.accumulate(np.where(np.diff(ranked, axis=1, prepend=np.uint32(0)) != 0, at, 0), axis=1)
    ranked = np.where(ranked > 0, ranked + (at - begin).astype(np.uint32) * np.uint32(0x9E3779B1), 0)
    shares, left, right = [np.zeros(0, bool)], of[: len(y)], of[len(y) :]
    for i in range(0, len(y), 8192):
        both = np.sort(np.concatenate([ranked[left[i : i + 8192]], ranked[right[i : i + 8192]]], 1), axis=1)
        shares.append(((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(1) >= SHARED)
    keep = np.concatenate(shares)
    ys, xs = [y[keep]], [x[keep]]

    hot = np.flatnonzero(covered(held).any(1))
    if len(hot):
        code = np.where(held[hot], code[hot], len(crowded))
        _, at, of = np.unique(np.ascontiguousarray(code).view(np.dtype((np.void, code.itemsize * AROUND))).ravel(), return_index=True, return_inverse=True)
        head = at[of.ravel()]
        later = np.flatnonzero((doc[hot] != doc[hot[head]]) & (sig[hot] != sig[hot[head]]))
        ys.append(hot[later])
        xs.append(hot[head[later]])
        ask = np.flatnonzero(doc[hot] == doc[hot[head]])  # first ones, and others of the same text
        q, x = first_covering(code, doc[hot], sig[hot], ask, np.sort(at), len(crowded))
        ys.append(hot[q])
        xs.append(hot[x])
    return np.concatenate(ys), np.concatenate(xs)


def _meet(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (b, a, js, windows) of windows that texts b > a share, js telling the hash functions as bits; rows (b, crowded) of
    crowded keys of b's windows, which are not paired here; and rows (texts) of id, signature and number of words of all texts."""
    least = LEAST
    fields = ("key", "doc", "sig", "c", "dl", "dr", "j")
    dtypes = ("<u8", "<i8", "<u4", "<i4", "<u2", "<u2", "u1")

    def pair(t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """Windows x and y as pairs of texts: of two, the larger id is b. Pairs of one text or of equal texts are left out."""
        apart = (t["doc"][x] != t["doc"][y]) & (t["sig"][x] != t["sig"][y])
        x, y = x[apart], y[apart]
        x, y = np.where(t["doc"][x] > t["doc"][y], x, y), np.where(t["doc"][x] > t["doc"][y], y, x)
        out = np.empty(len(x), WINDOW)
        out["j"] = t["j"][x]
        for side, at in (("b", x), ("a", y)):
            c, dl, dr = (t[f][at].astype(np.int64) for f in ("c", "dl", "dr"))  # arms of FAR and more reach to the text's ends
            out["c" + side], out["l" + side], out["r" + side] = c, np.where(dl < FAR, c - dl, 0), np.where(dr < FAR, c + dr, LONGEST)
        b, a = t["doc"][x], t["doc"][y]
        order = np.lexsort((out["ca"], out["cb"], out["j"], a, b))
        out, b, a = out[order], b[order], a[order]
        if not len(out):
            return []
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1])
        out, b, a = out[fresh], b[fresh], a[fresh]
        begin = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])))
        end = np.append(begin[1:], len(out))
        js = np.bitwise_or.reduceat(1 << out["j"], begin)
        return [(int(b[i]), int(a[i]), int(m), out[i:k].tobytes()) for i, k, m in zip(begin, end, js)]

    def one_of_equal(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """One window of equal texts: that of the smallest id."""
        order = np.lexsort((t["doc"], t["c"], t["sig"], t["key"]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (t["key"][order][1:] != t["key"][order][:-1]) | (t["sig"][order][1:] != t["sig"][order][:-1]) | (t["c"][order][1:] != t["c"][order][:-1])
        return {f: v[order[fresh]] for f, v in t.items()}

    def tell(doc: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1 if len(doc) else []
        start = 0
        for end in ends:
            yield int(doc[start]), np.unique(key[start:end]).tobytes()
            start = end

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "b", "a", "js", "windows", "crowded", "texts", *fields]
        types = [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * (3 + len(fields))
        blank = [None] * len(fields)
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            flat, past, sigs, counts = sequences(batch.column(1))
            known = np.empty(len(ids), TEXT)
            known["doc_id"], known["sig"], known["n"] = ids, sigs, counts
            part = int(ids[0]) % parts
            rows = [(part, None, None, None, None, None, known.tobytes(), *blank)]
            begin = np.append(0, past[:-1])
            order = np.lexsort((ids, sigs))
            texts = np.sort(order[np.append(True, sigs[order][1:] != sigs[order][:-1])])  # of equal texts that of the smallest id
            texts = texts[past[texts] - begin[texts] >= least]
            starts, ends = begin[texts], past[texts]
            t = {f: [] for f in fields}
            for j in range(HASHES):
                c, l, r = compact_windows(flat * MIX[j] + MIX[j + 1], starts, ends, least)
                owner = np.searchsorted(ends, c, "right")
                start = starts[owner]
                values = (window_keys(flat[c], j), ids[texts[owner]], sigs[texts[owner]].astype(np.uint64), c - start, np.minimum(c - l, FAR), np.minimum(r - c, FAR), np.full(len(c), j))
                for f, d, v in zip(fields, dtypes, values):
                    t[f].append(v.astype(d))
            t = {f: np.concatenate(v) for f, v in t.items()}
            _, inverse, counts = np.unique(t["key"], return_inverse=True, return_counts=True)
            many = (counts > CROWD)[inverse] if len(inverse) else np.zeros(0, bool)  # crowded already: told to its texts here
            for doc, keys in tell(t["doc"][many], t["key"][many]):
                rows.append((doc % parts, doc, None, None, None, keys, None, *blank))
            sent = ~many
            for part, values in deal(t["key"][sent], parts, *(t[f][sent] for f in fields)):
                rows.append((part, None, None, None, None, None, None, *values))
            flags = np.unique(t["key"][many])
            for part, (keys,) in deal(flags, parts, flags):
                rows.append((part, None, None, None, None, keys, None, *blank))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        t = {f: joined(table.column(f), d)[0] for f, d in zip(fields, dtypes)}
        t = one_of_equal(t)  # by key
        flags = table.filter(pa.compute.and_(pa.compute.is_valid(table.column("crowded")), pa.compute.is_null(table.column("b"))))
        _, inverse, counts = np.unique(t["key"], return_inverse=True, return_counts=True)
        many = (counts > CROWD)[inverse] | np.isin(t["key"], joined(flags.column("crowded"), "<u8")[0]) if len(inverse) else np.zeros(0, bool)
        few, x, y = np.flatnonzero(~many), [], []
        for step in range(1, CROWD):
            near = np.flatnonzero(t["key"][few[step:]] == t["key"][few[:-step]])
            x.append(few[near + step])
            y.append(few[near])
        told = tell(t["doc"][many], t["key"][many])
        pairs = pair(t, np.concatenate(x), np.concatenate(y))
        names, types = ["b", "a", "js", "windows", "crowded", "texts"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        rows = [(*p, None, None) for p in pairs] + [(doc, None, None, None, keys, None) for doc, keys in told]
        own = pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, types)], names=names)
        done = table.filter(pa.compute.or_(pa.compute.is_valid(table.column("b")), pa.compute.is_valid(table.column("texts"))))
        return pa.concat_tables([own, done.select(names)])

    schema = "part long, b long, a long, js int, windows binary, crowded binary, texts binary, " + ", ".join(f"{f} binary" for f in fields)
    return docs.mapInArrow(scan, schema).groupBy("part").applyInArrow(meet, "b long, a long, js int, windows binary, crowded binary, texts binary")


def _read(docs: DataFrame, wanted: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of the wanted texts (doc_id, crowded): (doc_id, words), the low 32 bits of each word's hash; and (b, a, starts), where
    starts are pairs of positions in b and a < b: of subsequences of LEAST shingles that b has, a is the first to have, and
    crowded keys leave unsettled; and of crowded minima with similar contexts. Equal texts don't meet here. The texts are
    shuffled and read once for all."""
    exact, around, again = ("gram", "doc", "start", "sig"), ("key", "of", "c", "own", "hash", "near"), ("key2", "of2", "c2", "hash2")
    fields = (*exact, *around, *again)
    dtypes = dict(zip(fields, ("<u8", "<i8", "<i4", "<u4", "<u8", "<i8", "<i4", "<u4", "<u8", "<u2", "<u8", "<i8", "<i4", "<u8")))
    names, types = ["part", "b", "a", "starts", *fields, "words"], [pa.int64()] * 3 + [pa.binary()] * (len(fields) + 2)
    one, other, last = [None] * len(exact), [None] * len(around), [None] * len(again)

    def grouped(b: np.ndarray, a: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
        by = np.lexsort((at[:, 0], a, b))
        b, a, at = b[by], a[by], at[by].astype("<i4")
        begin = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))) if len(b) else []
        return [(int(b[i]), int(a[i]), at[i:k].tobytes()) for i, k in zip(begin, [*begin[1:], len(b)])]

    def pairs(gram: np.ndarray, doc: np.ndarray, start: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
        """Wherever each gram's first text shows it, and the other texts' pairs with the first place there."""
        order = np.lexsort((start, doc, gram))
        gram, own, sig = gram[order], doc[order], sig[order]
        first = np.ones(len(order), bool)
        first[1:] = gram[1:] != gram[:-1]
        head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else np.zeros(0, np.int64)
        later = np.flatnonzero((own != own[head]) & (sig != sig[head]))
        at = np.stack([start[order[later]], start[order[head[later]]]], 1)
        return order[own == own[head]], grouped(own[later], own[head[later]], at)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            words, offsets = words_of(batch.column(1))
            low, cuts = words.astype("<u4"), offsets.tolist()
            rows = [(None, int(i), None, None, *one, *other, *last, low[x:y].tobytes()) for i, x, y in zip(ids.tolist(), cuts, cuts[1:]) if y - x >= MIN_WORDS]
            flat, ends, sigs, _ = shingled(words, offsets)
            starts, sigs = np.append(0, ends[:-1]), sigs.astype(np.uint64).astype("<u4")
            crowded = np.unique(np.frombuffer(b"".join(k for told in batch.column(2).to_pylist() for k in told), "<u8"))
            windows = hot_windows(flat, ends, crowded)
            found = unsettled(len(flat), windows)
            gram = grams(flat)[found] if len(found) else np.zeros(0, np.uint64)
            owner = np.searchsorted(ends, found, "right")
            values = (gram, ids[owner], (found - starts[owner]).astype("<i4"), sigs[owner])
            sent, near = pairs(*values)
            rows += [(b % parts, b, a, at, *one, *other, *last, None) for b, a, at in near]
            for part, columns in deal(gram[sent], parts, *(v[sent] for v in values)):
                rows.append((part, None, None, None, *columns, *other, *last, None))
            for key, c, l, r in windows:
                owner = np.searchsorted(ends, c, "right")
                shift = offsets[owner] - starts[owner]
                near, shown = contexts(words, l + shift, r + shift + SHINGLE, c + shift)
                doc, c = ids[owner], (c - starts[owner]).astype("<i4")
                order = np.lexsort((c, doc, shown, key))  # copies of a context in later texts are exact repeats
                first = np.ones(len(order), bool)
                first[1:] = (key[order][1:] != key[order][:-1]) | (shown[order][1:] != shown[order][:-1])
                head = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
                sent, more = order[first], order[~first & (doc[order] == doc[head])]
                for part, columns in deal(key[sent], parts, *(v[sent] for v in (key, doc, c, sigs[owner], shown, near))):
                    rows.append((part, None, None, None, *one, *columns, *last, None))
                for part, columns in deal(key[more], parts, *(v[more] for v in (key, doc, c, shown))):
                    rows.append((part, None, None, None, *one, *other, *columns, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    def meet(t: pa.Table) -> pa.Table:
        v = {f: joined(t.column(f), d)[0] for f, d in dtypes.items()}
        own = pairs(*(v[f] for f in exact))[1]
        near, shown = v.pop("near").reshape(-1, AROUND + SHINGLE - 1), v["hash"]
        order = np.lexsort((v["c"], v["of"], shown, v["key"]))
        same = (v["key"][order][1:] == v["key"][order][:-1]) & (shown[order][1:] == shown[order][:-1])
        order = order[np.append(True, ~same)] if len(order) else order  # of equal contexts that of the first text
        order = order[np.lexsort((v["c"][order], v["of"][order], v["key"][order]))]
        key, doc, c, sig, shown = v["key"][order], v["of"][order], v["c"][order], v["own"][order], shown[order]
        again = {}
        for k, i, at, h in zip(*(v[f].tolist() for f in ("key2", "of2", "c2", "hash2"))):
            again.setdefault((k, i, h), []).append(at)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
        b, a, at = [], [], []
        for i, k in zip(begin, [*begin[1:], len(key)]):
            y, x = similar_contexts(context_shingles(near[order[i:k]]), doc[i:k], sig[i:k])
            for y, x in zip((y + i).tolist(), (x + i).tolist()):
                for place in (int(c[y]), *again.get((int(key[y]), int(doc[y]), int(shown[y])), ())):
                    b.append(int(doc[y]))
                    a.append(int(doc[x]))
                    at.append((place, int(c[x])))
        own += grouped(np.array(b, np.int64), np.array(a, np.int64), np.array(at, np.int64).reshape(-1, 2))
        found = pa.table([pa.array(c, k) for c, k in zip(zip(*own) if own else [()] * 3, types[1:4])], names=names[1:4])
        return pa.concat_tables([found, t.filter(pa.compute.is_valid(t.column("b"))).select(names[1:4])])

    schema = "part long, b long, a long, starts binary, " + ", ".join(f"{f} binary" for f in (*fields, "words"))
    read = settle(docs.join(wanted, "doc_id").select("doc_id", "text", "crowded").mapInArrow(show, schema))
    texts = read.where("words is not null").groupBy(F.col("b").alias("doc_id")).agg(F.first("words").alias("words"))  # repeated rows are one
    met = read.where("part is not null").drop("words").groupBy("part").applyInArrow(meet, "b long, a long, starts binary")
    return texts, met.groupBy("b", "a").agg(F.collect_list("starts").alias("starts"))


def stretches(starts: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
    """Runs of neighbouring (start in b, start in a) on one diagonal, as clusters gives them; those that overlap in both
    texts are one, with several diagonals: of each, verify finds the exact runs, and the similar passages around them."""
    rows = starts[np.lexsort((starts[:, 0], starts[:, 0] - starts[:, 1]))].astype(np.int64)
    d = rows[:, 0] - rows[:, 1]
    begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (np.diff(rows[:, 0]) > LEAST)))
    end = np.append(begin[1:], len(rows)) - 1
    low, high = np.maximum(rows[begin] - MARGIN, 0), rows[end] + LEAST - 1 + MARGIN
    out = []
    for i in np.argsort(low[:, 0], kind="stable").tolist():
        lb, la, rb, ra, own = *low[i].tolist(), *high[i].tolist(), int(d[begin[i]])
        if out and lb <= out[-1][1] and la <= out[-1][3] and out[-1][2] <= ra:
            last = out[-1]
            out[-1] = (last[0], max(last[1], rb), min(last[2], la), max(last[3], ra), last[4])
            out[-1][4].add(own)
        else:
            out.append((lb, rb, la, ra, {own}))
    return [(*box, sorted(diagonals)) for *box, diagonals in out]


def known_texts(shown: DataFrame) -> DataFrame:
    """(doc_id, sig, n) of the texts that _meet tells."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), TEXT)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[f])) for f in TEXT.names], names=list(TEXT.names))

    return shown.where("texts is not null").select("texts").mapInArrow(unpack, "doc_id long, sig long, n long")


def _copies(whole: DataFrame) -> DataFrame:
    """Texts (doc_id, sig, n) of MIN_WORDS words or more that are those of a text of smaller doc_id, as one passage each."""
    whole = whole.where(F.col("n") >= MIN_WORDS)
    first = whole.groupBy("sig").agg(F.min("doc_id").alias("source_doc_id"))
    zero, n = F.lit(0).cast("long"), F.col("n")
    found = whole.join(first, "sig").where("doc_id > source_doc_id").distinct()
    return found.select("doc_id", zero.alias("start_word"), n.alias("end_word"), "source_doc_id", zero.alias("source_start"), n.alias("source_end"), n.alias("n_words"), F.lit(1.0).alias("similarity"))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _found(docs: DataFrame, shown: DataFrame, parts: int) -> DataFrame:
    """Passages of docs (doc_id, text), of which no id has several texts, from what met."""
    met = shown.where("a is not null").groupBy("b", "a").agg(F.bit_or("js").alias("js"), F.collect_list("windows").alias("windows"))
    shared = met.where(F.bit_count("js") >= AGREE).select("b", "a", "windows")
    names, types = ["b", "a", "lb", "rb", "la", "ra", "diagonals"], [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())]

    def joins(told: np.dtype, boxes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _few(batches):
                rows = []
                for b, a, parts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    rows += [(b, a, *box) for box in boxes(np.frombuffer(b"".join(parts), told))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

        return run

    spans = "b long, a long, lb int, rb int, la int, ra int, diagonals array<int>"
    near = settle(shared.mapInArrow(joins(WINDOW, clusters), spans))
    # the texts of these, and those with crowded minima
    told = shown.where("crowded is not null").select(F.col("b").alias("doc_id"), "crowded")
    asked = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().select("doc_id", F.lit(None).cast("binary").alias("crowded"))
    texts, exact = _read(docs, told.union(asked).groupBy("doc_id").agg(F.collect_list("crowded").alias("crowded")), parts)
    candidates = near.union(exact.mapInArrow(joins(np.dtype(("<i4", 2)), stretches), spans))
    cut = lambda side: F.expr(f"substring(words, 4 * l{side} + 1, 4 * (r{side} - l{side} + {SHINGLE}))")
    of_a = candidates.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "a", "lb", "rb", "la", "diagonals", cut("a").alias("of_a"))
    both = of_a.join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "a", "lb", "la", "diagonals", "of_a", cut("b").alias("of_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "of_b", 1 << 20):
            rows = []
            for b, a, lb, la, diagonals, of_a, of_b in zip(*(batch.column(i).to_pylist() for i in range(7))):
                x, y = (shingle_sequence(np.frombuffer(w, "<u4").astype(np.uint64), SHINGLE) for w in (of_b, of_a))
                for b0, b1, a0, a1, ratio in verify(x, y, [d - (lb - la) for d in diagonals]):
                    rows.append((b, lb + b0, lb + b1 + SHINGLE, a, la + a0, la + a1 + SHINGLE, b1 - b0 + SHINGLE, ratio))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 7 + [pa.float64()])], names=SPAN_NAMES)

    def maximal(t: pa.Table) -> pa.Table:
        """Of one text's passages, those that lie in no other; of equal ones that of the smallest source."""
        rows = sorted(t.to_pylist(), key=lambda r: (r["start_word"], -r["end_word"], r["source_doc_id"], r["source_start"]))
        kept, reach = [], -1
        for row in rows:
            if row["end_word"] > reach:
                kept.append(row)
                reach = row["end_word"]
        return pa.Table.from_pylist(kept, t.schema)

    copies = _copies(known_texts(shown))
    return both.mapInArrow(check, SPAN_SCHEMA).unionByName(copies).groupBy("doc_id").applyInArrow(maximal, SPAN_SCHEMA)


SPAN_SCHEMA = "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, n_words long, similarity double"
SPAN_NAMES = [part.split()[0] for part in SPAN_SCHEMA.split(", ")]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least 50 words of docs (doc_id, text) that a text of smaller doc_id has too, with a Jaccard
    similarity of 0.8 or more on 5-word shingles.

    A row is a maximal passage, words start_word to end_word (exclusive), with one source passage. Words are runs of
    other than ASCII white space, A-Z lowered. A whole copy is one passage. Null, empty and short texts have none;
    repeated rows and repeats within one text are not reported; a null doc_id takes no part; other columns are ignored.
    Where an id has several texts, all of them take part: the longest (of equal ones that of the least text_hash, xxhash64)
    under its id, the others as if they came after all ids. Their rows name the text by text_hash, which is null for all
    other ids.

    Repeats of whole passages are found by every hash function or, where very many texts share parts of them, by their
    exact subsequences; those that are not exact, by comparing what lies around such parts. At a similarity of exactly 0.8,
    about one passage in forty of the least length agrees on fewer than two of four functions and is missed.
    """
    parts = parts_for(docs, PART_BYTES)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shown = settle(_meet(rows, parts))
    several = known_texts(shown).groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("doc_id")
    none = F.lit(None).cast("long").alias("text_hash")
    if not several.limit(1).count():
        return _found(rows, shown, parts).select(*SPAN_NAMES, none)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    texts = rows.join(several, "doc_id", "left_semi").select("doc_id", "text_hash", F.coalesce(-F.length("text"), F.lit(0)).alias("short")).distinct()
    least = texts.groupBy("doc_id").agg(F.min(F.struct("short", "text_hash"))["text_hash"].alias("least"))
    last = F.lit(rows.agg(F.max("doc_id")).first()[0])
    key = F.when(F.col("text_hash") == F.col("least"), F.col("doc_id")).otherwise(last + 1 + F.monotonically_increasing_id())
    keys = settle(texts.join(least, "doc_id").select("doc_id", "text_hash", key.alias("key")))
    rows = rows.join(keys, ["doc_id", "text_hash"], "left").select(F.coalesce("key", "doc_id").alias("doc_id"), "text")
    found = _found(rows, settle(_meet(rows, parts)), parts)
    own = keys.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("id"), "text_hash")
    source = keys.select(F.col("key").alias("source_doc_id"), F.col("doc_id").alias("source_id"))
    named = found.join(own, "doc_id", "left").join(source, "source_doc_id", "left")
    named = named.withColumn("doc_id", F.coalesce("id", "doc_id")).withColumn("source_doc_id", F.coalesce("source_id", "source_doc_id"))
    return named.select(*SPAN_NAMES, "text_hash")


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of its spans (doc_id, start_word, end_word, text_hash) cut from text; all columns are kept.

    A text keeps its other words and the white space before them. Texts without spans, null ones among them, are
    returned as they are. A text_hash that is not null names one of several texts of an id. Overlapping spans are cut
    as one. Columns of any name are kept.
    """
    own, mark, cuts = (free_name(n, docs.columns) for n in ("own_id", "own_hash", "cuts"))
    cut = spans.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(mark)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    d, c = docs.alias("d"), cut.alias("c")
    same = (F.col("d.doc_id").cast("long") == F.col(f"c.{own}")) & (F.col(f"c.{mark}").isNull() | (F.col(f"c.{mark}") == F.xxhash64("d.text")))
    # pieces: each word with the white space before it; what follows the last word goes with it
    pieces = F.regexp_extract_all("d.text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)

    def left(pieces: Column, cuts: Column, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), reach)
        start = F.concat(F.transform(cuts, lambda s: s["start_word"].cast("int")), F.array(F.size(pieces)))
        kept = F.zip_with(before, start, lambda a, b: F.slice(pieces, a + 1, F.greatest(b - a, F.lit(0))))
        return F.array_join(F.flatten(kept), "")

    ends = running(F.transform(F.col(f"c.{cuts}"), lambda s: s["end_word"].cast("int")), F.greatest)
    text = F.when(F.col(f"c.{cuts}").isNull(), F.col("d.text")).otherwise(let(pieces, lambda p: let(ends, lambda reach: left(p, F.col(f"c.{cuts}"), reach))))
    return d.join(c, same, "left").select(*[text.alias(n) if n == "text" else F.col(f"d.`{n}`") for n in docs.columns])
