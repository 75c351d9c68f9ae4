"""The n-gram join against brute force, with copies, near copies, hot groups, odd texts and tiles."""

import random

import numpy as np
import pytest

from harrow.llm import setjoin
from harrow.llm.components import components


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return {tuple(words)} - {()} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and den * len(x & y) >= num * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(x), None if i is None else least[find(a)]) for a, (i, x) in enumerate(sets)), key=str)


def corpus(seed, n=120):
    rng, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 100, 400]))]
            if kind > 0.85:
                words += passage
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one  TWO\n"), (n + 5, "É one"), (5, rows[5][1]), (None, rows[7][1]), (7, "another text under the same id here")]
    return rows


@pytest.mark.parametrize("seed,k,sim", [(1, 4, (85, 100)), (2, 5, (4, 5)), (3, 4, (85, 100)), (4, 5, (4, 5)), (5, 2, (1, 2))])
def test_classes_match_brute_force(spark, monkeypatch, seed, k, sim):
    if seed == 3:
        monkeypatch.setattr(setjoin, "TILE_NGRAMS", 500)
        monkeypatch.setattr(setjoin, "COMMON", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, sig string").repartition(5)
    got = setjoin.jaccard_classes(df, k, sim)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, *sim)


@pytest.mark.parametrize("seed,k,sim", [(6, 4, (85, 100)), (7, 5, (4, 5))])
def test_partners_whose_slices_are_common(spark, monkeypatch, seed, k, sim):
    """Sets of 24 n-grams and more that differ in one or two; with the bound at 1 each shared slice is common."""
    monkeypatch.setattr(setjoin, "COMMON", 1)
    rng, rows = random.Random(seed), []
    for i in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(24, 60))]
        for j in range(rng.choice([2, 2, 40]) if i % 20 == 0 else 2):
            more = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
            rows.append((len(rows), " ".join(words + more if j % 2 else more + words)))
    rows.append((len(rows), " ".join(f"z{i}" for i in range(60_000))))
    rows.append((len(rows), " ".join(f"z{i}" for i in range(62_000))))
    got = setjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, sim)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, *sim)


def test_no_rows(spark):
    assert setjoin.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in setjoin.jaccard_classes(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).collect()] == [(4, 3, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_alone(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(80):
        if sets and rng.random() < 0.7:
            base = sets[rng.integers(len(sets))]
            base = base[rng.random(len(base)) > 0.05]
            sets.append(np.unique(np.append(base, rng.integers(0, 500, rng.integers(4)).astype(np.uint64))))
        else:
            sets.append(np.unique(rng.integers(0, 500, rng.integers(1, 60)).astype(np.uint64)))
    own = setjoin.UnionFind(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and both:
                own.union(a, b)
    assert setjoin.join_sets(sets, 85, 100).tolist() == [own.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for u, v in edges:
        if u is not None and u != v:
            low, high = sorted((find(u), find(v)))
            up[high] = low
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5)])
def test_partners_share_a_slice(num, den):
    rng = np.random.default_rng(3)
    bounds = setjoin.size_bounds(num, den, 9000)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 20, 40, 100, 300, 1000]) * rng.uniform(1, 1.7)) or 1
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        drop, more = rng.integers(0, max(1, n // 5) + 1), rng.integers(0, max(1, n // 5) + 1)
        y = np.unique(np.append(rng.permutation(x)[drop:], rng.integers(0, 1 << 60, more).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if both * den < num * (len(x) + len(y) - both) or not both:
            continue
        keys = []
        for s in (x, y):
            level = int(np.searchsorted(bounds, len(s), "right")) - 1
            keys.append({k for at in (level, level - 1) if at >= 0 for k in setjoin.slice_keys(s, at, bounds, num, den)[0].tolist()})
        assert keys[0] & keys[1]
        at = int(np.searchsorted(bounds, min(len(x), len(y)), "right")) - 1  # the level both show themselves at
        (of_x, unsafe), (of_y, same) = (setjoin.slice_keys(s, at, bounds, num, den) for s in (x, y))
        # whichever of the shared slices are common: either set is safe, and one isn't, or both are unsafe and meet there
        assert unsafe == same and len(set(of_x.tolist()) & set(of_y.tolist())) >= unsafe
        apart = setjoin.bits_apart(setjoin.bitmap(x), setjoin.bitmap(y))
        assert apart <= len(x) + len(y) - 2 * both


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_partners_of_all_sizes_are_looked_at(num, den):
    """Worst order: what is in one set only comes first in both."""
    for n in range(1, 400):
        for m in range(-(-num * n // den), n + 1):
            both = -(-num * (n + m) // (num + den))
            hits = min(setjoin.looked_at(n, num, den) - (n - both), setjoin.looked_at(m, num, den) - (m - both), both)
            assert hits >= max(1, setjoin.needed(n, num, den), setjoin.needed(m, num, den)), (n, m)


@pytest.mark.parametrize("words,k,sim", [(9, 4, (85, 100)), (8, 5, (4, 5))])
def test_one_word_more_at_an_end(spark, words, k, sim):
    text = [f"w{i}" for i in range(words)]
    for longer in ([*text, "more"], ["more", *text]):
        rows = [(1, " ".join(text)), (2, " ".join(longer)), (3, "quite another text than those two are here now")]
        got = setjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, sim)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, *sim)


def test_one_of_each_by_id_and_text(spark):
    """Rows that share an id, but not a text, stay or go by their own text; of repeated rows one stays."""
    plain = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, plain, 0), (5, plain + " ", 1), (5, "quite another text than this one is here", 2), (5, "a third text that none of the others is like", 3),
        (5, "a third text that none of the others is like", 4), (6, "a third text that none of the others is like", 5), (7, None, 6), (7, None, 7), (8, "", 8), (None, plain, 9), (9, "two words", 10), (9, "Two  words", 11),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, own_id int").repartition(3)
    out = setjoin.one_of_each(df)
    assert out.columns == df.columns
    left = sorted(r.own_id for r in out.collect())
    assert [k for k in left if k not in (3, 4, 10, 11)] == [0, 2, 6, 7, 8, 9] and len([k for k in left if k in (3, 4)]) == 1 == len([k for k in left if k in (10, 11)])
    assert setjoin.one_of_each(df.limit(0)).count() == 0
