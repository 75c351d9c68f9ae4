"""Compact windows and repeated passages against brute force and planted repeats."""

import random
import time

import numpy as np
import pytest

from harrow.llm import passages


def test_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 40, 60).astype(np.uint64)
    starts, ends, width = np.array([0, 25, 25]), np.array([25, 25, 60]), 4
    c, l, r = passages.compact_windows(values, starts, ends, width)
    for s, e in zip(starts, ends):
        for x in range(s, e):
            for y in range(x + width - 1, e):
                inside = [k for k in range(len(c)) if l[k] <= x <= c[k] <= y <= r[k]]
                assert len(inside) == 1 and values[c[inside[0]]] == values[x : y + 1].min()


def filler(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]


def plant(seed, n=60):
    """Texts, and for each text the planted passages: (doc, start, end, source)."""
    rng = random.Random(seed)
    repeats = [filler(rng, rng.choice([55, 60, 130, 150])) for _ in range(6)]
    rows, planted, first = [], [], {}
    for i in range(n):
        words = filler(rng, rng.choice([0, 20, 80, 300]))
        if i % 3 == 0:
            k = rng.randrange(len(repeats))
            passage = list(repeats[k])
            if i % 2 and len(passage) > 100:
                passage[rng.randrange(20, 30)] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
            if k in first:
                planted.append((i, at, at + len(passage)))
            first.setdefault(k, i)
        rows.append((i, " ".join(words)))
    return rows, planted


@pytest.mark.parametrize("seed", range(3))
def test_planted_repeats_are_found(spark, seed):
    rows, planted = plant(seed)
    copy = next(t for i, t in rows if len(t.split()) > 100)
    rows += [(900, copy.upper()), (901, copy + "\n"), (902, None), (903, ""), (904, "one two three"), (None, copy), (905, "x y " * 200)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, sig int, b string").repartition(4)
    got = passages.repeated_passages(df).collect()
    for doc, start, end in planted:
        cover = set()
        for r in got:
            if r.doc_id == doc:
                cover.update(range(r.start_word, r.end_word))
        missing = set(range(start, end)) - cover
        assert len(missing) <= 2, (doc, start, end, sorted(missing))
    near = {(d, w) for d, s, e in planted for w in range(s - 6, e + 6)}
    for r in got:
        assert r.n_words >= 50 and r.similarity >= 0.8 and r.source_doc_id < r.doc_id
        if r.doc_id < 900:
            assert all((r.doc_id, w) in near for w in range(r.start_word, r.end_word))
    assert {r.doc_id for r in got if r.doc_id >= 900} == {900, 901}
    cut = {r.doc_id: r.text for r in passages.without_passages(df, passages.repeated_passages(df)).collect()}
    texts = dict(rows)
    assert cut[902] is None and cut[903] == "" and cut[900].strip() == "" and cut[905] == texts[905]
    for i, t in rows[:60]:
        gone = {w for r in got if r.doc_id == i for w in range(r.start_word, r.end_word)}
        assert cut[i].split() == [w for k, w in enumerate(t.split()) if k not in gone]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeated_passages(empty).count() == 0
    assert passages.without_passages(empty, passages.repeated_passages(empty)).count() == 0


def test_interval_join_needs_agreement():
    one = np.array([(0, 30, 10, 80, 20, 0, 70)], passages.WINDOW)
    two = np.array([(0, 30, 10, 80, 20, 0, 70), (2, 50, 15, 90, 40, 5, 80)], passages.WINDOW)
    far = np.array([(0, 30, 10, 80, 20, 0, 70), (2, 350, 315, 390, 40, 5, 80)], passages.WINDOW)
    assert passages.clusters(one) == [] and passages.clusters(far) == []
    assert passages.clusters(two) == [(0, 90 + passages.MARGIN, 0, 80 + passages.MARGIN, [10])]


def test_one_line_repeated_is_covered():
    line = np.arange(100, 107, dtype=np.uint32)
    a, b = np.tile(line, 12), np.concatenate([np.arange(30, dtype=np.uint32), np.tile(line, 40)])
    found = passages.verify(b, a, list(range(30, 30 + 7 * 20, 7)))
    cover = {i for b0, b1, *_ in found for i in range(b0, b1 + 1)}
    assert cover >= set(range(30, 30 + 7 * 30)) and len(found) < 12
    assert all((b[b0 : b1 + 1] == a[a0 : a1 + 1]).all() for b0, b1, a0, a1, _ in found)


def test_exact_repeat_around_a_line_of_many_texts(spark):
    """Texts that share 50 words, 45 of them a line that all texts have, neither first nor neighbours by id."""
    rng = random.Random(7)
    line, rows, pairs = filler(rng, 45), {}, []
    for i in range(400):
        rows[i] = filler(rng, 60) + line + filler(rng, 60)
    for k in range(40):
        a, b, left = 20 + 4 * k, 202 + 4 * k, k % 6
        before, after = filler(rng, left), filler(rng, 5 - left)
        for i in (a, b):
            rows[i] = filler(rng, 60) + before + line + after + filler(rng, 60)
        pairs.append((a, b))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(5)
    got = {(r.source_doc_id, r.doc_id) for r in passages.repeated_passages(df).collect() if r.start_word <= 60 and r.end_word >= 110}
    assert not set(pairs) - got, sorted(set(pairs) - got)


def test_runs_of_one_word(spark):
    """Of runs of one word, as of any short period, all places count, also in a text that is the first of its batch."""
    rng = random.Random(2)
    rows = {i: filler(rng, 70) + ["again"] * n + filler(rng, 70) for i, n in enumerate([90, 300, 140, 500] + [60] * 30)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(6, "doc_id")
    found = passages.repeated_passages(df).collect()
    for i, words in rows.items():
        cover = {w for r in found if r.doc_id == i for w in range(r.start_word, r.end_word)}
        assert cover >= {k for k, w in enumerate(words) if w == "again" and i}, i


def brute_cover(texts):
    """Words of each text inside windows of 50 words, begun and ended by shared shingles, that have a Jaccard similarity
    of 0.8 with one of an earlier text."""
    shingles = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    cover = [set() for _ in texts]
    for y in range(len(texts)):
        for x in range(y):
            both = {s: i for i, s in enumerate(set(shingles[x]) & set(shingles[y]))}
            if len(both) < 36:
                continue
            held = []
            for s in (shingles[y], shingles[x]):
                m = np.zeros((len(s) - 45, len(both)), np.float32)
                for i in range(len(m)):
                    m[i, [both[g] for g in s[i : i + 46] if g in both]] = 1
                held.append((m, np.array([len(set(s[i : i + 46])) for i in range(len(m))])))
            (b, nb), (a, na) = held
            common = b @ a.T
            ends = np.array([shingles[y][i] in both and shingles[y][i + 45] in both for i in range(len(b))])
            for i in np.flatnonzero((common >= 0.8 * (nb[:, None] + na[None] - common)).any(1) & ends):
                cover[y].update(range(i, i + 50))
    return cover


def test_recall_against_brute_force(spark):
    """Edited passages at similarities of 0.8 to 1 between texts: at least 95 of 100 words that brute force finds."""
    rng, texts = random.Random(12), []
    sources = [filler(rng, rng.randrange(55, 160)) for _ in range(40)]
    for i in range(160):
        words = filler(rng, rng.randrange(90))
        for _ in range(rng.randrange(1, 3)):
            passage = list(rng.choice(sources))
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(passage) // 50 + 1])):
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1, 1, 2])] = filler(rng, rng.choice([0, 1, 1, 3]))
            words += passage + filler(rng, rng.randrange(40))
        texts.append(words)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = [set() for _ in texts]
    for r in passages.repeated_passages(df).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    want = brute_cover(texts)
    total, hit = sum(map(len, want)), sum(len(w & g) for w, g in zip(want, got))
    print(f"recall {hit / total:.4f} of {total} words; {sum(map(len, got))} reported")
    assert total > 5000 and hit >= 0.95 * total


def test_ids_with_several_texts(spark):
    """Spans name the text they are in, by its hash; only that text is cut, whatever the other columns are called."""
    rng = random.Random(5)
    passage, other = filler(rng, 80), filler(rng, 70)
    texts = [(1, passage + filler(rng, 60)), (5, filler(rng, 30) + passage), (5, filler(rng, 90) + other), (7, other + filler(rng, 20)), (9, filler(rng, 100)), (9, None)]
    rows = [(i, None if w is None else " ".join(w), k, "c", "h", 3) for k, (i, w) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, own_id int, cuts string, OWN_HASH string, text_hash int").repartition(3)
    found = passages.repeated_passages(df)
    by_row = {r.own_id: r.text for r in passages.without_passages(df, found).collect()}
    assert [len((by_row[k] or "").split()) for k in range(6)].count(0) == 1 and by_row[0] == rows[0][1] and by_row[4] == rows[4][1]
    left = [len(by_row[k].split()) for k in range(4)]
    # 80 words go from row 1; of the 70 that rows 2 and 3 share, those of one of the two
    assert left[1] == 30 and sorted((left[2], left[3])) in ([20, 160], [90, 90])
    assert {r.doc_id for r in found.collect()} <= {5, 7} and all(r.text_hash is not None for r in found.collect() if r.doc_id == 5)
    assert passages.without_passages(df, found).columns == df.columns


def test_ids_with_a_short_text_too(spark):
    """A short text under the id of a long one is neither taken for it nor cut."""
    rng = random.Random(8)
    passage = filler(rng, 80)
    rows = [(1, " ".join(passage), 0), (1, " ".join(passage[:9]), 1), (4, " ".join(passage + filler(rng, 30)), 2), (4, " ".join(filler(rng, 7)), 3), (4, None, 4)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(parts)
        found = passages.repeated_passages(df)
        assert [(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in found.collect()] == [(4, 0, 80, 1)]
        left = {r.k: r.text for r in passages.without_passages(df, found).collect()}
        assert len(left[2].split()) == 30 and all(left[k] == rows[k][1] for k in (0, 1, 3, 4))


def test_texts_without_words_and_very_long_ones(spark):
    rng = random.Random(6)
    long = filler(rng, 150_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:] + ["end"])), (3, "x" * 300_000), (4, " " * 5000), (5, None), (6, " ".join(filler(rng, 30) + long[100_000:100_060]))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in found) == [(2, 0, 80_000), (6, 30, 90)]


def crowd(seed, n=240, pairs=20):
    """Texts around one line that all of them hold, and pairs of texts, neither first nor neighbours, that share a passage
    with the line in it and one word of the line changed: (doc, start, end). No 50 words of such a passage are an exact repeat."""
    rng = random.Random(seed)
    line, rows, planted = filler(rng, 44), [], []
    for i in range(n):
        rows.append(filler(rng, 60) + line + filler(rng, 60))
    for k in range(pairs):
        b, a = 100 + 3 * k, 30 + 3 * k
        shared = filler(rng, 5) + line + filler(rng, 5)
        rows[a][55:109] = shared
        rows[b][55:109] = shared[: 24 + k % 6] + ["changed"] + shared[25 + k % 6 :]
        planted.append((b, 55, 109))
    return [(i, " ".join(words)) for i, words in enumerate(rows)], planted


def test_similar_passages_around_a_common_line_are_found(spark):
    rows, planted = crowd(4)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for doc, start, end in planted:
        cover = {w for r in got if r.doc_id == doc for w in range(r.start_word, r.end_word)}
        assert set(range(start, end)) <= cover, doc


def test_contexts_against_all_pairs():
    rng = np.random.default_rng(5)
    line = rng.integers(1, 1 << 31, passages.AROUND)
    rows = rng.integers(1, 1 << 31, (400, passages.AROUND))
    variants = [np.concatenate([line[:30], rng.integers(1, 1 << 31, 3), line[33:]]) for _ in range(5)]
    for i in range(400):  # a short line in all, a long line and its variants in many, and near copies in a few
        rows[i, 35:60] = line[35:60]
        if i % 4 == 0:
            rows[i, 20:75] = variants[i % 5][20:75]
        if i % 40 == 39:
            rows[i] = np.where(rng.random(passages.AROUND) < 0.05, rows[i], rows[(i - 39) // 2 + 7])
    near = np.unique(rows, axis=0).astype(np.uint32)
    near = near[rng.permutation(len(near))]
    doc, sig = np.arange(len(near)) // 2, np.arange(len(near)) // 2
    y, x = passages.similar_contexts(near, doc, sig)
    assert (doc[x] < doc[y]).all() and len(y) < 8 * len(near)

    def covered(row, others):
        out = set()
        for o in others:
            had = np.isin(near[row], near[o])
            out |= {s for s in range(passages.AROUND - passages.LEAST + 1) if had[s : s + passages.LEAST].sum() >= passages.SHARED}
        return out

    for row in range(len(near)):
        assert covered(row, x[y == row]) == covered(row, np.flatnonzero(doc < doc[row])), row


def test_many_contexts_of_runs():
    """6,000 different contexts of one crowded minimum, of runs of words that many have: the time is bounded, and what is
    covered is that of a comparison with all earlier rows."""
    rng = np.random.default_rng(9)
    n, none = 6000, passages.AROUND - passages.REACH
    near = np.zeros((n, passages.AROUND), np.uint32)
    for i in range(n):
        lengths = rng.integers(4, 24, 12)
        words = np.append(7, rng.integers(10, 900, 11))
        near[i, passages.REACH :] = np.repeat(words, lengths)[:none]
        if i % 9 == 8:  # as an earlier row but for its end
            near[i, : 80 + i % 7] = near[i // 9 * 4, : 80 + i % 7]
        if i % 5 == 0:  # with shingles on both sides
            near[i, 25 : passages.REACH] = np.repeat(rng.integers(10, 60, 4), 5)
    near = np.unique(near, axis=0)
    near = near[rng.permutation(len(near))]
    doc = sig = np.arange(len(near)) // 6
    began = time.thread_time()
    y, x = passages.similar_contexts(near, doc, sig)
    took = time.thread_time() - began
    assert (doc[x] < doc[y]).all() and len(y) > 600 and took < 6, took

    def covered(row, others):
        had = np.zeros((len(others), passages.AROUND + 1), np.int64)
        had[:, 1:] = np.cumsum([np.isin(near[row], near[o][near[o] > 0]) for o in others], axis=1)
        return set(np.flatnonzero((had[:, passages.LEAST :] - had[:, : -passages.LEAST] >= passages.SHARED).any(0)).tolist())

    for row in rng.choice(np.unique(y), 12, replace=False).tolist() + rng.choice(len(near), 6, replace=False).tolist():
        told = x[y == row]
        assert (covered(row, told) if len(told) else set()) == covered(row, np.flatnonzero(doc < doc[row]))
