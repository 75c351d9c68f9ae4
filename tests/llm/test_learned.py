"""Classifiers: held-out accuracy on planted signals, odd input; exact search against brute force."""

import dataclasses
import math
import random
import zlib

import numpy as np
import pytest

from harrow.llm import linear, vectors


def corpus(spark, n=400, seed=5):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice("of the river stone green valley music bread light table women muslim".split()) for _ in range(40)]
        bad = rng.random() < 0.4
        if bad:
            words[rng.randrange(40)] = rng.choice(["blargh", "blarghing", "zonk"])
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, int(not bad), int(bad), 0.5))
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "of the", "x"), (3, rows[3][1], "x")]
    labels += [(n, 1, 0, 0.5), (None, 1, 1, 0.5), (2, None, None, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, label double")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_learns_what_is_labelled(spark, name):
    docs, labels = corpus(spark)
    run = linear.quality_scores if name == "quality" else linear.toxicity_scores
    got = run(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[name] for r in labels.collect()}
    fold = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert fold and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in fold)
    assert np.mean([r.predicted == truth[r.doc_id] for r in fold]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (400, 401)}) == 1
    assert run(docs.limit(0), labels).count() == 0
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_scores_do_not_depend_on_partitions(spark, name):
    """Equal scores over 1 and 7 partitions, with repeated rows, and ids that are labelled both ways left out."""
    docs, labels = corpus(spark, 200)
    docs, labels = docs.cache(), labels.cache()
    run = linear.quality_scores if name == "quality" else linear.toxicity_scores
    settings = dataclasses.replace(linear.TOXICITY, max_rows=100)
    want = {r.doc_id: r.score for r in run(docs.coalesce(1), labels.coalesce(1), settings).collect()}
    twice = docs.union(docs).repartition(7)
    both = labels.union(labels).union(labels.sparkSession.createDataFrame([(900, 0, 0, 0.0), (900, 1, 1, 0.0)], labels.schema)).repartition(5)
    got = run(twice.union(docs.sparkSession.createDataFrame([(900, "of the blargh", "x")], docs.schema)), both, settings).collect()
    assert {r.doc_id: r.score for r in got if r.doc_id != 900} == want and len(got) == 2 * docs.count() + 1


def plain_ftrl(rows, s, seed=7):
    """Per-coordinate updates on dicts, one number at a time."""
    z, n, rng, rows = {}, {}, random.Random(seed), list(rows)

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= s.l1 else -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    def update(i, g, w):
        z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha * w
        n[i] = n.get(i, 0.0) + g * g

    for _ in range(s.epochs):
        rng.shuffle(rows)
        for x, y, label in rows:
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-sum(w.values())))
            for i in own:
                update(i, p - label, w[i])
            if y is not None and s.counterfactual:
                a, b = [i for i in x if i not in set(y)], [i for i in y if i not in set(x)]
                wa, wb = {i: weight(i) for i in a}, {i: weight(i) for i in b}
                pull = s.counterfactual * (sum(wa.values()) - sum(wb.values()))
                for i in a:
                    update(i, pull, wa[i])
                for i in b:
                    update(i, -pull, wb[i])
    return {i: weight(i) for i in z}


@pytest.mark.parametrize("settings", [linear.Settings(l1=0.05), linear.Settings(l1=0.05, ngrams=1, stems=(3, 4), counterfactual=0.5)])
def test_fit_and_scores_match_a_plain_version(spark, settings):
    rng, texts = random.Random(9), []
    for _ in range(120):
        texts.append(" ".join(rng.choice("a woman man of grim the black white x1 y2 stone, river!".split()) for _ in range(rng.randrange(1, 15))))
    docs = [linear.tokens_of(t) for t in texts]
    other = [linear.swapped(d, settings.identity_terms, rng) if settings.counterfactual else None for d in docs]
    assert any(o for o in other) or not settings.counterfactual
    one = lambda t: linear.featurise([t], settings)[0]
    rows = [(one(d), None if o is None else one(o), int("grim" in d)) for d, o in zip(docs, other)]
    w = linear.fit(rows, settings)
    plain = plain_ftrl([(x.tolist(), None if y is None else y.tolist(), label) for x, y, label in rows], settings)
    assert abs(w[-1] - plain["bias"]) < 1e-5 and all(abs(w[i] - v) < 1e-5 for i, v in plain.items() if i != "bias")
    assert np.count_nonzero(w) == sum(abs(v) > 0 for v in plain.values())
    got = {r.doc_id: r.score for r in linear.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), w, 0.5, settings).collect()}
    for i, (x, _, _) in enumerate(rows):
        assert abs(got[i] - 1 / (1 + math.exp(-sum(plain.get(f, 0.0) for f in {*x.tolist(), "bias"})))) < 1e-4


def test_counterfactual_term_narrows_the_gap():
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        words = [rng.choice("a b c d e f g".split()) for _ in range(12)]
        bad = rng.random() < 0.5
        words.append("gay" if rng.random() < (0.9 if bad else 0.1) else "straight")
        if bad:
            words.append("slur")
        rows.append((words, int(bad)))
    gaps = []
    for weight in (0.0, 1.0):
        s = linear.Settings(l1=0.1, ngrams=1, counterfactual=weight)
        one = lambda t: linear.featurise([t], s)[0]
        w = linear.fit([(one(t), one(linear.swapped(t, s.identity_terms, rng)), y) for t, y in rows], s)
        gaps.append(abs(w[one(["gay"])].sum() - w[one(["straight"])].sum()))
    assert gaps[1] < gaps[0] / 2


def brute(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 90)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    monkeypatch.setattr(vectors, "FAN_IN", 2)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(500)] + [(600 + i, [0.5] * 8) for i in range(40)]
    rows += [(None, [1.0] * 8), (700, None), (701, [None] + [1.0] * 7), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (50, [9.0] * 8), (650, [1e3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in vectors.exact_top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    assert sorted(got) == sorted(brute(rows, 5))
    big = spark.createDataFrame([(0, [1e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 2.5])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:3] for r in vectors.exact_top_k(big, big.where("vec_id = 0"), 5).collect()] == [(1, 2), (2, 1)]
    assert vectors.exact_top_k(df.limit(0), df.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(0, [1e18, 1.0, -0.5]), (1, [1e18, 2.0, 0.001]), (2, [-1e18, 1.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|int"):  # scores beyond 64 bits
        vectors.exact_top_k(odd, odd.where("vec_id = 0"), 5).collect()
    far = spark.createDataFrame([(0, [1e17, 2e17]), (1, [2.0, -1.0]), (2, [0.0, 0.0]), (50, None)], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in vectors.exact_top_k(far, far.where("vec_id = 0"), 5).collect()] == [(1, 1, 0), (2, 2, 0)]
