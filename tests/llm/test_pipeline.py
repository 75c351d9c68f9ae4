"""The corpus pipeline on planted documents, stage by stage against what each must do."""

import random

import pytest

import corpus_pipeline
from harrow.llm import linear


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(8), [], []
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(4))
    passage = " ".join(word() for _ in range(80))
    for i in range(300):
        words = [word() for _ in range(rng.choice([30, 120, 400]))]
        if i % 4 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        elif i % 7 == 0:
            words += passage.split()
        elif i % 11 == 0:
            words[3:3] = ["bob@mail.org", "+1", "(415)", "555-0134"]
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(i % 4 != 0), 0))
    near = rows[1][1].split()
    near[40:41] = ["other"]
    rows += [(300, " ".join(near), "en", "s", 0), (301, rows[2][1], "en", "s", 0), (302, None, "en", "s", 0), (303, "", None, None, None), (5, rows[5][1], "en", "src2", 0)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_copies":
            assert docs.where("doc_id = 5").count() == 1
    good = {i for i in range(300) if i % 4}
    assert set(seen["quality"]) >= good and len(set(seen["quality"]) & {i for i in range(0, 300, 4)}) < 8
    assert not {300, 301} & set(seen["near_copies"]) and set(seen["near_copies"]) >= good
    holders = sorted(i for i in seen["near_copies"] if i < 300 and i % 7 == 0 and i % 4)
    assert seen["repeated_passages"][holders[0]] == seen["near_copies"][holders[0]]
    for i in holders[1:]:
        assert 75 <= len(seen["near_copies"][i].split()) - len(seen["repeated_passages"][i].split()) <= 85
    clean = [i for i in good if i % 7 and i % 11 and i in seen["near_copies"]]
    assert all(seen["personal_data"][i] == seen["quality"][i] for i in clean)
    assert "[EMAIL] [PHONE]" in seen["personal_data"][11]


def test_run(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeated_passages", "personal_data", "pack"]
    out = corpus_pipeline.run(spark, folder)
    per_doc = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(per_doc) > 200
    assert max(r.n for r in out.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()) <= 1024


def test_accepted_agrees_with_scores(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights = linear.train(docs, labels, "quality", linear.QUALITY)
    want = sorted(r.doc_id for r in linear.score(docs, weights, 0.3, linear.QUALITY).where("predicted = 1").collect())
    assert sorted(r.doc_id for r in linear.accepted(docs, weights, 0.3, linear.QUALITY).collect()) == want


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in all columns, shared ids and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, own_id string, sig int, text_hash string, `a.b` int, cuts int, score double"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text, more = " ".join(f"word{i}" for i in range(80)), "".join(f" more{i}" for i in range(40))
    rows = [(1, text), (1, "other words under the same id as that text"), (2, None), (None, text), (None, None), (3, ""), (4, text + " mail a@b.org" + more), (4, "x " * 90), (5, "y " + text), (5, "y " + text)]
    full = spark.createDataFrame([(*r, *[None] * 9) for r in rows], schema)
    for docs, n in ((full, [10, 8, 8, 8]), (full.limit(0), [0, 0, 0, 0])):
        for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], n):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.count() == want, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
        if n[0]:
            assert sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) == sorted([(1, text), (1, rows[1][1]), (2, ""), (0, text), (0, ""), (3, ""), (4, " mail [EMAIL]" + more), (4, "x " * 90)])
