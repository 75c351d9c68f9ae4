"""Plain texts that gate patterns, typed columns against VARIANT, and dictionaries of class words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from harrow.functions import failures, pages, sanitize
from harrow.functions.regex import folded, has, has_any, held, java, let
from harrow.operators import contract, history, relevance
from harrow.operators.contract import Field

EVERY = [(p, "") for p in (*failures.TIME_LIMIT, *failures.INFRASTRUCTURE, *failures.CRASHES, *failures.CALL_LOG_STATE, *failures.SELECTORS, failures.DRIVER_LINE)]
EVERY += [(p, "m") for p in (*failures.PARSE_ERRORS, failures.PYTHON_ERROR, failures.ANY_ERROR)] + [(what, "") for _, _, kind, what in pages.PROVIDERS if kind == "content"] + [(p, "") for p, _ in pages.GENERIC]
EVERY += [(p.replace(r"\x{2019}", "’"), "i") for _, _, p, c in pages.NON_CONTENT]


def some_match(pattern, flags, rng):
    """A text that the pattern matches, made by walking it."""
    from re import _constants as op
    from re import _parser as parser

    def make(items):
        out = ""
        for what, value in items:
            if what is op.LITERAL:
                out += chr(value)
            elif what is op.SUBPATTERN:
                out += make(value[3])
            elif what in (op.MAX_REPEAT, op.MIN_REPEAT):
                out += "".join(make(value[2]) for _ in range(max(value[0], min(value[1], value[0] + rng.randrange(2)))))
            elif what is op.BRANCH:
                out += make(rng.choice(value[1]))
            elif what is op.ANY:
                out += "z"
            elif what in (op.IN, op.NOT_LITERAL):
                out += next(c for c in ["a", "7", " ", "_", *map(chr, range(33, 127)), "’"] if re.fullmatch(parser_text(what, value), c, re.I if "i" in flags else 0))
        return out

    def parser_text(what, value):
        if what is op.NOT_LITERAL:
            return f"[^{re.escape(chr(value))}]"
        text = ""
        for k, v in value:
            names = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_SPACE: r"\s", op.CATEGORY_WORD: r"\w", op.CATEGORY_NOT_SPACE: r"\S"}
            text += "^" if k is op.NEGATE else re.escape(chr(v)) if k is op.LITERAL else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}" if k is op.RANGE else names[v]
        return f"[{text}]"

    return make(parser.parse(pattern, re.I if "i" in flags else 0))


def test_matches_hold_what_they_must():
    rng, told = random.Random(1), 0
    for pattern, flags in EVERY:
        must, low = held(pattern, flags)
        told += bool(must)
        for _ in range(5):
            text = some_match(pattern, flags, rng)
            if re.search(pattern, text, re.I if "i" in flags else re.M):
                assert must in (text.lower() if low else text), (pattern, text)
    assert told > len(EVERY) / 2
    assert held("a|bc") == ("", False) and held(r"ab(?:cd)?ef{2}g")[0] in ("ab", "ef") and held(r"(?i)Ab\s+Cde") == ("cde", True) and held(r"\Qx\E") == ("", False)


def test_gated_patterns_agree_with_plain_ones(spark):
    rng = random.Random(2)
    texts = [some_match(p, f, rng) for p, f in EVERY for _ in range(2)] + ["", None, "Acceſſ  denied", "RATE  LıMIT", "rate limİt", "nothing"]
    texts += [t.upper() for t in texts if t] + [t.lower() for t in texts if t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    checks, gate = {}, lambda p, f: lambda s: has(s["text"], p, f, s)
    for i, (p, f) in enumerate(EVERY):
        plain = F.coalesce(F.col("t").rlike(java(p, f)), F.lit(False))
        gated = let(folded(F.col("t")), gate(p, f))
        checks[f"c{i}"] = F.count_if(~plain.eqNullSafe(gated))
    checks["any"] = F.count_if(~has_any(F.col("t"), failures.CRASHES).eqNullSafe(F.coalesce(F.col("t").rlike("(?Ud)" + "|".join(failures.CRASHES)), F.lit(False))))
    assert {k: v for k, v in df.agg(*[c.alias(k) for k, c in checks.items()]).first().asDict().items() if v} == {}


def test_typed_columns_agree_with_variant(spark):
    """Errors of a table are those of its rows as VARIANT, whatever the types of the columns."""
    rows = [(1, 5, 2.5, "abc", True, 7.0), (2, None, float("nan"), None, None, 1.5), (3, 50, 1e20, "x" * 60, False, float("inf")), (4, -3, -0.00001, "", True, -2.0), (5, 10, 100.0, "Q", None, None)]
    df = spark.createDataFrame(rows, "k long, i int, d double, s string, b boolean, f float")
    rules = {
        "i": Field(int, min=0, max=20), "d": Field(float, min=0, max=1000), "s": Field(str, pattern="^[a-z]", min_length=2, max_length=40), "b": bool, "f": Field(int, min=0), "k": Field(str, optional=True), "none": int,
        "maybe": Field(str, optional=True),
    }
    rules2 = {"s": Field(float), "i": Field(bool), "b": Field(str, enum=["True"]), "d": Field(str), "f": Field(float, max=3)}
    for r in (rules, rules2):
        got = sorted(map(tuple, contract.validate_table(df, r, "k").collect()), key=str)
        node = contract.parse(r)
        record = F.to_variant_object(F.struct(*[F.col(n) for n in node.fields if n in df.columns]))
        path = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]"))
        want = df.select(F.col("k").alias("ord"), F.explode(contract.errors(record, node, path)).alias("e")).select("ord", "e.*")
        assert got == sorted(map(tuple, want.collect()), key=str) and got
    nested = df.select("k", F.struct("i").alias("n"), "d")
    assert [r.path for r in contract.validate_table(nested, {"n": {"i": Field(int, max=20)}, "d": Field(float, max=1)}, "k").where("ord = 3").collect()] == ["[3].n.i", "[3].d"]


def test_plain_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id as v").write.parquet(f"{tmp_path}/t")
    plan = contract.validate_table(spark.read.parquet(f"{tmp_path}/t"), {"v": Field(int, max=5, optional=True)}, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "to_variant_object" not in plan


def test_similarity_of_long_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.randrange(12))) for _ in range(120)] + [None, "", " \n"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)] + [(" ".join(f"w{i}" for i in range(20_000)), " ".join(f"w{i}" for i in range(10_000, 30_000)))]

    def plain(x, y):
        from collections import Counter

        a, b = Counter((x or "").split()), Counter((y or "").split())
        total = sum((a | b).values())
        return sum((a & b).values()) / total if total else 1.0

    got = [r[0] for r in spark.createDataFrame(pairs, "x string, y string").coalesce(1).select(relevance.similarity(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([plain(*p) for p in pairs])


def test_values_so_far_keep_their_order(spark):
    rows = [(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, "c"), (2, 1, "a")]
    got = history.fills_so_far(spark.createDataFrame(rows, "session_id long, step int, value string")).orderBy("session_id", "step").collect()
    assert [r["values"] for r in got] == [["b"], ["b", "a"], ["b", "a"], ["b", "a"], ["b", "a", "c"], ["a"]]


def test_dictionary_of_class_words(tmp_path):
    """A name that looks generated by its letters is kept where a dictionary knows its words."""
    (tmp_path / "words.txt").write_text("quux\nzyxwvt\n")
    words = sanitize.read_words(str(tmp_path / "words.txt"))
    name = "zyxwvt-quux5x"
    assert "footer" in sanitize.CLASS_WORDS and words == {"quux", "zyxwvt"}
    assert sanitize.is_unstable_class(name) and not sanitize.is_unstable_class("zyxwvt-quux", words=words)
    assert sanitize.clean_classes('<a class="zyxwvt-quux">', words) == '<a class="zyxwvt-quux">'
