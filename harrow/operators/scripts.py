"""Static analysis of scripts as tables, and parameters of addresses that match what was filled in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from harrow.functions import scripts, urls
from harrow.functions.regex import grab, strip

SELECTOR_SCHEMA = "script_id long, selector string, selector_type string, action_category string, action string, line int, source string, in_loop boolean, after_navigation boolean"
FILL_SCHEMA = "script_id long, action string, value string, line int"
CONTAINED = 4


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"script_id": i, **row} for i, *args in zip(*(c.to_pylist() for c in batch.columns)) for row in make(*args)]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def _dict(pairs) -> dict | None:
    return dict(pairs) if pairs is not None else None


def selectors(code: DataFrame) -> DataFrame:
    """Selectors of scripts (script_id, code), one row each."""
    return _rows(code.select(F.col("script_id").cast("long"), "code"), scripts.selectors, SELECTOR_SCHEMA)


def fill_values(code: DataFrame) -> DataFrame:
    """Values that scripts (script_id, code, inputs map) fill in, one row each."""
    return _rows(code.select(F.col("script_id").cast("long"), "code", "inputs"), lambda c, i: scripts.fill_values(c, _dict(i)), FILL_SCHEMA)


def timeouts(code: DataFrame) -> DataFrame:
    """Predicted time limit of scripts (script_id, code, functions map)."""
    return _rows(code.select(F.col("script_id").cast("long"), "code", "functions"), lambda c, f: [{"timeout_s": scripts.predicted_timeout(c, _dict(f))}], "script_id long, timeout_s double")


def effective_timeout(asked: Column, predicted: Column) -> Column:
    return F.coalesce(F.greatest(predicted, F.least(F.greatest(asked, F.lit(scripts.LEAST)), F.lit(scripts.MOST))), predicted)


def signature_problems(code: DataFrame) -> DataFrame:
    """(script_id, problem): why scripts can't be run; null if they can."""
    return _rows(code.select(F.col("script_id").cast("long"), "code"), lambda c: [{"problem": scripts.signature_problem(c)}], "script_id long, problem string")


def known_functions(steps: DataFrame) -> DataFrame:
    """(session_id, name, source): functions that the steps (session_id, step, code) of sessions define; the last wins."""
    parsed = _rows(
        steps.select(F.col("session_id").cast("long"), "step", "code"), lambda s, c: [{"step": s, "name": n, "source": src} for n, src in scripts.function_sources(c).items()], "script_id long, step int, name string, source string"
    )
    return parsed.groupBy(F.col("script_id").alias("session_id"), "name").agg(F.max_by("source", "step").alias("source"))


def last_fenced_code(text: Column) -> Column:
    """The last fenced block of Python in a text."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)?[ \t]*\n(.*?)```"), F.lit(1)), F.lit(-1))


def changed_params(visits: DataFrame) -> DataFrame:
    """Parameters (visit_id, key, values) that an address after (url_after) has and the one before has not, or has with other values."""
    side = lambda url: visits.select("visit_id", F.posexplode(urls.query_pairs(F.coalesce(F.col(url), F.lit("")))).alias("i", "p")).groupBy("visit_id", F.col("p.key").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("p.value").alias("v")))), lambda x: x["v"]).alias("values"))
    after, before = side("url_after"), side("url_before").withColumnRenamed("values", "old")
    return after.join(before, ["visit_id", "key"], "left").where("old is null or old <> values").drop("old")


def matched_params(visits: DataFrame, fills: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(visit_id, key, value, action, fill_value, how): clean changed parameters that equal a filled value, contain one of
    four characters or more, or equal an input; in this order of preference, the first value and the first fill.

    fills has (visit_id, action, value, line), inputs (visit_id, name, value). All joins are on visit_id; a visit has few
    parameters and fills, so the containment test runs within it."""
    norm = lambda c: F.lower(strip(c))
    params = changed_params(visits).where(urls.param_class(F.col("key"), F.col("values")) == "clean")
    values = params.select("visit_id", "key", F.posexplode("values").alias("i", "value")).withColumn("norm", norm(F.col("value")))
    once = fills.withColumn("norm", norm(F.col("value"))).where("norm <> ''")
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("visit_id", "norm").orderBy("line"))).where("n = 1")
    once = once.select("visit_id", "action", F.col("value").alias("fill_value"), "line", F.col("norm").alias("fill_norm"))
    near = values.join(once, "visit_id").where((F.col("norm") == F.col("fill_norm")) | ((F.length("fill_norm") >= CONTAINED) & F.contains("norm", F.col("fill_norm"))))
    found = near.select("visit_id", "key", "i", "value", "action", "fill_value", "line", F.when(F.col("norm") == F.col("fill_norm"), 0).otherwise(1).alias("rank"))
    if inputs is not None:
        own = inputs.select("visit_id", F.concat(F.lit("input:"), "name").alias("action"), F.col("value").alias("fill_value"), norm(F.col("value")).alias("norm")).where("norm <> ''")
        found = found.unionByName(values.join(own, ["visit_id", "norm"]).select("visit_id", "key", "i", "value", "action", "fill_value", F.lit(0).alias("line"), F.lit(2).alias("rank")))
    best = Window.partitionBy("visit_id", "key").orderBy("i", "rank", "line", "action")
    how = F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("input")), F.col("rank") + 1)
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("visit_id", "key", "value", "action", "fill_value", how.alias("how"))


def hints(matched: DataFrame, visits: DataFrame) -> DataFrame:
    """(visit_id, hint): a note on the parameters of an address that match what was filled in, and up to five others."""
    left = F.when(F.startswith("action", F.lit("input:")), F.concat(F.lit('inputs["'), F.substring_index("action", ":", -1), F.lit('"]'))).otherwise(F.concat(F.lit('"'), "fill_value", F.lit('"')))
    notes = matched.groupBy("visit_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), left, F.lit("  →  "), "key"))), "\n").alias("lines"))
    rest = changed_params(visits).join(matched.select("visit_id", "key"), ["visit_id", "key"], "left_anti")
    shown = F.array_join(F.slice(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.element_at("values", 1)))), 1, 5), ", ")
    others = rest.groupBy("visit_id").agg(F.concat(F.lit("\n  ("), shown, F.lit(", etc.)")).alias("others"))
    both = notes.join(others, "visit_id", "left").join(visits.select("visit_id", "url_after"), "visit_id")
    head = F.concat(F.lit("After the form was sent, the page went to:\n  "), "url_after", F.lit("\nThese inputs appear in its parameters:\n"))
    return both.select("visit_id", F.concat(head, "lines", F.coalesce("others", F.lit(""))).alias("hint"))


def complex_hints(visits: DataFrame) -> DataFrame:
    """(visit_id, hint): a note on addresses that carry inputs in a structured parameter."""
    found = changed_params(visits).where(urls.param_class(F.col("key"), F.col("values")) == "complex").groupBy("visit_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))
    return found.join(visits.select("visit_id", "url_after"), "visit_id").select("visit_id", F.concat(F.lit("After the form was sent, the page went to:\n  "), "url_after", F.lit("\nInputs seem to be encoded in: "), "keys").alias("hint"))


def selectors_in_loops(found: DataFrame, loops: DataFrame) -> DataFrame:
    """found with in_loop, for loops (script_id, start, end, moves) as a table: a range join within a script."""
    hit = found.alias("s").join(loops.where("moves").alias("l"), F.expr("s.script_id = l.script_id and s.line between l.start and l.end"), "left_semi").select("script_id", "selector", "line").distinct().withColumn("hit", F.lit(True))
    return found.drop("in_loop").join(hit, ["script_id", "selector", "line"], "left").withColumn("in_loop", F.coalesce("hit", F.lit(False))).drop("hit")


def checklist(text: Column) -> Column:
    """The checklist in an answer: its fenced block, else what follows the heading of step 4, else the lines with boxes
    (and the dashed lines under one on fields), else all of it."""
    step = grab(text, r"\*\*Step\s*4[^*]*\*\*[^\n]*\n(.*)", 1, "s")
    bare = strip(F.regexp_replace(F.regexp_replace(strip(step), r"^```\w*\s*\n?", ""), r"\n?```\s*$", ""))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def walk(state: Column, line: Column) -> Column:
        box, item = line.startswith("[ ]"), line.startswith("- ") & state["inside"]
        kept = F.when(box, F.array(line)).when(item, F.array(F.concat(F.lit("    "), line))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(box, F.lower(line).contains("field")).otherwise(item).alias("inside"), F.concat(state["out"], kept).alias("out"))

    boxes = F.aggregate(F.transform(F.split(text, "\n"), strip), start, walk, lambda s: F.array_join(s["out"], "\n"))
    return F.coalesce(strip(grab(text, r"```checklist\s*\n(.*?)```", 1, "s")), bare, F.when(boxes != "", boxes), strip(text))
