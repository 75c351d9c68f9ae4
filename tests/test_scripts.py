"""Static script analysis, sources and transcript stages."""

from pyspark.sql import functions as F

from harrow.functions import scripts
from harrow.operators import relevance, transcript
from harrow.operators import scripts as ops
from harrow.sources import tables

CODE = '''
async def scrape(page, start_url, checkpoint):
    await page.goto(start_url)
    # page.click(".comment")
    await page.fill("#q", "Berlin")
    box = page.locator(".box")
    for i in range(20):
        await page.click(".next")
        await box.click()
    n = await page.locator(".a >> b").inner_text()
    await page.get_by_label("City").fill("Paris")
    await page.evaluate("() => { const b = document.querySelector('#go'); b.click(); document.getElementById('x'); }")
    await page.keyboard.type("typed")
    await page.locator("s").select_option(value="two")
    await page.fill("#d", str(inputs["day"]))
'''


def test_selectors():
    got = {(r["selector"], r["line"]): r for r in scripts.selectors(CODE)}
    assert {s for s, _ in got} == {"#q", ".next", ".box", ".a >> b", "City", "#go", "#x", "s", "#d"}
    assert got[".next", 8]["in_loop"] and got[".next", 8]["after_navigation"] and got[".next", 8]["action_category"] == "navigating"
    assert got[".box", 9]["action"] == "click" and got["#go", 12]["action_category"] == "navigating" and got["#x", 12]["action_category"] == "passive"
    assert got[".a >> b", 10]["selector_type"] == "playwright" and not got["#q", 5]["in_loop"]
    assert scripts.selectors(None) == []


def test_fill_values():
    got = [(r["action"], r["value"]) for r in scripts.fill_values(CODE, {"day": 7})]
    assert got == [("fill", "Berlin"), ("fill", "Paris"), ("keyboard.type", "typed"), ("select_option", "two"), ("fill", "7")]


def test_timeouts():
    assert scripts.predicted_timeout("x = = 1") == 30 and scripts.predicted_timeout("") == 30
    assert scripts.predicted_timeout("for i in range(100):\n    page.click('a')") == 1.5 * 225
    assert scripts.predicted_timeout("page.goto('a')\n" * 4) == 60
    assert scripts.predicted_timeout("async def f():\n    for i in range(10):\n        await g()") == 90
    assert scripts.predicted_timeout("f()", {"f": "def f():\n    pass\n\n" + "page.goto('x')\n" * 4}) == 60
    assert scripts.predicted_timeout("await page.wait_for_timeout(90000)") == 135
    assert scripts.effective_timeout(10, 40) == 40 and scripts.effective_timeout(9000, 40) == 3000 and scripts.effective_timeout(None, 40) == 40


def test_signature_and_inputs():
    assert scripts.signature_problem(CODE) is None and "not async" in scripts.signature_problem("def scrape(page): pass")
    assert scripts.signature_problem("x") == "no function named scrape" and scripts.signature_problem("x = = 1").startswith("syntax error")
    assert scripts.check_inputs({"a": "float", "b": "str"}, {"a": 1, "b": "x"}) == {"a": 1.0, "b": "x"}
    for declared, given in (({"a": "int"}, {}), ({"a": "int"}, {"a": 1.5}), ({}, {"b": 1})):
        try:
            scripts.check_inputs(declared, given)
            raise AssertionError
        except (ValueError, TypeError):
            pass
    assert scripts.normalise_inputs({"a": 1, "b": "x"}) == {"a": ("int", 1), "b": ("str", "x")}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, CODE, {"day": "7"}, None)], "script_id long, code string, inputs map<string,string>, functions map<string,string>")
    assert ops.selectors(df).count() == len(scripts.selectors(CODE)) and ops.fill_values(df).count() == 5 and ops.timeouts(df).first().timeout_s > 30
    steps = spark.createDataFrame([(1, 1, "def f():\n    return 1"), (1, 2, "def f():\n    return 2")], "session_id long, step int, code string")
    assert ops.known_functions(steps).first().source.endswith("2")
    visits = spark.createDataFrame([(1, "http://a/?p=1", "http://a/?p=1&q=Berlin+Mitte&d=7&utm_source=x#/s?c=paris")], "visit_id long, url_before string, url_after string")
    fills = spark.createDataFrame([(1, "fill", "berlin", 1), (1, "fill", " PARIS ", 2)], "visit_id long, action string, value string, line int")
    inputs = spark.createDataFrame([(1, "day", "7")], "visit_id long, name string, value string")
    got = {r.key: r.how for r in ops.matched_params(visits, fills, inputs).collect()}
    assert got == {"q": "contains", "c": "exact", "d": "input"}
    text = spark.createDataFrame([("a<<1>>b", '"""\nurl: http://x\\\\y\ntask: two\\nlines\nbad\n"""\ncode', "a (int), b (list), c (str)")], "t string, c string, i string")
    r = text.select(tables.between_markers(F.col("t"), "<<", ">>").alias("m"), tables.script_metadata(F.col("c")).alias("d"), tables.input_types(F.col("i")).alias("i")).first()
    assert (r.m.value, r.m.rest) == ("1", "ab") and r.d["url"] == "http://x\\y" and r.d["task"] == "two\nlines" and r.i == {"a": "int", "c": "str"}
    saved = spark.createDataFrame([("http://a/x", "t", " code ")], "url string, task string, code string")
    tables.save_scripts(saved, f"{tmp_path}/s")
    tables.save_scripts(saved, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == spark.read.parquet(f"{tmp_path}/s.bak").count() == 1
    (tmp_path / "cp").mkdir()
    for n, body in ((2, '{"id": "CP-2", "title": "two"}'), (10, '{"id": "CP-10"}'), (3, "{broken")):
        (tmp_path / "cp" / f"CP-{n}.json").write_text(body)
    assert [r.number for r in tables.read_checkpoints(spark, f"{tmp_path}/cp").collect()] == [2, 10]


def test_ageing(spark):
    view = "=== Page State #1 | http://a ===\n\n--- [one] content (1 interactive) ---\nfull text\n\n--- [two] list (0 interactive) ---\n[omitted]\n\n[3 sections omitted]\n__SECTION_META__\none|9|1|content|full text||\ntwo|40|0|list|start|end|a \"x\"\n__SECTION_META_END__"
    text = f"before\n__PAGE_VIEW_START__\n__TURN_3__\n{view}\n__PAGE_VIEW_END__ after"
    df = spark.createDataFrame([(t, text) for t in (3, 5, 8)], "turn int, text string")
    full, skeleton, stub = [r.t for r in df.select("turn", transcript.aged_view(F.col("text"), F.col("turn")).alias("t")).orderBy("turn").collect()]
    assert full == text and "[skeleton]" in skeleton and '[preview: "start ··· ...end" | 40 chars | a "x"]' in skeleton and "full text" in skeleton
    assert "[stub]" in stub and "2 sections, 1 kept: one" in stub and stub.startswith("before\n__PAGE_VIEW_START__") and stub.endswith("__PAGE_VIEW_END__ after")
    zoom = spark.createDataFrame([("a __ZOOM_START__|s1|\n__TURN_1__\nl1\nl2__ZOOM_END__ b",)], "t string")
    got = zoom.select(transcript.aged_zooms(F.col("t"), F.lit(9)).alias("old"), transcript.aged_zooms(F.col("t"), F.lit(2)).alias("new")).first()
    assert "Zoom stub for sections: s1 — 3 lines condensed" in got.old and got.new == zoom.first().t


def test_relevance(spark):
    el = "struct<tag:string,attributes:map<string,string>,classes:array<string>,element_text:string,full_tag_str:string>"
    rows = [(1, "s1", 1, ("a", {"data-testid": "buy-button"}, ["card"], "Buy", "<a>"), 'click data-testid="buy-button" now'), (1, "s2", 2, ("a", {"href": "/x"}, [], "Other", "<a>"), "nothing")]
    df = spark.createDataFrame(rows, f"page_id int, section_id string, ord int, element {el}, reasoning string")
    got = relevance.matched_elements(df).collect()
    assert [(r.section_id, r.score, r.signature) for r in got] == [("s1", 1.0, "a|data-testid=buy-button")]
    one = spark.createDataFrame([("a b b", "b c", "researching", "x" * 50 + " " + "y" * 200)], "x string, y string, z string, long string")
    r = one.select(relevance.similarity(F.col("x"), F.col("y")).alias("s"), relevance.boundary_match(F.lit("search"), F.col("z")).alias("m"), relevance.preview(F.col("long")).alias("p"), relevance.cut_at_word(F.lit("aaa bbb ccc"), 6).alias("c"), relevance.cut_at_word_reverse(F.lit("aaa bbb ccc"), 9).alias("d")).first()
    assert r.s == 1 / 4 and not r.m and r.p.startswith('[preview: "') and r.p.endswith("251 chars]") and r.c == "aaa bb..." and r.d == "...bbb ccc"
