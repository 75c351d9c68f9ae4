"""Histories, short text, streams, and the later additions to transcripts and scripts."""

from pyspark.sql import functions as F

from harrow.functions import text
from harrow.operators import history, pages, scripts, transcript
from harrow.streaming import sessions

LOG = [(1, 1.0, "started", "GET", "a"), (1, 2.0, "started", "GET", "b"), (1, 3.0, "finished", "GET", "a"), (1, 4.0, "failed", "GET", "c"), (1, 5.0, "finished", "GET", "z")]


def test_short_text(spark):
    df = spark.createDataFrame([(1234, 1_500_000, [1.0, 2.0, 8.0], "claude-x")], "a long, b long, s array<double>, m string")
    r = df.select(text.short_number(F.col("a")).alias("a"), text.short_number(F.col("b")).alias("b"), text.sparkline(F.col("s")).alias("s"), text.percent(F.lit(1), F.lit(4)).alias("p"), text.bar(F.lit(1), F.lit(2), 4).alias("bar"), text.with_provider(F.col("m")).alias("m")).first()
    assert tuple(r) == ("1.2K", "1.5M", "▁▂█", " 25.0%", "██░░", "anthropic:claude-x")


def test_requests(spark):
    df = spark.createDataFrame(LOG, "session_id long, ts double, kind string, method string, url string")
    got = sorted((r.url, r.state, r.duration) for r in history.requests(df).collect())
    assert got == [("a", "completed", 2.0), ("b", "pending", None), ("c", "failed", None)]
    fills = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "session_id long, step int, value string")
    assert [r["values"] for r in history.fills_so_far(fills).orderBy("step").collect()] == [["x"], ["x", "y"], ["x", "y"]]
    assert history.bounded(fills, 2).count() == 2 and history.since(df, 3.0, "ts").count() == 3
    nodes = pages.node_table(spark.createDataFrame([(1, "<div><p><b>x</b></p><i>y</i></div>")], "page_id long, html string"))
    inside = history.inside_marked(nodes, nodes.where("tag = 'p'")).collect()
    assert [r.tag for r in inside] == ["b"]


def test_inside_marked_by_a_condition(spark):
    df = spark.createDataFrame([(1, "<ul><li><b>x</b></li></ul><p>y</p>"), (2, None), (3, "<div><p><ul><li></li></ul></p></div>")], "page_id long, html string")
    every = pages.node_table(df)
    narrow = pages.node_table(df, ("node_id", "tag", "subtree_end"))
    assert narrow.columns == ["page_id", "node_id", "tag", "subtree_end"]
    assert sorted(narrow.collect()) == sorted(every.select(narrow.columns).collect())
    rows = lambda found: sorted(tuple(r) for r in found.select("page_id", "node_id", "tag").collect())
    by_condition = history.inside_marked(narrow, F.col("tag") == "ul")
    assert rows(by_condition) == rows(history.inside_marked(every, every.where("tag = 'ul'"))) == [(1, 2, "li"), (1, 3, "b"), (3, 3, "li")]
    plan = by_condition._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # each page is parsed once


def test_searching(spark):
    body = "\n".join(f"line {i}" + (" Needle" if i in (5, 6) else "") for i in range(200))
    df = spark.createDataFrame([(body,)], "t string")
    r = df.select(transcript.search_lines(F.col("t"), "needle", 1).alias("s"), transcript.sample_lines(F.col("t")).alias("p"), transcript.view_lines(F.col("t"), 3, 4).alias("v")).first()
    assert r.s.n == 2 and [(h.line, h.start) for h in r.s.hits] == [(6, 5), (7, 6)] and r.s.hits[0].text.split("\n")[1].endswith("Needle")
    assert len(r.p) == 7 * 15 and r.p[0].line == 1 and r.v == "line 2\nline 3"


def test_checklists_and_dumps(spark):
    answers = ["x\n```checklist\n[ ] a\n```", "**Step 4: list**\n```\n[ ] b\n```", "t\n[ ] fields:\n- one\nend\n- no\n[ ] c", "just text "]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, t string")
    assert [r.c for r in df.select("i", scripts.checklist(F.col("t")).alias("c")).orderBy("i").collect()] == ["[ ] a", "[ ] b", "[ ] fields:\n    - one\n[ ] c", "just text"]
    code = spark.createDataFrame([("h = await page.content()",), ("page.inner_html('body')",), ("page.inner_html('.a')",)], "c string")
    assert [r.d for r in code.select(pages.raw_dump(F.col("c")).alias("d")).collect()] == ["page.content()", '.inner_html("html"/"body")', None]
    visits = spark.createDataFrame([(1, None, "http://a/?q=Berlin&n=3")], "visit_id long, url_before string, url_after string")
    fills = spark.createDataFrame([(1, "fill", "berlin", 1)], "visit_id long, action string, value string, line int")
    hint = scripts.hints(scripts.matched_params(visits, fills), visits).first().hint
    assert '  "berlin"  →  q' in hint and hint.endswith("(n=3, etc.)")


def test_planning(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * 4000) for i in range(30)]
    m = transcript.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plan = transcript.compression_plan(m, "[SUMMARY]").first()
    assert (plan.start, plan.end, plan.worth_it) == (1, 19, True)
    assert transcript.summary_halves(m).first().cut == 17
    said = transcript.conversation_summary(m).first().summary
    assert said.startswith("### USER (message 1)") and "... (truncated) ..." in said
    past = spark.createDataFrame([(1, 1, "s" * 2000, "no", 0, "out")], "job_id long, attempt_no int, script string, feedback string, exit_code int, output string")
    assert "reviewing attempt 2 of 3" in transcript.attempt_history(past, 3).first().history


def _run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    views = [(1, 1, "a b c d e"), (1, 2, "a b c d e"), (1, 3, "a b c d x"), (1, 4, "q r s t u"), (2, 1, "")]
    spark.createDataFrame(views, "conv_id long, turn long, text string").write.json(f"{tmp_path}/v")
    _run(sessions.full_analyses(spark.readStream.schema("conv_id long, turn long, text string").json(f"{tmp_path}/v")), "views")
    assert sorted(tuple(r) for r in spark.sql("select * from views").collect()) == [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, True)]
    schema = "session_id long, ts double, kind string, method string, url string"
    spark.createDataFrame(LOG, schema).write.json(f"{tmp_path}/l")
    _run(sessions.closed_requests(spark.readStream.schema(schema).json(f"{tmp_path}/l")), "reqs")
    assert sorted((r.url, r.state) for r in spark.sql("select * from reqs").collect()) == [("a", "completed"), ("c", "failed")]
    schema = "ts timestamp, url string, target_url string, status int, html string"
    page = "<p>" + "word " * 200 + "</p>"
    rows = [(f"2024-01-01 00:0{i}:00", "http://a.com", "http://a.com", 200 if i else 503, page) for i in range(4)] + [("2024-01-01 02:00:00", "http://a.com", "http://a.com", 200, page)]
    spark.createDataFrame(rows, "ts string, url string, target_url string, status int, html string").write.json(f"{tmp_path}/c")
    _run(sessions.verdict_counts(spark.readStream.schema(schema).json(f"{tmp_path}/c")), "verdicts")
    assert sorted((r.verdict, r.n) for r in spark.sql("select * from verdicts").collect()) == [("real_page", 3), ("server_error", 1)]


def test_tool_summary(spark):
    calls = spark.createDataFrame([("a", 30, "xx", False), ("a", 10, "x", True), ("b", 60, None, False)], "name string, duration_ms long, content string, is_error boolean")
    got = {r.name: (r.n, r.total_ms, r.max_ms, r.chars, r.errors, r.share) for r in transcript.tool_summary(calls).collect()}
    assert got == {"a": (2, 40, 30, 3, 1, 0.4), "b": (1, 60, 60, 0, 0, 0.6)}
    saved = spark.createDataFrame([(100, 25), (100, 50)], "total_page_chars long, filtered_page_chars long")
    assert transcript.filter_savings(saved).first().saved == 0.625


def test_idle_state_is_dropped(spark, tmp_path):
    """A session heard of again after its time limit starts anew; the query itself has no end and is stopped."""
    schema = "conv_id long, turn long, text string"
    (tmp_path / "v").mkdir()
    views = spark.readStream.schema(schema).json(f"{tmp_path}/v")
    q = sessions.full_analyses(views, idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for turn in (1, 2):
            (tmp_path / f"{turn}.json").write_text(f'{{"conv_id": 1, "turn": {turn}, "text": "a b c d e"}}\n')
            (tmp_path / f"{turn}.json").rename(tmp_path / "v" / f"{turn}.json")
            for _ in range(40):
                if spark.sql("select * from idle").count() >= turn:
                    break
                q.awaitTermination(0.5)
            q.awaitTermination(4)
        assert sorted(tuple(r) for r in spark.sql("select * from idle").collect()) == [(1, 1, True), (1, 2, True)]
    finally:
        q.stop()
