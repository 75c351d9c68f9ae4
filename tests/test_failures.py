"""Categories, fingerprints, page verdicts, stability and decisions on cases that follow from the rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from harrow.functions import failures, pages
from harrow.operators import diagnosis

CASES = [
    ("  File x\nSyntaxError: invalid syntax", 1, None, "A"), ("IndentationError: unexpected indent", 1, None, "A"), ("text ImportError: x", 1, None, "B"),
    ("Script execution timed out after 30 seconds", None, None, "F2"), ("", 137, None, "F3"), ("BrowserType.launch: Executable doesn't exist at /x", 1, None, "F3"), ("", 139, None, "F1"),
    ("patchright._impl._errors.TargetClosedError: Page.click: gone", 1, None, "F1"), ("Page.goto: net::ERR_CONNECTION_REFUSED at http://x/", 1, None, "C"),
    ("Page.goto: Timeout 30000ms exceeded.", 1, None, "C"), ("Page.click: Timeout 500ms exceeded.\nCall log:\n - <div class=o></div> intercepts pointer events", 1, None, "E"),
    ("Error: strict mode violation: locator resolved to 3 elements", 1, None, "E"), ("Locator.fill: Timeout 500ms exceeded.\nCall log:\n - waiting for locator(\"#x\")", 1, None, "D"),
    ("element is not visible", 1, None, "B"), ("", 0, "list is empty", "G"), ("   ", None, "x", "G"), ("ValueError: x", 0, "list is empty", "B"), ("", 0, None, "B"), ("", 1, "x", "G"),
    ('"SyntaxError: inner" while running route callback. Consider awaiting `page.unroute_all(behavior=\'ignoreErrors\')`\nbefore the end of the test to ignore remaining routes in flight.', 1, None, "B"),
]


def test_categories(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, e string, x int, s string, want string")
    bad = df.withColumn("got", failures.classify_error(F.col("e"), F.col("x"), F.col("s"))).where("got <> want").collect()
    assert bad == []


def test_fingerprints(spark):
    cases = [
        ("ModuleNotFoundError: No module named 'foo'", "A", None, ("ModuleNotFoundError", None, "foo")),
        ("Traceback\nKeyError: 'price'", "B", None, ("KeyError", None, "price")),
        ("AttributeError: 'NoneType' object has no attribute 'inner_text'", "B", None, ("AttributeError", None, "inner_text")),
        ("patchright._impl._errors.Error: Page.evaluate: TypeError: Cannot read x", "B", None, ("JS.TypeError", "Page.evaluate", None)),
        ("Page.goto: net::ERR_X_Y at http://a/b", "C", None, ("net::ERR_X_Y", None, "http://a/b")),
        ("Page.goto: Timeout 3ms exceeded", "C", None, ("TimeoutError", "Page.goto", None)),
        ('Page.click: Timeout 3ms exceeded\nCall log: waiting for locator("#go")', "D", None, ("TimeoutError", "Page.click", "#go")),
        ("Page.click: Timeout 3ms exceeded\n<div id=a></div> intercepts pointer events", "E", None, ("pointer_intercept", "Page.click", "<div>")),
        ("strict mode violation: locator resolved to 4 elements", "E", None, ("strict_mode", None, "resolved_to_4")),
        ("Function timed out after 90 seconds", "F2", None, ("SubprocessTimeout", None, "90s")),
        ("OSError: No space left on device", "F3", None, ("DiskFull", None, None)), ("Socket closed", "F1", None, ("SocketError", None, None)),
        ("", "G", "Expected at least 5 items, got 0", ("SchemaValidationError", None, "item_count < 5")), ("", "G", "Missing required field: 'price'", ("SchemaValidationError", None, "missing field: price")),
    ]
    df = spark.createDataFrame([(i, e, c, s) for i, (e, c, s, _) in enumerate(cases)], "i int, e string, c string, s string")
    got = df.select("i", failures.extract_fingerprint(F.col("e"), F.col("c"), F.col("s")).alias("f")).orderBy("i").collect()
    assert [(r.f.error_type, r.f.method, r.f.target) for r in got] == [c[3] for c in cases]


def test_verdicts(spark):
    real = "<html><body><p>" + "Real content. " * 60 + "</p></body></html>"
    rows = [
        (200, "https://www.shop.com/a", real, {}, [], "real_page"), (404, "http://shop.com/a", real, {}, [], "real_page"), (503, "http://shop.com", real, {}, [], "server_error"),
        (429, "http://shop.com", real, {}, [], "server_error"), (None, None, None, {}, [], "no_response"), (200, "http://other.com", real, {}, [], "redirected"),
        (200, "https://shop.com:8443/", real, {}, [], "redirected"), (200, "about:blank", real, {}, [], "redirected"), (200, "https://shop.com/", real, {"X-Amzn-Waf-Action": "c"}, [], "anti_bot"),
        (200, "https://shop.com/", real, {"CF-Mitigated": "Challenge"}, [], "anti_bot"), (200, "https://shop.com/", real, {}, [{"name": "_abck"}], "anti_bot"), (200, "https://shop.com/", None, {}, [{"name": "_abck"}], "real_page"),
        (200, "https://shop.com/", "<p>Access Denied</p>" + "x" * 600, {}, [], "anti_bot"), (200, "https://shop.com/", "<p>Access Denied</p>" + "x" * 11000, {}, [], "real_page"), (200, "https://shop.com/", "<html></html>", {}, [], "anti_bot"),
        (200, "https://shop.com/", "<script>x</script>" * 100, {}, [], "anti_bot"), (200, "https://shop.com/", "<p>a</p><input name=p type='password'>", {}, [], "soft_block"), (200, "https://shop.com/", "<p>We’ll be right back</p>", {}, [], "soft_block"),
        (200, "https://shop.com/", "<p>please slow down</p>", {}, [], "real_page"), (200, "https://shop.com/", "<p>please slow down and wait</p>", {}, [], "soft_block"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, st int, u string, c string, h map<string,string>, k array<map<string,string>>, want string")
    got = df.withColumn("got", pages.verify_page(F.col("st"), F.col("u"), F.col("c"), F.col("h"), F.col("k"), F.lit("https://shop.com/x")))
    assert [tuple(r) for r in got.where("got <> want").select("i", "got", "want").collect()] == []


DECISIONS = {  # rows reached with a stable or consistent pattern and enough real pages
    ("B", "stable", 3): "rrr", ("B", "stable", 2): "-rr", ("G", "consistent", 3): "rrr", ("G", "consistent", 2): "--r", ("D", "stable", 3): "-rr", ("E", "stable", 2): "--r", ("D", "consistent", 3): "--r", ("E", "consistent", 2): "---",
}


def test_decision_table(spark):
    rows = []
    for (category, stability, real), want in DECISIONS.items():
        for mode, w in zip(("cautious", "balanced", "eager"), want):
            rows.append((category, stability, ["real_page"] * real + ["redirected"] * (3 - real), mode, True, "regenerate" if w == "r" else "raise"))
    for mode in ("cautious", "eager"):
        rows += [("A", None, [], mode, True, "regenerate"), ("E", "stable", ["real_page"] * 3, mode, False, "raise"), ("B", "mixed", ["real_page"] * 3, mode, True, "raise"), ("B", "stable", ["real_page"] * 2 + ["anti_bot"], mode, True, "raise"), ("B", "stable", ["real_page", "soft_block", "redirected"], mode, True, "raise"), ("B", None, ["real_page"] * 3, mode, True, "raise")]
        rows += [(c, "stable", ["real_page"] * 3, mode, True, "raise") for c in ("C", "F1", "F2", "F3")]
    df = spark.createDataFrame(rows, "c string, s string, p array<string>, m string, e boolean, want string")
    got = df.withColumn("d", diagnosis.decide(F.col("c"), F.col("s"), F.col("p"), F.col("m"), F.col("e")))
    assert got.where("d.action <> want").collect() == []


@pytest.mark.parametrize("n", [2, 3])
def test_stability(spark, n):
    prints = [("B", "KeyError", None, "a"), ("B", "KeyError", None, "b"), ("B", "ValueError", None, None), ("D", "TimeoutError", "Page.click", "x")]
    cases = list(itertools.product(prints, repeat=n))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<struct<category:string,error_type:string,method:string,target:string>>")
    got = {r.i: r.s for r in df.select("i", diagnosis.stability_of(F.col("p")).alias("s")).collect()}
    for i, case in enumerate(cases):
        categories = [c[0] for c in case]
        if len(set(categories)) == 2:
            want = "chaotic" if n == 2 else "mixed"
        else:
            want = "stable" if len({c[1:3] for c in case}) == 1 else "consistent"
        assert got[i] == want


def test_diagnose(spark):
    page, ok = "<p>" + "text " * 300 + "</p>", "https://a.com/"
    rows = [
        (1, 1, False, "KeyError: 'a'"), (1, 2, False, "KeyError: 'a'"), (1, 3, False, "KeyError: 'b'"), (1, 4, True, None), (2, 1, False, "KeyError: 'a'"), (2, 2, True, None), (3, 1, False, "SyntaxError: x"),
        (3, 2, True, None), (4, 1, False, "KeyError: 'a'"), (4, 2, False, "ImportError: x"), (4, 3, True, None), (5, 1, False, "Page.click: Timeout 5ms exceeded"), (5, 2, False, "Frame was detached"), (5, 3, False, "Page.click: Timeout 5ms exceeded"),
    ]
    df = spark.createDataFrame([(r, n, s, e, 1, None, 200, ok, page, None, None, ok, "balanced") for r, n, s, e in rows], "run_id int, attempt_no int, success boolean, error string, exit_code int, schema_error string, http_status int, page_url string, content string, headers map<string,string>, cookies array<map<string,string>>, target_url string, mode string")
    got = {r.run_id: r for r in diagnosis.diagnose(df).collect()}
    assert (got[1].action, got[1].stability, got[1].n_attempts) == ("regenerate", "stable", 3) and "Error:    KeyError: 'a'" in got[1].message
    assert got[2].succeeded and got[2].action is None
    assert (got[3].action, got[3].category, got[3].n_attempts) == ("regenerate", "A", 1)
    assert (got[4].category, got[4].n_attempts) == ("A", 2)
    assert (got[5].action, got[5].stability, got[5].e_eligible, got[5].exception) == ("raise", "mixed", False, "timeout")


def test_words_don_t_change_what_is_found(spark):
    phrases = ["<INPUT type='PASSWORD'", "<title>Log In</title><form>", "Under  Maintenance", "we'll be back", "we’ll be right back", "We will be back", "temporarily unavailable", "scheduled downtime", "scheduled maintenance", "be right back", "experiencing difficulties", "under construction", "<title>x coming soon</title>", "<h1 a=b>coming soon</h1>", "too many requests", "rate limit", "you're browsing too fast", "slow down and wait", "<meta http-equiv='refresh'> moment", "not available in your area", "geo restricted", "regional restriction", "blocked in your country", "not accessible from your location", "account has been banned", "IP blocked", "address has been banned", "ſomething went wrong", "maıntenance mode", "nothing"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "i int, c string")
    plain = F.coalesce(*[F.when(pages.has(F.col("c"), p, "i") & (pages.has(F.col("c"), x, "i") if x else F.lit(True)), F.lit(label)) for _, label, p, x in pages.NON_CONTENT])
    got = df.select("i", pages.detect_non_content(F.col("c"))["pattern"].alias("got"), plain.alias("want")).collect()
    assert [tuple(r) for r in got if r.got != r.want] == [] and sum(r.got is not None for r in got) == len(phrases) - 1
