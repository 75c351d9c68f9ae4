"""Queries on pages made from customers by an expression that Spark and DuckDB read alike: well-formed HTML whose nodes, text
and groups SQL can state. k, customers' keys modulo 5, is the number of items in a page's list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import failures as kinds
from harrow.functions import pages as verdicts
from harrow.operators import history, pages, scripts
from harrow.sources import tables
from harrow.sources.tables import table

_ITEM = '<li class="item css-1a2b3c"><b>no</b></li>'
_PAGES = f"""
SELECT c_custkey AS page_id, 'https://shop.example.com/c/' || CAST(c_custkey AS STRING) AS url, c_custkey % 5 AS k, c_mktsegment AS segment, c_custkey,
  '<html><head><title>Shop</title><style>.x</style></head><body><div data-hidden="true"><a href="/x">skip</a></div><h1>Customer ' || CAST(c_custkey AS STRING) || '</h1><ul class="items">'
  || repeat('{_ITEM}', CAST(c_custkey % 5 AS INT)) || '</ul><article class="offer"><h2>Segment</h2><p>Goods <b>' || c_mktsegment || '</b> here</p></article>'
  || '<form><input name="q" type="text"><button>Go</button></form><div class="note" onclick="x()">Bye</div><script>a=1</script></body></html>' AS html
FROM customer
"""


def _pages(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    return spark.sql(_PAGES.replace("FROM customer", "FROM {customer}"), customer=dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")))


#: Nodes of a page: its number if no item comes before it, else counted from 9 + 2 k on; parent, place, depth and tag.
_NODES = f"""
WITH c AS ({_PAGES}), fixed(n, parent, pos, depth, tag, hidden) AS (VALUES (0, NULL, 0, 0, 'html', false), (1, 0, 0, 1, 'head', true), (2, 1, 0, 2, 'title', true), (3, 1, 1, 2, 'style', true),
  (4, 0, 1, 1, 'body', false), (5, 4, 0, 2, 'div', true), (6, 5, 0, 3, 'a', true), (7, 4, 1, 2, 'h1', false), (8, 4, 2, 2, 'ul', false)),
after(n, parent, pos, depth, tag, hidden) AS (VALUES (0, NULL, 3, 2, 'article', false), (1, 0, 0, 3, 'h2', false), (2, 0, 1, 3, 'p', false), (3, 2, 0, 4, 'b', false), (4, NULL, 4, 2, 'form', false),
  (5, 4, 0, 3, 'input', false), (6, 4, 1, 3, 'button', false), (7, NULL, 5, 2, 'div', false), (8, NULL, 6, 2, 'script', true)),
nodes AS (
  SELECT page_id, n AS node_id, parent AS parent_id, pos, depth, tag, hidden FROM c, fixed
  UNION ALL SELECT page_id, 9 + 2 * i, 8, i, 3, 'li', false FROM (SELECT page_id, unnest(range(k)) AS i FROM c)
  UNION ALL SELECT page_id, 10 + 2 * i, 9 + 2 * i, 0, 4, 'b', false FROM (SELECT page_id, unnest(range(k)) AS i FROM c)
  UNION ALL SELECT page_id, 9 + 2 * k + n, CASE WHEN parent IS NULL THEN 4 ELSE 9 + 2 * k + parent END, pos, depth, tag, hidden FROM c, after
)
"""


def catalog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every page."""
    return pages.node_table(_pages(spark, sf_dir)).select("page_id", "node_id", "parent_id", "pos", "depth", "tag")


NODES_SQL = f"{_NODES} SELECT page_id, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(pos AS INTEGER) AS pos, CAST(depth AS INTEGER) AS depth, tag FROM nodes"


def catalog_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible nodes of every page."""
    return pages.visible_nodes(pages.node_table(_pages(spark, sf_dir))).select("page_id", "node_id", "tag")


VISIBLE_SQL = f"{_NODES} SELECT page_id, CAST(node_id AS INTEGER) AS node_id, tag FROM nodes WHERE NOT hidden"


def catalog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three or more equal siblings."""
    return pages.repeated_groups(pages.node_table(_pages(spark, sf_dir)))


GROUPS_SQL = f"SELECT page_id, CAST(8 AS INTEGER) AS parent_id, 'li|css-1a2b3c.item|b:0' AS signature, CAST(k AS BIGINT) AS n, CAST(9 AS INTEGER) AS first_node FROM ({_PAGES}) WHERE k >= 3"


def catalog_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of repeated groups."""
    return pages.group_members(_pages(spark, sf_dir))


MEMBERS_SQL = f"{_NODES} SELECT page_id, CAST(node_id AS INTEGER) AS node_id, CAST(8 AS INTEGER) AS parent_id, CAST(0 AS INTEGER) AS group_no FROM nodes JOIN c USING (page_id) WHERE tag = 'li' AND k >= 3"


def catalog_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lie in an article or a list."""
    nodes = pages.node_table(_pages(spark, sf_dir, tables.spread), ("node_id", "tag", "subtree_end"))
    return history.inside_marked(nodes, F.col("tag").isin("article", "ul")).select("page_id", "node_id", "tag")


ARTICLES_SQL = f"{_NODES} SELECT page_id, CAST(node_id AS INTEGER) AS node_id, tag FROM nodes JOIN c USING (page_id) WHERE node_id BETWEEN 9 AND 8 + 2 * k OR node_id BETWEEN 10 + 2 * k AND 12 + 2 * k"

_TEXT = "'Customer ' || c_custkey || repeat(chr(10) || chr(10) || 'no', CAST(k AS INT)) || chr(10) || chr(10) || 'Segment' || chr(10) || chr(10) || 'Goods ' || segment || ' here' || chr(10) || chr(10) || 'Go' || chr(10) || chr(10) || 'Bye'"


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every page."""
    return pages.page_text(_pages(spark, sf_dir)).select("page_id", "text")


TEXT_SQL = f"SELECT page_id, {_TEXT} AS text FROM ({_PAGES})"


def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, which is one section, under its header."""
    df = _pages(spark, sf_dir).select("page_id", "url", "html")
    return pages.page_view(pages.page_sections(df), df)


_SECTION = "'--- [h1-customer-' || c_custkey || '-segment] list (0 interactive) ---' || chr(10)"
VIEWS_SQL = f"SELECT page_id, '=== Page State #' || page_id || ' | ' || url || ' ===' || chr(10) || chr(10) || {_SECTION} || {_TEXT} || chr(10) AS view FROM ({_PAGES})"


def catalog_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page cleaned, white space at line beginnings left out."""
    return pages.cleaned(_pages(spark, sf_dir)).select("page_id", F.regexp_replace("html", r"\n\s*", "\n").alias("html"))


_LINES = ("<html>", "<body>", '<div data-hidden="true">', '<a href="/x">', "skip", "</a>", "</div>", "<h1>")
_MORE = ("</ul>", '<article class="offer">', "<h2>", "Segment", "</h2>", "<p>", "Goods", "<b>")
_REST = ("</b>", "here", "</p>", "</article>", "<form>", '<input name="q" type="text">', "<button>", "Go", "</button>", "</form>", '<div class="note">', "Bye", "</div>", "</body>", "</html>", "")
_ITEM_LINES = ('<li class="item">', "<b>", "no", "</b>", "</li>", "")


def _lines(lines: tuple[str, ...]) -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in lines)


CLEAN_SQL = f"""
SELECT page_id, {_lines(_LINES)} || chr(10) || 'Customer ' || c_custkey || chr(10) || '</h1>' || chr(10) || '<ul class="items">' || chr(10) || repeat({_lines(_ITEM_LINES)}, CAST(k AS INT))
  || {_lines(_MORE)} || chr(10) || segment || chr(10) || {_lines(_REST)} AS html
FROM ({_PAGES})
"""


def catalog_interactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactive elements of every page."""
    return pages.element_lines(pages.interactive_elements(_pages(spark, sf_dir))).select("page_id", "iid", "tag", "text", "selector")


INTERACTIVE_SQL = """
SELECT c_custkey AS page_id, CAST(iid AS INTEGER) AS iid, tag, text, 'body > form > ' || tag AS selector FROM customer, (VALUES (1, 'input', ''), (2, 'button', 'Go')) e(iid, tag, text)
"""


def catalog_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names and whether they look generated."""
    nodes = pages.node_table(_pages(spark, sf_dir))
    return pages.unstable_classes(nodes.select(F.explode(F.split(F.col("attrs")["class"], r"\s+")).alias("name")))


CLASSES_SQL = f"SELECT DISTINCT name, name LIKE 'css-%' AS unstable FROM (SELECT unnest(CASE WHEN k > 0 THEN ['items', 'item', 'css-1a2b3c', 'offer', 'note'] ELSE ['items', 'offer', 'note'] END) AS name FROM ({_PAGES}))"


# ---- checkpoints, saved scripts, answers -------------------------------------------------------------------------------


def checkpoint_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as checkpoints, some with a preview of their data."""
    preview = F.when(F.col("k") == 2, F.concat(F.lit("segment="), "segment"))
    return pages.checkpoint_views(_pages(spark, sf_dir).select(F.col("page_id").alias("number"), "url", "html", preview.alias("data_preview")))


_CLEAN_TEXT = _TEXT.replace("'Goods ' || segment || ' here'", "'Goods' || chr(10) || chr(10) || segment || chr(10) || chr(10) || 'here'")
CHECKPOINT_VIEWS_SQL = f"""
SELECT page_id, '=== Page State #' || page_id || ' | ' || url || ' ===' || chr(10) || chr(10) || {_SECTION} || {_CLEAN_TEXT} || chr(10)
  || CASE WHEN k = 2 THEN chr(10) || '--- [data-preview] data (0 interactive) ---' || chr(10) || 'segment=' || segment || chr(10) ELSE '' END AS view FROM ({_PAGES})
"""


def checkpoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as checkpoints, one line each."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("number"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 3 > 0, F.repeat(F.col("c_name"), (F.col("c_custkey") % 4).cast("int"))).alias("title"),
        (F.col("c_custkey") % 7).cast("int").alias("element_count"), (F.col("c_custkey") / 8).alias("timestamp_s"),
    )
    return pages.checkpoint_summary(rows)


CHECKPOINT_LINES_SQL = """
WITH c AS (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN repeat(c_name, CAST(c_custkey % 4 AS INT)) ELSE '' END AS title FROM customer)
SELECT CAST(c_custkey AS INTEGER) AS number, 'CP-' || c_custkey || '  ' || c_mktsegment || '  ' || CASE WHEN length(title) > 50 THEN left(title, 47) || '...' ELSE title END || '  (' || (c_custkey % 7) || ' elements, '
  || (c_custkey * 10 + 4) // 80 || '.' || ((c_custkey * 10 + 4) // 8) % 10 || 's)' AS line FROM c
"""


def answer_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fenced block of Python in answers."""
    said = (
        "CASE c_custkey % 4 WHEN 0 THEN 'no code ' || c_name WHEN 1 THEN 'a ```python\nx = 1\n``` b ```py\ny = ' || c_custkey || '\n``` c' WHEN 2 THEN '```\n' || c_name || '\n```' ELSE '```js\nz\n``` ```python\n\n```' END"
    )
    return table(spark, sf_dir, "customer").select("c_custkey", scripts.last_fenced_code(F.expr(said)).alias("code"))


ANSWER_SQL = "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'y = ' || c_custkey || chr(10) WHEN 2 THEN c_name || chr(10) WHEN 3 THEN chr(10) END AS code FROM customer"


def saved_script_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of saved scripts no longer agrees with what is asked."""
    m = lambda n: F.col("c_custkey") % n == 0
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("https://www.shop.example.com/a").alias("url"), F.when(m(2), "https://shop.example.com:443/b").otherwise("https://other.example.com/b").alias("asked_url"), F.lit(" list ").alias("task"),
        F.when(m(3), "list").otherwise("lists").alias("asked_task"), F.when(~m(7), "s").alias("schema_hash"), F.when(~m(5), "s").alias("asked_schema_hash"), F.col("c_name").alias("code"),
        F.when(m(11), "0").otherwise(tables.content_hash(F.col("c_name"))).alias("content_hash"),
    )
    return tables.drift(rows).select("c_custkey", F.array_join("drift", ",").alias("drift"))


DRIFT_SQL = """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'domain' END, CASE WHEN c_custkey % 3 <> 0 THEN 'task' END, CASE WHEN (c_custkey % 7 = 0) <> (c_custkey % 5 = 0) THEN 'schema' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'code' END) AS drift FROM customer
"""


def transient_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, by whether a failed one may succeed when repeated."""
    status = F.when(F.col("event_id") % 9 == 8, None).otherwise(F.element_at(F.array(*map(F.lit, (200, 404, 429, 499, 500, 503, 400, 401))), (F.col("event_id") % 9 + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select(status.alias("status"))
    return rows.groupBy("status", kinds.is_transient(F.col("status")).alias("transient")).agg(F.count("*").alias("n"))


TRANSIENT_SQL = """
SELECT status, status IS NOT NULL AND status IN (429, 500, 503) AS transient, count(*) AS n
FROM (SELECT CASE WHEN event_id % 9 < 8 THEN CAST([200, 404, 429, 499, 500, 503, 400, 401][event_id % 9 + 1] AS INTEGER) END AS status FROM events) GROUP BY ALL
"""


def antibot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What headers and cookies of responses tell, names of headers in any case."""
    case = F.col("c_custkey") % 9
    one = lambda i, k, v: F.when(case == i, F.create_map(F.lit(k), F.lit(v)))
    headers = F.coalesce(
        one(0, "CF-Mitigated", "Challenge"), one(1, "cf-mitigated", "no"), one(2, "X-DD-B", "1"), one(3, "X-CDN", "incapsula"), one(4, "x-cdn", "other"), one(5, "X-Amzn-WAF-Action", "captcha"), one(6, "x-kasada", "")
    )
    jar = lambda name: F.array(F.create_map(F.lit("name"), F.lit(name), F.lit("value"), F.lit("v")))
    cookies = F.when(F.col("c_custkey") % 4 == 0, jar("_abck")).when(F.col("c_custkey") % 4 == 1, jar("datadome")).when(F.col("c_custkey") % 4 == 2, jar("session"))
    content = F.when(F.col("c_custkey") % 6 > 0, F.lit("<p>" + "Plenty of goods. " * 40 + "</p>"))
    found = verdicts.detect_antibot(content, headers, cookies)
    return table(spark, sf_dir, "customer").select("c_custkey", found["provider"].alias("provider"), found["tier"].alias("tier"), found["pattern"].alias("pattern"))


ANTIBOT_SQL = """
WITH f AS (
  SELECT c_custkey, CASE WHEN c_custkey % 9 = 5 THEN ['aws_waf', 'x-amzn-waf-action header'] WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN ['cloudflare', 'cf-mitigated: challenge header']
    WHEN c_custkey % 4 = 0 THEN ['akamai', '_abck cookie'] WHEN c_custkey % 9 = 2 THEN ['datadome', 'x-dd-b header'] WHEN c_custkey % 4 = 1 THEN ['datadome', 'datadome cookie']
    WHEN c_custkey % 9 = 3 THEN ['imperva', 'x-cdn: Incapsula or x-iinfo header'] WHEN c_custkey % 9 = 6 THEN ['kasada', 'x-kasada header'] END AS f FROM customer
)
SELECT c_custkey, f[1] AS provider, CASE WHEN f IS NOT NULL THEN CAST(1 AS INTEGER) END AS tier, f[2] AS pattern FROM f
"""

QUERIES = {
    f.__name__: f
    for f in (
        catalog_nodes, catalog_visible, catalog_groups, catalog_members, catalog_articles, catalog_text, catalog_views, catalog_clean, catalog_interactive, catalog_classes, checkpoint_views,
        checkpoint_lines, answer_code, saved_script_drift, transient_failures, antibot_signals,
    )
}
SQL = {
    "catalog_nodes": NODES_SQL, "catalog_visible": VISIBLE_SQL, "catalog_groups": GROUPS_SQL, "catalog_members": MEMBERS_SQL, "catalog_articles": ARTICLES_SQL, "catalog_text": TEXT_SQL,
    "catalog_views": VIEWS_SQL, "catalog_clean": CLEAN_SQL, "catalog_interactive": INTERACTIVE_SQL, "catalog_classes": CLASSES_SQL, "checkpoint_views": CHECKPOINT_VIEWS_SQL,
    "checkpoint_lines": CHECKPOINT_LINES_SQL, "answer_code": ANSWER_SQL, "saved_script_drift": DRIFT_SQL, "transient_failures": TRANSIENT_SQL, "antibot_signals": ANTIBOT_SQL,
}
