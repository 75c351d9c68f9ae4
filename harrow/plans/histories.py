"""Queries on logs, sessions and text: requests in flight, values so far, searching, planning, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import text
from harrow.operators import diagnosis, history, pages, relevance, scripts, transcript
from harrow.plans import failures
from harrow.plans.scripts import _FILLS, _VISITS, FILL_PARAMS_SQL
from harrow.plans.transcripts import _PAGE, _SPACE, _messages, _sections
from harrow.sources import tables
from harrow.sources.tables import table

#: Events as a log of requests: a user is a session, and addresses are few, so that ends meet starts.
_LOG = """
SELECT user_id AS session_id, event_id AS ts, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'started' END AS kind, 'GET' AS method,
  'u' || CAST(event_id % 3 AS STRING) AS url FROM events
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by state, with how long they took."""
    return history.requests(_log(spark, sf_dir)).groupBy("session_id", "state").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


REQUESTS_SQL = f"""
WITH l AS ({_LOG}), r AS (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pt, lead(kind) OVER w AS nk FROM l WINDOW w AS (PARTITION BY session_id, method, url ORDER BY ts)), s AS (
  SELECT session_id, CASE WHEN kind = 'failed' THEN 'failed' ELSE 'completed' END AS state, CASE WHEN pk = 'started' THEN CAST(ts - pt AS DOUBLE) END AS duration FROM r WHERE kind = 'failed' OR (kind = 'finished' AND pk = 'started')
  UNION ALL SELECT session_id, 'pending', NULL FROM r WHERE kind = 'started' AND nk IS NULL)
SELECT session_id, state, count(*) AS n, sum(duration) AS total FROM s GROUP BY ALL
"""


def values_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different event types each user has had up to each event."""
    fills = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("step"), F.col("event_type").alias("value"))
    return history.fills_so_far(fills).select("session_id", "step", F.size("values").alias("n"))


SO_FAR_SQL = """
SELECT user_id AS session_id, event_id AS step, CAST(len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))) AS INTEGER) AS n FROM events
"""


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("step"), "event_type")
    return history.bounded(rows, 3)


BOUNDED_SQL = """
SELECT session_id, step, event_type FROM (SELECT user_id AS session_id, event_id AS step, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3
"""


def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document hold a word in any case."""
    return table(spark, sf_dir, "documents").select("doc_id", transcript.search_lines(F.col("text"), "The")["n"].alias("n"))


SEARCH_SQL = "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the'))) AS INTEGER) AS n FROM documents"


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document a sample of three slices of two lines shows, and the last of them."""
    s = transcript.sample_lines(F.col("text"), 3, 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.element_at(s, -1)["line"].alias("last"))


SAMPLES_SQL = """
WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), s AS (SELECT *, greatest(1, (n - 2) // 2) AS step FROM l)
SELECT doc_id, CAST(CASE WHEN n <= 6 THEN n ELSE 6 END AS INTEGER) AS n, CAST(CASE WHEN n <= 6 THEN n ELSE 2 * step + 2 END AS INTEGER) AS last FROM s
"""


def compression_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the compression of each conversation would begin and end."""
    return transcript.compression_plan(_messages(spark, sf_dir), "[SUMMARY]").select("conv_id", "start", "end", "n", "tokens")


PLANS_SQL = """
WITH m AS (SELECT conv_id, row_number() OVER w - 1 AS pos, role, lag(role) OVER w AS before, length(text) // 4 AS tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, sum(CASE WHEN role = 'user' AND before = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS after FROM m),
e AS (SELECT conv_id, coalesce(min(pos - 1) FILTER (role = 'user' AND before = 'assistant' AND after <= 5), count(*)) AS stop FROM p GROUP BY conv_id)
SELECT conv_id, 1 AS start, stop AS "end", count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM m JOIN e USING (conv_id) WHERE pos >= 1 AND pos < stop GROUP BY conv_id, stop
"""


def transcripts_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as text."""
    return transcript.serialised(_messages(spark, sf_dir))


SERIALISED_SQL = f"""
WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '--- Turn ' || n || ' ---' || chr(10) || chr(10) || CASE WHEN t = '' THEN '' ELSE 'ASSISTANT:' || chr(10) || t || chr(10) END
  WHEN t = '' OR (starts_with(t, '[Turn ') AND contains(t, 'remaining')) THEN '' ELSE 'USER: ' || t || chr(10) END, chr(10) ORDER BY turn) AS transcript FROM m GROUP BY conv_id
"""


def direct_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose id the reasoning names."""
    return relevance.direct_references(_sections(spark, sf_dir))


DIRECT_SQL = f"""
SELECT {_PAGE} AS page_id, 'item-' || lang || '-' || doc_id AS section_id FROM documents WHERE contains('look at item-en-1 and the thing about ' || {_PAGE}, 'item-' || lang || '-' || doc_id)
"""


def section_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", relevance.preview(F.col("text")).alias("preview"))


PREVIEWS_SQL = f"""
WITH s AS (SELECT doc_id, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM documents), c AS (SELECT *, regexp_replace(replace(t, chr(10), ' '), ' {{2,}}', ' ', 'g') AS c FROM s),
h AS (SELECT *, left(c, 80) AS head, right(c, 80) AS tail FROM c), i AS (SELECT *, 80 - strpos(reverse(head), ' ') AS last, strpos(tail, ' ') - 1 AS first FROM h)
SELECT doc_id, '[preview: "' || CASE WHEN length(c) <= 160 THEN c ELSE CASE WHEN contains(head, ' ') AND last > 40 THEN left(head, last) ELSE head END || '... ··· ...'
  || CASE WHEN first > 0 AND first < 40 THEN substr(tail, first + 2) ELSE tail END END || '" | ' || length(t) || ' chars]' AS preview FROM i
"""


def fill_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on addresses that carry what was filled in."""
    customers = table(spark, sf_dir, "customer")
    own = lambda sql: spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customers)
    visits = own(_VISITS)
    return scripts.hints(scripts.matched_params(visits, own(_FILLS)), visits)


HINTS_SQL = f"""
WITH m AS ({FILL_PARAMS_SQL}), v AS ({_VISITS}), p AS (
  SELECT visit_id, split_part(x, '=', 1) AS key, regexp_replace(x, '^[^=]*=', '') AS value FROM (SELECT visit_id, unnest(string_split(regexp_extract(url_after, '\\?([^#]*)', 1), '&')) AS x FROM v)
), o AS (
  SELECT visit_id, key || '=' || value AS shown, row_number() OVER (PARTITION BY visit_id ORDER BY key || '=' || value) AS n FROM p WHERE NOT (key = 'page' AND value = '1') AND (visit_id, key) NOT IN (SELECT (visit_id, key) FROM m)
), others AS (SELECT visit_id, chr(10) || '  (' || string_agg(shown, ', ' ORDER BY n) || ', etc.)' AS rest FROM o WHERE n <= 5 GROUP BY visit_id),
notes AS (SELECT visit_id, string_agg('  "' || fill_value || '"  →  ' || key, chr(10) ORDER BY '  "' || fill_value || '"  →  ' || key) AS lines FROM m GROUP BY visit_id)
SELECT visit_id, 'After the form was sent, the page went to:' || chr(10) || '  ' || url_after || chr(10) || 'These inputs appear in its parameters:' || chr(10) || lines || coalesce(rest, '') AS hint
FROM notes JOIN v USING (visit_id) LEFT JOIN others USING (visit_id)
"""


def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by mode and whether the pages they saw would pass the gate."""
    seen = diagnosis.examined(failures.attempts(spark, sf_dir)).where("not success")
    runs = seen.groupBy("run_id", "mode").agg(F.collect_list("page_result").alias("p"))
    return runs.groupBy("mode", diagnosis.page_gate(F.col("p"), F.col("mode"))["passes"].alias("passes")).agg(F.count("*").alias("n"))


GATES_SQL = f"""
SELECT mode, CASE WHEN bad THEN false WHEN mode IN ('cautious', 'balanced') THEN real = total ELSE real >= greatest(2, floor((2 * total + 2) / 3)) END AS passes, count(*) AS n FROM (
  SELECT run_id, mode, count(*) AS total, count(*) FILTER (page_result = 'real_page') AS real, bool_or(page_result = 'anti_bot') AS bad FROM ({failures._FAILED}) GROUP BY run_id, mode) GROUP BY ALL
"""


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all repeated groups of pages."""
    return pages.group_members(table(spark, sf_dir, "pages"))


def inside_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes inside an article, by tag."""
    nodes = pages.node_table(table(spark, sf_dir, "pages"))
    return history.inside_marked(nodes, nodes.where("tag = 'article'")).groupBy("tag").agg(F.count("*").alias("n"))


def class_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of pages and whether they look generated."""
    nodes = pages.node_table(table(spark, sf_dir, "pages"))
    return pages.unstable_classes(nodes.select(F.explode(F.split(F.col("attrs")["class"], r"\s+")).alias("name")))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short hash of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", tables.content_hash(F.col("text")).alias("hash"))


HASH_SQL = "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents"


def size_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of sources for people: a short number, a share, a bar, and a sparkline of the languages' sizes."""
    by = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.length("text")).alias("chars"))
    rows = by.groupBy("source").agg(F.sum("chars").alias("chars"), F.transform(F.array_sort(F.collect_list(F.struct("lang", "chars"))), lambda x: x["chars"].cast("double")).alias("parts"))
    whole = Window.partitionBy()  # one row a source
    return rows.select("source", text.short_number(F.col("chars")).alias("size"), text.percent(F.col("chars"), F.sum("chars").over(whole)).alias("share"), text.bar(F.col("chars"), F.max("chars").over(whole), 10).alias("bar"), text.sparkline(F.col("parts")).alias("by_lang"))


SIZE_SQL = """
WITH l AS (SELECT source, lang, sum(length(text)) AS n FROM documents GROUP BY ALL), s AS (SELECT source, sum(n) AS n, list(n ORDER BY lang) AS parts, list_min(list(n)) AS low, list_max(list(n)) AS high FROM l GROUP BY source),
w AS (SELECT *, sum(n) OVER () AS total, max(n) OVER () AS most FROM s)
SELECT source, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS size, printf('%5.1f%%', n / total * 100) AS share,
  repeat('█', CAST(floor(n / most * 10) AS INT)) || repeat('░', 10 - CAST(floor(n / most * 10) AS INT)) AS bar,
  array_to_string(list_transform(parts, lambda x: ['▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][1 + CAST(floor((x - low) / CASE WHEN high = low THEN 1 ELSE high - low END * 7) AS INT)]), '') AS by_lang FROM w
"""

QUERIES = {
    f.__name__: f
    for f in (
        request_states, values_so_far, bounded_history, line_search, line_samples, compression_plans, transcripts_serialised, direct_references, section_previews, fill_hints, page_gates,
        group_members, inside_articles, class_stability, content_hashes, size_lines,
    )
}
SQL = {
    "request_states": REQUESTS_SQL, "values_so_far": SO_FAR_SQL, "bounded_history": BOUNDED_SQL, "line_search": SEARCH_SQL, "line_samples": SAMPLES_SQL, "compression_plans": PLANS_SQL,
    "transcripts_serialised": SERIALISED_SQL, "direct_references": DIRECT_SQL, "section_previews": PREVIEWS_SQL, "fill_hints": HINTS_SQL, "page_gates": GATES_SQL, "content_hashes": HASH_SQL, "size_lines": SIZE_SQL,
}
