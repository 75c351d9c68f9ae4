"""Queries on failed runs. Attempts are derived from events by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import failures
from harrow.operators import diagnosis
from harrow.sources.tables import spread, table

#: Error texts by kind of failure; %d stands for a small number.
ERRORS = (
    "SyntaxError: invalid syntax",
    "ModuleNotFoundError: No module named 'helper'",
    "Script execution timed out after 120 seconds",
    "OSError: No space left on device",
    "Target page, context or browser has been closed",
    "Page.goto: net::ERR_NAME_NOT_RESOLVED at https://shop.example.com/list",
    "Page.goto: Timeout 30000ms exceeded.",
    'Page.click: Timeout 5000ms exceeded. Call log: waiting for locator("#buy") - element is not visible',
    'Page.click: Timeout 5000ms exceeded. Call log: waiting for locator(".card")',
    "Execution context was destroyed, most likely because of a navigation",
    "KeyError: 'price'",
    "AttributeError: 'NoneType' object has no attribute 'text_content'",
    "Script produced empty output file",
    "ValueError: could not convert string to float",
)
MODES = ("cautious", "balanced", "eager", "always")


def _pick(expression: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{str(v).replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE {expression} {cases} END"


_KIND = f"(CASE WHEN user_id % 3 = 0 THEN user_id ELSE event_id END) % {len(ERRORS)}"
#: Three events in a row are the attempts of a run.
ATTEMPTS = f"""
SELECT CAST(floor(event_id / 3) AS BIGINT) AS run_id, CAST(event_id % 3 + 1 AS INT) AS attempt_no, event_id % 41 = 0 AS success,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE {_pick(_KIND, ERRORS)} END AS error,
  CAST(CASE WHEN event_id % 97 = 0 THEN 137 WHEN event_id % 89 = 0 THEN 139 WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS INT) AS exit_code,
  CASE WHEN event_id % 34 = 0 THEN 'Expected at least 5 items, got 0' END AS schema_error,
  CAST(CASE WHEN event_id % 53 = 0 THEN 503 ELSE 200 END AS INT) AS http_status,
  CASE WHEN event_id % 59 = 0 THEN 'https://login.example.net/' ELSE 'https://www.example.com/list' END AS page_url,
  CASE WHEN event_id % 61 = 0 THEN '<html><p>Access Denied</p></html>' WHEN event_id % 67 = 0 THEN '<html><p>We will be right back</p></html>'
    ELSE '<html><p>{'Plenty of real goods. ' * 30}</p></html>' END AS content,
  'https://example.com/list' AS target_url, {_pick("CAST(floor(event_id / 3) AS BIGINT) % 4", MODES)} AS mode
FROM events
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(ATTEMPTS.replace("FROM events", "FROM {events}"), events=spread(table(spark, sf_dir, "events").select("event_id", "user_id")))
    return df.withColumn("headers", F.lit(None).cast("map<string,string>")).withColumn("cookies", F.lit(None).cast("array<map<string,string>>"))


def attempt_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by category and page verdict."""
    seen = diagnosis.examined(attempts(spark, sf_dir)).where("not success")
    return seen.groupBy("category", "page_result").agg(F.count("*").alias("n"))


_SILENT = "trim(coalesce(error, '')) = ''"
_CATEGORY = rf"""
CASE WHEN schema_error IS NOT NULL AND {_SILENT} AND exit_code = 0 THEN 'G'
  WHEN regexp_matches(error, '(?m)^(SyntaxError|IndentationError|TabError|ModuleNotFoundError|ImportError):') THEN 'A'
  WHEN regexp_matches(error, '(Script execution|Function) timed out after \d+ seconds') THEN 'F2'
  WHEN exit_code IN (137, -9) OR regexp_matches(error, 'No space left on device|Too many open files|Cannot open display') THEN 'F3'
  WHEN exit_code IN (139, 134, 135, -11, -6, -7) OR regexp_matches(error, 'Target page, context or browser has been closed|Page crashed|Target crashed') THEN 'F1'
  WHEN regexp_matches(error, 'net::ERR_\w+') OR regexp_matches(error, '(Page\.goto|Page\.reload|Page\.go_back|Page\.go_forward|Frame\.goto):\s+Timeout\s+\d+ms\s+exceeded') THEN 'C'
  WHEN regexp_matches(error, 'Execution context was destroyed|Frame was detached|strict mode violation:')
    OR (regexp_matches(error, '\b[A-Z]\w+\.\w+:\s+Timeout\s+\d+ms\s+exceeded') AND regexp_matches(error, '(?s)Call log:.*(intercepts pointer events|element is not visible|element is not enabled)')) THEN 'E'
  WHEN regexp_matches(error, '\b[A-Z]\w+\.\w+:\s+Timeout\s+\d+ms\s+exceeded') THEN 'D'
  WHEN schema_error IS NOT NULL AND {_SILENT} AND NOT (exit_code = 0) THEN 'G'
  ELSE 'B' END
"""
_VERDICT = r"""
CASE WHEN http_status >= 500 OR http_status = 429 THEN 'server_error'
  WHEN regexp_replace(regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') <> regexp_replace(regexp_extract(target_url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') THEN 'redirected'
  WHEN regexp_matches(content, '(?i)Access\s+Denied') THEN 'anti_bot'
  WHEN regexp_matches(content, '(?i)will\s+be\s+(right\s+)?back') THEN 'soft_block' ELSE 'real_page' END
"""
_FAILED = f"SELECT *, {_CATEGORY} AS category, {_VERDICT} AS page_result FROM ({ATTEMPTS}) WHERE NOT success"
CATEGORIES_SQL = f"SELECT category, page_result, count(*) AS n FROM ({_FAILED}) GROUP BY ALL"


def attempt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of failures and how often they occur."""
    seen = diagnosis.examined(attempts(spark, sf_dir)).where("not success").select("fingerprint.*")
    return seen.groupBy("category", "error_type", "method", "target").agg(F.count("*").alias("n"))


_TIMED = r"nullif(regexp_extract(error, '(\b[A-Z]\w+\.\w+):\s+Timeout\s+\d+ms\s+exceeded', 1), '')"
_SELECTOR = r"""nullif(regexp_extract(error, 'locator\(["'']([^"'']+)["'']\)', 1), '')"""
_FINGERPRINTED = rf"""
SELECT *,
  CASE category WHEN 'G' THEN 'SchemaValidationError' WHEN 'A' THEN regexp_extract(error, '^(\w+Error):', 1) WHEN 'F2' THEN 'SubprocessTimeout'
    WHEN 'F3' THEN CASE WHEN error LIKE '%No space left on device%' THEN 'DiskFull' ELSE 'InfrastructureError' END
    WHEN 'F1' THEN CASE WHEN regexp_matches(error, 'Browser.*closed') THEN 'BrowserClosed' ELSE 'ProcessDeath' END
    WHEN 'C' THEN coalesce(nullif(regexp_extract(error, '(net::ERR_\w+)', 1), ''), 'TimeoutError')
    WHEN 'E' THEN CASE WHEN error LIKE '%element is not visible%' THEN 'not_visible' ELSE 'context_destroyed' END
    WHEN 'D' THEN 'TimeoutError' ELSE nullif(regexp_extract(error, '^(\w+Error):', 1), '') END AS error_type,
  CASE WHEN category = 'C' AND NOT regexp_matches(error, 'net::ERR_') THEN {_TIMED} WHEN category IN ('D', 'E') THEN {_TIMED} END AS method,
  CASE WHEN category = 'G' THEN 'item_count < ' || regexp_extract(schema_error, 'at least (\d+)', 1)
    WHEN category = 'A' THEN nullif(regexp_extract(error, 'No module named ''([^'']+)''', 1), '')
    WHEN category = 'F2' THEN regexp_extract(error, 'timed out after (\d+) seconds', 1) || 's'
    WHEN category = 'C' THEN nullif(regexp_extract(error, 'net::ERR_\w+ at (\S+)', 1), '')
    WHEN category IN ('D', 'E') THEN {_SELECTOR}
    WHEN category = 'B' THEN coalesce(nullif(regexp_extract(error, 'has no attribute ''(\w+)''', 1), ''), nullif(regexp_extract(error, 'KeyError: ''([^'']+)''', 1), ''), {_SELECTOR}) END AS target
FROM ({_FAILED})
"""
FINGERPRINTS_SQL = f"SELECT category, error_type, method, target, count(*) AS n FROM ({_FINGERPRINTED}) GROUP BY ALL"


def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of runs of which every attempt failed: stability of all fingerprints and the weakest agreement of two."""
    seen = diagnosis.examined(attempts(spark, sf_dir)).where("not success")
    runs = seen.groupBy("run_id").agg(F.collect_list("fingerprint").alias("p"))
    told = runs.select("run_id", diagnosis.stability_of(F.col("p")).alias("stability"), diagnosis.weakest_level(F.col("p")).alias("weakest"))
    return told.groupBy("stability", "weakest").agg(F.count("*").alias("n"))


_PAIRS = """
SELECT a.run_id, min(CASE WHEN a.category <> b.category THEN 0 WHEN a.error_type IS DISTINCT FROM b.error_type OR a.method IS DISTINCT FROM b.method THEN 1
  WHEN a.target IS DISTINCT FROM b.target THEN 2 ELSE 3 END) AS level
FROM f a JOIN f b ON a.run_id = b.run_id AND a.attempt_no < b.attempt_no GROUP BY a.run_id
"""
STABILITY_SQL = f"""
WITH f AS ({_FINGERPRINTED}), p AS ({_PAIRS}), c AS (SELECT run_id, count(DISTINCT category) AS n, count(*) AS k FROM f GROUP BY run_id)
SELECT CASE WHEN k < 2 THEN NULL WHEN n >= 3 THEN 'chaotic' WHEN n = 2 THEN CASE WHEN k = 2 THEN 'chaotic' ELSE 'mixed' END WHEN level >= 2 THEN 'stable' ELSE 'consistent' END AS stability,
  CASE level WHEN 0 THEN 'none' WHEN 1 THEN 'same_category' WHEN 2 THEN 'same_kind' WHEN 3 THEN 'exact' END AS weakest, count(*) AS n
FROM c LEFT JOIN p USING (run_id) GROUP BY ALL
"""


def run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by mode, category, stability and what is decided."""
    told = diagnosis.diagnose(attempts(spark, sf_dir))
    return told.groupBy("mode", "succeeded", "category", "stability", "action").agg(F.count("*").alias("n"), F.sum("n_attempts").alias("n_attempts"))


DECISIONS_SQL = f"""
WITH f AS ({_FINGERPRINTED.replace("WHERE NOT success", "")}), k AS (
  SELECT *, CASE WHEN success OR category IN ('A', 'F3') OR (attempt_no = (SELECT min(attempt_no) FROM f g WHERE g.run_id = f.run_id) AND category = 'F2') THEN attempt_no END AS stop FROM f
), e AS (SELECT run_id, min(stop) AS stop FROM k GROUP BY run_id), h AS (
  SELECT k.*, e.stop AS end_no FROM k JOIN e USING (run_id) WHERE e.stop IS NULL OR attempt_no <= e.stop
), r AS (SELECT * FROM h WHERE page_result = 'real_page'), p AS (
  SELECT a.run_id, min(CASE WHEN a.category <> b.category THEN 0 WHEN a.error_type IS DISTINCT FROM b.error_type OR a.method IS DISTINCT FROM b.method THEN 1 ELSE 2 END) AS level
  FROM r a JOIN r b ON a.run_id = b.run_id AND a.attempt_no < b.attempt_no GROUP BY a.run_id
), c AS (SELECT run_id, count(DISTINCT category) AS n, count(*) AS k FROM r GROUP BY run_id), s AS (
  SELECT h.run_id, any_value(mode) AS mode, any_value(end_no) AS end_no, count(*) AS total, max(attempt_no) AS last, min(attempt_no) AS first,
    bool_or(success) AS succeeded, count(*) FILTER (page_result = 'real_page') AS real, bool_or(page_result = 'anti_bot') AS bad,
    coalesce(bool_or(category = 'E' AND error LIKE '%Execution context was destroyed%'), FALSE) AS gone,
    CASE WHEN any_value(end_no) IS NOT NULL THEN arg_max(category, attempt_no) ELSE arg_min(category, attempt_no) END AS category
  FROM h GROUP BY h.run_id
), t AS (
  SELECT s.*, CASE WHEN end_no IS NOT NULL OR coalesce(c.k, 0) < 2 THEN NULL WHEN c.n >= 3 THEN 'chaotic' WHEN c.n = 2 THEN CASE WHEN c.k = 2 THEN 'chaotic' ELSE 'mixed' END
    WHEN p.level >= 2 THEN 'stable' ELSE 'consistent' END AS stability
  FROM s LEFT JOIN c USING (run_id) LEFT JOIN p USING (run_id)
), d AS (
  SELECT *, CASE WHEN succeeded THEN NULL WHEN category = 'A' THEN 'regenerate' WHEN category IN ('C', 'F1', 'F2', 'F3') THEN 'raise' WHEN category = 'E' AND gone THEN 'raise'
    WHEN stability IN ('mixed', 'chaotic') OR bad OR real < greatest(2, floor((2 * total + 2) / 3)) OR stability IS NULL THEN 'raise'
    WHEN category IN ('B', 'G') THEN CASE WHEN real = total THEN 'regenerate' WHEN stability = 'stable' AND mode IN ('balanced', 'eager') THEN 'regenerate' WHEN mode = 'eager' THEN 'regenerate' ELSE 'raise' END
    WHEN stability = 'stable' AND real = total AND mode <> 'cautious' THEN 'regenerate' WHEN mode = 'eager' AND (stability = 'stable' OR real = total) THEN 'regenerate' ELSE 'raise' END AS action FROM t
)
SELECT mode, succeeded, CASE WHEN NOT succeeded THEN category END AS category, CASE WHEN NOT succeeded THEN stability END AS stability, action, count(*) AS n, CAST(sum(total) AS BIGINT) AS n_attempts FROM d GROUP BY ALL
"""


def diagnosis_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on every run that isn't repaired by itself."""
    return diagnosis.diagnose(attempts(spark, sf_dir)).where("not succeeded").select("run_id", "exception", "reason", "message")


def error_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of error texts, and how often."""
    rows = attempts(spark, sf_dir).where("not success").select(failures.error_summary(F.col("error")).alias("summary"))
    return rows.groupBy("summary").agg(F.count("*").alias("n"))


SUMMARIES_SQL = f"SELECT nullif(left(trim(error), 120), '') AS summary, count(*) AS n FROM ({ATTEMPTS}) WHERE NOT success GROUP BY ALL"

QUERIES = {f.__name__: f for f in (attempt_categories, attempt_fingerprints, run_stability, run_decisions, diagnosis_messages, error_summaries)}
SQL = {"attempt_categories": CATEGORIES_SQL, "attempt_fingerprints": FINGERPRINTS_SQL, "run_stability": STABILITY_SQL, "run_decisions": DECISIONS_SQL, "error_summaries": SUMMARIES_SQL}
