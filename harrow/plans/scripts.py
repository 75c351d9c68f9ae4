"""Queries on scripts, made from customers by an expression as the tables hold no code, and on values that addresses carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import scripts
from harrow.sources.tables import table

#: A script by customer: what it fills in, how often it pages on and how it is declared differ.
_CODE = """
SELECT c_custkey AS script_id, CASE c_custkey % 7 WHEN 0 THEN 'def scrape(page, start_url, checkpoint):' WHEN 1 THEN 'async def scrape(page, start_url):' WHEN 2 THEN 'async def run(page):'
    ELSE 'async def scrape(page, start_url, checkpoint):' END
  || '\n    # page.click(".no")\n    await page.goto(start_url)\n    await page.fill("#q", "' || c_mktsegment || '")\n    for i in range(' || CAST(c_custkey % 90 AS STRING) || '):\n        await page.click(".next-' || CAST(c_nationkey AS STRING)
  || '")\n    return await page.locator(".row").all_inner_texts()\n' || CASE WHEN c_custkey % 7 = 3 THEN 'x = = 1\n' ELSE '' END AS code FROM customer
"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    return spark.sql(_CODE.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")).withColumn("inputs", none).withColumn("functions", none)


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of the customers' scripts."""
    return scripts.selectors(_code(spark, sf_dir))


SELECTORS_SQL = """
SELECT c_custkey AS script_id, selector, 'css' AS selector_type, category AS action_category, action, CAST(line AS INTEGER) AS line, 'python' AS source, in_loop, true AS after_navigation FROM (
  SELECT c_custkey, unnest([{'selector': '#q', 'category': 'mutating', 'action': 'fill', 'line': 4, 'in_loop': false}, {'selector': '.next-' || c_nationkey, 'category': 'navigating', 'action': 'click', 'line': 6, 'in_loop': true},
    {'selector': '.row', 'category': 'passive', 'action': 'all_inner_texts', 'line': 7, 'in_loop': false}], recursive := true) FROM customer)
"""


def fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the customers' scripts fill in."""
    return scripts.fill_values(_code(spark, sf_dir))


FILL_VALUES_SQL = "SELECT c_custkey AS script_id, 'fill' AS action, c_mktsegment AS value, CAST(4 AS INTEGER) AS line FROM customer"


def predicted_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time limits of the customers' scripts."""
    return scripts.timeouts(_code(spark, sf_dir))


#: Six seconds an await, of which the loop has as many as rounds, fifty at most (ten where the range is empty), half more, 30 at least.
TIMEOUT_SQL = """
SELECT c_custkey AS script_id, CAST(CASE WHEN c_custkey % 7 = 3 THEN 30 ELSE greatest(30, 1.5 * 6 * (3 + CASE WHEN c_custkey % 90 = 0 THEN 10 ELSE least(c_custkey % 90, 50) END)) END AS DOUBLE) AS timeout_s FROM customer
"""


def signature_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the customers' scripts."""
    return scripts.signature_problems(_code(spark, sf_dir))


SIGNATURE_SQL = """
SELECT c_custkey AS script_id, CASE c_custkey % 7 WHEN 0 THEN 'scrape is not async' WHEN 1 THEN 'parameters are (page, start_url), not (page, start_url, checkpoint)' WHEN 2 THEN 'no function named scrape'
  WHEN 3 THEN 'syntax error: invalid syntax' END AS problem FROM customer
"""


#: A visit by customer: what was filled in is the market segment, or its beginning, or the name's end.
_VISITS = """
SELECT c_custkey AS visit_id, 'https://shop.example.com/find?page=1' AS url_before,
  'https://shop.example.com/find?page=' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END || '&segment=' || c_mktsegment || '&utm_source=mail&name=' || c_name AS url_after FROM customer
"""
_FILLS = """
SELECT c_custkey AS visit_id, 'fill' AS action, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN substr(c_mktsegment, 1, 5) ELSE 'xyz' END AS value, 1 AS line FROM customer
UNION ALL SELECT c_custkey AS visit_id, 'type' AS action, CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE ' Customer ' END AS value, 2 AS line FROM customer
"""


def fill_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of addresses that match what was filled in, exactly or by containment."""
    customers = table(spark, sf_dir, "customer")
    own = lambda sql: spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customers)
    return scripts.matched_params(own(_VISITS), own(_FILLS))


FILL_PARAMS_SQL = f"""
WITH v AS ({_VISITS}), f AS ({_FILLS}), p AS (
  SELECT visit_id, split_part(x, '=', 1) AS key, regexp_replace(x, '^[^=]*=', '') AS value FROM (SELECT visit_id, unnest(string_split(regexp_extract(url_after, '\\?([^#]*)', 1), '&')) AS x FROM v)
), c AS (SELECT * FROM p WHERE NOT starts_with(key, 'utm_') AND NOT (key = 'page' AND value = '1')), m AS (
  SELECT c.visit_id, c.key, c.value, f.action, f.value AS fill_value, line, CASE WHEN lower(trim(c.value)) = lower(trim(f.value)) THEN 0 ELSE 1 END AS rank
  FROM c JOIN f ON c.visit_id = f.visit_id AND (lower(trim(c.value)) = lower(trim(f.value)) OR (length(trim(f.value)) >= 4 AND contains(lower(trim(c.value)), lower(trim(f.value)))))
), r AS (SELECT *, row_number() OVER (PARTITION BY visit_id, key ORDER BY rank, line, action) AS n FROM m)
SELECT visit_id, key, value, action, fill_value, CASE rank WHEN 0 THEN 'exact' ELSE 'contains' END AS how FROM r WHERE n = 1
"""

QUERIES = {f.__name__: f for f in (selectors, fill_values, predicted_timeout, signature_problems, fill_params)}
SQL = {"selectors": SELECTORS_SQL, "fill_values": FILL_VALUES_SQL, "predicted_timeout": TIMEOUT_SQL, "signature_problems": SIGNATURE_SQL, "fill_params": FILL_PARAMS_SQL}
