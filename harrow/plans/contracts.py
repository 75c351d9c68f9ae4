"""Queries on contracts: rows of the order tables and JSON of events against declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import contract
from harrow.operators.contract import Field, Items
from harrow.sources.tables import table

ORDERS = {
    "o_orderkey": Field(int, min=0),
    "o_totalprice": Field(float, min=1000, max=200000),
    "o_orderstatus": Field(str, enum=["O", "F"]),
    "o_orderpriority": Field(str, max_length=8),
    "o_clerk": Field(str, optional=True),
}
CUSTOMERS = {"c_custkey": int, "c_name": Field(str, pattern="[05]$"), "c_acctbal": Field(float, min=0, optional=True), "c_mktsegment": str, "c_phone": str}
PROPS = {"k": Field(int, min=10, max=90)}


def contract_orders_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of orders by kind of message."""
    rows = contract.validate_table(table(spark, sf_dir, "orders"), ORDERS, "o_orderkey")
    said = F.regexp_replace("message", r"value is [-0-9.]+|\"[^\"]*\"(?= is not)|has \d+", "#")
    return rows.groupBy(F.regexp_replace("path", r"\[\d+\]", "[*]").alias("pattern"), said.alias("message"), "error_kind").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("n_rows"))


ORDERS_SQL = """
WITH e AS (
  SELECT o_orderkey AS k, '[*].o_totalprice' AS pattern, '#, must be between 1000 and 200000' AS message, 'constraint' AS error_kind FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 200000
  UNION ALL SELECT o_orderkey, '[*].o_orderstatus', 'value # is not one of the allowed values: "O", "F"', 'constraint' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT o_orderkey, '[*].o_orderpriority', 'string # characters, maximum is 8', 'constraint' FROM orders WHERE length(o_orderpriority) > 8
)
SELECT pattern, message, error_kind, count(*) AS n, count(DISTINCT k) AS n_rows FROM e GROUP BY ALL
"""


def contract_grouped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of customers' errors with their first position and three examples."""
    groups = contract.grouped(contract.validate_table(table(spark, sf_dir, "customer"), CUSTOMERS, "c_custkey"))
    shown = lambda field: F.array_join(F.transform("examples", lambda e: e[field]), ",")
    return groups.select("pattern", "message", "error_kind", F.col("count").alias("n"), "first_ord", shown("path").alias("paths"), shown("value").alias("values"))


GROUPED_SQL = """
WITH e AS (
  SELECT c_custkey AS ord, 'c_name' AS f, 'string "' || c_name || '" does not match pattern [05]$' AS message, 'constraint' AS error_kind, '"' || c_name || '"' AS value FROM customer WHERE NOT regexp_matches(c_name, '[05]$')
  UNION ALL SELECT c_custkey, 'c_acctbal', 'value is ' || CAST(c_acctbal AS VARCHAR) || ', must be >= 0', 'constraint', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, 'c_phone', 'missing required field', 'missing', NULL FROM customer
), r AS (SELECT *, row_number() OVER (PARTITION BY f, message ORDER BY ord) AS rank FROM e)
SELECT '[*].' || f AS pattern, message, error_kind, count(*) AS n, min(ord) AS first_ord, string_agg('[' || ord || '].' || f, ',' ORDER BY ord) FILTER (rank <= 3) AS paths,
  coalesce(string_agg(value, ',' ORDER BY ord) FILTER (rank <= 3), '') AS "values" FROM r GROUP BY f, message, error_kind
"""


def contract_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events whose JSON meets its contract, by type, and under which tolerance the type passes."""
    df = contract.validate_records(table(spark, sf_dir, "events").select("event_type", "props"), "props", PROPS)
    by = df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("n_failed"))
    rate = (F.col("n") - F.col("n_failed")) / F.col("n")
    chain = F.when(rate >= contract.THRESHOLDS["strict"], "strict").when(rate >= contract.THRESHOLDS["balanced"], "balanced").when(rate >= contract.THRESHOLDS["lenient"], "lenient").otherwise("none")
    return by.withColumn("passes", chain)


TOLERANCE_SQL = """
SELECT event_type, n, n_failed, CASE WHEN n_failed = 0 THEN 'strict' WHEN (n - n_failed) / n >= 0.8 THEN 'balanced' WHEN (n - n_failed) / n >= 0.5 THEN 'lenient' ELSE 'none' END AS passes
FROM (SELECT event_type, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS INTEGER) NOT BETWEEN 10 AND 90) AS n_failed FROM events GROUP BY event_type)
"""


def contract_missing_vs_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields, nulls, wrong types and good values are told apart."""
    made = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, '{"v": null}').when(F.col("event_id") % 4 == 2, '{"v": "7"}').otherwise(F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit("}")))
    df = contract.validate_records(table(spark, sf_dir, "events").select(made.alias("j")), "j", {"v": int})
    kind = F.coalesce(F.try_element_at("errors", F.lit(1))["error_kind"], F.lit("ok"))
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


MISSING_SQL = "SELECT CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' WHEN 2 THEN 'type' ELSE 'ok' END AS kind, count(*) AS n FROM events GROUP BY ALL"


def contract_list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one nested record: structure errors and, under two tolerances, what remains."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("price"))).alias("items"))
    rules = Items({"price": Field(float, max=150000)}, min_items=3, max_items=12)
    node, record = contract.parse(rules), F.to_variant_object("items")
    found = contract.root_errors(record, node)
    left = lambda t: F.size(contract.tolerated(found, contract.list_positions(record, node), t))
    out = orders.select(F.size("items").alias("n_items"), left("strict").alias("strict"), left("balanced").alias("balanced"))
    return out.groupBy("n_items").agg(F.count("*").alias("n"), F.sum("strict").alias("strict"), F.sum("balanced").alias("balanced"))


LIST_SQL = """
WITH c AS (SELECT o_custkey, count(*) AS n_items, count(*) FILTER (o_totalprice > 150000) AS bad FROM orders GROUP BY o_custkey),
s AS (SELECT *, (CASE WHEN n_items < 3 OR n_items > 12 THEN 1 ELSE 0 END) AS structure FROM c)
SELECT CAST(n_items AS INTEGER) AS n_items, count(*) AS n, CAST(sum(structure + bad) AS BIGINT) AS strict, CAST(sum(structure + CASE WHEN bad > 0 AND (n_items - bad) / n_items >= 0.8 THEN 0 ELSE bad END) AS BIGINT) AS balanced FROM s GROUP BY n_items
"""

QUERIES = {f.__name__: f for f in (contract_orders_errors, contract_grouped_errors, contract_tolerance, contract_missing_vs_null, contract_list_records)}
SQL = {"contract_orders_errors": ORDERS_SQL, "contract_grouped_errors": GROUPED_SQL, "contract_tolerance": TOLERANCE_SQL, "contract_missing_vs_null": MISSING_SQL, "contract_list_records": LIST_SQL}
