"""Names of the library's queries, with the SQL that states the same result.

Where SQL can state a result, it is written for DuckDB over the same tables; the rest is tested in tests/.
"""

from __future__ import annotations

from harrow.plans import catalog, contracts, failures, histories, pages, scripts, transcripts

FLAGSHIP = "page_verdicts"
MODULES = (pages, catalog, failures, contracts, transcripts, scripts, histories)


def queries() -> dict:
    """Every query: name -> (spark, sf_dir) -> DataFrame."""
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict:
    """The SQL of those queries that SQL can express."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
