"""harrow: web-data quality analytics expressed as Spark DataFrame operators."""
