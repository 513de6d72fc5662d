"""Data quality and table reconciliation on Spark DataFrames."""
