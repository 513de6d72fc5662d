"""Storing and reading rule results, one folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.results import RULE_RESULTS_SCHEMA


def write_results(results: DataFrame, path: str) -> None:
    """Write rule results by run. Writing a run again replaces that run only."""
    (results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def read_results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Rule results of one run, or of all. Run ids are text as written: ``007`` isn't read as a number."""
    results = spark.read.schema(RULE_RESULTS_SCHEMA).option("basePath", path).parquet(path)
    return results if run_id is None else results.where(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored run ids."""
    return read_results(spark, path).select("run_id").distinct()


def write_report(report: DataFrame, path: str) -> None:
    """Write run reports as JSON documents, by run."""
    (report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
     .partitionBy("run_id").json(path))
