"""From rule results to stage statuses, a go-live decision, gates and a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, LOW, MEDIUM, PASS, SKIPPED, WARN


@dataclass(frozen=True)
class Stage:
    """One step of a run: the groups of checks it holds, and whether its failures stop the later steps."""

    number: int
    name: str
    agents: tuple[str, ...]
    blocks: bool


# The order of the steps and which of them block.
STAGES: tuple[Stage, ...] = (
    Stage(1, "Table Profiling", ("table_profiling",), True),
    Stage(2, "Column Profiling", ("column_profiling",), True),
    Stage(3, "Pattern Analysis + Reconciliation", ("pattern_analysis", "reconciliation"), False),
    Stage(4, "Semantic Validation + Freshness", ("semantic", "freshness"), False),
)

URGENCIES = ("critical", "normal", "audit")


def failed(severity: str | None = None) -> Column:
    is_failure = F.col("status") == FAIL
    return is_failure if severity is None else is_failure & (F.col("severity") == severity)


def blocking(urgency: str) -> Column:
    """Is this result a failure that stops later stages: HIGH, in critical runs MEDIUM too, in audits none."""
    if urgency not in URGENCIES:
        raise ValueError(f"unknown urgency: {urgency}")
    if urgency == "audit":
        return F.lit(False)
    return failed(HIGH) | failed(MEDIUM) if urgency == "critical" else failed(HIGH)


def _status(high: str = "high_failures", medium: str = "medium_failures", warned: str = "rules_warned") -> Column:
    return (F.when(F.col(high) > 0, FAIL).when((F.col(medium) > 0) | (F.col(warned) > 0), WARN).otherwise(PASS))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("rules_checked"),
            *[F.count_if(F.col("status") == s).alias(n) for s, n in (
                (PASS, "rules_passed"), (FAIL, "rules_failed"), (WARN, "rules_warned"), (SKIPPED, "rules_skipped"))],
            *[F.count_if(failed(s)).alias(f"{s.lower()}_failures") for s in (HIGH, MEDIUM, LOW)]]


def rollup(results: DataFrame, by: Sequence[str] = ("run_id", "stage")) -> DataFrame:
    """Counts and status per stage. A LOW failure alone still passes."""
    return results.groupBy(*by).agg(*_counts()).withColumn("status", _status())


def go_live(results: DataFrame, urgency: str = "normal") -> DataFrame:
    """Per run: overall status, whether go-live is blocked, and a recommendation."""
    blocking(urgency)
    runs = results.groupBy("run_id").agg(*_counts()).withColumn("overall_status", _status())
    blocked = (F.col("high_failures") > 0) & F.lit(urgency != "audit")
    careful = (F.col("medium_failures") > 0) | (F.col("overall_status") == WARN)
    return runs.withColumns({
        "go_live_blocked": blocked,
        "recommendation": F.when(blocked, "BLOCK").when(careful, "PROCEED_WITH_CAUTION").otherwise("PROCEED")})


def severity_rank() -> Column:
    return F.when(F.col("severity") == HIGH, 1).when(F.col("severity") == MEDIUM, 2).otherwise(3)


def top_failures(results: DataFrame, k: int = 3, severities: Sequence[str] = (HIGH, MEDIUM)) -> DataFrame:
    """The ``k`` most severe failures per run, of the severities that alert."""
    order = W.partitionBy("run_id").orderBy(severity_rank(), "table", F.col("column").asc_nulls_first(), "rule", "stage")
    alerts = results.where(failed() & F.col("severity").isin(list(severities)))
    return alerts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def failure_counts(results: DataFrame) -> DataFrame:
    """Failures per run and severity."""
    return results.where(failed()).groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("failures"))


def stage_gate(results: DataFrame, stages: Sequence[Stage] = STAGES, urgency: str = "normal") -> DataFrame:
    """Per run and group of checks: its status, or WARN with a reason when an earlier stage blocks it."""
    spark = results.sparkSession
    rows = [(s.number, s.name, agent, s.blocks) for s in stages for agent in s.agents]
    plan = spark.createDataFrame(rows, "stage_no int, stage_name string, stage string, blocks boolean")
    placed = results.join(F.broadcast(plan), "stage")  # a row per group of checks
    per_stage = (placed.groupBy("run_id", "stage", "stage_no", "stage_name")
                 .agg(*_counts(), F.max(F.col("blocks") & blocking(urgency)).alias("is_blocking"))
                 .withColumn("own_status", _status()))
    gates = per_stage.groupBy("run_id").agg(F.min(F.when(F.col("is_blocking"), F.col("stage_no"))).alias("blocked_at"))
    blocked = F.coalesce(F.col("stage_no") > F.col("blocked_at"), F.lit(False))
    return per_stage.join(gates, "run_id").select(
        "run_id", "stage_no", "stage_name", "stage", F.when(blocked, WARN).otherwise(F.col("own_status")).alias("status"),
        blocked.alias("skipped"),
        F.when(blocked, F.lit("Skipped: an earlier stage reported a blocking failure")).alias("reason"))


def run_report(results: DataFrame, urgency: str = "normal", timestamp: str | None = None) -> DataFrame:
    """One nested document per run: decision, tables, stages with their counts and failures.

    Rule results are a few rows per table and column, so a run's failures fit one document.
    """
    failure = F.struct(severity_rank().alias("severity_rank"), "table", "column", "rule", "severity", "detail",
                       "remediation", F.to_json("metrics").alias("metrics"))
    per_stage = results.groupBy("run_id", "stage").agg(
        *_counts(), F.sort_array(F.collect_list(F.when(failed(), failure))).alias("failures"))
    document = F.struct("stage", _status().alias("status"), "rules_checked", "rules_passed", "rules_failed",
                        "rules_warned", "rules_skipped", "failures")
    stages = per_stage.groupBy("run_id").agg(F.sort_array(F.collect_list(document)).alias("stages"))
    tables = results.groupBy("run_id").agg(F.sort_array(F.collect_set("table")).alias("tables_validated"))
    return (go_live(results, urgency).join(stages, "run_id").join(tables, "run_id")
            .withColumns({"timestamp": F.lit(timestamp).cast("string"), "urgency": F.lit(urgency)}))
