"""A whole validation run: every check of every table, stage by stage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, WARN, verdict
from plumbline.operators import (columns, content, drift, fingerprint, freshness, fuzzy, keys, outliers, profile,
                                 schema, volume)
from plumbline.plans.results import to_rule_results, union_results
from plumbline.plans.rollup import STAGES, Stage, blocking
from plumbline.operators.increments import reconcile_increment
from plumbline.sources.checkpoints import CHECKPOINT_SCHEMA, append_checkpoints, checkpoint_latest, read_checkpoints
from plumbline.sources.workspace import checkpoint


@dataclass(frozen=True)
class Thresholds:
    row_count_tolerance_pct: float = 0.0
    null_rate_delta_pct: float = 1.0
    distribution_drift_pvalue: float = 0.05
    cardinality_change_pct: float = 10.0
    chunk_size: int = 100_000
    cdc_lag_max_minutes: float = 15.0
    hash_algorithm: str = "md5"
    volume_baseline_pct: float = 10.0
    fuzzy_duplicate_threshold: float = 0.85
    levenshtein_max_distance: int = 3


@dataclass
class TableSpec:
    """A pair of tables to compare. ``fuzzy_columns=None`` searches all text columns for near duplicates."""

    name: str
    source: DataFrame
    target: DataFrame
    keys: Sequence[str]
    skip_columns: Sequence[str] = ()
    sla_hours: float = 24
    business_rules: dict[str, str] = field(default_factory=dict)
    foreign_keys: dict[str, tuple[DataFrame, Sequence[tuple[str, str]]]] = field(default_factory=dict)
    constraints: keys.Constraints | None = None
    baseline_rows: int | None = None
    fuzzy_columns: Sequence[str] | None = None
    target_lengths: dict[str, int] | None = None
    source_lengths: dict[str, int] | None = None
    checkpoint_path: str | None = None


def _common(spec: TableSpec, names: Sequence[str]) -> list[str]:
    """Source names that the target has too, in any case."""
    theirs = {c.lower() for c in spec.target.columns}
    skipped = {c.lower() for c in spec.skip_columns}
    return [c for c in names if c.lower() in theirs and c.lower() not in skipped]


class _Collector:
    """Rule results of one group of checks on one table."""

    def __init__(self, run_id: str, stage: str, table: str) -> None:
        self.run_id, self.stage, self.table = run_id, stage, table
        self.parts: list[DataFrame] = []

    def add(self, rule: str, df: DataFrame, column=None, metrics=(), shown=(), remediation=None) -> None:
        self.parts.append(to_rule_results(df, self.run_id, self.stage, rule, self.table, column, metrics, shown,
                                          remediation))

    def skip(self, rule: str, spec: TableSpec, why: str) -> None:
        row = spec.source.sparkSession.range(1).select(F.lit(why).alias("reason"))
        self.add(rule, verdict(row, otherwise=(SKIPPED, MEDIUM)), shown=["reason"])


def table_profiling(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    out.add("row_count_reconciliation", volume.row_count_reconcile(spec.source, spec.target, t.row_count_tolerance_pct),
            metrics=["n_source", "n_target", "diff_pct"], remediation="Investigate missing or extra rows")
    compatible = schema.schema_compatibility(spec.source, spec.target, spec.skip_columns)
    issues = compatible.agg(F.count_if(F.col("issue").isNotNull()).alias("mismatches"),
                            F.array_join(F.sort_array(F.collect_list(F.when(F.col("issue").isNotNull(), F.concat_ws(
                                " ", "issue", "name")))), ", ").alias("columns"))
    out.add("schema_compatibility", verdict(issues, (F.col("mismatches") > 0, FAIL, HIGH)), metrics=["mismatches"],
            shown=["columns"], remediation="Align the target schema with the source")
    excess = keys.duplicate_excess(spec.target, spec.keys)
    out.add("duplicate_primary_key", excess, metrics=["duplicate_keys", "excess_rows"],
            remediation="Remove duplicate keys from the target")
    if spec.foreign_keys:
        for name, (parent, on) in spec.foreign_keys.items():
            out.add("referential_integrity", keys.orphaned_keys(spec.target, parent, on), F.lit(name),
                    ["orphaned_rows", "orphaned_keys"], remediation="Load the missing parent rows")
    else:
        out.skip("referential_integrity", spec, "no foreign keys given")
    shared = _common(spec, spec.source.columns)
    out.add("checksum_hash", fingerprint.compare_fingerprint(spec.source, spec.target, shared, t.hash_algorithm),
            metrics=["source_n_rows", "target_n_rows"], shown=["source_fingerprint", "target_fingerprint"],
            remediation="Find the differing rows by chunk hashes")
    if spec.constraints is not None:
        out.add("constraint_preservation", keys.constraint_check(spec.target, spec.constraints), "constraint",
                ["violations"], remediation="Repair the rows that break the constraint")
    else:
        out.skip("constraint_preservation", spec, "no constraints given")
    out.add("volume_baseline", volume.volume_check(spec.target, spec.baseline_rows, t.volume_baseline_pct),
            metrics=["n_rows"], remediation="Check whether the load ran")


def column_profiling(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    types = schema.type_compatibility(spec.source, spec.target, spec.skip_columns, spec.target_lengths,
                                      spec.source_lengths)
    out.add("data_type_compatibility", types, "name", ["lost_length", "lost_digits", "lost_scale"],
            ["source_data_type", "target_data_type"], "Widen the target column")
    paired = checkpoint(columns.paired_profile(spec.source, spec.target, skip=spec.skip_columns))  # a row per column
    out.add("null_completeness_ratio", columns.null_rate_delta(paired, t.null_rate_delta_pct), "column",
            ["source_null_pct", "target_null_pct", "delta_pct"], remediation="Investigate nulls that the load introduced")
    out.add("distinct_cardinality", columns.cardinality_delta(paired, t.cardinality_change_pct), "column",
            ["source_distinct_count", "target_distinct_count", "change_pct"],
            remediation="Check for repeated or lost values")
    out.add("statistical_range", columns.range_drift(paired), "column", ["source_mean", "target_mean", "mean_drift_pct"],
            ["source_min_value", "target_min_value", "source_max_value", "target_max_value"])
    texts = profile.text_columns(spec.target, spec.skip_columns)
    if texts:
        out.add("whitespace_encoding", columns.whitespace_check(spec.target, texts), "column",
                ["spaced_rows", "spaced_values"], remediation="Trim the values")
        mixed = columns.format_consistency(spec.target, texts).where(F.col("status") == WARN)
        out.add("format_validation", mixed, "column", ["match_rate"], ["format"])


def pattern_analysis(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    target_numbers = {c.lower() for c in profile.numeric_columns(spec.target)}
    numbers = [c for c in _common(spec, profile.numeric_columns(spec.source)) if c.lower() in target_numbers]
    others = [c for c in _common(spec, spec.source.columns) if c not in profile.numeric_columns(spec.source)]
    if numbers:
        ks = drift.ks_test(spec.source, spec.target, numbers, t.distribution_drift_pvalue)
        out.add("distribution_drift", ks.where(F.col("status") != SKIPPED), "column", ["statistic", "p_value"])
        rates = outliers.outlier_rate(spec.target, numbers)
        out.add("outlier_detection", rates.where(F.col("status") != SKIPPED), "column",
                ["outliers", "iqr_outliers", "z_outliers", "outlier_pct"])
    for name in others:
        shifts = drift.frequency_shift_verdict(drift.frequency_shift(spec.source, spec.target, name))
        out.add("frequency_shift", shifts.where(F.col("status") != "PASS"), F.lit(name),
                ["shifted_values", "largest_shift"])
    texts = _common(spec, profile.text_columns(spec.source) if spec.fuzzy_columns is None else spec.fuzzy_columns)
    for name in texts:
        groups = fuzzy.fuzzy_duplicates(spec.target, name, t.levenshtein_max_distance).agg(
            F.count_distinct("leader").alias("groups"), F.count(F.lit(1)).alias("members"))
        out.add("fuzzy_duplicates", verdict(groups.where("groups > 0"), otherwise=(FAIL, MEDIUM)), F.lit(name),
                ["groups", "members"], remediation="Review near-duplicate values")
    changes = schema.schema_drift(spec.source, spec.target, spec.skip_columns).agg(
        F.count(F.lit(1)).alias("changes"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "change", "name"))), ", ").alias("columns"))
    out.add("schema_drift", verdict(changes, (F.col("changes") > 0, FAIL, HIGH)), metrics=["changes"], shown=["columns"],
            remediation="Review the schema changes")


def reconciliation(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    found = checkpoint(keys.reconcile_keys(spec.source, spec.target, spec.keys).drop("status", "severity"))  # one row
    out.add("missing_records", verdict(found, (F.col("missing_rows") > 0, FAIL, HIGH)),
            metrics=["missing_rows", "missing_keys"], remediation="Load the missing rows again")
    out.add("row_reconciliation",
            verdict(found, ((F.col("missing_rows") > 0) | (F.col("extra_rows") > 0), FAIL, HIGH)),
            metrics=["missing_rows", "extra_rows", "matched_rows"])
    shared = _common(spec, spec.source.columns)
    kind = spec.source.schema[spec.keys[0]].dataType.typeName()
    ranged = len(spec.keys) == 1 and kind in ("byte", "short", "integer", "long")
    rows = found.first()["source_rows"]
    chunked = fingerprint.chunk_hash_compare(
        spec.source, spec.target, spec.keys, t.chunk_size, t.hash_algorithm, "range" if ranged else "hash",
        None if ranged else -(-rows // t.chunk_size) or 1, shared).agg(F.count(F.lit(1)).alias("chunks"),
                                              F.count_if(F.col("status") == FAIL).alias("mismatched_chunks"))
    out.add("chunk_hash", verdict(chunked, (F.col("mismatched_chunks") > 0, FAIL, HIGH)),
            metrics=["chunks", "mismatched_chunks"], remediation="Compare the rows of the mismatched chunks")
    out.add("duplicate_injection", keys.duplicate_excess(spec.target, spec.keys),
            metrics=["duplicate_keys", "excess_rows"], remediation="Remove the repeated rows")
    if spec.checkpoint_path is not None:
        _since_checkpoint(spec, out, as_of)


def _since_checkpoint(spec: TableSpec, out: _Collector, as_of: str | datetime) -> None:
    """Reconcile what came after the table's last checkpoint of any run, and log the next one."""
    spark = spec.source.sparkSession
    try:
        log = read_checkpoints(spark, spec.checkpoint_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # no log yet: everything is new
        log = spark.createDataFrame([], CHECKPOINT_SCHEMA)
    last = checkpoint_latest(log, spec.name)
    found, record = reconcile_increment(spec.source, spec.target, spec.keys, spec.name, out.run_id, as_of, last)
    out.add("incremental_validation", checkpoint(found), metrics=["source_rows", "missing_rows", "extra_rows"])
    append_checkpoints(record, spec.checkpoint_path)


def semantic(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    mapping = fuzzy.column_mapping(spec.source, spec.target)
    out.add("semantic_schema_mapping", mapping, "source_column", ["confidence"], ["target_column"],
            "Review unmapped columns and type changes")
    if spec.business_rules:
        out.add("business_rule_preservation",
                content.business_rules(spec.source, spec.target, spec.business_rules, round_to=6), "rule_name",
                ["source_value", "target_value", "drift_pct"])
    else:
        out.skip("business_rule_preservation", spec, "no business rules given")
    out.add("cross_column_consistency", content.temporal_order(spec.target).where(F.col("status") != SKIPPED),
            metrics=["checked_rows", "violations"], shown=["earlier", "later"])
    findings = content.pii_scan(spec.target)
    out.add("pii_detection", findings, "column", ["confidence", "matching_rows"],
            ["pii_type", "risk", "regulations", "recommendation"], "Protect the column as recommended")
    out.add("pii_detection", verdict(content.pii_risk(findings).where("risk_level = 'NONE'")), metrics=["findings"],
            shown=["risk_level"])


def freshness_checks(spec: TableSpec, t: Thresholds, out: _Collector, as_of: str | datetime) -> None:
    if not profile.temporal_columns(spec.target):
        out.skip("data_freshness", spec, "no date columns")
        return
    out.add("data_freshness", freshness.freshness(spec.target, as_of, sla_hours=spec.sla_hours), "column", ["age_hours"],
            remediation="Look for delayed or stalled loads")
    out.add("temporal_sequence", freshness.future_timestamps(spec.target, as_of), "column", ["future_count"],
            remediation="Look for time zone errors")
    out.add("pipeline_lag", freshness.pipeline_lag(spec.target, as_of, max_minutes=t.cdc_lag_max_minutes), "column",
            ["lag_minutes"], remediation="Check the replication lag")
    if any(f.nullable and f.name in profile.temporal_columns(spec.target) for f in spec.target.schema.fields):
        out.add("timestamp_integrity", freshness.null_timestamps(spec.target), "column", ["null_count", "null_pct"],
                remediation="Fill the missing dates")
    out.add("stale_partition", freshness.stale_data(spec.target, as_of, sla_hours=spec.sla_hours), "column", ["age_hours"])


_CHECKS = {"table_profiling": table_profiling, "column_profiling": column_profiling,
           "pattern_analysis": pattern_analysis, "reconciliation": reconciliation, "semantic": semantic,
           "freshness": freshness_checks}


def run_agent(agent: str, specs: Sequence[TableSpec], run_id: str, as_of: str | datetime,
              thresholds: Thresholds | None = None) -> DataFrame:
    """Rule results of one group of checks over all tables."""
    thresholds = thresholds or Thresholds()
    parts: list[DataFrame] = []
    for spec in specs:
        out = _Collector(run_id, agent, spec.name)
        _CHECKS[agent](spec, thresholds, out, as_of)
        parts += out.parts
    return union_results(specs[0].source.sparkSession, parts)


def validate(specs: Sequence[TableSpec], run_id: str, as_of: str | datetime, thresholds: Thresholds | None = None,
             agents: Sequence[str] | None = None, urgency: str = "normal",
             stages: Sequence[Stage] = STAGES) -> DataFrame:
    """Rule results of a whole run. A stage with a blocking failure ends the run, unless it is an audit.

    The results of each stage (a few rows per table and column) are written before the next stage is decided on.
    """
    done: list[DataFrame] = []
    for stage in stages:
        chosen = [a for a in stage.agents if agents is None or a in agents]
        if not chosen:
            continue
        results = checkpoint(union_results(specs[0].source.sparkSession,
                                           [run_agent(a, specs, run_id, as_of, thresholds) for a in chosen]))
        done.append(results)
        if stage.blocks and not results.where(blocking(urgency)).isEmpty():
            break
    return union_results(specs[0].source.sparkSession, done)
