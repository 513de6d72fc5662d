"""Verdict columns: every check result carries ``status`` and ``severity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, WARN, SKIPPED = "PASS", "FAIL", "WARN", "SKIPPED"
HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"


def verdict(df: DataFrame, *cases: tuple[Column, str, str], otherwise: tuple[str, str] = (PASS, HIGH)) -> DataFrame:
    """Append ``status``/``severity`` from the first case whose condition is true."""
    status = severity = None
    for condition, case_status, case_severity in cases:
        status = (F if status is None else status).when(condition, case_status)
        severity = (F if severity is None else severity).when(condition, case_severity)
    if status is None:
        return df.withColumns({"status": F.lit(otherwise[0]), "severity": F.lit(otherwise[1])})
    return df.withColumns({"status": status.otherwise(otherwise[0]), "severity": severity.otherwise(otherwise[1])})


def change_pct(base: Column, other: Column) -> Column:
    """Absolute change in percent of the base; 0 when the base is 0."""
    base, other = base.cast("double"), other.cast("double")
    return F.when(base == 0, F.lit(0.0)).otherwise(F.abs(other - base) / F.abs(base) * 100)


def share_pct(part: Column, whole: Column) -> Column:
    """Part of the whole in percent; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole * 100)
