"""Declarative checks of one table, many of them in one pass."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import FORMATS
from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, share_pct, verdict
from plumbline.operators.freshness import _moment, _time, hours_between
from plumbline.operators.keys import duplicate_excess, orphaned_keys

_OPERATORS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq,
              "!=": operator.ne}


@dataclass(frozen=True)
class Check:
    """A measured number and what it has to be; measured by an aggregate of the table, or by a job of its own."""

    name: str
    op: str
    limit: float
    aggregate: Column | None = None
    frame: Callable[[DataFrame], DataFrame] | None = None
    severity: str = HIGH


def check_row_count(op: str = ">", n: float = 0, severity: str = HIGH) -> Check:
    return Check(f"row_count {op} {n:g}", op, n, F.count(F.lit(1)), severity=severity)


def check_missing(col: str, op: str = "=", limit: float = 0, percent: bool = False, severity: str = HIGH) -> Check:
    """Number or percentage of nulls."""
    missing = F.count_if(F.col(col).isNull())
    name = f"missing_{'percent' if percent else 'count'}({col}) {op} {limit:g}"
    return Check(name, op, limit, share_pct(missing, F.count(F.lit(1))) if percent else missing, severity=severity)


def check_duplicates(col: str | Sequence[str], op: str = "=", limit: float = 0, severity: str = HIGH) -> Check:
    """Number of values (or key combinations) that occur more than once."""
    cols = [col] if isinstance(col, str) else list(col)

    def measure(df: DataFrame) -> DataFrame:
        return duplicate_excess(df.dropna(subset=cols), cols).select(F.col("duplicate_keys").alias("measured"))
    return Check(f"duplicate_count({', '.join(cols)}) {op} {limit:g}", op, limit, frame=measure, severity=severity)


def check_invalid(col: str, valid_format: str | None = None, pattern: str | None = None, op: str = "<",
                  limit: float = 2, severity: str = HIGH) -> Check:
    """Percentage of rows whose non-null value doesn't match the format."""
    invalid = F.count_if(~F.col(col).rlike(pattern or FORMATS[valid_format]))
    return Check(f"invalid_percent({col}) {op} {limit:g}", op, limit, share_pct(invalid, F.count(F.lit(1))),
                 severity=severity)


def check_required_columns(df: DataFrame, cols: Sequence[str], severity: str = HIGH) -> Check:
    """Number of required columns that don't exist or hold no value at all."""
    present = {c.lower() for c in df.columns}
    absent = F.lit(sum(c.lower() not in present for c in cols)).cast("long")
    empty = [(F.count(F.col(c)) == 0).cast("long") for c in cols if c.lower() in present]
    return Check(f"required columns: {', '.join(cols)}", "=", 0, sum(empty, absent), severity=severity)


def check_bound(aggregate: str, op: str, limit: float, severity: str = HIGH) -> Check:
    """Any aggregate expression against a bound, e.g. ``min(total_amount) >= 0``."""
    return Check(f"{aggregate} {op} {limit:g}", op, limit, F.expr(aggregate), severity=severity)


def check_freshness(col: str, hours: float, as_of: str | datetime, severity: str = MEDIUM) -> Check:
    """Age of the newest row in hours."""
    return Check(f"freshness({col}) < {hours:g}h", "<", hours, hours_between(_moment(as_of), F.max(_time(col))),
                 severity=severity)


def check_references(col: str, other: DataFrame, other_col: str, other_name: str, severity: str = HIGH) -> Check:
    """Number of rows whose value doesn't exist in the other table."""
    def measure(df: DataFrame) -> DataFrame:
        return orphaned_keys(df, other, [(col, other_col)]).select(F.col("orphaned_rows").alias("measured"))
    return Check(f"values in ({col}) must exist in {other_name} ({other_col})", "=", 0, frame=measure, severity=severity)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Name, measured number and verdict of every check. All aggregate checks share one pass over the table.

    A number that can't be measured (null) fails.
    """
    def outcome(check: Check, measured: Column) -> Column:
        held = _OPERATORS[check.op](measured, F.lit(float(check.limit)))
        return F.struct(F.lit(check.name).alias("check"), measured.alias("measured"),
                        F.coalesce(held, F.lit(False)).alias("held"), F.lit(check.severity).alias("on_failure"))

    parts = []
    single_pass = [c for c in checks if c.frame is None]
    if single_pass:
        rows = [outcome(c, c.aggregate.cast("double")) for c in single_pass]
        parts.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    for check in checks:
        if check.frame is not None:
            measured = check.frame(df).select(outcome(check, F.col("measured").cast("double")).alias("row"))
            parts.append(measured.select("row.*"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    broken = ~F.col("held")
    judged = verdict(found, (broken & (F.col("on_failure") == HIGH), FAIL, HIGH),
                     (broken & (F.col("on_failure") == MEDIUM), FAIL, MEDIUM), (broken, FAIL, "LOW"))
    return judged.drop("held", "on_failure")
