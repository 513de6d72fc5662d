"""The common table of rule results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_RESULTS_SCHEMA = ("run_id string, stage string, rule string, table string, column string, status string, "
                       "severity string, metrics map<string,double>, detail string, remediation string")


def to_rule_results(df: DataFrame, run_id: str, stage: str, rule: str, table: str, column: str | Column | None = None,
                    metrics: Sequence[str] = (), shown: Sequence[str] = (), remediation: str | None = None) -> DataFrame:
    """Rows with ``status`` and ``severity`` as rule results.

    ``metrics`` go into the map as numbers and, with the ``shown`` columns, into the detail text.
    """
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    texts = "".join(f", concat('{m}=', coalesce(cast(`{m}` as string), 'none'))" for m in (*shown, *metrics))
    name = F.col(column) if isinstance(column, str) else F.lit(None) if column is None else column
    advice = "null" if remediation is None else f"if(status in ('FAIL', 'WARN'), '{remediation}', null)"
    return df.select(
        *(F.lit(text).alias(label) for label, text in (("run_id", run_id), ("stage", stage), ("rule", rule),
                                                       ("table", table))),
        name.cast("string").alias("column"), "status", "severity",
        F.expr(f"cast({f'map({pairs})' if pairs else 'null'} as map<string,double>) as metrics"),
        F.expr(f"concat_ws(', '{texts}) as detail"), F.expr(f"cast({advice} as string) as remediation"))


def union_results(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """All parts in one table; an empty one for no parts."""
    if not parts:
        return spark.createDataFrame([], RULE_RESULTS_SCHEMA)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
