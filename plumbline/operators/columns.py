"""Column against column: null rate, cardinality, range, outer white space and value formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import number_sql, short_key_sql
from plumbline.functions.text import FORMATS, has_outer_space
from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, WARN, change_pct, share_pct, verdict
from plumbline.operators.profile import STATS, column_stats, text_columns

NULL_MEASURES = ("total_count", "null_count")
CARDINALITY_MEASURES = ("distinct_count",)
RANGE_MEASURES = ("min_value", "max_value", "mean")


def paired_profile(source: DataFrame, target: DataFrame, cols: Sequence[str] | None = None, skip: Sequence[str] = (),
                   measures: Sequence[str] = STATS, distinct: str = "exact") -> DataFrame:
    """The profiles of the common columns of both sides next to each other (one row per column).

    ``measures`` selects what a comparison needs: ``NULL_MEASURES``, ``CARDINALITY_MEASURES`` or ``RANGE_MEASURES``.
    """
    skipped = {c.lower() for c in skip}
    wanted = {c.lower() for c in (cols or source.columns)} - skipped
    theirs = {c.lower() for c in target.columns}
    sides = []
    for prefix, side in (("source", source), ("target", target)):
        names = [c for c in side.columns if c.lower() in wanted and c.lower() in theirs
                 and c.lower() in {s.lower() for s in source.columns}]
        profile = column_stats(side, names, measures=measures, distinct=distinct)
        sides.append(profile.select(F.lower("column").alias("column"),
                                    *[F.col(c).alias(f"{prefix}_{c}") for c in profile.columns if c != "column"]))
    return sides[0].join(sides[1], "column")


def null_rate_delta(profile: DataFrame, max_delta_pct: float = 1.0) -> DataFrame:
    """Null rates of both sides in percent, and their difference in percentage points."""
    rates = profile.select("column", "source_total_count", "target_total_count",
                           share_pct(F.col("source_null_count"), F.col("source_total_count")).alias("source_null_pct"),
                           share_pct(F.col("target_null_count"), F.col("target_total_count")).alias("target_null_pct"))
    measured = rates.withColumn("delta_pct", F.abs(F.col("target_null_pct") - F.col("source_null_pct")))
    return verdict(measured, (F.col("delta_pct") > max_delta_pct, FAIL, HIGH))


def cardinality_delta(profile: DataFrame, max_change_pct: float = 10.0) -> DataFrame:
    """Distinct counts of both sides and their change in percent of the source."""
    measured = profile.select("column", "source_distinct_count", "target_distinct_count",
                              change_pct(F.col("source_distinct_count"), F.col("target_distinct_count"))
                              .alias("change_pct"))
    return verdict(measured, (F.col("change_pct") > max_change_pct, FAIL, MEDIUM))


def range_drift(profile: DataFrame, max_mean_pct: float = 5.0) -> DataFrame:
    """For columns with a mean on both sides: minimum or maximum changed, or the mean moved by too much.

    Bounds are compared as numbers, exactly, so 2.5 as a double and 2.50 as a decimal are equal.
    """
    measured = profile.where("source_mean is not null and target_mean is not null").select(
        "column", "source_min_value", "target_min_value", "source_max_value", "target_max_value",
        "source_mean", "target_mean",
        *[F.expr(f"{number_sql(f'source_{m}_value')} <> {number_sql(f'target_{m}_value')}").alias(f"{m}_changed")
          for m in ("min", "max")],
        change_pct(F.col("source_mean"), F.col("target_mean")).alias("mean_drift_pct"))
    moved = F.col("min_changed") | F.col("max_changed") | (F.col("mean_drift_pct") > max_mean_pct)
    return verdict(measured, (moved, FAIL, MEDIUM))


def whitespace_check(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows and distinct values with leading or trailing white space, per text column."""
    cols = list(cols or text_columns(df))
    spaced = [F.struct(F.lit(c).alias("column"), F.count(f"`{c}`").alias("checked_rows"),
                       F.count_if(has_outer_space(F.col(f"`{c}`"))).alias("spaced_rows")) for c in cols]
    row_counts = df.agg(F.array(*spaced).alias("rows")).select(F.inline("rows"))
    # only the faulty values are shuffled
    faulty = df.select(*cols).unpivot([], cols, "column", "value").where(has_outer_space(F.col("value")))
    values = faulty.select("column", F.expr(short_key_sql("value")).alias("key")).distinct()
    value_counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("spaced_values"))
    measured = row_counts.join(value_counts, "column", "left").fillna(0, ["spaced_values"])
    return verdict(measured, (F.col("spaced_rows") > 0, FAIL, MEDIUM))


def format_consistency(df: DataFrame, cols: Sequence[str] | None = None, formats: dict[str, str] | None = None,
                       low: float = 0.5, high: float = 0.8, distinct: bool = True) -> DataFrame:
    """Share of values matching each known format; strictly between ``low`` and ``high`` is a mix worth a warning.

    Counts distinct values; ``distinct=False`` counts rows, in one pass without a shuffle of values.
    """
    cols, formats = list(cols or text_columns(df)), formats or FORMATS
    long = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    flags = {name: F.col("value").rlike(pattern).cast("int").alias(f"is_{name}") for name, pattern in formats.items()}
    long = long.select("column", F.expr(short_key_sql("value")).alias("key"), *flags.values())
    if distinct:
        long = long.distinct()
    grid = [F.struct(F.lit(name).alias("format"), F.avg(f"is_{name}").alias("match_rate")) for name in flags]
    measured = (long.groupBy("column").agg(F.count(F.lit(1)).alias("checked"), F.array(*grid).alias("grid"))
                .select("column", "checked", F.inline("grid")))
    mixed = (F.col("match_rate") > low) & (F.col("match_rate") < high)
    return verdict(measured, (mixed, WARN, MEDIUM))
