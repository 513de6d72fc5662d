"""Outliers by quartile fences and by z-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, MEDIUM, SKIPPED, WARN, verdict
from plumbline.operators.ordering import quantiles, value_counts
from plumbline.operators.profile import numeric_columns, per_column


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "midpoint",
               approx: bool = False) -> DataFrame:
    """Quartiles and fences per column; null fences below four values.

    ``approx=True`` reads the quartiles from one approximate aggregate instead of the exact running totals.
    """
    measures = {}
    for c in cols:
        value = f"cast(`{c}` as double)"
        measures[c] = {"n": f"count({value})", "mean": f"avg({value})", "stddev": f"stddev_pop({value})"}
        if approx:
            measures[c] |= {"q1": f"percentile_approx({value}, 0.25)", "q3": f"percentile_approx({value}, 0.75)"}
    bounds = per_column(df, measures)
    if not approx:
        bounds = bounds.join(quantiles(value_counts(df, cols), {"q1": 0.25, "q3": 0.75}, method), "column", "left")
    iqr = F.col("q3") - F.col("q1")
    enough = F.col("n") >= 4
    return bounds.withColumns({"iqr": iqr, "lower_bound": F.when(enough, F.col("q1") - k * iqr),
                               "upper_bound": F.when(enough, F.col("q3") + k * iqr)})


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5, method: str = "midpoint", approx: bool = False) -> DataFrame:
    """The rows whose value lies outside the fences, with the fences."""
    fences = iqr_bounds(df, [col], k, method, approx).select(F.array("lower_bound", "upper_bound")).scalar()
    value = F.col(col).cast("double")
    fenced = df.withColumn("_fences", fences).withColumns({
        "lower_bound": F.col("_fences")[0], "upper_bound": F.col("_fences")[1]}).drop("_fences")
    return fenced.where((value < F.col("lower_bound")) | (value > F.col("upper_bound")))


def zscore(df: DataFrame, col: str, group: Sequence[str] = (), name: str = "z_score") -> DataFrame:
    """Append (value - mean) / population deviation, 0 where the deviation is 0; over all rows or per group."""
    value = F.col(col).cast("double")
    mean, deviation = F.avg(value), F.stddev_pop(value)
    if group:
        stats = df.groupBy(*group).agg(mean.alias("_mean"), deviation.alias("_sd"))
        stats = stats.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_mean", "_sd")
        joined = df.join(stats, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]).drop(*[f"_g_{g}" for g in group])
    else:
        moments = df.agg(F.array(mean, deviation)).scalar()  # both from one scan
        joined = df.withColumn("_moments", moments).withColumns({
            "_mean": F.col("_moments")[0], "_sd": F.col("_moments")[1]}).drop("_moments")
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((value - F.col("_mean")) / F.col("_sd"))
    return joined.withColumn(name, z).drop("_mean", "_sd")


def zscore_outliers(df: DataFrame, col: str, threshold: float = 3.0, group: Sequence[str] = ()) -> DataFrame:
    """Rows with an absolute z-score above the threshold. Below three values none can exceed 1.42."""
    return zscore(df, col, group).where(F.abs("z_score") > threshold)


def outlier_rate(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5, threshold: float = 3.0,
                 max_rate_pct: float = 10.0, min_values: int = 11, method: str = "midpoint", approx: bool = False,
                 distinct: bool = False) -> DataFrame:
    """Per numeric column: values outside the fences, beyond the z threshold, and in either; as a rate of all values.

    ``distinct=True`` counts each distinct value once, for the fences and moments as well.
    """
    cols = list(cols or numeric_columns(df))
    if distinct:
        return _distinct_outlier_rate(df, cols, k, threshold, max_rate_pct, min_values, method)
    bounds = iqr_bounds(df, cols, k, method, approx)
    return _rate(value_counts(df, cols), bounds, threshold, max_rate_pct, min_values)


def _distinct_outlier_rate(df, cols, k, threshold, max_rate_pct, min_values, method) -> DataFrame:
    values = value_counts(df, cols).withColumn("n", F.lit(1).cast("long"))
    moments = values.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                           F.stddev_pop("value").alias("stddev"))
    bounds = moments.join(quantiles(values, {"q1": 0.25, "q3": 0.75}, method), "column")
    iqr = F.col("q3") - F.col("q1")
    bounds = bounds.withColumns({"lower_bound": F.when(F.col("n") >= 4, F.col("q1") - k * iqr),
                                 "upper_bound": F.when(F.col("n") >= 4, F.col("q3") + k * iqr)})
    return _rate(values, bounds, threshold, max_rate_pct, min_values)


def _rate(values: DataFrame, bounds: DataFrame, threshold: float, max_rate_pct: float, min_values: int) -> DataFrame:
    limits = bounds.select("column", "lower_bound", "upper_bound", "mean", "stddev")
    v = F.col("value")
    outside = F.coalesce((v < F.col("lower_bound")) | (v > F.col("upper_bound")), F.lit(False))
    far = F.coalesce((F.col("stddev") > 0) & (F.abs(v - F.col("mean")) / F.col("stddev") > threshold), F.lit(False))
    # one row of limits per column of the table
    counted = values.join(F.broadcast(limits), "column").groupBy("column").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("iqr_outliers"),
        F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("z_outliers"),
        F.coalesce(F.sum(F.when(outside | far, F.col("n"))), F.lit(0)).alias("outliers"))
    measured = counted.withColumn("outlier_pct", F.col("outliers") / F.col("n") * 100)
    return verdict(measured, (F.col("n") < min_values, SKIPPED, MEDIUM), (F.col("outlier_pct") > max_rate_pct, FAIL, MEDIUM),
                   (F.col("outliers") > 0, WARN, MEDIUM))
