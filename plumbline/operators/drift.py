"""Distribution drift between two sides: Kolmogorov-Smirnov, chi-square, a combined score, frequency shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.statistics import chi_square_p_value, ks_p_value
from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, WARN, verdict
from plumbline.operators.ordering import quantile_columns, running_totals
from plumbline.operators.pairing import side_counts, tagged_union
from plumbline.operators.profile import numeric_columns, per_column
from plumbline.operators.sampling import top_values


def _paired_counts(source: DataFrame, target: DataFrame, cols: Sequence[str], distinct: bool) -> DataFrame:
    """Long table (column, value, n_source, n_target) of the numeric columns of both sides."""
    sides = [side.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) for side in (source, target)]
    long = (tagged_union(*sides).unpivot(["in_source", "in_target"], list(cols), "column", "value")
            .where(F.col("value").isNotNull()))
    merge = F.max if distinct else F.sum
    return long.groupBy("column", "value").agg(merge("in_source").alias("n_source"), merge("in_target").alias("n_target"))


def _ks(counts: DataFrame, *also: Column) -> DataFrame:
    """Test statistic and p-value per column, with other aggregates over the same running totals."""
    totals = running_totals(counts, ["value"], ["n_source", "n_target"], by=["column"])
    gap = F.abs(F.col("upto_n_source") / F.col("all_n_source") - F.col("upto_n_target") / F.col("all_n_target"))
    found = totals.groupBy("column").agg(F.max("all_n_source").alias("n_source"), F.max("all_n_target").alias("n_target"),
                                         F.max(F.when((F.col("all_n_source") > 0) & (F.col("all_n_target") > 0), gap))
                                         .alias("statistic"), *also)
    found = found.withColumn("statistic", F.coalesce("statistic", F.lit(0.0)))
    return found.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_source"), F.col("n_target")))


def ks_test(source: DataFrame, target: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05,
            min_values: int = 11, distinct: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per numeric column, over all rows of both sides.

    Columns with less than ``min_values`` values on a side are skipped. ``distinct=True`` compares the sets of
    distinct values instead of the rows.
    """
    common = {c.lower() for c in numeric_columns(target)}
    cols = list(cols or [c for c in numeric_columns(source) if c.lower() in common])
    measured = _ks(_paired_counts(source, target, cols, distinct))
    measured = measured.withColumn("significant", F.col("p_value") < alpha)
    few = F.least("n_source", "n_target") < min_values
    return verdict(measured, (few, SKIPPED, MEDIUM), (F.col("significant"), FAIL, HIGH))


def chi_square(source: DataFrame, target: DataFrame, cols: Sequence[str], alpha: float = 0.05,
               scale_expected: bool = True) -> DataFrame:
    """Chi-square test of the target's category counts (observed) against the source's (expected), per column.

    ``scale_expected`` scales the source counts to the target's total. Categories without expectation add nothing.
    """
    sides = [side.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
             .unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull()) for side in (source, target)]
    counts = side_counts(*sides, ["column", "value"])
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("categories"), F.sum("n_source").alias("all_source"),
                                          F.sum("n_target").alias("all_target"))
    observed = F.col("n_target").cast("double")
    expected = F.col("n_source").cast("double")
    if scale_expected:
        expected = expected * F.col("all_target") / F.col("all_source")
    counted = (F.col("n_source") > 0) & ((F.col("all_target") > 0) | F.lit(not scale_expected))
    # one row of totals per column; the counts are shuffled once and read twice
    terms = counts.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max("categories").alias("categories"), F.max("all_source").alias("n_source"), F.max("all_target").alias("n_target"),
        F.coalesce(F.sum(F.when(counted, F.pow(observed - expected, F.lit(2.0)) / expected)), F.lit(0.0))
        .alias("statistic"))
    measured = terms.withColumn("degrees_of_freedom", F.col("categories") - 1)
    measured = measured.withColumn("p_value", chi_square_p_value(F.col("statistic"), F.col("degrees_of_freedom")))
    return verdict(measured.withColumn("significant", F.col("p_value") < alpha), (F.col("significant"), FAIL, HIGH))


def drift_score(source: DataFrame, target: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Per numeric column: 0.5 KS + 0.3 relative mean shift + 0.2 relative deviation shift, at most 1."""
    common = {c.lower() for c in numeric_columns(target)}
    cols = list(cols or [c for c in numeric_columns(source) if c.lower() in common])
    counts = _paired_counts(source, target, cols, distinct=False)
    picks, medians = [], []
    for name in ("source", "target"):
        more, median = quantile_columns({f"{name}_median": 0.5}, "midpoint", f"n_{name}")
        picks += more
        medians += median
    result = _ks(counts, *picks).select("column", "statistic", "p_value", *medians)
    for name, side in (("source", source), ("target", target)):
        result = result.join(per_column(side, {c: {
            f"{name}_mean": f"coalesce(avg(cast(`{c}` as double)), 0.0D)",
            f"{name}_stddev": f"coalesce(stddev_pop(cast(`{c}` as double)), 0.0D)"} for c in cols}), "column")
    mean_shift = F.when(F.col("source_mean") != 0, F.abs(F.col("target_mean") - F.col("source_mean"))
                        / F.abs(F.col("source_mean"))).otherwise(0.0)
    stddev_shift = F.when(F.col("source_stddev") != 0, F.abs(F.col("target_stddev") - F.col("source_stddev"))
                          / F.col("source_stddev")).otherwise(0.0)
    return result.withColumns({
        "source_median": F.coalesce("source_median", F.lit(0.0)), "target_median": F.coalesce("target_median", F.lit(0.0)),
        "drift_score": F.least(F.lit(1.0), 0.5 * F.col("statistic") + 0.3 * mean_shift + 0.2 * stddev_shift),
        "significant": F.col("p_value") < alpha})


def frequency_shift(source: DataFrame, target: DataFrame, col: str, top_fetch: int = 50, top_n: int = 20,
                    denominator: str = "fetched") -> DataFrame:
    """Relative frequencies of each side's ``top_n`` values, and their absolute difference, as text values.

    Frequencies are relative to the ``top_fetch`` most frequent values of the side, or to all its non-null rows with
    ``denominator="table"``.
    """
    sides = []
    for name, side in (("source", source), ("target", target)):
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value", "n")))  # top_fetch values
        top = top_values(side, col, top_fetch).agg(ranked.alias("top"), F.sum("n").alias("fetched"))
        whole = F.col("fetched") if denominator == "fetched" else side.agg(F.count(col)).scalar()
        shown = top.select("fetched", F.inline(F.slice("top", 1, top_n)))
        sides.append(shown.select(F.col("value").cast("string").alias("value"), F.lit(name).alias("side"),
                                  (F.col("n") / whole).alias("frequency")))
    pick = {name: F.coalesce(F.max(F.when(F.col("side") == name, F.col("frequency"))), F.lit(0.0))
            for name in ("source", "target")}
    both = sides[0].unionByName(sides[1]).groupBy("value").agg(
        *[column.alias(f"{name}_frequency") for name, column in pick.items()])
    return both.withColumn("shift", F.abs(F.col("target_frequency") - F.col("source_frequency")))


def frequency_shift_verdict(shifts: DataFrame, max_shift: float = 0.05, max_values: int = 5) -> DataFrame:
    """More than ``max_values`` shifts above ``max_shift`` fail, any warns."""
    measured = shifts.agg(F.count(F.lit(1)).alias("values"),
                          F.count_if(F.col("shift") > max_shift).alias("shifted_values"),
                          F.coalesce(F.max("shift"), F.lit(0.0)).alias("largest_shift"))
    return verdict(measured, (F.col("shifted_values") > max_values, FAIL, MEDIUM),
                   (F.col("shifted_values") > 0, WARN, MEDIUM))
