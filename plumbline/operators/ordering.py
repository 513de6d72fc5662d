"""Running totals over a global order, without sorting everything in one task.

A window ordered but not partitioned moves all rows to a single task. Here the rows are range-partitioned into slices
and written once to the checkpoint folder; the slice totals (one small row per slice and group) give each slice its
starting value, and the rest is a window inside each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.workspace import checkpoint


def default_slices(spark: SparkSession) -> int:
    """As many slices as the session has shuffle partitions, within bounds that keep the totals table small."""
    return max(1, min(20_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(df: DataFrame, order_by: Sequence[str], sums: Sequence[str], by: Sequence[str] = (),
                   slices: int | None = None) -> DataFrame:
    """Add ``upto_<c>`` (inclusive running sum in the global order) and ``all_<c>`` (group total) for each ``c``.

    ``by`` restarts the totals per group. Rows equal in ``by`` and ``order_by`` get an arbitrary order among
    themselves, so callers aggregate or number them first.
    """
    spark = df.sparkSession
    order = [*by, *order_by]
    sliced = checkpoint(df.repartitionByRange(slices or default_slices(spark), *order)
                        .withColumn("_slice", F.spark_partition_id()))  # read back from files, never recomputed
    per_slice = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(c) for c in sums])
    group = W.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(b).alias(f"_{b}") for b in by], F.col("_slice").alias("_at"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(group).alias(f"all_{c}") for c in sums])
    same_slice = F.col("_slice") == F.col("_at")
    for b in by:
        same_slice = same_slice & F.col(b).eqNullSafe(F.col(f"_{b}"))
    # at most slices + groups rows, so broadcasting is safe
    joined = sliced.join(F.broadcast(offsets), same_slice).drop("_at", *[f"_{b}" for b in by])
    inside = W.partitionBy(*by, "_slice").orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = {f"upto_{c}": F.sum(c).over(inside) + F.col(f"_before_{c}") for c in sums}
    return joined.withColumns(totals).drop("_slice", *[f"_before_{c}" for c in sums])


def row_numbers(df: DataFrame, order_by: Sequence[str], name: str = "row_number") -> DataFrame:
    """Global 1-based row numbers in the given order, all rows kept."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order_by, ["_one"])
    return numbered.withColumnRenamed("upto__one", name).drop("_one", "all__one")


def value_counts(df: DataFrame, cols: Sequence[str], cast: str = "double") -> DataFrame:
    """Long table ``(column, value, n)`` of the non-null values of many columns, in one shuffle."""
    long = df.select(*[F.col(f"`{c}`").cast(cast).alias(c) for c in cols])
    long = long.unpivot([], list(cols), "column", "value") if cols else long
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _positions(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """0-based positions of the lower and upper neighbour of a quantile, and the weight of the upper one."""
    n = n.cast("double")
    if method == "linear":
        at = (n - 1) * p
        low = F.floor(at)
        return low, F.ceil(at), at - low
    at = n * p  # method "midpoint": the next value, or the mean of the two neighbours of an even-sized sample
    whole = at == F.floor(at)
    low = F.when(whole & (n % 2 == 0), at - 1).when(whole, at).otherwise(F.ceil(at) - 1)
    high = F.when(whole, at).otherwise(low)
    low, high = (F.least(F.greatest(x, F.lit(0.0)), n - 1).cast("long") for x in (low, high))
    return low, high, F.lit(0.5)


def quantiles(counts: DataFrame, probabilities: dict[str, float], method: str = "midpoint",
              n: str = "n") -> DataFrame:
    """Exact quantiles per column of a ``value_counts`` table, read off its running totals.

    ``method``: ``midpoint`` (the next sample value; the mean of both neighbours of an exact position in an
    even-sized sample) or ``linear`` (interpolated). One row per column, one output column per probability.
    """
    totals = running_totals(counts.select("column", "value", n), ["value"], [n], by=["column"])
    picks, outputs = quantile_columns(probabilities, method, n)
    return totals.groupBy("column").agg(*picks).select("column", *outputs)


def quantile_columns(probabilities: dict[str, float], method: str, n: str) -> tuple[list[Column], list[Column]]:
    """Aggregates over running totals of the counts ``n``, and the quantiles computed from them."""
    start, end = F.col(f"upto_{n}") - F.col(n), F.col(f"upto_{n}")
    picks, outputs = [], []
    for name, p in probabilities.items():
        low, high, weight = _positions(F.col(f"all_{n}"), p, method)
        for side, position in (("low", low), ("high", high)):
            picks.append(F.max(F.when((start <= position) & (position < end), F.col("value"))).alias(f"{name}_{side}"))
        picks.append(F.max(weight).alias(f"{name}_weight"))
        outputs.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low"))
                        * F.col(f"{name}_weight")).alias(name))
    return picks, outputs
