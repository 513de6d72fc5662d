"""Row counts: both sides against each other, one table against a baseline, buckets against their past."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, WARN, change_pct, verdict
from plumbline.operators.pairing import row_counts


def row_count_reconcile(source: DataFrame, target: DataFrame, tolerance_pct: float = 0.0) -> DataFrame:
    """Equal counts pass, a difference within tolerance warns, any other fails.

    The difference is 0 % for an empty source, which therefore only warns; ``source_empty`` tells.
    """
    counts = row_counts(source, target).withColumns({
        "diff_pct": change_pct(F.col("n_source"), F.col("n_target")),
        "source_empty": F.col("n_source") == 0})
    return verdict(counts, (F.col("n_source") == F.col("n_target"), "PASS", HIGH),
                   (F.col("diff_pct") <= tolerance_pct, WARN, MEDIUM), otherwise=(FAIL, HIGH))


def volume_check(df: DataFrame, baseline: int | None = None, baseline_pct: float = 10.0) -> DataFrame:
    """An empty table fails; with a baseline, so does a count further than ``baseline_pct`` from it."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "baseline_rows": F.lit(baseline).cast("long"),
        "deviation_pct": F.lit(None).cast("double") if baseline is None
        else change_pct(F.lit(baseline), F.col("n_rows"))})
    return verdict(counts, (F.col("n_rows") == 0, FAIL, HIGH),
                   (F.coalesce(F.col("deviation_pct") > baseline_pct, F.lit(False)), FAIL, MEDIUM))


def volume_anomaly(df: DataFrame, ts: str, bucket: str = "1 day", preceding: int = 30, sensitivity: float = 3.0,
                   min_history: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Row count per time bucket against the mean and sample deviation of the ``preceding`` buckets before it.

    Buckets between the first and the last (of each group) that hold no rows count as 0, so an outage shows and is part
    of the history after it. Each bucket hands its count to those after it, so no ordered pass over all buckets is
    needed. Buckets with less than ``min_history`` earlier ones are skipped.
    """
    counts = (df.where(F.col(ts).isNotNull())
              .groupBy(*by, F.window(ts, bucket)["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows")))
    step = F.expr(f"interval {bucket}")
    every = counts.groupBy(*by).agg(F.min("bucket").alias("_low"), F.max("bucket").alias("_high")).where(
        "_low IS NOT NULL").select(*by, F.explode(F.sequence("_low", "_high", step)).alias("bucket"))
    counts = (counts.unionByName(every.withColumn("n_rows", F.lit(0).cast("long")))
              .groupBy(*by, "bucket").agg(F.sum("n_rows").alias("n_rows")))
    later = F.transform(F.sequence(F.lit(1), F.lit(preceding)), lambda i: F.col("bucket") + step * i)
    handed = counts.select(*by, F.explode(later).alias("bucket"), F.lit(None).cast("long").alias("own"),
                           F.col("n_rows").alias("earlier"))
    own = counts.select(*by, "bucket", F.col("n_rows").alias("own"), F.lit(None).cast("long").alias("earlier"))
    measured = (own.unionByName(handed).groupBy(*by, "bucket")
                .agg(F.max("own").alias("n_rows"), F.count("earlier").alias("history"),
                     F.avg("earlier").alias("mean_rows"), F.stddev_samp("earlier").alias("stddev_rows"))
                .where(F.col("n_rows").isNotNull()))
    gap = F.col("n_rows") - F.col("mean_rows")
    measured = measured.withColumn("z_score", F.when(F.col("stddev_rows") > 0, gap / F.col("stddev_rows"))
                                   .when(gap == 0, F.lit(0.0)))
    off = F.when(F.col("stddev_rows") > 0, F.abs(F.col("z_score")) > sensitivity).otherwise(gap != 0)
    return verdict(measured, (F.col("history") < min_history, SKIPPED, MEDIUM),
                   (F.coalesce(off, F.lit(False)), FAIL, MEDIUM))
