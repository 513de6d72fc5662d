"""Time: age of the newest and oldest data, future and missing dates, pipeline lag."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, WARN, share_pct, verdict
from plumbline.operators.profile import per_column, temporal_columns


def _moment(as_of: str | datetime) -> Column:
    """The reference time, as a time without zone so that it compares with every date type."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _time(name: str) -> Column:
    return F.col(f"`{name}`").cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from earlier to later, with fractions; independent of the session time zone."""
    gap = later - earlier
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 24 + part("HOUR") + part("MINUTE") / 60 + part("SECOND") / 3600


def pick_time_column(df: DataFrame, *parts: str, fallback: bool = True) -> str | None:
    """The first date column whose name holds one of the parts, else the first date column."""
    names = temporal_columns(df)
    named = [n for n in names if any(p in n.lower() for p in parts)]
    return named[0] if named else names[0] if fallback and names else None


def _no_column(df: DataFrame, **nulls: str) -> DataFrame:
    row = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("column"),
                                          *[F.lit(None).cast(t).alias(n) for n, t in nulls.items()])
    return verdict(row, otherwise=(SKIPPED, MEDIUM))


def freshness(df: DataFrame, as_of: str | datetime, ts: str | None = None, sla_hours: float = 24,
              by: Sequence[str] = ()) -> DataFrame:
    """Age of the newest row against the SLA; no data fails as well. ``by`` measures each part of the table."""
    ts = ts or pick_time_column(df, "updat", "modif", "creat")
    if ts is None:
        return _no_column(df, newest="timestamp_ntz", age_hours="double")
    newest = F.max(_time(ts)).alias("newest")
    measured = df.groupBy(*by).agg(newest) if by else df.agg(newest)
    measured = measured.select(*by, F.lit(ts).alias("column"), "newest",
                               hours_between(_moment(as_of), F.col("newest")).alias("age_hours"))
    late = F.col("age_hours").isNull() | (F.col("age_hours") > sla_hours)
    return verdict(measured, (late, FAIL, MEDIUM))


def timestamp_anomalies(df: DataFrame, as_of: str | datetime, cols: Sequence[str] | None = None) -> DataFrame:
    """Per date column: total, null and future rows, all columns in one pass."""
    cols = list(cols or temporal_columns(df))
    return per_column(df, {c: {"total_count": "count(1)", "null_count": f"count(1) - count(`{c}`)",
                               "future_count": f"count_if(cast(`{c}` as timestamp_ntz) > timestamp_ntz'{as_of}')"}
                           for c in cols})


def future_timestamps(df: DataFrame, as_of: str | datetime, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows dated after the reference time, per date column."""
    measured = timestamp_anomalies(df, as_of, cols).select("column", "total_count", "future_count")
    return verdict(measured, (F.col("future_count") > 0, FAIL, HIGH))


def null_timestamps(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing dates, per nullable date column."""
    nullable = [f.name for f in df.schema.fields if f.nullable and f.name in temporal_columns(df)]
    cols = list(cols or nullable)
    measured = per_column(df, {c: {"total_count": "count(1)", "null_count": f"count(1) - count(`{c}`)"} for c in cols})
    measured = measured.withColumn("null_pct", share_pct(F.col("null_count"), F.col("total_count")))
    return verdict(measured, (F.col("null_count") > 0, FAIL, MEDIUM))


def pipeline_lag(df: DataFrame, as_of: str | datetime, load_ts: str | None = None, max_minutes: float = 15,
                 event_ts: str | None = None) -> DataFrame:
    """Minutes since the newest load time; with an event time also the rows' own delays. No data gives no row."""
    load_ts = load_ts or pick_time_column(df, "cdc", "replicated", "synced", "loaded", "etl", fallback=False)
    if load_ts is None:
        return _no_column(df, newest="timestamp_ntz", lag_minutes="double")
    aggregates = [F.max(_time(load_ts)).alias("newest")]
    if event_ts is not None:
        delay = hours_between(_time(load_ts), _time(event_ts)) * 60
        aggregates += [F.max(delay).alias("max_delay_minutes"), F.avg(delay).alias("avg_delay_minutes"),
                       F.percentile_approx(delay, 0.95).alias("p95_delay_minutes")]
    measured = df.agg(*aggregates).where("newest is not null").withColumns({
        "column": F.lit(load_ts), "lag_minutes": hours_between(_moment(as_of), F.col("newest")) * 60})
    return verdict(measured, (F.col("lag_minutes") > max_minutes, FAIL, HIGH))


def stale_data(df: DataFrame, as_of: str | datetime, ts: str | None = None, sla_hours: float = 24,
               factor: float = 720, by: Sequence[str] = ()) -> DataFrame:
    """Warn when the oldest row is older than ``factor`` times the SLA. ``by`` finds the stale parts of the table."""
    ts = ts or pick_time_column(df, "creat", "updat")
    if ts is None:
        return _no_column(df, oldest="timestamp_ntz", age_hours="double")
    oldest = F.min(_time(ts)).alias("oldest")
    measured = (df.groupBy(*by).agg(oldest) if by else df.agg(oldest)).where("oldest is not null")
    measured = measured.select(*by, F.lit(ts).alias("column"), "oldest",
                               hours_between(_moment(as_of), F.col("oldest")).alias("age_hours"))
    return verdict(measured, (F.col("age_hours") > sla_hours * factor, WARN, MEDIUM))
