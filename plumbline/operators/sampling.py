"""Repeatable samples, distinct values and most frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows in a random but repeatable order: by the hash of key and seed (a distributed top-n)."""
    shuffled = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(shuffled, *keys).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A random fraction of the rows, repeatable for the same input partitions."""
    return df.sample(fraction=fraction, seed=seed)


def distinct_values(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Distinct non-null values; the smallest ``limit`` of them if a limit is given."""
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    return values if limit is None else values.orderBy(col).limit(limit)


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values with their counts; ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)
