"""Two-sided grouping: source and target counted side by side in one shuffle.

A full outer join of two per-key aggregates shuffles both sides and joins them again. Tagging the rows with their side
and grouping the union once gives the same numbers, combines on the map side (so a hot key costs one row per map task)
and treats two null keys as equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged_union(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both sides with 0/1 columns ``in_source`` and ``in_target``."""
    left = source.withColumns({"in_source": F.lit(1).cast("long"), "in_target": F.lit(0).cast("long")})
    right = target.withColumns({"in_source": F.lit(0).cast("long"), "in_target": F.lit(1).cast("long")})
    return left.unionByName(right)


def side_counts(source: DataFrame, target: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Per key: ``n_source`` and ``n_target`` row counts, plus any extra aggregates over the tagged rows."""
    return (tagged_union(source.select(*keys), target.select(*keys)).groupBy(*keys)
            .agg(F.sum("in_source").alias("n_source"), F.sum("in_target").alias("n_target"), *extra))


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: ``n_source``, ``n_target``."""
    both = tagged_union(source.select(F.lit(1).alias("one")), target.select(F.lit(1).alias("one")))
    return both.agg(F.coalesce(F.sum("in_source"), F.lit(0)).alias("n_source"),
                    F.coalesce(F.sum("in_target"), F.lit(0)).alias("n_target"))
