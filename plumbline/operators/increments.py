"""Reconciling only what came after the last checkpoint."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keys import reconcile_keys
from plumbline.sources.checkpoints import CHECKPOINT_SCHEMA


def incremental_slice(df: DataFrame, key: str, after: Any = None, upto: Any = None, again: bool = False) -> DataFrame:
    """Rows with ``after`` < key <= ``upto`` (``again``: from ``after`` itself on); the bounds are literals, so they reach
    the scan. Rows with a null key come before and after nothing, so they are part of every slice."""
    if after is not None:
        bound = F.lit(after).cast(df.schema[key].dataType)
        df = df.where((F.col(key) >= bound if again else F.col(key) > bound) | F.col(key).isNull())
    if upto is not None:
        df = df.where((F.col(key) <= F.lit(upto).cast(df.schema[key].dataType)) | F.col(key).isNull())
    return df


def reconcile_increment(source: DataFrame, target: DataFrame, key: str | Sequence[str], table: str, run_id: str, now: str | datetime,
                        checkpoint: DataFrame | None = None, open_end: bool = False) -> tuple[DataFrame, DataFrame]:
    """Key reconciliation of the rows after the checkpoint, and the next checkpoint record.

    ``checkpoint`` is the result of ``checkpoint_get``. The slice ends at the source's largest key of this moment; with
    ``open_end`` the target's slice has no end, so target rows beyond the source are extra until the source has them.
    Of a composite key the first column orders the rows and all columns match them; the slice then starts at the last
    value itself, which may have got further rows since.
    """
    keys = [key] if isinstance(key, str) else list(key)
    key, again = keys[0], len(keys) > 1
    spark = source.sparkSession
    last = checkpoint.first() if checkpoint is not None else None
    after = last["last_key"] if last is not None else None
    upto = incremental_slice(source, key, after, again=again).agg(F.max(key).cast("string")).first()[0] or after
    chunk = (last["chunk_index"] + 1) if last is not None else 0
    if upto is None and not open_end:  # no source key yet: only rows without one can be compared
        result = reconcile_keys(source.where(F.col(key).isNull()), target.where(F.col(key).isNull()), keys)
    else:
        result = reconcile_keys(incremental_slice(source, key, after, upto, again),
                                incremental_slice(target, key, after, None if open_end else upto, again), keys)
    record = spark.createDataFrame([(table, run_id, None, upto, chunk)], CHECKPOINT_SCHEMA)
    return result, record.withColumn("last_validated_at", F.lit(str(now)).cast("timestamp_ntz"))
