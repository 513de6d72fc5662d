"""Validation checkpoints: how far each (table, run) has been validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SCHEMA = ("table string, run_id string, last_validated_at timestamp_ntz, last_key string, "
                     "chunk_index bigint")


def checkpoint_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The latest record of each (table, run); of equally late ones, that with the larger chunk and key."""
    columns = ["last_validated_at", "chunk_index", "last_key"]
    latest = (existing.unionByName(new).groupBy("table", "run_id")
              .agg(F.max(F.struct(*columns)).alias("latest")))
    return latest.select("table", "run_id", "latest.*")


def checkpoint_get(checkpoints: DataFrame, table: str, run_id: str) -> DataFrame:
    """The latest record of one table and run: no row or one."""
    mine = checkpoints.where((F.col("table") == table) & (F.col("run_id") == run_id))
    return checkpoint_upsert(mine, mine.limit(0))


def checkpoint_latest(checkpoints: DataFrame, table: str) -> DataFrame:
    """The latest record of one table, whichever run wrote it: no row or one."""
    columns = ["last_validated_at", "chunk_index", "last_key", "run_id"]
    latest = (checkpoints.where(F.col("table") == table).groupBy("table")
              .agg(F.max(F.struct(*columns)).alias("latest")))
    return latest.select("table", *[f"latest.{c}" for c in ("run_id", "last_validated_at", "last_key", "chunk_index")])


def append_checkpoints(new: DataFrame, path: str) -> None:
    """Append to the log; the latest record wins when it is read."""
    new.write.mode("append").parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(CHECKPOINT_SCHEMA).parquet(path)
    return checkpoint_upsert(log, log.limit(0))


def compact_checkpoints(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the latest records to a new place; the log being read is never overwritten."""
    read_checkpoints(spark, path).write.mode("errorifexists").parquet(new_path)
