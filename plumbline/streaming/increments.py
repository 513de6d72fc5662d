"""Reconciling a growing source folder against a target, batch by batch, with the seen keys kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def _seen_before(spark: SparkSession, state_path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Keys with their presence from the batches before ``batch_id``: the state."""
    try:
        seen = spark.read.schema(schema).parquet(state_path).where(F.col("batch_id") < batch_id)
        return seen.select("_key", "presence")
    except AnalysisException:  # no batch has written state yet
        return spark.createDataFrame([], schema).select("_key", "presence")


def stream_reconcile(spark: SparkSession, source_path: str, schema: T.StructType, target: DataFrame, key: str,
                     results_path: str, checkpoint_path: str, max_files: int | None = None) -> StreamingQuery:
    """Process all files not yet seen and stop: each batch's keys are looked up in the target once, when first seen.

    The state is the keys seen so far with their presence (``matched`` or ``missing``), written per batch under
    ``results_path/state``; a key seen again in a later file adds its rows but no key. Results go to
    ``results_path/counts/batch_id=<n>``. A batch replayed after a failure reads only the state of earlier batches and
    overwrites its own folders, so it leaves the same result. Only the target's key range of the batch is scanned.
    Null keys equal each other. Extra target keys are counted when the results are read (``read_stream_results``).
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    key_type = schema[key].dataType
    state_schema = T.StructType([T.StructField("_key", key_type), T.StructField("rows", T.LongType()),
                                 T.StructField("presence", T.StringType()), T.StructField("batch_id", T.LongType())])

    def reconcile(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("rows"))
        seen = _seen_before(spark, f"{results_path}/state", batch_id, state_schema)
        known = counts.join(seen, counts["_key"].eqNullSafe(seen["_key"]), "left").select(
            counts["_key"], "rows", seen["presence"])
        low, high = batch.agg(F.min(key), F.max(key)).first()
        wanted = target.where(F.col(key).between(low, high) | F.col(key).isNull()).select(
            F.col(key).alias("_t")).distinct().withColumn("_hit", F.lit(True))
        fresh = known.where(F.col("presence").isNull()).drop("presence")
        fresh = fresh.join(wanted, fresh["_key"].eqNullSafe(wanted["_t"]), "left").select(
            "_key", "rows", F.when(F.col("_hit"), "matched").otherwise("missing").alias("presence"))
        state = f"{results_path}/state/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(state)
        new = spark.read.parquet(state).groupBy("presence").agg(F.count(F.lit(1)).alias("keys"),
                                                                F.sum("rows").alias("source_rows"))
        again = known.where(F.col("presence").isNotNull()).groupBy("presence").agg(
            F.lit(0).cast("long").alias("keys"), F.sum("rows").alias("source_rows"))
        new.unionByName(again).write.mode("overwrite").parquet(f"{results_path}/counts/batch_id={batch_id}")

    return (reader.parquet(source_path).writeStream.foreachBatch(reconcile).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint_path).start())


def read_stream_results(spark: SparkSession, results_path: str, target: DataFrame | None = None,
                        key: str | None = None) -> DataFrame:
    """Totals over all batches: ``(presence, keys, source_rows)``. Given the target and key, target keys that no batch
    has matched yet are one more row, ``extra``, with no source rows."""
    totals = spark.read.parquet(f"{results_path}/counts").groupBy("presence").agg(
        F.sum("keys").alias("keys"), F.sum("source_rows").alias("source_rows"))
    if target is None:
        return totals
    matched = spark.read.parquet(f"{results_path}/state").where(F.col("presence") == "matched").select("_key")
    keys = target.select(F.col(key).alias("_t")).distinct()
    extra = (keys.join(matched, keys["_t"].eqNullSafe(matched["_key"]), "left_anti")
             .agg(F.count(F.lit(1)).alias("keys")).where("keys > 0")
             .select(F.lit("extra").alias("presence"), "keys", F.lit(0).cast("long").alias("source_rows")))
    return totals.unionByName(extra)
