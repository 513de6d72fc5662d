"""Helpers of the training-data operators: shared folders, salts, hash sums of fixed size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.workspace import use_checkpoint_dir

#: ASCII white space, the only word separators.
SPACE = r"[\x20\x09-\x0D]"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, which all executors share."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet to the shared folder and continue from the files: lineage ends here."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, small: DataFrame, on: str, by: str, how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Equi-join in which the rows of a key are dealt to ``salts`` tasks by a hash of ``by``; ``small`` (one or a few
    rows a key) is repeated as often. For keys that may hold a third of all rows."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return left.join(small.withColumn("_salt", spread), [on, "_salt"], how).drop("_salt")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
