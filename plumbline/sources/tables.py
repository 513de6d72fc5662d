"""Reading tables (SQL databases and files) and document collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# JDBC URL prefixes and drivers by database type.
_JDBC = {
    "postgresql": ("jdbc:postgresql", "org.postgresql.Driver"),
    "neon": ("jdbc:postgresql", "org.postgresql.Driver"),
    "sqlserver": ("jdbc:sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "mysql": ("jdbc:mysql", "com.mysql.cj.jdbc.Driver"),
}
_KINDS = ("array", "boolean", "null", "number", "object", "string")
_FILES = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    """Open a table for a lazy, partitioned scan.

    File types need ``path``. Database types need ``table`` and either ``url`` or ``host``/``database``;
    ``partition_column``, ``lower_bound``, ``upper_bound`` and ``num_partitions`` split the read over executors.
    A ``mongodb`` collection needs the MongoDB Spark connector on the class path. ``options`` go to the reader.
    """
    kind = spec["type"]
    reader = spark.read.options(**spec.get("options", {}))
    if "schema_ddl" in spec:
        reader = reader.schema(spec["schema_ddl"])
    if kind in _FILES:
        return reader.format(kind).load(spec["path"])
    if kind == "mongodb":
        return (reader.format("mongodb").option("connection.uri", spec["url"])
                .option("database", spec["database"]).option("collection", spec["table"]).load())
    if kind == "jdbc":
        url, driver = spec["url"], spec.get("driver")
    elif kind in _JDBC:
        prefix, driver = _JDBC[kind]
        separator = ";databaseName=" if kind == "sqlserver" else "/"
        host = spec.get("host", "localhost") + (f":{spec['port']}" if "port" in spec else "")
        url = spec.get("url") or f"{prefix}://{host}{separator}{spec['database']}"
    else:
        raise ValueError(f"unknown table type: {kind}")
    reader = reader.format("jdbc").option("url", url).option(
        "dbtable", f"{spec['schema']}.{spec['table']}" if spec.get("schema") else spec["table"])
    for option, key in (("driver", None), ("user", "user"), ("password", "password"),
                        ("partitionColumn", "partition_column"), ("lowerBound", "lower_bound"),
                        ("upperBound", "upper_bound"), ("numPartitions", "num_partitions")):
        value = driver if key is None else spec.get(key)
        if value is not None:
            reader = reader.option(option, value)
    return reader.load()


def document_fields(df: DataFrame, document: str) -> DataFrame:
    """The top-level fields of a JSON document column, over all documents.

    ``types`` joins every type seen (null, boolean, number, string, array, object) by a pipe; ``nullable`` is true
    when the field is null in or absent from any document. ``ordinal`` is its earliest place in a document. Malformed
    documents have no fields.
    """
    spark = df.sparkSession
    parsed = df.select(F.try_parse_json(document).alias("document"), F.json_object_keys(document).alias("names"))
    fields = parsed.lateralJoin(spark.tvf.variant_explode(F.col("document").outer()))
    declared = F.schema_of_variant("value")
    kind = (F.when(declared == "VOID", "null").when(declared == "STRING", "string")
            .when(declared == "BOOLEAN", "boolean").when(declared.startswith("ARRAY"), "array")
            .when(declared.startswith("OBJECT"), "object").otherwise("number"))
    text = F.variant_get("value", "$", "string")
    seen = (fields.where("key is not null").select(
        (F.array_position("names", F.col("key")) - 1).cast("int").alias("pos"), F.col("key").alias("field"), kind.alias("kind"),
                          F.when(kind == "string", F.length(text)).alias("length"))
            .groupBy("field")
            .agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("kind") == "null").alias("nulls"),
                 F.concat_ws("|", *[F.when(F.bool_or(F.col("kind") == t), t) for t in _KINDS]).alias("types"),
                 F.max("length").alias("max_length"), F.min("pos").alias("ordinal")))
    documents = df.agg(F.count(document)).scalar()
    return seen.withColumns({"documents": documents, "nullable": (F.col("present") < documents) | (F.col("nulls") > 0)})
