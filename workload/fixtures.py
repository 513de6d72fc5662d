"""Source/target pairs derived from the test tables.

Only one copy of each table exists, so the target of ``orders`` is the whole table with faults put in at known keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with missing, changed, repeated and extra rows, in one scan."""
    key = F.col("o_orderkey")
    at = lambda modulus, rest: key % modulus == rest
    changed = table(spark, sf_dir, "orders").where(~at(97, 0)).withColumns({
        "o_custkey": F.when(at(89, 7), F.lit(-1).cast("long")).otherwise(F.col("o_custkey")),
        "o_orderstatus": F.when(at(67, 4), F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(at(53, 2), F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice")),
        "o_orderdate": F.when(at(71, 8), F.lit(None)).when(at(307, 6), F.col("o_orderdate") + F.expr("interval 10 year"))
        .otherwise(F.col("o_orderdate")),
        "o_orderpriority": F.when(at(41, 3), F.lit(None)).otherwise(F.col("o_orderpriority"))})
    shifts = F.filter(F.array(F.lit(0), F.when(at(101, 1), 0), F.when(at(211, 5), 10_000_000)),
                      lambda shift: shift.isNotNull())
    return (changed.withColumn("shift", F.explode(shifts))
            .withColumn("o_orderkey", F.col("o_orderkey") + F.col("shift")).drop("shift"))


def orders_target_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target under another schema: renamed, dropped, added and retyped columns."""
    return orders_target(spark, sf_dir).select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderstatus").alias("o_orderStatus"),
        F.col("o_totalprice").alias("totalPrice"), "o_orderdate",
        (F.col("o_orderdate") + F.expr("interval 20 minutes")).alias("loaded_at"))


def page_addresses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page addresses, and the same after a clean-up that changed the scheme and cut fragments."""
    pages = table(spark, sf_dir, "pages").select("url")
    cleaned = F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "#top", "")
    return pages, pages.select(cleaned.alias("clean_url"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a contact column of mixed formats."""
    local = F.lower(F.regexp_replace("c_name", "#", "."))
    return table(spark, sf_dir, "customer").select(
        "c_name", "c_mktsegment",
        F.when(F.col("c_nationkey") < 16, F.concat(local, F.lit("@example.com")))
        .otherwise(F.format_string("555-%07d", "c_custkey")).alias("contact"),
        F.format_string("10.0.%d.%d", "c_nationkey", F.col("c_custkey") % 256).alias("address"))


def event_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event documents, and the same with one field renamed in error events and one added in purchases."""
    events = table(spark, sf_dir, "events")
    changed = (F.when(F.col("event_type") == "error", F.replace(F.col("props"), F.lit('"k"'), F.lit('"code"')))
               .when(F.col("event_type") == "purchase",
                     F.replace(F.col("props"), F.lit("{"), F.lit('{"note": "paid", ')))
               .otherwise(F.col("props")))
    return events.select("props"), events.select(changed.alias("props"))


def event_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as a validation checkpoint of its type, by user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("table"), F.concat(F.lit("run-"), "user_id").alias("run_id"),
        F.col("ts").alias("last_validated_at"), F.col("event_id").cast("string").alias("last_key"),
        (F.col("event_id") % 7).alias("chunk_index"))


def shipped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the date of their order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
