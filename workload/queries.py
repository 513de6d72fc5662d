"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.verdicts import FAIL, HIGH, verdict
from plumbline.operators import (checks, columns, content, drift, fingerprint, freshness, fuzzy, increments, keys,
                                 outliers, profile, sampling, schema, volume)
from plumbline.plans import rollup
from plumbline.plans.results import to_rule_results, union_results
from plumbline.sources.checkpoints import append_checkpoints, checkpoint_upsert, read_checkpoints
from plumbline.sources.results import list_runs, read_results, write_report, write_results
from plumbline.sources.tables import document_fields, read_table
from plumbline.sources.workspace import use_checkpoint_dir
from plumbline.streaming.increments import read_stream_results, stream_reconcile
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register under a name; floats are rounded to 6 places and times shown as text, as in the SQL."""
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shown(build(spark, sf_dir))
        return build
    return register


def shown(df: DataFrame) -> DataFrame:
    def show(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        return F.col(f"`{f.name}`")
    return df.select(*[show(f) for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the session's checkpoints."""
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.table(spark, sf_dir, "orders"), fx.orders_target(spark, sf_dir)


# --- sources and sinks ------------------------------------------------------------------------------------------------

@query("a1_read_table")
def _(spark, d):
    return read_table(spark, {"type": "parquet", "path": f"{d}/customer.parquet"})


@query("a2_document_fields")
def _(spark, d):
    return document_fields(fx.event_documents(spark, d)[1], "props")


@query("a3_sample_rows")
def _(spark, d):
    return sampling.sample_rows(fx.table(spark, d, "orders"), 100, ["o_orderkey"], seed=7)


@query("a4_distinct_values")
def _(spark, d):
    return sampling.distinct_values(fx.table(spark, d, "lineitem"), "l_partkey")


@query("a5_top_values")
def _(spark, d):
    return sampling.top_values(fx.table(spark, d, "lineitem"), "l_suppkey", 20)


@query("a6_write_results")
def _(spark, d):
    path = scratch(spark, "results")
    write_results(order_rules(spark, d), path)
    write_results(order_rules(spark, d).where("run_id = 'clean'"), path)  # a repeated run replaces itself
    return list_runs(spark, path)


@query("a7_read_results")
def _(spark, d):
    path = scratch(spark, "results")
    write_results(order_rules(spark, d), path)
    return read_results(spark, path, "faulty").select("run_id", "stage", "rule", "table", "column", "status", "severity")


@query("a8_checkpoint_upsert")
def _(spark, d):
    every = fx.event_checkpoints(spark, d)
    return checkpoint_upsert(every.where("table <> 'click'"), every.where("table = 'click'"))


@query("a8_checkpoint_log")
def _(spark, d):
    path, every = scratch(spark, "log"), fx.event_checkpoints(spark, d)
    append_checkpoints(every.where("table <> 'click'"), path)
    append_checkpoints(every.where("table = 'click'"), path)
    return read_checkpoints(spark, path)


# --- tables ------------------------------------------------------------------------------------------------------------

@query("b1_row_count_reconcile")
def _(spark, d):
    return volume.row_count_reconcile(*orders_pair(spark, d), tolerance_pct=1.0)


@query("b2_table_fingerprint")
def _(spark, d):
    return fingerprint.table_fingerprint(fx.table(spark, d, "lineitem"))


@query("b2_compare_fingerprint")
def _(spark, d):
    return fingerprint.compare_fingerprint(*orders_pair(spark, d), algorithm="sha256")


@query("b3_column_catalog")
def _(spark, d):
    return schema.column_catalog(fx.orders_target(spark, d))


@query("b3_schema_compatibility")
def _(spark, d):
    return schema.schema_compatibility(fx.table(spark, d, "orders"), fx.orders_target_v2(spark, d), observed=True)


@query("b4_schema_drift")
def _(spark, d):
    return schema.schema_drift(fx.table(spark, d, "orders"), fx.orders_target_v2(spark, d), observed=True)


@query("b4_field_drift")
def _(spark, d):
    before, after = (document_fields(docs, "props") for docs in fx.event_documents(spark, d))
    return schema.field_drift(before, after)


@query("b5_duplicate_keys")
def _(spark, d):
    return keys.duplicate_keys(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("b6_orphaned_keys")
def _(spark, d):
    return keys.orphaned_keys(fx.orders_target(spark, d), fx.table(spark, d, "customer"), [("o_custkey", "c_custkey")])


@query("b6_orphaned_rows")
def _(spark, d):
    return keys.orphaned_rows(fx.orders_target(spark, d), fx.table(spark, d, "customer"),
                              [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


@query("b7_constraint_check")
def _(spark, d):
    declared = keys.Constraints(
        primary_key=["o_orderkey"], unique=[["o_custkey", "o_orderdate"]], not_null=["o_orderdate", "o_orderpriority"],
        checks={"price_positive": "o_totalprice > 0", "status_known": "o_orderstatus in ('O', 'F', 'P')"},
        foreign_keys={"fk_customer": (fx.table(spark, d, "customer"), [("o_custkey", "c_custkey")])})
    return keys.constraint_check(fx.orders_target(spark, d), declared)


@query("b8_volume_check")
def _(spark, d):
    return volume.volume_check(fx.orders_target(spark, d), baseline=15_000, baseline_pct=10)


# --- columns -----------------------------------------------------------------------------------------------------------

@query("c1_column_stats")
def _(spark, d):
    return profile.column_stats(fx.orders_target(spark, d))


@query("c1_column_stats_items")
def _(spark, d):
    return profile.column_stats(fx.table(spark, d, "lineitem")).withColumn("mean", F.round("mean", 4))


@query("c2_null_rate_delta")
def _(spark, d):
    return columns.null_rate_delta(columns.paired_profile(*orders_pair(spark, d), measures=columns.NULL_MEASURES))


@query("c3_cardinality_delta")
def _(spark, d):
    return columns.cardinality_delta(columns.paired_profile(*orders_pair(spark, d), measures=columns.CARDINALITY_MEASURES))


@query("c4_range_drift")
def _(spark, d):
    return columns.range_drift(columns.paired_profile(*orders_pair(spark, d), measures=columns.RANGE_MEASURES))


@query("c5_type_compatibility")
def _(spark, d):
    return schema.type_compatibility(fx.table(spark, d, "orders"), fx.orders_target_v2(spark, d).withColumn(
        "o_orderkey", F.col("o_orderkey").cast("decimal(10,0)")), target_lengths={"o_custkey": 3, "o_orderstatus": 1})


@query("c6_whitespace_check")
def _(spark, d):
    return columns.whitespace_check(fx.orders_target(spark, d))


@query("c6_whitespace_documents")
def _(spark, d):
    return columns.whitespace_check(fx.table(spark, d, "documents"), ["text", "source"])


@query("c7_format_consistency")
def _(spark, d):
    return columns.format_consistency(fx.contacts(spark, d))


# --- distributions -----------------------------------------------------------------------------------------------------

@query("d1_ks_test")
def _(spark, d):
    return drift.ks_test(*orders_pair(spark, d))


@query("d1_ks_balances")
def _(spark, d):
    return drift.ks_test(fx.table(spark, d, "customer").select(F.col("c_acctbal").alias("balance")),
                         fx.table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance")))


@query("d1_ks_distinct")
def _(spark, d):
    return drift.ks_test(*orders_pair(spark, d), distinct=True)


@query("d2_chi_square")
def _(spark, d):
    return drift.chi_square(*orders_pair(spark, d), ["o_orderstatus", "o_orderpriority"])


@query("d2_chi_square_unscaled")
def _(spark, d):
    return drift.chi_square(*orders_pair(spark, d), ["o_orderstatus", "o_orderpriority"], scale_expected=False)


@query("d3_iqr_outliers")
def _(spark, d):
    return outliers.iqr_outliers(fx.table(spark, d, "events"), "value").select(
        "event_id", "value", "lower_bound", "upper_bound")


@query("d3_iqr_bounds_linear")
def _(spark, d):
    return outliers.iqr_bounds(fx.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], method="linear")


@query("d4_zscore")
def _(spark, d):
    return outliers.zscore(fx.table(spark, d, "customer"), "c_acctbal").select("c_custkey", "z_score")


@query("d4_zscore_outliers")
def _(spark, d):
    return outliers.zscore_outliers(fx.table(spark, d, "events"), "value", 3.0, ["event_type"]).select(
        "event_id", "event_type", "z_score")


@query("d5_outlier_rate")
def _(spark, d):
    return outliers.outlier_rate(fx.table(spark, d, "events"), ["value", "user_id"])


@query("d5_outlier_rate_distinct")
def _(spark, d):
    return outliers.outlier_rate(fx.table(spark, d, "lineitem"), ["l_extendedprice", "l_tax"], distinct=True)


@query("d6_drift_score")
def _(spark, d):
    return drift.drift_score(*orders_pair(spark, d), ["o_totalprice", "o_custkey"])


@query("d7_frequency_shift")
def _(spark, d):
    return drift.frequency_shift(*orders_pair(spark, d), "o_orderstatus")


@query("d7_frequency_shift_dates")
def _(spark, d):
    source, target = orders_pair(spark, d)
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return drift.frequency_shift(source.select(month), target.select(month), "month", denominator="table")


@query("d7_frequency_verdict")
def _(spark, d):
    return drift.frequency_shift_verdict(drift.frequency_shift(*orders_pair(spark, d), "o_orderpriority"), 0.001)


@query("d8_distribution_summary")
def _(spark, d):
    return profile.distribution_summary(fx.table(spark, d, "lineitem"),
                                        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn(
        "mean", F.round("mean", 4))


# --- edit distance -----------------------------------------------------------------------------------------------------

@query("e1_with_similarity")
def _(spark, d):
    return fuzzy.with_similarity(fx.table(spark, d, "part"), "p_name", "p_type").select(
        "p_partkey", "distance", "similarity")


@query("e2_fuzzy_match")
def _(spark, d):
    pages, cleaned = fx.page_addresses(spark, d)
    return fuzzy.fuzzy_match(pages, "url", cleaned, "clean_url")


@query("e3_fuzzy_pairs")
def _(spark, d):
    return fuzzy.fuzzy_pairs(fx.table(spark, d, "part"), "p_name")


@query("e3_fuzzy_duplicates")
def _(spark, d):
    return fuzzy.fuzzy_duplicates(fx.table(spark, d, "part"), "p_name")


@query("e3_fuzzy_groups_names")
def _(spark, d):
    return fuzzy.fuzzy_groups(fuzzy.fuzzy_duplicates(fx.table(spark, d, "customer"), "c_name"))


@query("e4_column_mapping")
def _(spark, d):
    return fuzzy.column_mapping(fx.table(spark, d, "orders"), fx.orders_target_v2(spark, d))


# --- reconciliation ----------------------------------------------------------------------------------------------------

@query("f1_reconcile_keys")
def _(spark, d):
    return keys.reconcile_keys(*orders_pair(spark, d), ["o_orderkey"])


@query("f1_key_presence")
def _(spark, d):
    return keys.key_presence(*orders_pair(spark, d), ["o_orderkey"])


@query("f1_missing_rows")
def _(spark, d):
    return keys.missing_rows(*orders_pair(spark, d), ["o_orderkey"])


@query("f1_extra_rows")
def _(spark, d):
    source, target = orders_pair(spark, d)
    return keys.missing_rows(target, source, ["o_orderkey"])


@query("f1_reconcile_null_keys")
def _(spark, d):
    return keys.reconcile_keys(*orders_pair(spark, d), ["o_custkey", "o_orderdate"])


@query("f2_row_hash")
def _(spark, d):
    return fingerprint.with_row_hash(fx.orders_target(spark, d)).select("o_orderkey", "row_hash")


@query("f2_row_hash_sha256")
def _(spark, d):
    return fingerprint.with_row_hash(fx.table(spark, d, "documents"), algorithm="sha256").select("doc_id", "row_hash")


@query("f2_row_hash_nested")
def _(spark, d):
    return fingerprint.with_row_hash(fx.table(spark, d, "embeddings")).select("vec_id", "row_hash")


@query("f3_chunk_hash_range")
def _(spark, d):
    return fingerprint.chunk_hash_compare(*orders_pair(spark, d), ["o_orderkey"], chunk_size=500)


@query("f3_chunk_hash_hash")
def _(spark, d):
    return fingerprint.chunk_hash_compare(*orders_pair(spark, d), ["o_orderkey"], mode="hash", chunks=64)


@query("f3_chunk_hash_rank")
def _(spark, d):
    return fingerprint.chunk_hash_compare(*orders_pair(spark, d), ["o_orderkey"], chunk_size=1000, mode="rank")


@query("f4_duplicate_excess")
def _(spark, d):
    return keys.duplicate_excess(fx.orders_target(spark, d), ["o_orderkey"])


@query("f5_reconcile_increment")
def _(spark, d):
    source, target = orders_pair(spark, d)
    reached = source.select(F.lit("orders").alias("table"), F.lit("r1").alias("run_id"), "o_orderdate", "o_orderkey").groupBy(
        "table", "run_id").agg(F.max("o_orderdate").alias("last_validated_at"),
                               F.floor(F.avg("o_orderkey")).cast("string").alias("last_key"),
                               F.lit(0).cast("long").alias("chunk_index"))
    return increments.reconcile_increment(source, target, "o_orderkey", "orders", "r1", fx.AS_OF, reached)[0]


@query("f5_stream_reconcile")
def _(spark, d):
    source, target = orders_pair(spark, d)
    results = scratch(spark, "stream")
    stream_reconcile(spark, f"{d}/orders*.parquet", source.schema, target, "o_orderkey", results,
                     scratch(spark, "offsets")).awaitTermination()
    return read_stream_results(spark, results)


@query("f5_stream_two_batches")
def _(spark, d):
    """The orders as two batches that share keys: the even keys first, then all rows; extras of the target count."""
    source, target = orders_pair(spark, d)
    folder, results, offsets = (scratch(spark, x) for x in ("files", "stream", "offsets"))
    for part in (source.where("o_orderkey % 2 = 0"), source):
        part.write.mode("append").parquet(folder)
        stream_reconcile(spark, folder, source.schema, target, "o_orderkey", results, offsets).awaitTermination()
    return read_stream_results(spark, results, target, "o_orderkey")


# --- content -----------------------------------------------------------------------------------------------------------

@query("g1_business_rules")
def _(spark, d):
    return content.business_rules(*orders_pair(spark, d), {
        "order_count": "count(*)", "total_revenue": "sum(o_totalprice)", "avg_order_value": "round(avg(o_totalprice), 2)",
        "finished_ratio": "round(count_if(o_orderstatus = 'F') * 100 / count(*), 2)",
        "largest_order": "max(o_totalprice)"}, tolerance_pct=0.1, round_to=2)


@query("g1_rule_query")
def _(spark, d):
    return content.rule_query(*orders_pair(spark, d), "busiest_customer",
                              "SELECT max(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY o_custkey)")


@query("g2_temporal_order")
def _(spark, d):
    return content.temporal_order(fx.shipped_orders(spark, d), "o_orderdate", "l_shipdate")


@query("g3_pii_scan")
def _(spark, d):
    return content.pii_scan(fx.table(spark, d, "documents"))


@query("g3_pii_conversations")
def _(spark, d):
    return content.pii_scan(fx.table(spark, d, "conversations"))


@query("g3_pii_risk")
def _(spark, d):
    return content.pii_risk(content.pii_scan(fx.contacts(spark, d)))


# --- time --------------------------------------------------------------------------------------------------------------

@query("h1_freshness")
def _(spark, d):
    return freshness.freshness(fx.table(spark, d, "events"), fx.EVENTS_AS_OF, sla_hours=24)


@query("h1_freshness_by_type")
def _(spark, d):
    return freshness.freshness(fx.table(spark, d, "events"), fx.EVENTS_AS_OF, "ts", 48, by=["event_type"])


@query("h2_future_timestamps")
def _(spark, d):
    return freshness.future_timestamps(fx.orders_target(spark, d), fx.AS_OF)


@query("h3_pipeline_lag")
def _(spark, d):
    return freshness.pipeline_lag(fx.orders_target_v2(spark, d), fx.AS_OF, event_ts="o_orderdate").drop(
        "p95_delay_minutes")


@query("h4_null_timestamps")
def _(spark, d):
    return freshness.null_timestamps(fx.orders_target_v2(spark, d))


@query("h5_stale_data")
def _(spark, d):
    return freshness.stale_data(fx.table(spark, d, "orders"), fx.AS_OF, by=["o_orderpriority"])


# --- declared checks ---------------------------------------------------------------------------------------------------

@query("i1_row_count")
def _(spark, d):
    return checks.run_checks(fx.orders_target(spark, d), [checks.check_row_count(">", 0)])


@query("i2_missing")
def _(spark, d):
    return checks.run_checks(fx.orders_target(spark, d), [
        checks.check_missing("o_orderkey"), checks.check_missing("o_orderpriority", "<", 5, percent=True),
        checks.check_missing("o_orderdate")])


@query("i3_duplicates")
def _(spark, d):
    return checks.run_checks(fx.orders_target(spark, d), [checks.check_duplicates("o_orderkey")])


@query("i4_invalid")
def _(spark, d):
    return checks.run_checks(fx.contacts(spark, d), [checks.check_invalid("contact", "email", limit=2)])


@query("i5_required_columns")
def _(spark, d):
    df = fx.orders_target_v2(spark, d)
    return checks.run_checks(df, [checks.check_required_columns(df, ["o_orderkey", "o_orderpriority", "loaded_at"])])


@query("i6_bound")
def _(spark, d):
    return checks.run_checks(fx.orders_target(spark, d), [checks.check_bound("min(o_totalprice)", ">=", 0)])


@query("i7_freshness")
def _(spark, d):
    return checks.run_checks(fx.table(spark, d, "events"), [checks.check_freshness("ts", 2, fx.EVENTS_AS_OF)])


@query("i8_references")
def _(spark, d):
    return checks.run_checks(fx.table(spark, d, "lineitem"), [checks.check_references(
        "l_orderkey", fx.orders_target(spark, d), "o_orderkey", "orders")])


@query("a7_numeric_run_ids")
def _(spark, d):
    path = scratch(spark, "results")
    rows = fx.table(spark, d, "nation").select(
        F.format_string("%03d", "n_nationkey").alias("run_id"), F.lit("s").alias("stage"), F.lit("r").alias("rule"),
        F.lit("nation").alias("table"), F.col("n_name").alias("column"), F.lit("PASS").alias("status"),
        F.lit("LOW").alias("severity"))
    write_results(rows, path)
    return read_results(spark, path).select("run_id", "column", "status")


@query("f5_increment_composite")
def _(spark, d):
    items = fx.table(spark, d, "lineitem")
    target = items.where("NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)")
    return increments.reconcile_increment(items, target, ["l_orderkey", "l_linenumber"], "lineitem", "r1", fx.AS_OF)[0]


@query("b2_fingerprint_types")
def _(spark, d):
    orders = fx.table(spark, d, "orders")
    target = orders.withColumns({"o_orderkey": F.col("o_orderkey").cast("decimal(20,0)"),
                                 "o_totalprice": F.col("o_totalprice").cast("decimal(18,6)")})
    return fingerprint.compare_fingerprint(orders, target).select("source_n_rows", "target_n_rows", "status", "severity")


@query("c4_range_types")
def _(spark, d):
    orders = fx.table(spark, d, "orders").select("o_totalprice")
    target = orders.select(F.col("o_totalprice").cast("decimal(18,6)").alias("o_totalprice"))
    return columns.range_drift(columns.paired_profile(orders, target, measures=columns.RANGE_MEASURES)).select(
        "column", "min_changed", "max_changed", "status", "severity")


@query("c5_narrowing")
def _(spark, d):
    source = fx.table(spark, d, "orders").selectExpr("o_orderkey * 1000000 AS big", "o_orderkey AS small",
                                                     "o_totalprice AS price")
    target = source.selectExpr(*[f"try_cast({c} AS int) AS {c}" for c in source.columns])
    return schema.type_compatibility(source, target)


@query("g3_pii_cards")
def _(spark, d):
    notes = fx.table(spark, d, "customer").selectExpr(
        "concat('n ', c_custkey, ' ', 4000000000000000 + c_custkey * 7, ' 12345678') AS note")
    return content.pii_scan(notes)


def line_numbers(spark, d):
    """Every line item as a note of its numbers: order, part, supplier, line and ship date, one blank between them."""
    return fx.table(spark, d, "lineitem").selectExpr(
        "concat_ws(' ', 'line', l_orderkey, l_partkey, l_suppkey, l_linenumber, date_format(l_shipdate, 'yyyyMMdd')) "
        "AS note")


@query("g3_pii_line_numbers")
def _(spark, d):
    return content.pii_scan(line_numbers(spark, d))


@query("f5_increment_null_keys")
def _(spark, d):
    source, target = orders_pair(spark, d)
    keyed = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey")).alias("k")
    return increments.reconcile_increment(source.select(keyed), target.select(keyed), "k", "orders", "r1", fx.AS_OF,
                                          open_end=True)[0]


@query("i9_volume_outage")
def _(spark, d):
    events = fx.table(spark, d, "events").where("cast(ts AS date) <> date '2024-01-15'")
    return volume.volume_anomaly(events, "ts", "6 hours", preceding=28)


@query("i9_volume_anomaly")
def _(spark, d):
    return volume.volume_anomaly(fx.table(spark, d, "events"), "ts", "6 hours", preceding=28)


@query("i10_run_checks")
def _(spark, d):
    df = fx.orders_target(spark, d)
    return checks.run_checks(df, [
        checks.check_row_count(">", 0), checks.check_missing("o_orderkey"), checks.check_duplicates("o_orderkey"),
        checks.check_missing("o_orderpriority", "<", 5, percent=True), checks.check_bound("min(o_totalprice)", ">=", 0),
        checks.check_freshness("o_orderdate", 2, fx.AS_OF), checks.check_required_columns(df, ["o_orderkey", "o_custkey"]),
        checks.check_references("o_custkey", fx.table(spark, d, "customer"), "c_custkey", "customer")])


# --- roll-up -----------------------------------------------------------------------------------------------------------

def order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule results of two runs: the faulty target of orders, and orders against itself."""
    orders, customer = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "customer")
    parts = []
    for run_id, target in (("faulty", fx.orders_target(spark, sf_dir)), ("clean", orders)):
        def add(stage: str, rule: str, df: DataFrame, column=None, run_id=run_id, metrics=()):
            parts.append(to_rule_results(df, run_id, stage, rule, "orders", column, metrics))
        add("table_profiling", "row_count_reconciliation", volume.row_count_reconcile(orders, target, 1.0),
            metrics=["diff_pct"])
        add("table_profiling", "duplicate_primary_key", keys.duplicate_excess(target, ["o_orderkey"]),
            metrics=["excess_rows"])
        add("table_profiling", "referential_integrity",
            keys.orphaned_keys(target, customer, [("o_custkey", "c_custkey")]), metrics=["orphaned_rows"])
        add("column_profiling", "null_completeness_ratio",
            columns.null_rate_delta(columns.paired_profile(orders, target, measures=columns.NULL_MEASURES)), "column",
            metrics=["delta_pct"])
        add("column_profiling", "whitespace_encoding", columns.whitespace_check(target), "column", metrics=["spaced_rows"])
        found = keys.reconcile_keys(orders, target, ["o_orderkey"])
        add("reconciliation", "row_reconciliation", found, metrics=["missing_rows", "extra_rows"])
        add("reconciliation", "missing_records",
            verdict(found.drop("status", "severity"), (F.col("missing_rows") > 0, FAIL, HIGH)), metrics=["missing_rows"])
        add("freshness", "temporal_sequence", freshness.future_timestamps(target, fx.AS_OF), "column",
            metrics=["future_count"])
        add("freshness", "timestamp_integrity", freshness.null_timestamps(target), "column", metrics=["null_count"])
        add("freshness", "stale_partition", freshness.stale_data(target, fx.AS_OF), "column", metrics=["age_hours"])
    return union_results(spark, parts)


@query("j1_rollup")
def _(spark, d):
    return rollup.rollup(order_rules(spark, d))


@query("j2_go_live")
def _(spark, d):
    return rollup.go_live(order_rules(spark, d))


@query("j3_top_failures")
def _(spark, d):
    return rollup.top_failures(order_rules(spark, d), 5).select(
        "run_id", "position", "stage", "rule", "table", "column", "severity")


@query("j3_failure_counts")
def _(spark, d):
    return rollup.failure_counts(order_rules(spark, d))


@query("j4_run_report")
def _(spark, d):
    path = scratch(spark, "reports")
    write_report(rollup.run_report(order_rules(spark, d)), path)
    stored = spark.read.json(path)
    return stored.select("run_id", "overall_status", "go_live_blocked", F.explode("stages").alias("s")).select(
        "run_id", "overall_status", "go_live_blocked", "s.stage", "s.status", "s.rules_checked",
        F.size("s.failures").cast("long").alias("listed_failures"))


@query("j5_stage_gate")
def _(spark, d):
    return rollup.stage_gate(order_rules(spark, d))


@query("j5_stage_gate_audit")
def _(spark, d):
    return rollup.stage_gate(order_rules(spark, d), urgency="audit")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their faulty target: counts and keys, as rule results, rolled up to a status per stage."""
    source, target = orders_pair(spark, sf_dir)
    parts = [to_rule_results(volume.row_count_reconcile(source, target), "run", "table_profiling",
                             "row_count_reconciliation", "orders"),
             to_rule_results(keys.reconcile_keys(source, target, ["o_orderkey"]), "run", "reconciliation",
                             "row_reconciliation", "orders")]
    return rollup.rollup(union_results(spark, parts))
