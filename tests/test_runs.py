"""Roll-up, gates, stores, increments, streaming and a whole validation run."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import increments, keys
from plumbline.plans import rollup
from plumbline.plans.results import RULE_RESULTS_SCHEMA
from plumbline.plans.validation import TableSpec, validate
from plumbline.sources.checkpoints import (CHECKPOINT_SCHEMA, append_checkpoints, checkpoint_get, checkpoint_upsert,
                                           compact_checkpoints, read_checkpoints)
from plumbline.sources.results import list_runs, read_results, write_report, write_results
from plumbline.streaming.increments import read_stream_results, stream_reconcile
from tests.conftest import one, rows


def results(spark, *triples, run="r"):
    """(stage, status, severity) rows."""
    return spark.createDataFrame(
        [(run, stage, f"rule{i}", "t", None, status, severity, {"n": float(i)}, "d", None)
         for i, (stage, status, severity) in enumerate(triples)], RULE_RESULTS_SCHEMA)


@pytest.mark.parametrize("given, want", [
    ([("PASS", "HIGH"), ("FAIL", "HIGH")], "FAIL"), ([("FAIL", "MEDIUM")], "WARN"), ([("WARN", "MEDIUM")], "WARN"),
    ([("FAIL", "LOW")], "PASS"), ([("SKIPPED", "MEDIUM"), ("PASS", "HIGH")], "PASS")])
def test_rollup(spark, given, want):
    found = one(rollup.rollup(results(spark, *[("s", *g) for g in given])))
    assert found["status"] == want and found["rules_checked"] == len(given)
    assert found["rules_skipped"] == sum(g[0] == "SKIPPED" for g in given)


@pytest.mark.parametrize("given, urgency, blocked, advice", [
    (("FAIL", "HIGH"), "normal", True, "BLOCK"), (("FAIL", "HIGH"), "audit", False, "PROCEED"),
    (("FAIL", "MEDIUM"), "normal", False, "PROCEED_WITH_CAUTION"), (("PASS", "HIGH"), "normal", False, "PROCEED")])
def test_go_live(spark, given, urgency, blocked, advice):
    found = one(rollup.go_live(results(spark, ("s", *given)), urgency))
    assert (found["go_live_blocked"], found["recommendation"]) == (blocked, advice)


def test_top_failures(spark):
    df = results(spark, ("s", "FAIL", "MEDIUM"), ("s", "FAIL", "HIGH"), ("s", "FAIL", "LOW"), ("s", "PASS", "HIGH"))
    assert [(r["position"], r["rule"]) for r in rollup.top_failures(df, 2).orderBy("position").collect()] == [(1, "rule1"), (2, "rule0")]
    assert rows(rollup.failure_counts(df)) == [("r", "HIGH", 1), ("r", "LOW", 1), ("r", "MEDIUM", 1)]


@pytest.mark.parametrize("urgency, severity, skipped", [
    ("normal", "HIGH", True), ("normal", "MEDIUM", False), ("critical", "MEDIUM", True), ("audit", "HIGH", False)])
def test_stage_gate(spark, urgency, severity, skipped):
    df = results(spark, ("table_profiling", "FAIL", severity), ("reconciliation", "PASS", "HIGH"))
    got = {r["stage"]: r for r in rollup.stage_gate(df, urgency=urgency).collect()}
    assert got["reconciliation"]["skipped"] is skipped
    assert got["reconciliation"]["status"] == ("WARN" if skipped else "PASS")
    assert not got["table_profiling"]["skipped"]
    with pytest.raises(ValueError):
        rollup.stage_gate(df, urgency="maybe")


def test_later_stages_never_block(spark):
    df = results(spark, ("reconciliation", "FAIL", "HIGH"), ("freshness", "PASS", "HIGH"))
    assert rollup.stage_gate(df).where("skipped").count() == 0


def test_report_and_stores(spark, tmp_path):
    path, reports = str(tmp_path / "results"), str(tmp_path / "reports")
    first = results(spark, ("a", "FAIL", "HIGH"), ("b", "PASS", "HIGH"))
    write_results(first, path)
    write_results(results(spark, ("a", "PASS", "HIGH"), run="007"), path)
    write_results(first, path)
    assert rows(list_runs(spark, path)) == [("007",), ("r",)]
    assert read_results(spark, path, "r").count() == 2 and read_results(spark, path, "007").count() == 1
    write_report(rollup.run_report(read_results(spark, path)), reports)
    document = json.loads(spark.read.text(f"{reports}/run_id=r").first()[0])
    assert document["overall_status"] == "FAIL" and document["tables_validated"] == ["t"]
    assert [s["stage"] for s in document["stages"]] == ["a", "b"]
    assert document["stages"][0]["failures"][0]["rule"] == "rule0"


def log(spark, *records):
    return spark.createDataFrame(records, CHECKPOINT_SCHEMA.replace("timestamp_ntz", "string")).withColumn(
        "last_validated_at", F.col("last_validated_at").cast("timestamp_ntz"))


def test_checkpoints(spark, tmp_path):
    old = log(spark, ("t", "r", "2024-01-01", "5", 0), ("u", "r", "2024-01-01", "1", 0))
    new = log(spark, ("t", "r", "2024-01-02", "9", 1))
    latest = checkpoint_upsert(old, new)
    assert latest.count() == 2 and one(checkpoint_get(latest, "t", "r"))["last_key"] == "9"
    assert checkpoint_get(latest, "x", "r").count() == 0
    path = str(tmp_path / "log")
    append_checkpoints(old, path)
    append_checkpoints(new, path)
    compact_checkpoints(spark, path, str(tmp_path / "compact"))
    assert rows(read_checkpoints(spark, path)) == rows(read_checkpoints(spark, str(tmp_path / "compact")))


def test_two_increments_equal_one_full_run(spark, pair):
    source, target = pair
    inside = F.col("o_orderkey") < 10_000_000  # extra keys beyond the source's last key stay outside every slice
    full = one(keys.reconcile_keys(source, target.where(inside), ["o_orderkey"]))
    first, record = increments.reconcile_increment(
        source.where("o_orderkey < 700"), target.where(inside & (F.col("o_orderkey") < 700)), "o_orderkey", "orders", "r", "2024-01-01")
    second, last = increments.reconcile_increment(source, target.where(inside), "o_orderkey", "orders", "r", "2024-01-02", record)
    a, b = one(first), one(second)
    assert all(a[c] + b[c] == full[c] for c in full if c.endswith(("_rows", "_keys")))
    assert one(last)["last_key"] == "1499" and one(last)["chunk_index"] == 1
    third, again = increments.reconcile_increment(source, target.where(inside), "o_orderkey", "orders", "r", "2024-01-03", last)
    assert one(third)["source_rows"] == 0 and one(again)["last_key"] == "1499"
    empty, nothing = increments.reconcile_increment(source.limit(0), target, "o_orderkey", "orders", "r", "2024-01-03")
    assert one(empty)["source_rows"] == 0 and one(nothing)["last_key"] is None


def test_increment_bounds_reach_the_scan(spark, sf):
    df = increments.incremental_slice(spark.read.parquet(f"{sf}/events.parquet"), "event_id", "100", "200")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,100)" in plan and "LessThanOrEqual(event_id,200)" in plan
    assert df.count() == 100


def test_stream_resumes_and_replays(spark, pair, tmp_path):
    source, target = pair
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    source.where("o_orderkey < 800").coalesce(1).write.parquet(folder)
    run = lambda: stream_reconcile(spark, folder, source.schema, target, "o_orderkey", out, state, 1).awaitTermination()
    run()
    source.where("o_orderkey >= 800").coalesce(1).write.mode("append").parquet(folder)
    run()
    run()
    assert rows(read_stream_results(spark, out)) == [("matched", 1484, 1484), ("missing", 16, 16)]


@pytest.mark.parametrize("files", [[[1, 2], [2, 3]], [[1, 2, 2, 3]], [[2], [1, 3], [3, 2]], [[None, 1], [None, 4]]])
def test_stream_counts_a_key_once_and_keeps_extras(spark, tmp_path, files):
    from plumbline.operators.keys import key_presence
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    target = spark.createDataFrame([(k,) for k in (1, 2, 3, 9, None)], "k long")
    for i, keys in enumerate(files):
        spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1).write.mode("append").parquet(folder)
        stream_reconcile(spark, folder, target.schema, target, "k", out, state).awaitTermination()
    got = rows(read_stream_results(spark, out, target, "k").where("keys > 0 or source_rows > 0"))
    source = spark.createDataFrame([(k,) for keys in files for k in keys], "k long")
    want = rows(key_presence(source, target, ["k"]).groupBy("presence").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n_source").alias("source_rows")))
    assert got == want


def specs(source, target, **more):
    return [TableSpec("orders", source, target, ["o_orderkey"], fuzzy_columns=["o_orderpriority"],
                      business_rules={"revenue": "sum(o_totalprice)"}, **more)]


def test_validation_stops_at_a_blocking_stage(spark, pair):
    found = validate(specs(*pair), "r1", "2002-01-01")
    assert {r[0] for r in found.select("stage").distinct().collect()} == {"table_profiling"}
    status = {r["rule"]: r["status"] for r in found.collect()}
    assert status["row_count_reconciliation"] == "FAIL" and status["schema_compatibility"] == "PASS"
    assert status["referential_integrity"] == "SKIPPED"


def test_audit_runs_everything(spark, pair, sf, tmp_path):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    found = validate(specs(*pair, foreign_keys={"customer": (customer, [("o_custkey", "c_custkey")])},
                           constraints=keys.Constraints(not_null=["o_orderdate"]), checkpoint_path=str(tmp_path / "log")),
                     "r2", "2002-01-01", urgency="audit").cache()
    assert {r[0] for r in found.select("stage").distinct().collect()} == {
        "table_profiling", "column_profiling", "pattern_analysis", "reconciliation", "semantic", "freshness"}
    failed = {(r["rule"], r["column"]) for r in found.where("status = 'FAIL'").collect()}
    assert {("missing_records", None), ("whitespace_encoding", "o_orderstatus"), ("temporal_sequence", "o_orderdate"),
            ("referential_integrity", "customer"), ("null_completeness_ratio", "o_orderpriority")} <= failed
    assert one(rollup.go_live(found, "audit"))["go_live_blocked"] is False
    assert read_checkpoints(spark, str(tmp_path / "log")).count() == 1
    assert found.columns == [c.split()[0] for c in RULE_RESULTS_SCHEMA.split(", ")]


def test_a_clean_pair_goes_live(spark, pair):
    source, _ = pair
    found = validate(specs(source, source.repartition(3)), "r3", "2002-01-01", agents=["table_profiling", "reconciliation"])
    assert found.where("status in ('FAIL', 'WARN')").count() == 0
    assert one(rollup.go_live(found))["recommendation"] == "PROCEED"


def test_null_keys_and_extra_rows_of_an_increment(spark):
    source = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    target = spark.createDataFrame([(1,), (2,), (9,)], "k long")
    got = increments.reconcile_increment(source, target, "k", "t", "r", "2024-01-01", open_end=True)[0].first()
    assert got["source_rows"] == 3 and got["target_rows"] == 3 and got["status"] == "FAIL"


def test_run_ids_stay_text(spark, tmp_path):
    from plumbline.plans.results import RULE_RESULTS_SCHEMA
    from plumbline.sources.results import list_runs, read_results, write_results
    rows = spark.createDataFrame([], RULE_RESULTS_SCHEMA)
    stored = spark.range(7, 9).selectExpr(
        *[f"lpad(id, 3, '0') AS `{n}`" if n == "run_id" else f"cast(null as {t}) AS `{n}`" for n, t in rows.dtypes])
    write_results(stored, str(tmp_path / "runs"))
    assert sorted(r[0] for r in list_runs(spark, str(tmp_path / "runs")).collect()) == ["007", "008"]
    assert read_results(spark, str(tmp_path / "runs"), "007").count() == 1


def test_increments_of_composite_keys(spark):
    rows_ = "values (1, 1), (1, 2), (2, 1)"
    source = spark.sql(f"select * from {rows_} as t(a, b)")
    target = source.where("NOT (a = 1 AND b = 2)")
    found, record = increments.reconcile_increment(source, target, ["a", "b"], "t", "r1", "2024-01-01")
    assert one(found)["missing_rows"] == 1 and one(record)["last_key"] == "2"
    # a further row of the last value isn't passed over
    more = source.union(spark.sql("select 2, 2"))
    found, _ = increments.reconcile_increment(more, source, ["a", "b"], "t", "r1", "2024-01-02", record)
    assert (one(found)["source_rows"], one(found)["missing_rows"]) == (2, 1)


def test_a_new_run_goes_on_from_the_last_checkpoint(spark, tmp_path):
    log = str(tmp_path / "log")
    for run, size, seen in (("r1", 5, 5), ("r2", 8, 3)):
        df = spark.range(size).withColumnRenamed("id", "k")
        spec = TableSpec("t", df, df, ["k"], checkpoint_path=log)
        results = validate([spec], run, "2024-01-01 00:00:00", agents=["reconciliation"])
        metrics = one(results.where("rule = 'incremental_validation'"))["metrics"]
        assert float(metrics["source_rows"]) == seen
