"""Physical plans: nothing whole in one task, no nested loops, single scans; and results that don't depend on
partitions."""

import re

import pytest

from plumbline.operators import drift, fingerprint, keys, profile
from tests.conftest import rows
from workload.queries import QUERIES

SLOW = {"e2_fuzzy_match", "e3_fuzzy_pairs", "e3_fuzzy_duplicates", "e3_fuzzy_groups_names", "a6_write_results",
        "a7_read_results", "j4_run_report", "f5_stream_reconcile"}
CHEAP = sorted(set(QUERIES) - SLOW)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_products_and_no_window_over_everything(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = [re.sub(r"^[\s:|+*()\d-]+", "", line) for line in plan.splitlines()]
    for i, line in enumerate(lines):
        # (the starts of the slices are summed over one small row per slice)
        if line.startswith("Window ") and "_slice" not in line and i + 2 < len(lines):
            assert "SinglePartition" not in lines[i + 1] + lines[i + 2], name


def test_one_scan_per_side(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert plan_of(keys.reconcile_keys(orders, orders.where("o_orderkey > 5"), ["o_orderkey"])).count("FileScan") == 2
    assert plan_of(fingerprint.table_fingerprint(orders)).count("FileScan") == 1
    null_counts = profile.column_stats(orders, measures=["null_count", "mean"])
    assert plan_of(null_counts).count("FileScan") == 1


def test_only_needed_columns_are_read(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = plan_of(keys.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


@pytest.mark.parametrize("partitions", [1, 13])
def test_results_do_not_depend_on_partitions(spark, pair, partitions):
    source, target = pair
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def measure(s, t):
        return [rows(keys.reconcile_keys(s, t, ["o_orderkey"])), rows(fingerprint.table_fingerprint(t)),
                rows(fingerprint.chunk_hash_compare(s, t, ["o_orderkey"], 100, mode="rank")),
                [(r["column"], r["statistic"]) for r in drift.ks_test(s, t).orderBy("column").collect()]]
    want = measure(source, target)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert measure(source.repartition(partitions), target.repartition(partitions)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
