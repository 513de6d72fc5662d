"""Distribution tests, outliers and quantiles on literal samples and against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.statistics import chi_square_p_value, log_gamma
from plumbline.operators import drift, outliers, profile
from plumbline.operators.ordering import quantiles, row_numbers, running_totals, value_counts
from tests.conftest import one, rows


@pytest.mark.parametrize("source, target, low, high, significant", [
    (range(1, 11), range(1, 11), 0, 0, False),
    (range(100), range(100, 200), 0.5, 1, True),
    ([], [1, 2, 3], 0, 0, False),
    (range(1, 11), [*range(1, 10), 11], 0, 0.2, False),
])
def test_ks_literals(column, source, target, low, high, significant):
    s, t = column(map(float, source)), column(map(float, target))
    found = one(drift.ks_test(s, t, ["v"], min_values=0))
    assert low <= found["statistic"] <= high
    assert found["significant"] is significant
    if not list(source):
        assert found["p_value"] == 1


def test_ks_matches_direct_computation(column):
    rng = random.Random(3)
    a = [rng.choice([0.5, 1.0, rng.gauss(0, 1)]) for _ in range(400)]
    b = [rng.choice([1.0, rng.gauss(0.2, 1.5)]) for _ in range(300)]
    points = sorted(set(a) | set(b))
    want = max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)
    assert one(drift.ks_test(column(a), column(b)))["statistic"] == pytest.approx(want, abs=1e-12)


def test_ks_of_nearly_equal_large_samples_is_not_significant(spark):
    s = spark.range(600_000).select(F.col("id").cast("double").alias("v"))
    t = s.select(F.when(F.col("v") == 5, 7.0).otherwise(F.col("v")).alias("v"))
    assert one(drift.ks_test(s, t))["status"] == "PASS"


def test_ks_with_one_value_holding_a_third_of_all_rows(spark):
    s = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id")).cast("double").alias("v"))
    assert one(drift.ks_test(s, s))["statistic"] == 0


def test_chi_square_literals(spark):
    def counts(numbers):
        return spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "c int, n int").selectExpr(
            "cast(c as string) as c", "explode(sequence(1, n)) as x").select("c")
    same = one(drift.chi_square(counts([10, 20, 30, 40]), counts([10, 20, 30, 40]), ["c"], scale_expected=False))
    assert same["statistic"] == 0 and same["p_value"] == 1 and not same["significant"]
    moved = one(drift.chi_square(counts([25] * 4), counts([50, 10, 10, 30]), ["c"], scale_expected=False))
    assert moved["statistic"] == pytest.approx(44) and moved["degrees_of_freedom"] == 3
    assert moved["p_value"] == pytest.approx(1.5e-9, rel=0.05) and moved["status"] == "FAIL"
    gone = one(drift.chi_square(counts([2, 3]), counts([2, 3]).limit(0), ["c"], scale_expected=False))
    assert gone["statistic"] == 5
    assert one(drift.chi_square(counts([2, 3]), counts([2, 3]).limit(0), ["c"]))["statistic"] == 0


@pytest.mark.parametrize("statistic, df, want", [
    (400.0, 3, 2.1e-86), (3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (100000.0, 100000, 0.4994053),
    (124.34211340400407, 100, 0.05), (0.0, 4, 1.0)])
def test_chi_square_p_values(spark, statistic, df, want):
    got = spark.range(1).select(chi_square_p_value(F.lit(statistic), F.lit(df))).first()[0]
    assert got == pytest.approx(want, rel=2e-2 if want < 1e-9 else 1e-4)


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 3.0, 10.5, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "z double").select("z", log_gamma(F.col("z")).alias("g"))
    for z, g in df.collect():
        assert g == pytest.approx(math.lgamma(z), abs=1e-9)


@pytest.mark.parametrize("values, want", [
    ([*range(1, 10), 100], [100.0]), ([5] * 8, []), ([1, 2], [])])
def test_iqr_outliers(column, values, want):
    assert [r["v"] for r in outliers.iqr_outliers(column(map(float, values)), "v").collect()] == want


def test_zscore(column):
    assert outliers.zscore_outliers(column([*map(float, range(1, 10)), 50.0]), "v", 2.0).count() == 1
    assert outliers.zscore_outliers(column([5.0] * 5), "v").count() == 0
    assert {r["z_score"] for r in outliers.zscore(column([5.0] * 5), "v").collect()} == {0.0}


def test_zscore_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 10.0)], "g string, v double")
    assert rows(outliers.zscore(df, "v", ["g"]).select("g", "z_score")) == [
        ("a", -1.0), ("a", 1.0), (None, 0.0), (None, 0.0)]


def test_outlier_rate_needs_eleven_values(column):
    assert one(outliers.outlier_rate(column(map(float, range(10)))))["status"] == "SKIPPED"
    many = one(outliers.outlier_rate(column([*map(float, range(20)), 500.0, 600.0, 700.0])))
    assert many["outliers"] == 3 and many["status"] == "FAIL"


def test_drift_score(column):
    same = column(map(float, range(1, 11)))
    assert one(drift.drift_score(same, same))["drift_score"] < 0.1
    far = one(drift.drift_score(column(map(float, range(100))), column(map(float, range(200, 300)))))
    assert far["drift_score"] > 0.3 and far["source_median"] == 49.5 and far["target_median"] == 249.5


def test_frequency_shift(spark, column):
    def letters(a, b, c):
        return column(["a"] * a + ["b"] * b + ["c"] * c, kind="string")
    moved = drift.frequency_shift(letters(50, 30, 20), letters(30, 50, 20), "v")
    assert {r["value"]: round(r["shift"], 6) for r in moved.collect()} == {"a": 0.2, "b": 0.2, "c": 0.0}
    assert one(drift.frequency_shift_verdict(moved))["status"] == "WARN"
    same = drift.frequency_shift(letters(5, 3, 2), letters(5, 3, 2), "v")
    assert one(drift.frequency_shift_verdict(same))["status"] == "PASS"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 101])
def test_quantiles(column, n):
    rng = random.Random(n)
    values = sorted(rng.choice([1.5, rng.random()]) for _ in range(n))
    counts = value_counts(column(values), ["v"])
    linear = one(quantiles(counts, {"q": 0.25, "m": 0.5, "t": 0.9}, "linear"))
    assert [linear[k] for k in "qmt"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))
    at = n * 0.25
    want = (values[math.ceil(at) - 1] if at % 1 else (values[int(at) - 1] + values[int(at)]) / 2 if n % 2 == 0
            else values[int(at)])
    nearest = one(quantiles(counts, {"q": 0.25, "m": 0.5}))
    assert nearest["q"] == pytest.approx(want) and nearest["m"] == pytest.approx(float(np.median(values)))


def test_distribution_summary(column):
    values = [1.0, 2.0, 2.0, 9.0, 4.0]
    found = one(profile.distribution_summary(column(values)))
    x = np.array(values)
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert found["skewness"] == pytest.approx(g1 * math.sqrt(5 * 4) / 3)
    assert found["stddev"] == pytest.approx(x.std()) and found["median"] == 2.0


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_totals_do_not_depend_on_slices(spark, slices):
    df = spark.range(500).selectExpr("id % 2 as g", "id as k", "id % 5 + 1 as n").repartition(7)
    got = running_totals(df, ["k"], ["n"], by=["g"], slices=slices).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"]):
            total += r["n"]
            assert r["upto_n"] == total
        assert all(r["all_n"] == total for r in got if r["g"] == g)


def test_row_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    assert rows(row_numbers(df, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]
