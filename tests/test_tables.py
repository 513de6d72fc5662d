"""Counts, keys, schemas, hashes and chunks: literal verdicts and a target with known faults."""

import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions.hashing import number_sql, ordered_digest, row_hash, row_text
from plumbline.operators import fingerprint, keys, sampling, schema, volume
from tests.conftest import one, rows


@pytest.mark.parametrize("n_source, n_target, tolerance, want", [
    (1000, 1000, 0, ("PASS", "HIGH")), (1000, 900, 0, ("FAIL", "HIGH")), (1000, 500, 0, ("FAIL", "HIGH")),
    (1000, 995, 1, ("WARN", "MEDIUM")), (0, 5, 0, ("WARN", "MEDIUM")), (0, 0, 0, ("PASS", "HIGH"))])
def test_row_counts(spark, n_source, n_target, tolerance, want):
    found = one(volume.row_count_reconcile(spark.range(n_source), spark.range(n_target), tolerance))
    assert (found["status"], found["severity"]) == want
    assert found["source_empty"] == (n_source == 0)


def test_volume(spark):
    assert one(volume.volume_check(spark.range(0)))["status"] == "FAIL"
    assert one(volume.volume_check(spark.range(5)))["status"] == "PASS"
    assert one(volume.volume_check(spark.range(80), 100, 10))["status"] == "FAIL"
    assert one(volume.volume_check(spark.range(95), 100, 10))["status"] == "PASS"


def test_volume_anomaly(spark):
    days = [(f"2024-01-{d:02d} 10:00:00",) for d in range(1, 11) for _ in range(10 + d % 2)]
    df = spark.createDataFrame(days + [("2024-01-11 00:00:00",)] * 60, "t string").selectExpr("cast(t as timestamp_ntz) as ts")
    got = {r["bucket"].day: r for r in volume.volume_anomaly(df, "ts", "1 day", 30).collect()}
    assert got[1]["status"] == "SKIPPED" and got[10]["status"] == "PASS" and got[11]["status"] == "FAIL"
    assert got[11]["history"] == 10


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(42,)] * 3 + [(99,)] * 2 + [(1,)], "id int")
    assert rows(keys.duplicate_keys(df, ["id"])) == [(42, 3), (99, 2)]
    assert rows(keys.duplicate_keys(df, ["id"], 1)) == [(42, 3)]
    found = one(keys.duplicate_excess(df, ["id"]))
    assert (found["duplicate_keys"], found["excess_rows"], found["status"]) == (2, 3, "FAIL")


def test_orphans_ignore_null_and_use_all_key_columns(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (3, None), (4, 4), (4, 4)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    on = [("a", "x"), ("b", "y")]
    found = one(keys.orphaned_keys(child, parent, on))
    assert (found["checked_rows"], found["orphaned_rows"], found["orphaned_keys"]) == (4, 3, 2)
    assert rows(keys.orphaned_rows(child, parent, on)) == [(1, 2), (4, 4), (4, 4)]


def test_reconcile_counts_rows_and_equates_nulls(spark):
    s = spark.createDataFrame([(1,), (1,), (2,), (None,), (7,), (7,)], "k int")
    t = spark.createDataFrame([(1,), (None,), (None,), (5,)], "k int")
    found = one(keys.reconcile_keys(s, t, ["k"]))
    assert {k: found[k] for k in ("source_rows", "target_rows", "missing_rows", "extra_rows", "missing_keys", "matched_rows")} == {
        "source_rows": 6, "target_rows": 4, "missing_rows": 3, "extra_rows": 1, "missing_keys": 2, "matched_rows": 3}
    assert rows(keys.missing_rows(s, t, ["k"])) == [(2,), (7,), (7,)]


def test_reconcile_empty_sides(spark):
    some, none = spark.range(3), spark.range(0)
    assert one(keys.reconcile_keys(some, none, ["id"]))["missing_rows"] == 3
    assert one(keys.reconcile_keys(none, some, ["id"]))["extra_rows"] == 3
    assert one(keys.reconcile_keys(none, none, ["id"]))["status"] == "PASS"


def test_known_faults(pair, spark, sf):
    source, target = pair
    found = one(keys.reconcile_keys(source, target, ["o_orderkey"]))
    assert (found["source_rows"], found["target_rows"], found["missing_rows"], found["extra_rows"]) == (1500, 1507, 16, 8)
    assert one(keys.duplicate_excess(target, ["o_orderkey"]))["excess_rows"] == 15
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    assert one(keys.orphaned_keys(target, customer, [("o_custkey", "c_custkey")]))["orphaned_rows"] == 16


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, None, -1), (None, "y", None)], "id int, name string, n int")
    declared = keys.Constraints(primary_key=["id"], unique=[["name"]], not_null=["name"], checks={"positive": "n > 0"})
    got = {r["constraint"]: (r["violations"], r["status"], r["severity"]) for r in keys.constraint_check(df, declared).collect()}
    assert got == {"not_null(id)": (1, "FAIL", "MEDIUM"), "not_null(name)": (1, "FAIL", "MEDIUM"),
                   "positive": (1, "FAIL", "MEDIUM"), "primary_key(id)": (1, "FAIL", "HIGH"), "unique(name)": (0, "PASS", "HIGH")}
    assert one(keys.constraint_check(df, keys.Constraints()))["status"] == "SKIPPED"


def test_row_text_and_hash(spark):
    df = spark.createDataFrame(
        [Row(a=None, b=date(2024, 1, 2), c=datetime(2024, 1, 2, 3, 4, 5, 678901), d=Decimal("1.50"), e=2.5, f="x|y\\", g=True)],
        "a int, b date, c timestamp_ntz, d decimal(5,2), e double, f string, g boolean")
    assert df.select(row_text(df)).first()[0] == "\\N|2024-01-02|2024-01-02T03:04:05.678901|1.50|2.5|x\\|y\\\\|true"
    plain = df.select(row_text(df, ["a", "c", "f"], compat=True)).first()[0]
    assert plain == "\\N|2024-01-02T03:04:05.678Z|x|y\\"
    assert df.select(row_hash(df)).first()[0] == hashlib.md5(df.select(row_text(df)).first()[0].encode()).hexdigest()
    assert len(df.select(row_hash(df, algorithm="sha256")).first()[0]) == 64
    with pytest.raises(ValueError):
        row_hash(df, algorithm="crc")


def test_separator_in_values_is_not_ambiguous(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("\\N", "c"), (None, "c")], "x string, y string")
    assert df.select(row_hash(df)).distinct().count() == 4


def test_nested_values_hash_by_sorted_keys(spark):
    left = spark.sql("select named_struct('b', 1, 'a', map('y', 2, 'x', 1)) as s, array(1, null) as l, cast(null as array<int>) as n")
    right = spark.sql("select named_struct('a', map('x', 1, 'y', 2), 'b', 1) as s, array(1, null) as l, cast(null as array<int>) as n")
    assert left.select(row_text(left)).first()[0] == '{"a":{"x":1,"y":2},"b":1}|[1,null]|\\N'
    assert left.select(row_hash(left)).first() == right.select(row_hash(right)).first()
    variant = spark.sql("""select parse_json('{"b": 1, "a": [true, null]}') as v""")
    assert variant.select(row_text(variant)).first()[0] == '{"a":[true,null],"b":1}'


def test_timestamps_hash_the_same_in_every_time_zone(spark):
    df = spark.sql("select timestamp'2024-03-10 12:00:00.5 UTC' as t")
    texts = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        texts.append(df.select(row_text(df)).first()[0])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert texts == ["2024-03-10T12:00:00.500000"] * 2


def test_floats(spark):
    df = spark.sql("select 0.0D as a, -0.0D as b, 1e300D as c, double('NaN') as d, 0.1D + 0.2D as e")
    assert df.select(row_text(df)).first()[0] == "0.0|0.0|1.0E300|NaN|0.30000000000000004"
    assert df.select(row_text(df, float_scale=2)).first()[0] == "0.00|0.00|1.0E300|NaN|0.30"


def test_ordered_digest(spark):
    digest = lambda *h: spark.range(1).select(ordered_digest(F.array(*map(F.lit, h)))).first()[0]
    assert digest("aaa", "bbb", "ccc") == digest("ccc", "aaa", "bbb") == hashlib.md5(b"aaabbbccc").hexdigest()
    assert digest("aaa", "bbb", "ccc") != digest("aaa", "bbb", "ccd")
    assert len(spark.sql("select array() as h").select(ordered_digest(F.col("h").cast("array<string>"))).first()[0]) == 32


def test_fingerprints(spark, pair):
    source, target = pair
    assert one(fingerprint.compare_fingerprint(source, source.repartition(7).orderBy("o_totalprice")))["status"] == "PASS"
    assert one(fingerprint.compare_fingerprint(source, target))["status"] == "FAIL"
    swapped = source.select(*reversed(source.columns))
    assert one(fingerprint.compare_fingerprint(source, swapped))["status"] == "PASS"
    doubled = source.limit(2).union(source.limit(2))
    assert one(fingerprint.compare_fingerprint(source.limit(2), doubled))["status"] == "FAIL"
    assert one(fingerprint.table_fingerprint(source.limit(0)))["digest"] == "0:0:0"


@pytest.mark.parametrize("options", [{"chunk_size": 100}, {"mode": "hash", "chunks": 16}, {"mode": "rank", "chunk_size": 100}])
def test_chunks_of_equal_tables_match(pair, options):
    source, _ = pair
    found = fingerprint.chunk_hash_compare(source, source.repartition(5), ["o_orderkey"], **options)
    assert found.where("status = 'FAIL'").count() == 0
    assert found.agg(F.sum("source_rows")).first()[0] == 1500


def test_one_changed_row_disturbs_one_range_chunk(pair):
    source, _ = pair
    changed = source.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 250, 0.0).otherwise(F.col("o_totalprice")))
    found = fingerprint.chunk_hash_compare(source, changed, ["o_orderkey"], 100).where("status = 'FAIL'")
    assert [r["chunk"] for r in found.collect()] == [2]


def test_rank_chunks_are_hashes_of_sorted_row_hashes(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b"), (3, "c")], "k int, v string")  # copies straddle chunks
    found = fingerprint.chunk_hash_compare(df, df.where("k < 3"), ["k"], 3, mode="rank")
    hashes = [hashlib.md5(t.encode()).hexdigest() for t in ["1|a"] * 5 + ["2|b", "3|c"]]
    want = [hashlib.md5("".join(sorted(hashes[i:i + 3])).encode()).hexdigest() for i in (0, 3, 6)]
    got = {r["chunk"]: r for r in found.collect()}
    assert [got[i]["source_digest"] for i in range(3)] == want
    assert [got[i]["status"] for i in range(3)] == ["PASS", "PASS", "FAIL"]


def test_string_keys_need_hash_chunks(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        fingerprint.chunk_hash_compare(df, df, ["k"])
    assert fingerprint.chunk_hash_compare(df, df, ["k"], mode="hash", chunks=4).count() == 1


def test_schema_checks(spark):
    s = spark.createDataFrame([(1, "abc", 12.5, 1)], "id long, Name string, n double, z int")
    t = spark.createDataFrame([("abc", 1, None)], "name string, id int, extra string")
    issues = {r["name"]: r["issue"] for r in schema.schema_compatibility(s, t, skip=["Z"]).collect()}
    assert issues == {"id": "moved", "name": "moved", "n": "missing", "extra": "extra"}
    assert rows(schema.schema_drift(s, t, skip=["z"]).select("name", "change")) == [("extra", "added"), ("n", "removed")]
    types = {r["name"]: (r["status"], r["lost_length"]) for r in schema.type_compatibility(s, t, target_lengths={"name": 2}).collect()}
    assert types == {"id": ("WARN", 0), "name": ("FAIL", 1)}


def test_column_catalog(spark):
    df = spark.sql("select cast(123.450 as decimal(10,3)) as d, -1200L as l, 0.5D as f, 'héé' as s union all select null, null, null, null")
    got = {r["column"]: (r["null_count"], r["max_length"], r["max_digits"], r["max_scale"]) for r in schema.column_catalog(df).collect()}
    assert got == {"d": (1, None, 3, 2), "l": (1, None, 4, 0), "f": (1, None, 1, 1), "s": (1, 3, None, None)}


def test_decimals_lose_digits(spark):
    s, t = spark.sql("select 12345.678D as v"), spark.sql("select cast(1 as decimal(6,2)) as v")
    found = one(schema.type_compatibility(s, t))
    assert (found["lost_digits"], found["lost_scale"], found["status"]) == (1, 1, "FAIL")


def test_scales_beyond_ten_and_narrow_integers(spark):
    s = spark.sql("select 0.123456789012345678BD as a, 1000000000000L as b, 2.5D as c, 1e300D as d, 7L as e, 0BD as f")
    t = spark.sql("select cast(0 as decimal(38,12)) as a, 1 as b, 1L as c, 1L as d, 1S as e, 1 as f")
    got = {r["name"]: (r["lost_digits"], r["lost_scale"], r["status"]) for r in schema.type_compatibility(s, t).collect()}
    assert got == {"a": (0, 6, "FAIL"), "b": (3, 0, "FAIL"), "c": (0, 1, "FAIL"), "d": (282, 0, "FAIL"),
                   "e": (0, 0, "WARN"), "f": (0, 0, "WARN")}


def test_column_names_with_quotes(spark):
    df = spark.range(3).withColumnRenamed("id", "it's")
    assert [r["column"] for r in schema.column_catalog(df).collect()] == ["it's"]


def test_equal_numbers_of_other_types_hash_alike(spark):
    s = spark.sql("select * from values (1L, 2.5D, 0.1f), (2L, 1e7D, -3f), (3L, 0.05D, 0f), (4L, null, null) as t(k, v, w)")
    t = s.selectExpr("cast(k as decimal(10,0)) k", "cast(v as decimal(20,6)) v", "cast(cast(w as string) as double) w")
    assert one(fingerprint.compare_fingerprint(s, t))["status"] == "PASS"
    assert {r["status"] for r in fingerprint.chunk_hash_compare(s, t, ["k"], mode="hash", chunks=3).collect()} == {"PASS"}
    other = t.withColumn("v", F.col("v") + F.expr("0.000001BD"))
    assert one(fingerprint.compare_fingerprint(s, other))["status"] == "FAIL"
    texts = {"2.50": "25E-1", "-0.050": "-5E-2", "100": "1E2", "1.0E7": "1E7", "0.00": "0", "-0.0": "0", "NaN": "NaN"}
    df = spark.createDataFrame(list(texts.items()), "a string, b string").select(F.expr(number_sql("a")).alias("got"), "b")
    assert all(r["got"] == r["b"] for r in df.collect())


def test_sampling(spark):
    df = spark.range(100)
    first = rows(sampling.sample_rows(df, 10, ["id"], 1))
    assert first == rows(sampling.sample_rows(df.repartition(9), 10, ["id"], 1)) != rows(sampling.sample_rows(df, 10, ["id"], 2))
    values = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "v string")
    assert rows(sampling.distinct_values(values, "v", 2)) == [("a",), ("b",)]
    assert [tuple(r) for r in sampling.top_values(values, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert 0 < sampling.sample_fraction(spark.range(10_000), 0.1, 3).count() < 2000


def test_a_bucket_without_rows_is_an_anomaly(spark):
    days = [d for d in range(1, 21) if d != 15]
    df = spark.range(10).selectExpr(f"explode(array({','.join(map(str, days))})) AS d", "id").selectExpr(
        "make_timestamp_ntz(2024, 1, d, 12, 0, 0) AS ts")
    got = {r["bucket"].day: r for r in volume.volume_anomaly(df, "ts", "1 day", 30).collect()}
    assert len(got) == 20 and got[15]["n_rows"] == 0 and got[15]["status"] == "FAIL"
