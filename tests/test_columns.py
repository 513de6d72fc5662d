"""Column profiles and their comparison, documents, content and time checks, declared checks."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import FORMATS, has_outer_space
from plumbline.operators import checks, columns, content, freshness, profile
from plumbline.sources.tables import document_fields, read_table
from tests.conftest import one, rows


def test_column_stats(spark):
    df = spark.createDataFrame([(3, "ab", 1.5), (10, None, 1.5), (None, "xyz", None)], "i int, s string, d double")
    got = {r["column"]: r.asDict() for r in profile.column_stats(df).collect()}
    i = got["i"]
    assert (i["total_count"], i["null_count"], i["distinct_count"], i["min_value"], i["max_value"]) == (3, 1, 2, "3", "10")
    assert i["mean"] == 6.5 and i["stddev"] == pytest.approx(4.949747)
    s = got["s"]
    assert (s["min_length"], s["max_length"], s["avg_length"], s["mean"], s["distinct_count"]) == (2, 3, 2.5, None, 2)
    assert got["d"]["distinct_count"] == 1


def test_only_numeric_text_has_a_mean(spark):
    df = spark.createDataFrame([("1.5",), (" -2e1 ",), ("1-URGENT",), ("abc",), (None,), (".5",)], "s string")
    assert one(profile.column_stats(df))["mean"] == pytest.approx((1.5 - 20 + 0.5) / 3)


def test_long_texts_stay_apart(spark):
    long = "x" * 40
    df = spark.createDataFrame([(long,), (long,), (long + "y",), (" " + long,), ("x",)], "s string")
    found = one(profile.column_stats(df))
    assert (found["distinct_count"], found["max_length"], found["min_length"]) == (4, 41, 1)
    assert one(columns.whitespace_check(df))["spaced_values"] == 1


def test_column_stats_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "i int, s string")
    got = {r["column"]: r.asDict() for r in profile.column_stats(df).collect()}
    assert got["i"]["distinct_count"] == 0 and got["s"]["null_count"] == 1 and got["s"]["min_value"] is None
    assert {r["total_count"] for r in profile.column_stats(df.limit(0)).collect()} == {0}


def test_column_stats_by_measure_and_approximate(spark, pair):
    source, _ = pair
    some = profile.column_stats(source, measures=["null_count"])
    assert some.columns == ["column", "null_count"]
    exact = {r["column"]: r["distinct_count"] for r in profile.column_stats(source, measures=["distinct_count"]).collect()}
    near = {r["column"]: r["distinct_count"] for r in profile.column_stats(source, distinct="approx").collect()}
    assert all(abs(near[c] - exact[c]) <= 0.1 * exact[c] + 1 for c in exact)


def test_nested_columns_have_a_profile(spark):
    df = spark.sql("select array(1, 2) as a, map('k', 1) as m union all select array(1, 2), map('k', 2)")
    got = {r["column"]: r["distinct_count"] for r in profile.column_stats(df).collect()}
    assert got == {"a": 1, "m": 2}


def test_deltas_on_the_faulty_pair(pair):
    profiles = columns.paired_profile(*pair).cache()
    nulls = {r["column"]: r["status"] for r in columns.null_rate_delta(profiles).collect()}
    assert nulls["o_orderpriority"] == "FAIL" and nulls["o_orderkey"] == "PASS"
    assert {r["column"] for r in columns.range_drift(profiles).where("status = 'FAIL'").collect()} >= {"o_orderkey", "o_custkey"}
    status = {r["column"]: r["status"] for r in columns.cardinality_delta(profiles).collect()}
    assert status["o_orderstatus"] == "FAIL" and status["o_orderpriority"] == "PASS"


def test_a_clean_pair_passes(pair):
    source, _ = pair
    profiles = columns.paired_profile(source, source.repartition(5)).cache()
    for check in (columns.null_rate_delta, columns.cardinality_delta, columns.range_drift):
        assert check(profiles).where("status <> 'PASS'").count() == 0


def test_deltas_without_rows(spark):
    empty = spark.createDataFrame([], "v double")
    profiles = columns.paired_profile(empty, spark.createDataFrame([(None,), (1.0,)], "v double"))
    assert one(columns.null_rate_delta(profiles))["delta_pct"] == 50
    assert one(columns.cardinality_delta(profiles))["change_pct"] == 0


@pytest.mark.parametrize("text, want", [
    ("a", False), (" a", True), ("a\t", True), ("a\n", True), (" a", True), ("a ", True), ("﻿a", True),
    ("a b", False), ("", False)])
def test_outer_space(spark, text, want):
    assert spark.range(1).select(has_outer_space(F.lit(text))).first()[0] is want


def test_whitespace_counts_rows_and_values(spark):
    df = spark.createDataFrame([(" a",), (" a",), ("b",), (None,)], "v string")
    found = one(columns.whitespace_check(df))
    assert (found["checked_rows"], found["spaced_rows"], found["spaced_values"], found["status"]) == (3, 2, 1, "FAIL")


@pytest.mark.parametrize("name, good, bad", [
    ("email", "a.b@c.org", "a b@c.org"), ("phone", "+1 555 123-4567", "12345"), ("date_iso", "2024-01-02T00:00", "02.01.2024"),
    ("uuid", "123E4567-e89b-12d3-a456-426614174000", "123e4567"), ("ip_address", "10.0.0.1", "10.0.0.1\n")])
def test_formats(spark, name, good, bad):
    match = lambda t: spark.range(1).select(F.lit(t).rlike(FORMATS[name])).first()[0]
    assert match(good) and not match(bad)


def test_mixed_formats_warn(spark):
    df = spark.createDataFrame([(f"u{i}@x.org",) for i in range(7)] + [("none",), ("nil",), ("n/a",)], "v string")
    got = {r["format"]: r["status"] for r in columns.format_consistency(df).collect()}
    assert got["email"] == "WARN" and got["uuid"] == "PASS"
    half = df.limit(5).union(spark.createDataFrame([(str(i),) for i in range(5)], "v string"))
    assert {r["status"] for r in columns.format_consistency(half).collect()} == {"PASS"}


def test_document_fields(spark):
    docs = spark.createDataFrame([('{"b": 1, "a": "xy"}',), ('{"a": null, "c": [1]}',), ('{"a": 2.5, "b": {"z": true}}',),
                                  (None,), ('{"d": false',)], "doc string")
    got = {r["field"]: r.asDict() for r in document_fields(docs, "doc").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["types"] == "null|number|string" and got["a"]["nullable"] and got["a"]["max_length"] == 2
    assert got["b"]["types"] == "number|object" and got["b"]["ordinal"] == 0
    assert got["c"]["types"] == "array" and got["c"]["present"] == 1


def test_read_table_files(spark, sf, tmp_path):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    for kind in ("orc", "csv", "json"):
        nation.write.format(kind).option("header", True).save(str(tmp_path / kind))
        options = {"header": "true"} if kind == "csv" else {}
        got = read_table(spark, {"type": kind, "path": str(tmp_path / kind), "options": options,
                                 "schema_ddl": "n_nationkey int, n_name string, n_regionkey int"})
        assert rows(got.select(*sorted(got.columns))) == rows(nation.select(*sorted(nation.columns)))
    with pytest.raises(ValueError):
        read_table(spark, {"type": "oracle"})


def test_business_rules(spark):
    s = spark.createDataFrame([("active", 10.0), ("idle", 20.0)], "status string, total double")
    t = spark.createDataFrame([("active", 10.0), ("idle", 25.0)], "status string, total double")
    rules = {"n": "count(*)", "revenue": "sum(total)", "ratio": "round(count_if(status = 'active') * 100 / count(*), 2)"}
    got = {r["rule_name"]: (r["status"], round(r["drift_pct"], 4)) for r in content.business_rules(s, t, rules).collect()}
    assert got == {"n": ("PASS", 0), "revenue": ("FAIL", 16.6667), "ratio": ("PASS", 0)}
    assert {r["status"] for r in content.business_rules(s, t, rules, tolerance_pct=20).collect()} == {"PASS"}
    empty = content.business_rules(s.limit(0), t, {"revenue": "sum(total)"})
    assert one(empty)["status"] == "FAIL"
    assert one(content.rule_query(s, t, "top", "select max(total) from {table}"))["status"] == "FAIL"


def test_temporal_order(spark):
    df = spark.sql("""select * from values (timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-01'),
        (timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02'), (null, timestamp_ntz'2024-01-01') as t(created_at, updated_at)""")
    found = one(content.temporal_order(df))
    assert (found["checked_rows"], found["violations"], found["status"]) == (2, 1, "FAIL")
    assert one(content.temporal_order(df.select("created_at")))["status"] == "SKIPPED"


def test_pii(spark):
    df = spark.createDataFrame([
        (1, "call 555-123-4567 now", "Ann"), (2, "ssn 123-45-6789.", "Bob"), (3, "card 4111 1111 1111 1111", None),
        (4, "from 192.168.0.1 and x@y.org", "Eve"), (5, "order 4111 1111 1111 1112", "Dan")], "id int, note string, last_name string")
    got = {(r["column"], r["pii_type"]): r.asDict() for r in content.pii_scan(df).collect()}
    assert set(got) == {("note", k) for k in ("phone", "ssn", "card_number", "ip_address", "email")} | {("last_name", "name")}
    assert got["note", "card_number"]["matching_rows"] == 1 and got["note", "card_number"]["risk"] == "HIGH"
    assert got["note", "email"]["confidence"] == pytest.approx(0.2) and got["last_name", "name"]["confidence"] == 0.9
    assert one(content.pii_risk(content.pii_scan(df)))["risk_level"] == "HIGH"
    assert one(content.pii_risk(content.pii_scan(df.select("id"))))["risk_level"] == "NONE"


def test_card_numbers_next_to_other_digits(spark):
    texts = [("qty 2 4111 1111 1111 1111", True), ("ref 4111111111111111 12345678", True), ("4111-1111-1111-1111.", True),
             ("1234567894111111111111111", False), ("4111111111111111123456789", False), ("4111  1111  1111  1111", False),
             ("", False), (None, None), ("1 " * 50_000, False), ("9" * 100_000, False)]
    df = spark.createDataFrame(texts, "note string, want boolean")
    got = df.select(content.has_pii(F.col("note"), "card_number").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


AS_OF = "2024-01-02 00:00:00"


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_freshness(spark, kind):
    df = spark.sql(f"select cast('2024-01-01' as {kind}) as updated_at, cast('2020-01-01' as {kind}) as created_at")
    found = one(freshness.freshness(df, AS_OF))
    assert (found["column"], found["age_hours"], found["status"]) == ("updated_at", 24, "PASS")
    assert one(freshness.freshness(df, AS_OF, sla_hours=23))["status"] == "FAIL"
    assert one(freshness.freshness(df.limit(0), AS_OF))["status"] == "FAIL"
    assert one(freshness.freshness(spark.range(1), AS_OF))["status"] == "SKIPPED"
    assert one(freshness.stale_data(df.select("created_at"), AS_OF))["status"] == "WARN"
    assert one(freshness.stale_data(df.select("updated_at"), AS_OF))["status"] == "PASS"


def test_future_null_and_lag(spark, pair):
    _, target = pair
    assert one(freshness.future_timestamps(target, "2002-01-01 00:00:00"))["future_count"] == 5
    assert one(freshness.null_timestamps(target))["null_count"] == 22
    df = spark.sql("select timestamp_ntz'2024-01-01 23:50:00' as loaded_at, timestamp_ntz'2024-01-01 23:00:00' as t")
    lag = one(freshness.pipeline_lag(df, AS_OF, event_ts="t"))
    assert lag["lag_minutes"] == pytest.approx(10) and lag["max_delay_minutes"] == pytest.approx(50) and lag["status"] == "PASS"
    assert one(freshness.pipeline_lag(df, AS_OF, max_minutes=5))["status"] == "FAIL"
    assert one(freshness.pipeline_lag(df.select("t"), AS_OF))["status"] == "SKIPPED"
    assert freshness.pipeline_lag(df.limit(0), AS_OF).count() == 0


def test_checks(spark):
    df = spark.createDataFrame([(1, "a@b.org", 5.0), (1, "bad", None), (3, None, 2.0)], "id int, email string, total double")
    other = spark.createDataFrame([(1,)], "k int")
    got = {r["check"]: (r["measured"], r["status"]) for r in checks.run_checks(df, [
        checks.check_row_count(), checks.check_missing("email"), checks.check_missing("total", "<", 50, percent=True),
        checks.check_duplicates("id"), checks.check_invalid("email", "email", limit=20), checks.check_bound("min(total)", ">=", 0),
        checks.check_required_columns(df, ["id", "gone"]), checks.check_references("id", other, "k", "other"),
        checks.check_bound("max(nullif(total, total))", ">=", 0)]).collect()}
    assert got == {
        "row_count > 0": (3, "PASS"), "missing_count(email) = 0": (1, "FAIL"),
        "missing_percent(total) < 50": (pytest.approx(100 / 3), "PASS"), "duplicate_count(id) = 0": (1, "FAIL"),
        "invalid_percent(email) < 20": (pytest.approx(100 / 3), "FAIL"), "min(total) >= 0": (2, "PASS"),
        "required columns: id, gone": (1, "FAIL"), "values in (id) must exist in other (k)": (1, "FAIL"),
        "max(nullif(total, total)) >= 0": (None, "FAIL")}


def test_check_freshness_and_severity(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' as ts")
    assert one(checks.run_checks(df, [checks.check_freshness("ts", 2, AS_OF)]))["severity"] == "MEDIUM"
    assert one(checks.run_checks(df, [checks.check_freshness("ts", 13, AS_OF)]))["status"] == "PASS"


def _brute_card(text):
    """Whole groups of digits, single blanks or hyphens between, 13 to 19 digits, Luhn: by listing every window."""
    if text is None:
        return None
    for run in re.findall(r"[0-9][0-9 -]{11,}[0-9]", text):
        for piece in re.split(r"[ -][ -]+", run):
            groups = re.split(r"[ -]", piece)
            for i in range(len(groups)):
                for j in range(i, len(groups)):
                    digits = "".join(groups[i:j + 1])
                    if 13 <= len(digits) <= 19:
                        total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c))
                                    for k, c in enumerate(reversed(digits)))
                        if total % 10 == 0:
                            return True
    return False


def test_card_numbers_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789  -x") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["4111 1111 1111 1111", "41 11-1111 1111 111 1", "x4111111111111111y", "1" * 19, "0" * 13]
    df = spark.createDataFrame([(t,) for t in texts], "note string")
    got = [r["got"] for r in df.select(content.has_pii(F.col("note"), "card_number").alias("got")).collect()]
    assert got == [_brute_card(t) for t in texts]


def test_card_search_is_linear(spark):
    df = spark.createDataFrame([("1 " * 500_000,), ("12-" * 300_000,)], "note string")
    started = time.time()
    assert not any(r["got"] for r in df.select(content.has_pii(F.col("note"), "card_number").alias("got")).collect())
    assert time.time() - started < 30


def test_card_search_of_many_lines(spark):
    """Lines of many short numbers: as many as 200,000 in a few seconds, whatever lies next to them in a batch."""
    lines = F.concat_ws(" ", F.lit("line"), F.col("id"), (F.col("id") * 7919) % 200000, (F.col("id") * 31) % 10000,
                        F.col("id") % 7, F.lit("19960313"))
    df = spark.range(0, 200_000, 1, 2).select(lines.alias("note"))
    started = time.time()
    got = df.agg(F.count_if(content.has_pii(F.col("note"), "card_number"))).first()[0]
    assert time.time() - started < 6
    notes = [r["note"] for r in df.where("crc32(note) % 200 = 0").collect()]
    some = spark.createDataFrame([(n,) for n in notes], "note string")
    found = [r[0] for r in some.select(content.has_pii(F.col("note"), "card_number")).collect()]
    assert found == [_brute_card(n) for n in notes] and 0 < got < 200_000


def test_card_search_across_segments(monkeypatch):
    """Numbers that cross a segment's border are found, and numbers of two rows never make up one."""
    monkeypatch.setattr(content, "_CARD_SEGMENT", 16)
    rng = random.Random(8)
    texts = ["".join(rng.choice("0123456789 -x") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    texts += [None, "", "41111111", "11111111", "4111-1111 1111 1111", "é 4111 1111 1111 1111 é"]
    for cut in (texts, texts[:1], []):
        got = content._card_search().func(pa.array(cut, pa.string())).to_pylist()
        assert got == [_brute_card(t) for t in cut]
    assert content._card_search().func(pa.array(texts, pa.string()).slice(5, 300)).to_pylist() == [
        _brute_card(t) for t in texts[5:305]]
