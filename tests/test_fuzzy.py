"""Edit-distance work against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import luhn_valid, name_similarity, normal_name, similarity
from plumbline.operators import fuzzy
from tests.conftest import rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def domains():
    rng = random.Random(11)
    return {
        "short": sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(90)}),
        "shared prefix": sorted({f"Customer#{rng.randint(0, 400):09d}" for _ in range(60)}),
        "addresses": sorted({f"http://www.example.com/item/{rng.randint(0, 50)}?x={'abc'[rng.randint(0, 2)] * rng.randint(0, 3)}"
                             for _ in range(60)}),
        "unicode": ["Zürich", "Zurich", "ZÜRICH", "naïve", "naive", "", "é"],
    }


@pytest.mark.parametrize("name", domains())
@pytest.mark.parametrize("k, crowd", [(1, 1000), (3, 1000), (3, 1), (5, 1), (9, 1000)])
def test_pairs_are_all_found(column, name, k, crowd):
    """A crowd of 1 sends every shared segment down the other ways, which must find the same pairs."""
    values = domains()[name]
    want = [(a, b, distance(a, b)) for i, a in enumerate(values) for b in values[i + 1:] if distance(a, b) <= k]
    got = rows(fuzzy.fuzzy_pairs(column(values, kind="string"), "v", k, crowd))
    assert got == sorted(((*sorted(p[:2]), p[2]) for p in want), key=str)


def greedy(values, k):
    order = sorted(set(values), key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v))
    taken, members = set(), []
    for i, leader in enumerate(order):
        if leader in taken:
            continue
        for other in order[i + 1:]:
            if other not in taken and 0 < distance(leader, other) <= k:
                taken.add(other)
                members.append((leader, other, distance(leader, other)))
    return sorted(members, key=str)


@pytest.mark.parametrize("name", domains())
@pytest.mark.parametrize("first_batch", [4, 1000])
def test_groups_equal_a_sequential_pass(column, name, first_batch):
    values = domains()[name]
    got = rows(fuzzy.fuzzy_duplicates(column(values, kind="string"), "v", 2, first_batch))
    assert got == greedy(values, 2)


def test_group_literals(column):
    names = column(["John Smith", "Jon Smith", "Jane Doe", "John Smth"], kind="string")
    assert fuzzy.fuzzy_groups(fuzzy.fuzzy_duplicates(names, "v", 2)).count() == 1
    six = column(["abcdef", "abcxyz"], kind="string")
    assert fuzzy.fuzzy_duplicates(six, "v", 2).count() == 0
    assert fuzzy.fuzzy_duplicates(six, "v", 3).count() == 1


def nearest(source, target, threshold):
    out = []
    for a in sorted(set(source)):
        b = min(sorted(set(target)), key=lambda t: distance(a, t))
        longest = max(len(a), len(b))
        s = 1.0 if longest == 0 else 1 - distance(a, b) / longest
        if threshold <= s < 1:
            out.append((a, b, distance(a, b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_match_equals_nearest_neighbour(spark, column, threshold):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
    source, target = [word() for _ in range(60)], [word() for _ in range(60)]
    got = fuzzy.fuzzy_match(column(source, kind="string"), "v", column(target, kind="string"), "v", threshold)
    assert rows(got.select("source_value", "target_value", "distance")) == nearest(source, target, threshold)


def test_match_literals(column):
    names = lambda *v: column(v, kind="string")
    assert fuzzy.fuzzy_match(names("customer_id", "cust_name"), "v",
                             names("customer_identifier", "customer_name"), "v", 0.5).count() > 0
    assert fuzzy.fuzzy_match(names("exact"), "v", names("exact"), "v").count() == 0
    assert fuzzy.fuzzy_match(names(), "v", names("x"), "v").count() == 0


@pytest.mark.parametrize("a, b, want", [("hello", "hello", 1), ("", "", 1), ("hello", "hallo", 0.8), ("abc", "xyz", 0)])
def test_similarity(spark, a, b, want):
    assert spark.range(1).select(similarity(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want)


def test_names(spark):
    pick = lambda c: spark.range(1).select(c).first()[0]
    assert pick(normal_name(F.lit("customerName"))) == "customer_name"
    assert pick(normal_name(F.lit("Customer-ID"))) == "customer_id"
    assert pick(name_similarity(F.lit("customerName"), F.lit("customer_name"))) == 1


def test_column_mapping(spark):
    source = spark.createDataFrame([(i, f"u{i}@x.org", i * 7.5) for i in range(20)], "id long, email string, score double")
    target = spark.createDataFrame([(i, f"u{i}@x.org", "z") for i in range(20)], "id int, mail_addr string, other string")
    got = {r["source_column"]: r for r in fuzzy.column_mapping(source, target).collect()}
    assert got["id"]["target_column"] == "id" and got["id"]["status"] == "FAIL"  # the type changed
    assert got["email"]["target_column"] == "mail_addr" and got["email"]["value_overlap"] == 1
    assert not got["score"]["mapped"]


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("79927398713",)], "d string")
    assert [r[0] for r in df.select(luhn_valid(F.col("d"))).collect()] == [True, False, True]


def test_busy_keys_are_split_over_tasks(column, monkeypatch):
    from plumbline.operators import edit_join
    monkeypatch.setattr(edit_join, "_TASK", 5)
    values = domains()["addresses"]
    want = sum(distance(a, b) <= 3 for i, a in enumerate(values) for b in values[i + 1:])
    assert fuzzy.fuzzy_pairs(column(values, kind="string"), "v", 3).count() == want


def test_a_small_left_side_is_broadcast(spark):
    from plumbline.operators.edit_join import edit_pairs
    left = spark.createDataFrame([(v,) for v in domains()["addresses"][:20]], "a string")
    right = spark.createDataFrame([(v,) for v in domains()["addresses"]], "b string")
    got = rows(edit_pairs(left, right, lambda n: F.lit(3), 3, left_rows=20))
    want = [(a, b, distance(a, b)) for a in domains()["addresses"][:20] for b in domains()["addresses"] if distance(a, b) <= 3]
    assert got == sorted(want, key=str)
    plan = edit_pairs(left, right, lambda n: F.lit(3), 3, left_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_character_sets_never_rule_out_a_close_pair(spark):
    """The bound on character sets is at most the distance, for any characters, and tight for foreign ones."""
    from plumbline.operators import edit_join
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab9/😀é") for _ in range(rng.randint(0, 15))) for _ in range(60)] + ["", "x" * 400, "x" * 397]
    pairs = [(a, b, distance(a, b)) for a in texts for b in rng.sample(texts, 12)]
    df = spark.createDataFrame(pairs, "a string, b string, k int")
    df = edit_join.with_characters(edit_join.with_characters(df, "a"), "b")
    assert df.where(~edit_join._may_be_close()).isEmpty()
    far = spark.createDataFrame([("abcdef", "uvwxyz", 5)], "a string, b string, k int")
    far = edit_join.with_characters(edit_join.with_characters(far, "a"), "b")
    assert far.where(edit_join._may_be_close()).isEmpty()


def test_match_of_crowded_addresses_equals_nearest_neighbour(spark, column, monkeypatch):
    """Addresses of one host, all alike but for the number; tiles, leaves and parts of a few strings."""
    from plumbline.operators import edit_tree
    for name, size in (("_LEAF", 2), ("_CHUNK", 7), ("_EMIT", 3), ("_LEFT_ROWS", 5), ("_RIGHT_ROWS", 6)):
        monkeypatch.setattr(edit_tree, name, size)
    rng = random.Random(9)
    numbers = [rng.randint(0, 3000) for _ in range(60)]
    source = [f"http://example.org/en/{n}{rng.choice(['', '#top', '/', '?ü=日'])}" for n in numbers] + ["", "é"]
    target = [f"https://example.org/{rng.choice(['en', 'de'])}/{n}{rng.choice(['', '/', '?u=日'])}" for n in numbers] + ["è"]
    got = fuzzy.fuzzy_match(column(source + [None], kind="string"), "v", column(target + [None], kind="string"), "v", 0.7)
    assert rows(got.select("source_value", "target_value", "distance")) == nearest(source, target, 0.7)


def test_a_crowd_makes_few_candidates():
    """Strings that share their segments and most q-grams; the table of NumPy leaves the close ones alone."""
    from plumbline.operators import edit_tree
    rng = random.Random(2)
    left = [f"http://example.org/en/{n:06d}#top" for n in rng.sample(range(10**6), 300)]
    right = [f"https://example.org/en/{n:06d}" for n in rng.sample(range(10**6), 3000)] + [
        "https" + left[0].removeprefix("http").removesuffix("#top")]
    table = pa.table({"size": pa.array([len(right[0])] * 3301, pa.int32()), "text": left + right,
                      "k": pa.array([5] * 300 + [None] * 3001, pa.int32())})
    bits = edit_tree._character_bits(*[edit_tree._counts(pa.array(x, pa.large_string())) for x in (left, right)])
    words = [edit_tree._packed(x) for x in bits]
    ruled_in = list(edit_tree._descend(edit_tree._tree(bits[1], words[1]), words[1], words[0], np.full(300, 5)))
    assert sum(len(i) for i, _ in ruled_in) < 300 * 3001 // 10
    found = [(r["a"], r["b"]) for x in edit_tree._candidates(table.to_batches()) for r in x.to_pylist()]
    assert (left[0], right[-1]) in found and len(found) == len(set(found))
    assert {b for a, b in found if a == left[0]} == {b for b in right if distance(left[0], b) <= 5}
    assert all(distance(a, b) <= 5 for a, b in found)


@pytest.mark.parametrize("letters", ["ab", "日本語é😀a", "x"])
@pytest.mark.parametrize("most", [0, 1, 3, 9, 20])
def test_the_tree_never_rules_out_a_close_pair(letters, most):
    """Against brute force, below and above the largest radius whose distances NumPy computes."""
    from plumbline.operators import edit_tree
    rng = random.Random(most)
    for size in (0, 1, 6, 25):
        right = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(40)]
        k = [most] + [rng.randint(0, most) for _ in range(39)]
        left = ["".join(rng.choice(letters) for _ in range(rng.randint(max(0, size - n), size + n))) for n in k]
        table = pa.table({"size": pa.array([size] * 80, pa.int32()), "text": left + right,
                          "k": pa.array(k + [None] * 40, pa.int32())})
        found = {(r["a"], r["b"]) for x in edit_tree._candidates(table.to_batches()) for r in x.to_pylist()}
        want = {(a, b) for a, n in zip(left, k) for b in right if distance(a, b) <= n}
        assert want <= found and (most > 16 or {p for p in found if distance(*p) > most} == set())
