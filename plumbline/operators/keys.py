"""Keys: duplicates, orphans, declared constraints and source/target reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, verdict
from plumbline.operators.pairing import side_counts


def duplicate_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys held by more than one row with their row counts; with a limit, the most repeated ones."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated if limit is None else repeated.orderBy(F.desc("n"), *keys).limit(limit)


def duplicate_excess(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of repeated keys and of rows beyond the first of each."""
    measured = duplicate_keys(df, keys).agg(
        F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))
    return verdict(measured, (F.col("duplicate_keys") > 0, FAIL, HIGH))


def orphaned_keys(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose (fully non-null) key has no parent, and the number of such distinct keys.

    ``on`` pairs child columns with parent columns. Both sides are counted per key in one shuffle.
    """
    names = [f"key_{i}" for i in range(len(on))]
    left = child.select(*[F.col(c).alias(k) for (c, _), k in zip(on, names)])
    right = parent.select(*[F.col(p).alias(k) for (_, p), k in zip(on, names)])
    given = " and ".join(f"{k} is not null" for k in names)
    counts = side_counts(left.where(given), right.where(given), names)
    orphan = F.col("n_target") == 0
    measured = counts.agg(
        F.coalesce(F.sum("n_source"), F.lit(0)).alias("checked_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n_source"))), F.lit(0)).alias("orphaned_rows"),
        F.count_if(orphan).alias("orphaned_keys"))
    return verdict(measured, (F.col("orphaned_rows") > 0, FAIL, HIGH))


def orphaned_rows(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """The orphaned child rows themselves."""
    parents = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)])
    for c, _ in on:
        child = child.where(F.col(c).isNotNull())
    return child.join(parents, [F.col(c) == F.col(f"_p{i}") for i, (c, _) in enumerate(on)], "left_anti")


@dataclass
class Constraints:
    """Declared constraints of a table; each is verified against the data."""

    primary_key: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: dict[str, tuple[DataFrame, Sequence[tuple[str, str]]]] = field(default_factory=dict)


def constraint_check(df: DataFrame, constraints: Constraints) -> DataFrame:
    """Violations per constraint. A check that evaluates to null is not violated, as in SQL.

    All NOT NULL and CHECK constraints share one pass over the table.
    """
    spark = df.sparkSession
    rows: list[Column] = []
    not_null = [*constraints.primary_key, *[c for c in constraints.not_null if c not in constraints.primary_key]]
    for name in not_null:
        rows.append(F.struct(F.lit(f"not_null({name})").alias("constraint"), F.lit("NOT NULL").alias("kind"),
                             F.count_if(F.col(name).isNull()).alias("violations")))
    for name, condition in constraints.checks.items():
        rows.append(F.struct(F.lit(name).alias("constraint"), F.lit("CHECK").alias("kind"),
                             F.count_if(~F.expr(condition)).alias("violations")))
    parts = []
    if rows:
        parts.append(df.agg(F.array(*rows).alias("found")).select(F.inline("found")))
    keys = [("PRIMARY KEY", constraints.primary_key)] if constraints.primary_key else []
    for kind, cols in [*keys, *[("UNIQUE", u) for u in constraints.unique]]:
        present = df if kind == "PRIMARY KEY" else df.where(" and ".join(f"`{c}` is not null" for c in cols))
        parts.append(duplicate_excess(present, cols).select(
            F.lit(f"{kind.lower().replace(' ', '_')}({', '.join(cols)})").alias("constraint"),
            F.lit(kind).alias("kind"), F.col("excess_rows").alias("violations")))
    for name, (parent, on) in constraints.foreign_keys.items():
        parts.append(orphaned_keys(df, parent, on).select(
            F.lit(name).alias("constraint"), F.lit("FOREIGN KEY").alias("kind"),
            F.col("orphaned_rows").alias("violations")))
    if not parts:
        empty = spark.range(1).select(F.lit("none").alias("constraint"), F.lit("NONE").alias("kind"),
                                      F.lit(0).cast("long").alias("violations"))
        return verdict(empty, otherwise=(SKIPPED, MEDIUM))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    broken = F.col("violations") > 0
    structural = F.col("kind").isin("PRIMARY KEY", "FOREIGN KEY")
    return verdict(found, (broken & structural, FAIL, HIGH), (broken, FAIL, MEDIUM))


def key_presence(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: row counts of both sides and whether it is missing, extra or matched. Null equals null."""
    counts = side_counts(source, target, keys)
    return counts.withColumn("presence", F.when(F.col("n_target") == 0, "missing")
                             .when(F.col("n_source") == 0, "extra").otherwise("matched"))


def reconcile_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the source missing in the target, rows of the target extra to the source, and matched source rows."""
    presence = key_presence(source, target, keys)
    missing, extra = F.col("presence") == "missing", F.col("presence") == "extra"
    measured = presence.agg(
        F.coalesce(F.sum("n_source"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("n_target"), F.lit(0)).alias("target_rows"),
        F.coalesce(F.sum(F.when(missing, F.col("n_source"))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.when(extra, F.col("n_target"))), F.lit(0)).alias("extra_rows"),
        F.count_if(missing).alias("missing_keys"), F.count_if(extra).alias("extra_keys"),
        F.coalesce(F.sum(F.when(F.col("presence") == "matched", F.col("n_source"))), F.lit(0)).alias("matched_rows"))
    return verdict(measured, ((F.col("missing_rows") > 0) | (F.col("extra_rows") > 0), FAIL, HIGH))


def missing_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole source rows whose key isn't in the target (swap the sides for the extra rows)."""
    others = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    return source.join(others, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys], "left_anti")
