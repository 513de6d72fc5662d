"""Schemas: the column catalog of a table, and what differs between two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.hashing import digits_sql
from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, WARN, verdict
from plumbline.operators.profile import per_column


def column_catalog(df: DataFrame, declared: dict[str, int] | None = None) -> DataFrame:
    """Per column: ordinal, declared type, and what the data needs (nulls, text length, integer digits, scale).

    ``declared`` gives maximum text lengths that the schema itself can't express. Digits and scale are those of the
    values' own texts (the shortest one of a float), however many they are; infinite values and NaN have none.
    """
    declared = {name.lower(): length for name, length in (declared or {}).items()}
    measures = {}
    for ordinal, f in enumerate(df.schema.fields, start=1):
        value, nothing = f"`{f.name}`", "cast(null as int)"
        digits = scale = nothing
        if isinstance(f.dataType, T.IntegralType):
            digits, scale = f"greatest(length(abs(cast(max({value}) as decimal(20,0)))), " \
                            f"length(abs(cast(min({value}) as decimal(20,0)))))", f"if(count({value}) > 0, 0, null)"
        elif isinstance(f.dataType, T.NumericType):
            part = digits_sql(f"cast({value} as string)")
            finite = f"abs({value}) < double('infinity')" if isinstance(f.dataType, T.FractionalType) else "true"
            digits = f"max(if({finite}, greatest(1, length({part['whole']}) + {part['exponent']}), null))"
            scale = f"max(if({finite}, if({value} = 0, 0, greatest(0, length({part['decimals']}) - {part['exponent']})), null))"
        length = getattr(f.dataType, "length", None) or declared.get(f.name.lower())
        measures[f.name] = {
            "ordinal": str(ordinal), "data_type": f"'{f.dataType.simpleString()}'",
            "declared_length": nothing if length is None else str(length), "total_count": "count(1)",
            "null_count": f"count(1) - count({value})",
            "max_length": f"max(length({value}))" if isinstance(f.dataType, T.StringType) else nothing,
            "max_digits": digits, "max_scale": scale}
    return per_column(df, measures)


def _names(df: DataFrame, skip: Sequence[str]) -> DataFrame:
    """Declared names, ordinals and types of a table, read from its schema (driver metadata, a row per column)."""
    skipped = {name.lower() for name in skip}
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)
            if f.name.lower() not in skipped]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, data_type string")


def _sides(source: DataFrame, target: DataFrame) -> DataFrame:
    s = source.select(F.lower("column").alias("name"), *[F.col(c).alias(f"source_{c}") for c in source.columns])
    t = target.select(F.lower("column").alias("name"), *[F.col(c).alias(f"target_{c}") for c in target.columns])
    return s.join(t, "name", "full_outer")


def schema_compatibility(source: DataFrame, target: DataFrame, skip: Sequence[str] = (),
                         observed: bool = False) -> DataFrame:
    """Per source column: is it in the target (by name in any case), and at the same position. Plus extra columns.

    ``issue`` is ``missing``, ``moved``, ``extra`` or null. ``observed=True`` also reads both tables and reports as
    ``emptied`` a column that has values in the source and none in the target.
    """
    if observed:
        found = _sides(_observed(source, skip), _observed(target, skip))
        emptied = (F.col("source_values") > 0) & (F.col("target_values") == 0)
    else:
        found, emptied = _sides(_names(source, skip), _names(target, skip)), F.lit(False)
    issue = (F.when(F.col("target_column").isNull(), "missing").when(F.col("source_column").isNull(), "extra")
             .when(F.col("source_ordinal") != F.col("target_ordinal"), "moved").when(emptied, "emptied"))
    return verdict(found.withColumn("issue", issue), (F.col("issue").isNotNull(), FAIL, HIGH))


def _observed(df: DataFrame, skip: Sequence[str]) -> DataFrame:
    """Names, ordinals and types with the number of non-null values."""
    skipped = {name.lower() for name in skip}
    return per_column(df, {f.name: {"ordinal": str(i), "data_type": f"'{f.dataType.simpleString()}'",
                                    "values": f"count(`{f.name}`)"}
                           for i, f in enumerate(df.schema.fields, start=1) if f.name.lower() not in skipped})


def schema_drift(source: DataFrame, target: DataFrame, skip: Sequence[str] = (), observed: bool = False) -> DataFrame:
    """Columns added to or removed from the source's set of (lower-case) names.

    ``observed=True`` reads both tables and treats a column without any value as absent.
    """
    if observed:
        sides = [_observed(side, skip).where("values > 0") for side in (source, target)]
    else:
        sides = [_names(side, skip) for side in (source, target)]
    return field_drift(*sides, "column")


def field_drift(source: DataFrame, target: DataFrame, name: str = "field") -> DataFrame:
    """Names in only one of two catalogs, with ``change`` = added or removed; e.g. of ``document_fields``."""
    s, t = (side.select(F.lower(name).alias("name")).distinct() for side in (source, target))
    added = t.join(s, "name", "left_anti").withColumn("change", F.lit("added"))
    removed = s.join(t, "name", "left_anti").withColumn("change", F.lit("removed"))
    return verdict(added.unionByName(removed), otherwise=(FAIL, HIGH))


# Bits and digits of the integer types.
_LIMITS = {"tinyint": (8, 3), "smallint": (16, 5), "int": (32, 10), "bigint": (64, 19)}


def _beyond_limits(source: DataFrame, target: DataFrame) -> DataFrame | None:
    """``(name, beyond)`` of the source's numbers that the target stores as integers: one pass, no row if there's none."""
    theirs = {f.name.lower(): f.dataType.simpleString() for f in target.schema.fields}
    measures = {}
    for f in source.schema.fields:
        bits = _LIMITS.get(theirs.get(f.name.lower()), (None,))[0]
        if bits is None or not isinstance(f.dataType, T.NumericType):
            continue
        value, kind = f"`{f.name}`", f.dataType.simpleString()
        # both limits are powers of two, so they are exact in floats too; decimals and integers compare as decimals
        low, high = ((f"-double('{2 ** (bits - 1)}')", f"double('{2 ** (bits - 1)}')") if kind in ("float", "double")
                     else (f"-{2 ** (bits - 1)}BD", f"{2 ** (bits - 1)}BD"))
        finite = f"abs({value}) < double('infinity')" if kind in ("float", "double") else f"{value} is not null"
        measures[f.name] = {"beyond": f"coalesce(bool_or(({value} < {low} or {value} >= {high}) and {finite}), false)"}
    return per_column(source, measures).select(F.lower("column").alias("name"), "beyond") if measures else None


def type_compatibility(source: DataFrame, target: DataFrame, skip: Sequence[str] = (),
                       target_lengths: dict[str, int] | None = None,
                       source_lengths: dict[str, int] | None = None) -> DataFrame:
    """Per common column: would the source's values fit the target's type?

    Truncation is judged on the longest text, most integer digits and largest scale actually present in the source
    (or its declared length, if longer), against the declared target length or decimal precision. For integer targets
    a least or largest value beyond the type's limits loses a digit or more, and any scale is lost.
    """
    skipped = [c.lower() for c in skip]
    beyond = _beyond_limits(source, target)
    both = _sides(column_catalog(source, source_lengths), column_catalog(target, target_lengths)).where(
        F.col("source_column").isNotNull() & F.col("target_column").isNotNull() & ~F.col("name").isin(skipped))
    precision = F.try_to_number(F.nullif(F.regexp_extract("target_data_type", r"^decimal\((\d+),", 1), F.lit("")),
                                F.lit("99")).cast("int")
    scale = F.try_to_number(F.nullif(F.regexp_extract("target_data_type", r"^decimal\(\d+,(\d+)\)", 1), F.lit("")),
                            F.lit("99")).cast("int")
    need = F.greatest(F.col("source_max_length"), F.col("source_declared_length"))
    measured = both.withColumns({
        "needed_length": need,
        "lost_length": F.greatest(need - F.col("target_declared_length"), F.lit(0)),
        "lost_digits": F.greatest(F.col("source_max_digits") - (precision - scale), F.lit(0)),
        "lost_scale": F.greatest(F.col("source_max_scale") - scale, F.lit(0))})
    if beyond is not None:
        whole = F.col("target_data_type").isin(*_LIMITS)
        room = F.element_at(F.create_map(*[F.lit(x) for k, (_, n) in _LIMITS.items() for x in (k, n)]), F.col("target_data_type"))
        measured = measured.join(beyond, "name", "left").withColumns({
            "lost_digits": F.when(F.col("beyond"), F.greatest(F.col("source_max_digits") - room, F.lit(1)))
            .otherwise(F.col("lost_digits")),
            "lost_scale": F.when(whole, F.col("source_max_scale")).otherwise(F.col("lost_scale"))})
    lost = F.coalesce("lost_length", F.lit(0)) + F.coalesce("lost_digits", F.lit(0)) + F.coalesce("lost_scale", F.lit(0))
    return verdict(measured, (lost > 0, FAIL, HIGH),
                   (F.col("source_data_type") != F.col("target_data_type"), WARN, MEDIUM)).select(
        "name", "source_data_type", "target_data_type", "needed_length", "target_declared_length",
        F.coalesce("lost_length", F.lit(0)).alias("lost_length"), F.coalesce("lost_digits", F.lit(0)).alias("lost_digits"),
        F.coalesce("lost_scale", F.lit(0)).alias("lost_scale"), "status", "severity")
