"""Column profiles: one aggregate over all columns of a table, turned to one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.hashing import short_key_sql, text_sql
from plumbline.operators.ordering import quantiles, value_counts

_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def columns_of(df: DataFrame, *kinds: type[T.DataType], skip: Sequence[str] = ()) -> list[str]:
    """Names of the columns of the given types, without the skipped ones (compared case-insensitively)."""
    skipped = {name.lower() for name in skip}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name.lower() not in skipped]


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return columns_of(df, T.NumericType, skip=skip)


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return columns_of(df, T.StringType, skip=skip)


def temporal_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return columns_of(df, T.DateType, T.TimestampType, T.TimestampNTZType, skip=skip)


def _quoted(text: str) -> str:
    """The text inside a SQL string literal."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def per_column(df: DataFrame, measures: dict[str, dict[str, str]], name: str = "column") -> DataFrame:
    """Run all ``{column: {measure: SQL aggregate}}`` in one pass; one output row per column."""
    rows = [f"named_struct('{name}', '{_quoted(column)}', " + ", ".join(f"'{m}', {sql}" for m, sql in aggregates.items()) + ")"
            for column, aggregates in measures.items()]
    return df.agg(F.expr(f"array({', '.join(rows)})").alias("rows")).selectExpr("inline(rows)")


def _value_measures(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: exact distinct count and text lengths, from the counts of its distinct values.

    The values are counted in their own types, the columns of one type together, so that texts are only made of
    distinct values and every column is read once.
    """
    by_kind: dict[str, tuple[T.DataType, list[str]]] = {}
    for f in df.schema.fields:
        if f.name in cols:
            kind = T.LongType() if isinstance(f.dataType, T.IntegralType) else f.dataType
            by_kind.setdefault(kind.simpleString(), (kind, []))[1].append(f.name)
    parts = []
    for kind, names in by_kind.values():
        nested = not isinstance(kind, T.AtomicType) or isinstance(kind, T.VariantType)
        texts = [f"{text_sql(f'`{c}`', kind) if nested else f'cast(`{c}` as {kind.simpleString()})'} as `{c}`" for c in names]
        long = df.selectExpr(*texts).unpivot([], names, "column", "value").where("value is not null")
        if nested or isinstance(kind, T.StringType):
            counts = (long.selectExpr("column", f"{short_key_sql('value')} as key", "length(value) as size")
                      .groupBy("column", "key", "size").agg(F.expr("count(1)").alias("n")))
        else:
            counts = (long.groupBy("column", "value").agg(F.expr("count(1)").alias("n"))
                      .selectExpr("column", "n", f"length({text_sql('value', kind)}) as size"))
        parts.append(counts.groupBy("column").agg(
            F.expr("count(1)").alias("distinct_count"), F.expr("min(size)").alias("min_length"),
            F.expr("max(size)").alias("max_length"), F.expr("sum(size * n) / sum(n)").alias("avg_length")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# Tested before the cast, since a failing cast is far more costly than the pattern.
_NUMERIC_TEXT = r"^[ ]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ ]*$"

STATS = ("total_count", "null_count", "min_value", "max_value", "mean", "stddev", "min_length", "max_length",
         "avg_length", "distinct_count")
_FROM_VALUES = STATS[6:]


def column_stats(df: DataFrame, cols: Sequence[str] | None = None, *, measures: Sequence[str] = STATS,
                 distinct: str = "exact", rsd: float = 0.02) -> DataFrame:
    """Per column: total, null and distinct counts, min and max as text, mean, sample deviation, text lengths.

    Min and max compare typed values; mean and deviation are null for text that isn't numeric. ``measures`` selects;
    without distinct count and lengths, or with ``distinct="approx"`` (within ``rsd``), no values are shuffled.
    """
    cols = list(cols or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    approximate = distinct == "approx"
    aggregates = {}
    for name in cols:
        value, kind = f"`{name}`", kinds[name]
        size = f"length({text_sql(value, kind)})"
        least, most = ((text_sql(f"{m}({value})", kind) for m in ("min", "max")) if isinstance(kind, _ORDERED)
                       else ("cast(null as string)",) * 2)
        number = (f"cast({value} as double)" if isinstance(kind, T.NumericType)
                  else f"if({value} rlike '{_NUMERIC_TEXT}', try_cast({value} as double), null)"
                  if isinstance(kind, T.StringType) else "cast(null as double)")
        every = {"total_count": "count(1)", "null_count": f"count(1) - count({value})", "min_value": least,
                 "max_value": most, "mean": f"avg({number})", "stddev": f"stddev_samp({number})",
                 "min_length": f"min({size})", "max_length": f"max({size})", "avg_length": f"avg({size})",
                 "distinct_count": f"approx_count_distinct({text_sql(value, kind)}, {rsd})"}
        aggregates[name] = {m: every[m] for m in STATS if m in measures and (approximate or m not in _FROM_VALUES)}
    from_values = [m for m in _FROM_VALUES if m in measures]
    if approximate or not from_values:
        return per_column(df, aggregates)
    if not any(aggregates.values()):
        aggregates = {name: {"total_count": "count(1)"} for name in cols}
    values = _value_measures(df, cols).select("column", *from_values)
    joined = per_column(df, aggregates).join(values, "column", "left")
    return joined.fillna(0, ["distinct_count"]) if "distinct_count" in from_values else joined


def distribution_summary(df: DataFrame, cols: Sequence[str] | None = None, method: str = "midpoint") -> DataFrame:
    """Per numeric column: count, mean, population deviation, median, quartiles, interquartile range, sample skewness."""
    cols = list(cols or numeric_columns(df))
    measures = {}
    for name in cols:
        v = f"cast(`{name}` as double)"
        n = f"cast(count({v}) as double)"
        measures[name] = {"n": f"count({v})", "mean": f"avg({v})", "stddev": f"stddev_pop({v})",
                          "skewness": f"skewness({v}) * if({n} > 2, sqrt({n} * ({n} - 1)) / ({n} - 2), null)"}
    quarters = quantiles(value_counts(df, cols), {"q1": 0.25, "median": 0.5, "q3": 0.75}, method)
    return per_column(df, measures).join(quarters, "column", "left").withColumn("iqr", F.expr("q3 - q1"))
