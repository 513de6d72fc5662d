"""Canonical row text, row hashes and a mergeable order-independent digest of many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.StructType, T.MapType, T.ArrayType, T.VariantType)


def _sorted_keys(value: str, kind: T.DataType, depth: int = 0) -> str:
    """SQL for the nested value with struct fields and map entries in key order, at every level."""
    item = f"item{depth}"
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda field: field.name)
        parts = ", ".join(f"'{f.name}', {_sorted_keys(f'{value}.`{f.name}`', f.dataType, depth + 1)}" for f in fields)
        return f"if({value} is null, null, named_struct({parts}))"
    if isinstance(kind, T.MapType):
        inner = _sorted_keys(f"{item}.value", kind.valueType, depth + 1)
        return (f"map_from_entries(transform(array_sort(map_entries({value})), "
                f"{item} -> struct({item}.key as key, {inner} as value)))")
    if isinstance(kind, T.ArrayType):
        return f"transform({value}, {item} -> {_sorted_keys(item, kind.elementType, depth + 1)})"
    return value


def text_sql(value: str, kind: T.DataType, *, float_scale: int | None = None, compat: bool = False) -> str:
    """SQL for the text of one value, null when the value is null; the same value always gives the same text.

    ``float_scale`` rounds floating point numbers to that many decimals, for sides whose float widths differ.
    ``compat`` writes date-times with milliseconds and ``Z``.
    """
    if isinstance(kind, _NESTED):
        return f"to_json({_sorted_keys(value, kind)}, map('ignoreNullFields', 'false'))"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = f"if({value} = 0, '0.0', cast({value} as string))"
        if float_scale is None:
            return plain
        return f"coalesce(cast(try_cast({value} as decimal(38,{float_scale})) as string), {plain})"
    if isinstance(kind, T.TimestampType):  # an instant: written in UTC whatever the session time zone is
        seconds = f"cast(cast(unix_micros({value}) as decimal(20,0)) / 1000000 as decimal(18,6))"
        value = f"(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        pattern = "yyyy-MM-dd''T''HH:mm:ss.SSS''Z''" if compat else "yyyy-MM-dd''T''HH:mm:ss.SSSSSS"
        return f"""date_format({value}, "{pattern.replace("''", "'")}")"""
    if isinstance(kind, T.DateType):
        return f"""date_format({value}, "{"yyyy-MM-dd'T00:00:00.000Z'" if compat else "yyyy-MM-dd"}")"""
    if isinstance(kind, T.BinaryType):
        return f"lower(hex({value}))"
    return f"cast({value} as string)"


def digits_sql(text: str) -> dict[str, str]:
    """SQL for the parts of a number's text (``12.50``, ``1.2E-7``): digits before and after the point, exponent."""
    return {"whole": f"regexp_extract({text}, '^-?([0-9]*)', 1)",
            "decimals": f"regexp_extract({text}, '[.]([0-9]*?)0*(E|$)', 1)",
            "exponent": f"coalesce(try_cast(nullif(regexp_extract({text}, 'E(-?[0-9]+)$', 1), '') as int), 0)"}


def number_sql(text: str) -> str:
    """SQL for one text of equal numbers, whatever their types: 2.5, 2.50 and 0.25E1 all give ``25E-1``.

    Digits are kept as they are, so nothing is rounded; what isn't a finite number keeps its text.
    """
    part = digits_sql(text)
    digits = f"regexp_replace({text}, '^-|[.]|E.*$', '')"
    significant = f"regexp_replace({digits}, '^0+|0+$', '')"
    power = (f"{part['exponent']} + length({part['whole']}) - length(regexp_extract({digits}, '^(0*)', 1)) "
             f"- length({significant})")
    return (f"case when not {text} rlike '^-?[0-9]' then {text} when {significant} = '' then '0' "
            f"else concat(if({text} like '-%', '-', ''), {significant}, 'E', {power}) end")


def short_key_sql(text: str) -> str:
    """SQL for a key that tells texts apart and is never long: the text itself, or its hash beyond 32 characters.

    Grouping on it keeps long texts out of the shuffle.
    """
    return f"if(length({text}) > 32, concat('#', md5({text})), concat('=', {text}))"


def canonical_text(name: str, kind: T.DataType, **options) -> Column:
    """Text of a column's values."""
    return F.expr(text_sql(f"`{name}`", kind, **options))


def row_text(df: DataFrame, cols: Sequence[str] | None = None, *, float_scale: int | None = None,
             compat: bool = False, as_numbers: Sequence[str] = ()) -> Column:
    """Canonical text of the columns in the given order, joined by a pipe.

    Columns named in ``as_numbers`` (any case) are written by ``number_sql``, for sides of different number types.

    Backslash and pipe inside text are escaped so that two different rows never share a text; ``compat=True``
    leaves them as they are.
    """
    kinds = {field.name.lower(): field.dataType for field in df.schema.fields}
    parts = []
    for name in cols or df.columns:
        kind = kinds[name.lower()]
        text = text_sql(f"`{name}`", kind, float_scale=float_scale, compat=compat)
        if name.lower() in as_numbers:
            text = number_sql(text)
        if not compat and isinstance(kind, (T.StringType, *_NESTED)):
            text = f"replace(replace({text}, char(92), concat(char(92), char(92))), '|', concat(char(92), '|'))"
        parts.append(f"coalesce({text}, concat(char(92), 'N'))")
    return F.expr(f"concat_ws('|', {', '.join(parts)})")


def text_hash(text: Column, algorithm: str = "md5") -> Column:
    """Hex hash of a text: ``md5`` or ``sha256``."""
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha256":
        return F.sha2(text, 256)
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def row_hash(df: DataFrame, cols: Sequence[str] | None = None, algorithm: str = "md5", **text_options) -> Column:
    """Hash of the canonical row text."""
    return text_hash(row_text(df, cols, **text_options), algorithm)


def ordered_digest(hashes: Column, algorithm: str = "md5") -> Column:
    """Hash of the sorted, concatenated hashes of an array; only for arrays of bounded length."""
    return text_hash(F.array_join(F.array_sort(hashes), ""), algorithm)


# --- mergeable digest -------------------------------------------------------------------------------------------
# Two 60-bit numbers are read from each hash and summed exactly. They are summed in 20-bit limbs so that the partial
# aggregation stays in primitive longs: a limb overflows only past 2^43 rows.
_LIMB = 20
_MASK = (1 << _LIMB) - 1


def hash_numbers(hash_hex: Column) -> dict[str, Column]:
    """The two 60-bit numbers of a hex hash (characters 1-15 and 16-30)."""
    return {f"h{i}": F.conv(F.substring(hash_hex, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)}


def digest_aggregates(prefix: str = "", where: Column | None = None) -> list[Column]:
    """Aggregates over ``h0``/``h1`` columns: exact limb sums, optionally only of rows matching ``where``."""
    aggregates = []
    for number in ("h0", "h1"):
        for limb in range(3):
            value = F.shiftright(F.col(number), _LIMB * limb).bitwiseAND(F.lit(_MASK))
            value = value if where is None else F.when(where, value).otherwise(F.lit(0))
            aggregates.append(F.sum(value.cast("long")).alias(f"{prefix}{number}_{limb}"))
    return aggregates


def digest_sum(number: str, prefix: str = "") -> Column:
    """The exact sum of one 60-bit number over the rows, from its limb sums."""
    wide = [F.coalesce(F.col(f"{prefix}{number}_{limb}"), F.lit(0)).cast("decimal(20,0)") for limb in range(3)]
    return (wide[0] + wide[1] * F.lit(1 << _LIMB).cast("decimal(7,0)")
            + wide[2] * F.lit(1 << 2 * _LIMB).cast("decimal(13,0)")).cast("decimal(38,0)")


def digest_text(rows: Column, prefix: str = "") -> Column:
    """Row count and both sums as one text; equal for equal multisets of rows, in any order."""
    return F.concat_ws(":", rows.cast("string"), digest_sum("h0", prefix).cast("string"),
                       digest_sum("h1", prefix).cast("string"))
