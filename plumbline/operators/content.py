"""Checks of meaning: business rules on both sides, order of dates, personal data."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, SKIPPED, change_pct, verdict
from plumbline.operators.profile import per_column, temporal_columns, text_columns


def business_rules(source: DataFrame, target: DataFrame, rules: dict[str, str], tolerance_pct: float = 0.0,
                   round_to: int | None = None) -> DataFrame:
    """Aggregate expressions evaluated on both sides, one pass per side for all rules, and compared.

    ``rules`` maps a name to a Spark SQL aggregate, e.g. ``round(count_if(status = 'active') * 100 / count(*), 2)``.
    ``round_to`` rounds both values first, since sums of doubles differ in the last bits with the order of rows.
    """
    sides = []
    for name, side in (("source", source), ("target", target)):
        value = "cast({} as double)" if round_to is None else f"round(cast({{}} as double), {round_to})"
        measures = {rule: {f"{name}_value": value.format(f"({sql})")} for rule, sql in rules.items()}
        sides.append(per_column(side, measures, "rule_name"))
    measured = sides[0].join(sides[1], "rule_name")
    s, t = F.col("source_value"), F.col("target_value")
    measured = measured.withColumn("drift_pct", F.when(s == t, F.lit(0.0)).when(s == 0, F.lit(100.0))
                                   .otherwise(change_pct(s, t)))
    same = s.eqNullSafe(t) | F.coalesce(F.col("drift_pct") <= tolerance_pct, F.lit(False))
    return verdict(measured, (~same, FAIL, HIGH))


def rule_query(source: DataFrame, target: DataFrame, name: str, query: str, tolerance_pct: float = 0.0) -> DataFrame:
    """A rule given as a whole query: ``{table}`` stands for the table, and the first row and column is its value."""
    sides = []
    for side, df in (("source", source), ("target", target)):
        result = df.sparkSession.sql(query, table=df)
        sides.append(result.limit(1).select(F.lit(name).alias("rule_name"),
                                            F.lit(side).alias("side"),
                                            F.col(f"`{result.columns[0]}`").cast("double").alias("value")))
    measured = sides[0].unionByName(sides[1]).groupBy("rule_name").agg(
        *[F.max(F.when(F.col("side") == side, F.col("value"))).alias(f"{side}_value") for side in ("source", "target")])
    s, t = F.col("source_value"), F.col("target_value")
    measured = measured.withColumn("drift_pct", F.when(s == t, F.lit(0.0)).when(s == 0, F.lit(100.0))
                                   .otherwise(change_pct(s, t)))
    same = s.eqNullSafe(t) | F.coalesce(F.col("drift_pct") <= tolerance_pct, F.lit(False))
    return verdict(measured, (~same, FAIL, HIGH))


def _first_named(names: Sequence[str], *parts: str) -> str | None:
    return next((n for n in names if any(p in n.lower() for p in parts)), None)


def temporal_order(df: DataFrame, earlier: str | None = None, later: str | None = None) -> DataFrame:
    """Rows whose ``earlier`` date lies after their ``later`` one; nulls are ignored.

    Without names, the first created/inserted and the first updated/modified date column are taken.
    """
    dates = temporal_columns(df)
    earlier = earlier or _first_named(dates, "creat", "insert")
    later = later or _first_named(dates, "updat", "modif")
    if earlier is None or later is None:
        nothing = df.sparkSession.range(1).select(
            F.lit(earlier).cast("string").alias("earlier"), F.lit(later).cast("string").alias("later"),
            F.lit(0).cast("long").alias("checked_rows"), F.lit(0).cast("long").alias("violations"))
        return verdict(nothing, otherwise=(SKIPPED, MEDIUM))
    measured = df.agg(F.count_if(F.col(earlier).isNotNull() & F.col(later).isNotNull()).alias("checked_rows"),
                      F.count_if(F.col(earlier) > F.col(later)).alias("violations"))
    measured = measured.select(F.lit(earlier).alias("earlier"), F.lit(later).alias("later"), "checked_rows", "violations")
    return verdict(measured, (F.col("violations") > 0, FAIL, MEDIUM))


# Personal data recognised by value, as patterns searched in the whole text.
PII_VALUES: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(^|[^0-9])(\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}([^0-9]|\z)",
    "ssn": r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9-]|\z)",
    "card_number": r"[0-9][0-9 -]{11,}[0-9]",
    "ip_address": r"(^|[^0-9.])((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([^0-9]|\z)",
}

# Personal data recognised by column name.
PII_NAMES: dict[str, str] = {
    "email": r"e_?mail",
    "phone": r"phone|mobile|(^|_)tel(_|$)",
    "ssn": r"(^|_)ssn(_|$)|social_sec",
    "card_number": r"card_?(no|num)|credit_?card",
    "ip_address": r"(^|_)ip(_|$)|ip_addr",
    "passport": r"passport",
    "name": r"(^|_)(first|last|full|sur)_?name$|(^|_)name$",
    "address": r"(^|_)(street|postal|home)?_?address$",
    "date_of_birth": r"(^|_)dob(_|$)|birth",
    "zip_code": r"(^|_)zip|postcode|postal_code",
    "age": r"(^|_)age$",
    "gender": r"gender|(^|_)sex$",
}

# Risk level, regulations and protection by type of personal data.
PII_POLICY: dict[str, tuple[str, str, str]] = {
    "email": ("MEDIUM", "GDPR, CCPA, DPDP", "encrypt"),
    "phone": ("MEDIUM", "GDPR, CCPA, DPDP", "mask"),
    "ssn": ("HIGH", "GDPR, HIPAA, CCPA", "encrypt"),
    "card_number": ("HIGH", "PCI-DSS, GDPR, CCPA", "tokenize"),
    "ip_address": ("MEDIUM", "GDPR, CCPA", "mask"),
    "passport": ("HIGH", "GDPR, CCPA, DPDP", "encrypt"),
    "name": ("MEDIUM", "GDPR, CCPA, DPDP, HIPAA", "mask"),
    "address": ("MEDIUM", "GDPR, CCPA, DPDP, HIPAA", "mask"),
    "date_of_birth": ("MEDIUM", "GDPR, HIPAA, CCPA", "mask"),
    "zip_code": ("LOW", "HIPAA, CCPA", "audit-log"),
    "age": ("LOW", "HIPAA", "audit-log"),
    "gender": ("LOW", "GDPR, HIPAA", "audit-log"),
}

NAME_CONFIDENCE = 0.9


# Cheap conditions that every match fulfils, tested before the costly pattern.
_NECESSARY = {"email": lambda text: F.contains(text, F.lit("@")), "phone": lambda text: text.rlike("[0-9]{3}[-. ][0-9]{4}"),
              "ssn": lambda text: text.rlike("[0-9]-[0-9]{2}-[0-9]"), "ip_address": lambda text: text.rlike(r"[0-9]\.[0-9]")}


def has_pii(text: Column, kind: str) -> Column:
    """True when the text holds a value of the kind.

    A card number is 13 to 19 digits that pass the Luhn check, with single blanks or hyphens between them; it begins and
    ends where a group of digits does, so it is found next to other numbers and never inside a longer one.
    """
    if kind != "card_number":
        return _NECESSARY[kind](text) & text.rlike(PII_VALUES[kind])
    enough = text.rlike(f"[0-9](?:[ -]?[0-9]){{{CARD_DIGITS[0] - 1}}}")  # only such texts go to Python
    return enough & _card_search()(F.when(enough, text))


#: Digits of a card number, least and most.
CARD_DIGITS = (13, 19)
_CARD_SEGMENT = 1 << 20  # bytes looked at together


def _card_search():
    """Arrow function telling for each text whether it holds a card number, by NumPy over the bytes of all texts.

    Two running sums of the digits' Luhn values, one for each parity, give the sum of every window by two lookups. Long
    buffers are read in overlapping segments, so memory is fixed beyond the texts; the work is linear in their bytes.
    The function is nested, so its code travels with the job.
    """
    (low, high), segment = CARD_DIGITS, _CARD_SEGMENT

    def search(texts: pa.Array) -> pa.Array:
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
        raw = filled.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        found = np.zeros(len(filled), bool)
        for at in range(int(offsets[0]), int(offsets[-1]), segment) if len(filled) else ():
            # windows that begin here reach 2 * high - 1 bytes; one byte more on each side shows where groups end
            begin, end = max(at - 1, int(offsets[0])), min(at + segment + 2 * high, int(offsets[-1]))
            piece = data[begin:end]
            where = np.flatnonzero((piece >= 48) & (piece <= 57))
            if len(where) < low:
                continue
            digits = piece[where].astype(np.int64) - 48
            doubled = np.where(digits > 4, 2 * digits - 9, 2 * digits)
            even = np.arange(len(where)) % 2 == 0
            sums = np.zeros((2, len(where) + 1), np.int64)  # by the parity of the place that isn't doubled
            np.cumsum(np.where(even, digits, doubled), out=sums[0, 1:])
            np.cumsum(np.where(even, doubled, digits), out=sums[1, 1:])
            row = np.searchsorted(offsets, where + begin, "right")
            gap = np.diff(where)
            between = piece[where[:-1] + 1]
            same = row[1:] == row[:-1]
            group = same & (gap == 1)
            linked = group | (same & (gap == 2) & ((between == 32) | (between == 45)))
            run = np.concatenate(([0], np.cumsum(~linked)))
            starts = np.concatenate(([True], ~group)) & (where + begin >= at) & (where + begin < at + segment)
            ends = np.concatenate((~group, [True]))
            for n in range(low, min(high, len(where)) + 1):
                first = np.flatnonzero(starts[:len(where) - n + 1] & ends[n - 1:])
                last = first + n - 1
                first, last = first[run[first] == run[last]], last[run[first] == run[last]]
                total = sums[last % 2, last + 1] - sums[last % 2, first]
                found[row[first[total % 10 == 0]] - 1] = True
        return pa.array(found, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(search, "boolean")


def pii_scan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns holding personal data: type, rows and rate of matching values, confidence, risk, what to do.

    Every text value is scanned whole, for all types in one pass; a telling column name counts with a confidence of 0.9.
    """
    cols = list(cols or df.columns)
    texts = [c for c in text_columns(df) if c in cols]
    cells, names = [], {}
    for c in cols:
        kinds = [k for k, pattern in PII_NAMES.items() if re.search(pattern, c.lower())]
        for kind in [*(PII_VALUES if c in texts else ()), *[k for k in kinds if c not in texts or k not in PII_VALUES]]:
            matches = (F.count_if(has_pii(F.col(f"`{c}`"), kind)) if c in texts and kind in PII_VALUES
                       else F.lit(0).cast("long"))
            risk, regulations, protection = PII_POLICY[kind]
            cells.append(F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("pii_type"), F.count(F.col(f"`{c}`")).alias("checked_rows"),
                matches.alias("matching_rows"), F.lit(kind in kinds).alias("named"), F.lit(risk).alias("risk"),
                F.lit(regulations).alias("regulations"), F.lit(protection).alias("recommendation")))
    if not cells:  # nothing to look at: one cell without a match, which is dropped below
        cells = [F.expr("""named_struct('column', '', 'pii_type', '', 'checked_rows', 0L, 'matching_rows', 0L, 'named', false,
                                        'risk', '', 'regulations', '', 'recommendation', '')""")]
    found = df.agg(F.count(F.lit(1)), F.array(*cells).alias("cells")).select(F.inline("cells"))
    rate = F.when(F.col("checked_rows") == 0, F.lit(0.0)).otherwise(F.col("matching_rows") / F.col("checked_rows"))
    found = found.withColumn("match_rate", rate).withColumn(
        "confidence", F.greatest("match_rate", F.when(F.col("named"), F.lit(NAME_CONFIDENCE)).otherwise(F.lit(0.0))))
    return verdict(found.where("matching_rows > 0 or named"), otherwise=(FAIL, HIGH))


def pii_risk(findings: DataFrame) -> DataFrame:
    """Risk level of the whole table: the highest of its findings, or NONE."""
    rank = F.when(F.col("risk") == "HIGH", 3).when(F.col("risk") == "MEDIUM", 2).when(F.col("risk") == "LOW", 1)
    top = findings.agg(F.coalesce(F.max(rank), F.lit(0)).alias("rank"), F.count(F.lit(1)).alias("findings"))
    return top.select(F.element_at(F.array(*[F.lit(x) for x in ("NONE", "LOW", "MEDIUM", "HIGH")]),
                                   F.col("rank") + 1).alias("risk_level"), "findings")
