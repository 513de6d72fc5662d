"""String expressions: format patterns, outer whitespace, column-name normal form, edit similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as understood by a JavaScript trim (ASCII, Unicode separators, byte order mark).
_SPACE = r"\s\p{Z}\x{FEFF}"

# The formats looked for in text columns.
FORMATS: dict[str, str] = {
    "email": rf"^[^{_SPACE}@]+@[^{_SPACE}@]+\.[^{_SPACE}@]+\z",
    "phone": rf"^[+]?[\d{_SPACE}\-()]{{7,15}}\z",
    "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "uuid": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "ip_address": r"^(\d{1,3}\.){3}\d{1,3}\z",
}


def has_outer_space(text: Column) -> Column:
    """True when the text differs from its trimmed form."""
    return text.rlike(rf"^[{_SPACE}]|[{_SPACE}]\z")


def normal_name(name: Column) -> Column:
    """customerName, Customer-ID -> customer_name, customer_id."""
    snake = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(snake, "[^a-z0-9]+", "_"), r"^_|_\z", "")


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings. ``distance`` is used if it is known."""
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b) if distance is None else distance
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two column names after normalisation."""
    return similarity(normal_name(a), normal_name(b))


def luhn_valid(digits: Column) -> Column:
    """Luhn check of a string of digits, from the last digit leftwards."""
    def step(char: Column, index: Column) -> Column:
        doubled = char.cast("int") * (1 + index % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    scored = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), step)
    return F.aggregate(scored, F.lit(0), lambda total, score: total + score) % 10 == 0
