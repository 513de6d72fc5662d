"""Table and chunk hashes: does the target hold the same rows, and if not, where not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.hashing import (digest_aggregates, digest_text, hash_numbers, ordered_digest, row_hash,
                                         row_text, text_hash)
from plumbline.functions.verdicts import FAIL, HIGH, verdict
from plumbline.operators.ordering import running_totals
from plumbline.operators.pairing import tagged_union


def with_row_hash(df: DataFrame, cols: Sequence[str] | None = None, algorithm: str = "md5", name: str = "row_hash",
                  **text_options) -> DataFrame:
    """Append the canonical hash of each row."""
    return df.withColumn(name, row_hash(df, cols, algorithm, **text_options))


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, algorithm: str = "md5",
                      **text_options) -> DataFrame:
    """One row: row count and an order-independent hash of the whole multiset of rows, in one map-side-combined pass."""
    numbers = hash_numbers(row_hash(df, cols, algorithm, **text_options))
    totals = df.select(*[c.alias(n) for n, c in numbers.items()]).agg(
        F.count(F.lit(1)).alias("n_rows"), *digest_aggregates())
    return totals.select("n_rows", digest_text(F.col("n_rows")).alias("digest"),
                         text_hash(digest_text(F.col("n_rows")), algorithm).alias("fingerprint"))


def number_pairs(source: DataFrame, target: DataFrame, cols: Sequence[str]) -> set[str]:
    """Lower-case names of the columns that hold numbers of different types on the two sides."""
    kinds = [{f.name.lower(): f.dataType for f in side.schema.fields} for side in (source, target)]
    pairs = {c.lower(): [kind[c.lower()] for kind in kinds] for c in cols}
    return {name for name, (a, b) in pairs.items()
            if a != b and isinstance(a, T.NumericType) and isinstance(b, T.NumericType)}


def compare_fingerprint(source: DataFrame, target: DataFrame, cols: Sequence[str] | None = None,
                        algorithm: str = "md5", **text_options) -> DataFrame:
    """Equal fingerprints pass. Columns are taken by name, in source order; numbers of different types that are equal
    hash alike."""
    cols = list(cols or source.columns)
    text_options = {"as_numbers": number_pairs(source, target, cols)} | text_options
    sides = [table_fingerprint(side, cols, algorithm, **text_options).select(
        F.lit(name).alias("side"), "n_rows", "fingerprint") for name, side in (("source", source), ("target", target))]
    both = sides[0].unionByName(sides[1])
    pick = {f"{name}_{c}": F.max(F.when(F.col("side") == name, F.col(c))) for name in ("source", "target")
            for c in ("n_rows", "fingerprint")}
    measured = both.agg(*[column.alias(name) for name, column in pick.items()])
    return verdict(measured, (F.col("source_fingerprint") != F.col("target_fingerprint"), FAIL, HIGH))


def _chunk_of(df: DataFrame, keys: Sequence[str], size: int, mode: str, chunks: int | None, as_numbers: set[str]):
    kind = df.schema[keys[0]].dataType
    if mode == "range":
        if len(keys) != 1 or not isinstance(kind, T.IntegralType):
            raise ValueError("range chunks need one integer key; use mode='hash' or mode='rank'")
        return F.floor(F.col(keys[0]) / F.lit(size)).cast("long")
    if mode == "hash":
        if not chunks:
            raise ValueError("hash chunks need the number of chunks")
        key_hash = F.md5(row_text(df, keys, as_numbers=as_numbers))
        return (F.conv(F.substring(key_hash, 1, 12), 16, 10).cast("long") % chunks).cast("long")
    raise ValueError(f"unknown chunk mode: {mode}")


def chunk_hash_compare(source: DataFrame, target: DataFrame, keys: Sequence[str], chunk_size: int = 100_000,
                       algorithm: str = "md5", mode: str = "range", chunks: int | None = None,
                       cols: Sequence[str] | None = None, **text_options) -> DataFrame:
    """Per chunk: row counts and digests of both sides, and whether they match.

    ``range``: chunks of ``chunk_size`` key values of an integer key; a missing row disturbs only its own chunk.
    ``hash``: ``chunks`` chunks by key hash, for any key type. ``rank``: chunks of ``chunk_size`` rows in key order,
    hashed over the sorted row hashes; one missing row shifts every later chunk. Digests of range and hash chunks
    merge on the map side, so no chunk is collected whatever its size; a rank chunk never exceeds ``chunk_size``.
    """
    cols = list(cols or source.columns)
    text_options = {"as_numbers": number_pairs(source, target, cols)} | text_options
    if mode == "rank":
        return _rank_chunks(source, target, keys, chunk_size, algorithm, cols, text_options)
    hashed = []
    for side in (source, target):
        numbers = hash_numbers(row_hash(side, cols, algorithm, **text_options))
        chunk = _chunk_of(side, keys, chunk_size, mode, chunks, number_pairs(source, target, keys))
        hashed.append(side.select(chunk.alias("chunk"), *[c.alias(n) for n, c in numbers.items()]))
    both = tagged_union(*hashed).groupBy("chunk").agg(
        F.sum("in_source").alias("source_rows"), F.sum("in_target").alias("target_rows"),
        *digest_aggregates("s_", F.col("in_source") == 1), *digest_aggregates("t_", F.col("in_target") == 1))
    measured = both.select("chunk", "source_rows", "target_rows",
                           digest_text(F.col("source_rows"), "s_").alias("source_digest"),
                           digest_text(F.col("target_rows"), "t_").alias("target_digest"))
    return verdict(measured, (F.col("source_digest") != F.col("target_digest"), FAIL, HIGH))


def _rank_chunks(source, target, keys, size, algorithm, cols, text_options) -> DataFrame:
    sides = []
    for name, side in (("source", source), ("target", target)):
        hashed = side.select(*keys, row_hash(side, cols, algorithm, **text_options).alias("h"))
        # identical rows travel as one row with a count and are laid out again only inside their chunks
        copies = hashed.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
        placed = running_totals(copies, [*keys, "h"], ["n"])
        start, end = F.col("upto_n") - F.col("n"), F.col("upto_n") - 1
        first, last = F.floor(start / F.lit(size)), F.floor(end / F.lit(size))
        spread = placed.select("h", start.alias("start"), end.alias("end"),
                               F.explode(F.sequence(first, last)).alias("chunk"))
        share = (F.least(F.col("end"), (F.col("chunk") + 1) * size - 1)
                 - F.greatest(F.col("start"), F.col("chunk") * size) + 1)
        sides.append(spread.select("chunk", F.array_repeat("h", share.cast("int")).alias("hs"))
                     .groupBy("chunk").agg(F.flatten(F.collect_list("hs")).alias("hashes"))
                     .select("chunk", F.size("hashes").cast("long").alias(f"{name}_rows"),
                             ordered_digest(F.col("hashes"), algorithm).alias(f"{name}_digest")))
    measured = sides[0].join(sides[1], "chunk", "full_outer").select(
        F.col("chunk").cast("long").alias("chunk"), F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("target_rows", F.lit(0)).alias("target_rows"), "source_digest", "target_digest")
    return verdict(measured, (~F.col("source_digest").eqNullSafe(F.col("target_digest")), FAIL, HIGH))
