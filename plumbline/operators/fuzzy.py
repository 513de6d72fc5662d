"""Edit-distance work: similarity of pairs, nearest matches, near-duplicate groups, column mapping."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import canonical_text, short_key_sql
from plumbline.functions.text import name_similarity, similarity
from plumbline.functions.verdicts import FAIL, HIGH, MEDIUM, WARN, verdict
from plumbline.operators.edit_join import edit_pairs
from plumbline.operators.edit_tree import tree_pairs
from plumbline.sources.workspace import checkpoint


def with_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Append edit ``distance`` and ``similarity`` of two text columns."""
    return df.withColumns({"distance": F.levenshtein(a, b), "similarity": similarity(F.col(a), F.col(b))})


def _tasks(df: DataFrame) -> int:
    """Tasks to spread strings over: comparing them costs far more than their bytes suggest."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fuzzy_match(source: DataFrame, source_col: str, target: DataFrame, target_col: str,
                threshold: float = 0.85) -> DataFrame:
    """For each distinct source value its nearest target value, if that is similar enough but not equal.

    Ties go to the smallest target value. A value that occurs in the target is dropped. The search widens its radius
    by one edit at a time (by a quarter from 8 on) and carries on only with the values that have found nothing, so a
    value lists its nearest neighbours and few beyond them.
    """
    values = source.where(F.col(source_col).isNotNull()).select(F.col(source_col).alias("a")).distinct()
    others = target.where(F.col(target_col).isNotNull()).select(F.col(target_col).alias("b")).distinct()
    others = checkpoint(others.repartition(_tasks(others)))
    pending = checkpoint(values.join(others, F.col("a") == F.col("b"), "left_anti"))
    longest = pending.agg(F.coalesce(F.max(F.length("a")), F.lit(0))).first()[0]

    def limit(length: Column) -> Column:
        # a similar partner is at most length / threshold long, and differs by (1 - threshold) of that
        return F.floor((1 - threshold) * F.floor(length / threshold + 1e-9) + 1e-9)

    furthest = math.floor((1 - threshold) * math.floor(longest / threshold + 1e-9) + 1e-9)
    nearest = None
    reach = 1
    while True:
        radius = min(reach, furthest)
        within = F.least(limit(F.length("a")), F.lit(radius)).cast("int").alias("k")
        pairs = tree_pairs(pending.select("a", within), others, radius, _tasks(others))
        best = pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best"))
        step = checkpoint(best.select("a", "best.b", "best.distance"))
        nearest = step if nearest is None else nearest.unionByName(step)
        if radius >= furthest:
            break
        pending = checkpoint(pending.join(step, "a", "left_anti").where(limit(F.length("a")) > radius))
        if pending.isEmpty():
            break
        reach = max(reach + 1, reach * 5 // 4)
    scored = nearest.select(F.col("a").alias("source_value"), F.col("b").alias("target_value"), "distance",
                            similarity(F.col("a"), F.col("b"), F.col("distance")).alias("similarity"))
    return scored.where((F.col("similarity") >= threshold) & (F.col("similarity") < 1))


def fuzzy_pairs(df: DataFrame, col: str, max_distance: int = 3, crowd: int = 1000) -> DataFrame:
    """All pairs of distinct values at 1 <= distance <= ``max_distance``, each once (a < b)."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("a")).distinct()
    pairs = edit_pairs(values, values.withColumnRenamed("a", "b"), lambda n: F.lit(max_distance), max_distance, crowd)
    return pairs.where("a < b")


def _greedy_leaders(prefix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Values of the prefix that a sequential greedy pass in rank order would make leaders.

    In rounds: a value without an undecided smaller neighbour leads, its neighbours follow. For random ranks the number
    of rounds is logarithmic (Blelloch, Fineman, Shun, SPAA 2012).
    """
    ranked = pairs.select(F.struct(F.md5("a").alias("h"), F.col("a").alias("v")).alias("x"),
                          F.struct(F.md5("b").alias("h"), F.col("b").alias("v")).alias("y"))
    edges = checkpoint(ranked.where("x < y").select(F.col("x.v").alias("small"), F.col("y.v").alias("large")).distinct())
    undecided, decided = prefix, []
    while not edges.isEmpty():
        lead = checkpoint(undecided.join(edges, F.col("value") == F.col("large"), "left_anti"))
        decided.append(lead)
        follow = edges.join(lead, F.col("small") == F.col("value"), "left_semi").select(F.col("large").alias("value"))
        settled = lead.unionByName(follow)
        undecided = checkpoint(undecided.join(settled, "value", "left_anti"))
        for end in ("small", "large"):
            edges = edges.join(undecided, F.col(end) == F.col("value"), "left_semi")
        edges = checkpoint(edges)
    leaders = undecided
    for lead in decided:
        leaders = leaders.unionByName(lead)
    return leaders


def fuzzy_duplicates(df: DataFrame, col: str, max_distance: int = 3, first_batch: int = 256,
                     crowd: int = 1000) -> DataFrame:
    """Near-duplicate groups: ``(leader, value, distance)``, a row per member other than the leader.

    The result is that of one greedy pass over the distinct values in the order of ``(md5(value), value)``: each value
    not yet in a group leads one, and takes all later free values within ``max_distance``. The pass runs in growing
    batches of that order. A batch is compared within itself and its leaders with everything left, so crowded values
    meet a few leaders instead of each other; leaders lie more than ``max_distance`` apart, so each value meets few.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    place = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    pending = checkpoint(values.withColumn("place", place).repartition(_tasks(values)))
    share = min(1.0, first_batch / max(1, pending.count()))
    members = None
    radius = lambda n: F.lit(max_distance)
    while True:
        batch = checkpoint(pending.where(F.col("place") < share).select("value"))
        size = batch.count()
        a = batch.select(F.col("value").alias("a"))
        inside = edit_pairs(a, a.withColumnRenamed("a", "b"), radius, max_distance, crowd, size).where("a <> b")
        leaders = checkpoint(_greedy_leaders(batch, inside))
        rest = pending.join(leaders, "value", "left_anti")
        pairs = edit_pairs(leaders.select(F.col("value").alias("a")), rest.select(F.col("value").alias("b")),
                           radius, max_distance, crowd, size)
        first = F.min(F.struct(F.md5("a").alias("h"), F.col("a").alias("leader"), "distance")).alias("best")
        step = checkpoint(pairs.groupBy(F.col("b").alias("value")).agg(first)
                          .select("best.leader", "value", "best.distance"))
        members = step if members is None else members.unionByName(step)
        if share >= 1.0:
            return members
        pending = checkpoint(rest.join(step, "value", "left_anti"))
        share = min(1.0, share * 8)


def fuzzy_groups(members: DataFrame) -> DataFrame:
    """One row per group of ``fuzzy_duplicates``: size with its leader, and smallest distance; each group fails."""
    groups = members.groupBy("leader").agg((F.count(F.lit(1)) + 1).alias("size"), F.min("distance").alias("distance"))
    return verdict(groups, otherwise=(FAIL, MEDIUM))


_BITS = 63  # columns per bit mask


def _masks(side: str, columns: Sequence[str]) -> dict[str, Column]:
    """Bit masks telling which columns of a side hold a value."""
    masks = {}
    for word in range(0, len(columns), _BITS):
        cases = " ".join(f"when '{c}' then {1 << i}L" for i, c in enumerate(columns[word:word + _BITS]))
        masks[f"{side}_{word}"] = F.expr(f"bit_or(if(side = '{side}', case column {cases} else 0L end, 0L))")
    return masks


def _columns_of(side: str, columns: Sequence[str]) -> Column:
    """The column names of the bits set in a side's masks."""
    names = ", ".join(f"if(getbit({side}_{i - i % _BITS}, {i % _BITS}) = 1, '{c}', null)" for i, c in enumerate(columns))
    return F.expr(f"array_compact(array({names}))")


def _shared_values(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct values that each pair of columns shares, and distinct values of each source column.

    Each value is reduced to the set of columns holding it, and the values to counts of such sets, of which there are few.
    """
    sides = []
    for name, side in (("source", source), ("target", target)):
        kinds = {f.name: f.dataType for f in side.schema.fields}
        texts = side.select(*[canonical_text(c, kinds[c]).alias(c) for c in side.columns])
        sides.append(texts.unpivot([], side.columns, "column", "value").where(F.col("value").isNotNull())
                     .select(F.lit(name).alias("side"), "column", F.expr(short_key_sql("value")).alias("value")))
    masks = _masks("source", source.columns) | _masks("target", target.columns)
    held = sides[0].unionByName(sides[1]).groupBy("value").agg(*[mask.alias(name) for name, mask in masks.items()])
    counts = checkpoint(held.groupBy(*masks).agg(F.count(F.lit(1)).alias("n")))
    cells = counts.select(F.explode(_columns_of("source", source.columns)).alias("source_column"),
                          _columns_of("target", target.columns).alias("others"), "n")
    sizes = cells.groupBy("source_column").agg(F.sum("n").alias("distinct_values"))
    shared = (cells.select("source_column", F.explode("others").alias("target_column"), "n")
              .groupBy("source_column", "target_column").agg(F.sum("n").alias("shared_values")))
    return shared, sizes


def column_mapping(source: DataFrame, target: DataFrame, min_confidence: float = 0.7,
                   unmapped_below: float = 0.4) -> DataFrame:
    """The best target column for each source column, judged by name and by shared values.

    ``confidence`` is 1 for equal normalised names, otherwise half the name similarity plus half the share of the
    source's distinct values found in the target column. Columns below ``unmapped_below`` count as unmapped.
    """
    spark = source.sparkSession
    shared, sizes = _shared_values(source, target)
    kinds = {"source": {f.name: f.dataType.simpleString() for f in source.schema.fields},
             "target": {f.name: f.dataType.simpleString() for f in target.schema.fields}}
    grid = spark.createDataFrame(
        [(s, t, kinds["source"][s], kinds["target"][t]) for s in source.columns for t in target.columns],
        "source_column string, target_column string, source_type string, target_type string")
    scored = (grid.join(shared, ["source_column", "target_column"], "left").join(sizes, "source_column", "left")
              .withColumns({"name_similarity": name_similarity(F.col("source_column"), F.col("target_column")),
                            "value_overlap": F.coalesce(F.col("shared_values") / F.col("distinct_values"), F.lit(0.0))}))
    scored = scored.withColumn("confidence", F.when(F.col("name_similarity") == 1, 1.0)
                               .otherwise(0.5 * F.col("name_similarity") + 0.5 * F.col("value_overlap")))
    best = (scored.groupBy("source_column", "source_type")
            .agg(F.max_by(F.struct("target_column", "target_type", "name_similarity", "value_overlap", "confidence"),
                          F.struct("confidence", "target_column")).alias("best"))
            .select("source_column", "source_type", "best.*"))
    mapped = F.col("confidence") >= unmapped_below
    result = best.withColumn("mapped", mapped)
    return verdict(result, (~F.col("mapped"), FAIL, HIGH), (F.col("source_type") != F.col("target_type"), FAIL, HIGH),
                   (F.col("confidence") < min_confidence, WARN, MEDIUM))
