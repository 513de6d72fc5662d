"""Hard-negative mining with Four-Russians scoring.

Components become integers q = floor(256 x). A candidate is stored as bit planes: for each group of eight
dimensions and each bit of q in two's complement, one byte of the eight bits. For each anchor, a table per group gives
the sum of the anchor's components over every subset of the eight (256 entries). A score is then the sum over groups
and bits of the table entry that the candidate's byte indexes, shifted by the bit (the sign bit subtracted): the exact
integer inner product, from lookups and shifts.

Anchors (a query set) are scored against all rows in tiles: candidates are dealt to tiles by a hash of a row number,
anchors to blocks, and each (tile, block) pair is one task, so no task holds more than a tile and a block whatever the
labels or repeated vectors. Each task keeps its best few per anchor; a window over those picks the global best. A first
round finds the positives, a second the negatives in the band that the positives' scores set.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

#: Candidates per tile and anchors per block: a task holds a score matrix of at most both (8 MB).
TILE_ROWS, BLOCK_ANCHORS = 8192, 128
#: Bit i of byte b, for every byte: the subsets of a group of eight.
SUBSETS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)

RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
          "positive_rank int")


def _matrix(column, d: int) -> np.ndarray:
    """A list column as (rows, d) int64, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), d), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def bit_planes(q: np.ndarray, bits: int) -> np.ndarray:
    """(rows, groups, bits) bytes: byte [r, g, b] holds bit b (two's complement) of dimensions 8g .. 8g+7 of row r."""
    rows, d = q.shape
    groups = -(-d // 8)
    padded = np.zeros((rows, groups * 8), dtype=np.int64)
    padded[:, :d] = q
    unsigned = padded & ((1 << bits) - 1)
    planes = (unsigned[:, :, None] >> np.arange(bits)) & 1  # rows, dims, bits
    planes = planes.reshape(rows, groups, 8, bits)
    return (planes << np.arange(8)[None, None, :, None]).sum(axis=2).astype(np.uint8)


def tables(anchors: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256): the sum of each anchor's components over every subset of each group of eight."""
    rows, d = anchors.shape
    groups = -(-d // 8)
    padded = np.zeros((rows, groups * 8), dtype=np.int64)
    padded[:, :d] = anchors
    return padded.reshape(rows, groups, 8) @ SUBSETS.T


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products by lookups: shift and add per bit, the sign bit subtracted."""
    _, groups, bits = planes.shape
    total = np.zeros((table.shape[0], planes.shape[0]), dtype=np.int64)
    for b in range(bits):
        part = np.zeros_like(total)
        for g in range(groups):
            part += table[:, g, :][:, planes[:, g, b]]
        total += -(part << b) if b == bits - 1 else part << b
    return total


def _best(score: np.ndarray, ids: np.ndarray, keep: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` kept candidates by score falling, then smaller id."""
    where = np.flatnonzero(keep)
    if len(where) > most:
        # a partial cut by score first: only ties at the cut are ordered by id
        cut = np.partition(score[where], len(where) - most)[len(where) - most]
        where = where[score[where] >= cut]
    order = np.lexsort((ids[where], -score[where]))
    return where[order[:most]]


def mine(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label",
         anchor_every: int = 100, relabel_every: int = 7, classes: int = 10, scale: int = 256, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank)``.

    Rows with a null id, label or vector, or any null or non-finite component take no part. Where the id is divisible
    by ``relabel_every`` the label becomes (label + 1) % ``classes`` (SQL remainder). Anchors are ids divisible by
    ``anchor_every``. Scores are integer inner products of floor(``scale`` x), shorter vectors padded with zeros;
    higher first, ties by smaller id. Positives: the first ``positives`` rows of the anchor's label with another id.
    Per positive, the first ``negatives`` rows of another label with low·ps <= 100·ns <= high·ps. Repeated rows are
    separate rows (a repeated anchor gives its rows twice); an empty table, or one without anchors, gives no rows.
    Further columns of the input are ignored. Raises if scores could leave 64 bits."""
    spark = embeddings.sparkSession
    v = F.col(column)
    fine = (F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull()
            & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))))
    relabel = F.when(F.col(key) % relabel_every == 0, (F.col(label) + 1) % classes).otherwise(F.col(label))
    q = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = stored(embeddings.where(fine).select(F.col(key).cast("long").alias("_id"), relabel.cast("long").alias("_label"),
                                               q.alias("_q")).withColumn("_row", F.monotonically_increasing_id()),
                  "negatives-rows")
    anchor = F.col("_id") % anchor_every == 0
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(anchor, 1)).alias("a"),
                     F.max(F.size("_q")).alias("d"), F.min(F.array_min("_q")).alias("lo"),
                     F.max(F.array_max("_q")).alias("hi")).first()
    if not facts["n"] or not facts["a"]:
        return spark.createDataFrame([], RESULT)
    d = max(1, facts["d"])
    bits = 1 + max(int(facts["lo"] or 0).bit_length() if (facts["lo"] or 0) < 0 else 0,
                   int(facts["hi"] or 0).bit_length(), 1)
    if math.log2(d) + 2 * bits > 62:
        raise ValueError(f"scores of {d} dimensions of {bits} bits could leave 64 bits")
    tiles, blocks = -(-facts["n"] // TILE_ROWS), -(-facts["a"] // BLOCK_ANCHORS)

    def planes(batches):
        for batch in batches:
            p = bit_planes(_matrix(batch.column(3), d), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array([x.tobytes() for x in p], pa.binary())], names=["_id", "_label", "_row", "_planes"])

    candidates = stored(rows.select("_id", "_label", "_row", "_q").mapInArrow(
        planes, "_id long, _label long, _row long, _planes binary"), "negatives-planes")
    candidates = (candidates.withColumn("tile", F.pmod(F.xxhash64("_row"), F.lit(tiles)))
                  .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1)))))
    anchors = (rows.where(anchor).select(F.col("_row").alias("a_row"), F.col("_id").alias("a_id"),
                                         F.col("_label").alias("a_label"), F.col("_q").alias("a_q"))
               .withColumn("block", F.pmod(F.xxhash64("a_row"), F.lit(blocks))))

    def score_block(cands: pd.DataFrame, anchs: pd.DataFrame) -> np.ndarray:
        table = tables(np.array([np.pad(np.asarray(a, dtype=np.int64), (0, d - len(a))) for a in anchs["a_q"]]))
        planes_ = np.frombuffer(b"".join(cands["_planes"]), dtype=np.uint8)
        return scores(table, planes_.reshape(len(cands), -(-d // 8), bits))

    def first(cands: pd.DataFrame, anchs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cands) and len(anchs):
            s = score_block(cands, anchs)
            ids, labels = cands["_id"].to_numpy(), cands["_label"].to_numpy()
            for i, a in enumerate(anchs.itertuples(index=False)):
                pick = _best(s[i], ids, (labels == a.a_label) & (ids != a.a_id), positives)
                out.append(pd.DataFrame({"a_row": a.a_row, "p_id": ids[pick], "p_score": s[i][pick]}))
        return pd.concat(out) if out else pd.DataFrame({"a_row": [], "p_id": [], "p_score": []})

    order = Window.partitionBy("a_row").orderBy(F.col("p_score").desc(), "p_id")
    found = (candidates.groupBy("tile", "block")
             .cogroup(anchors.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1))))
                      .groupBy("tile", "block"))
             .applyInPandas(first, "a_row long, p_id long, p_score long")
             .withColumn("p_rank", F.row_number().over(order)).where(F.col("p_rank") <= positives))
    chosen = stored(found.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("p_rank", "p_id", "p_score")))
                                               .alias("pos")), "negatives-positives")
    anchors = anchors.join(chosen, "a_row")  # one row per anchor on both sides

    def second(cands: pd.DataFrame, anchs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cands) and len(anchs):
            s = score_block(cands, anchs)
            ids, labels = cands["_id"].to_numpy(), cands["_label"].to_numpy()
            for i, a in enumerate(anchs.itertuples(index=False)):
                other = labels != a.a_label
                for p in a.pos:
                    ps = int(p["p_score"])
                    band = other & (low * ps <= 100 * s[i]) & (100 * s[i] <= high * ps)
                    pick = _best(s[i], ids, band, negatives)
                    out.append(pd.DataFrame({"a_row": a.a_row, "a_id": a.a_id, "positive_rank": p["p_rank"],
                                             "positive_id": p["p_id"], "positive_score": ps,
                                             "negative_id": ids[pick], "negative_score": s[i][pick]}))
        names = ["a_row", "a_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    order = Window.partitionBy("a_row", "positive_rank").orderBy(F.col("negative_score").desc(), "negative_id")
    return (candidates.groupBy("tile", "block")
            .cogroup(anchors.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1))))
                     .groupBy("tile", "block"))
            .applyInPandas(second, "a_row long, a_id long, positive_rank int, positive_id long, positive_score long, "
                                   "negative_id long, negative_score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score", "positive_rank"))
