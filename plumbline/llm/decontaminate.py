"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a run of ``seed`` words are joined; each pair is tiled: the longest common runs
are marked again and again, none overlapping another, by running Karp-Rabin with a falling search length. The share of
an item's words under tiles is its coverage. Tiles may lie in any order, so reordered passages count as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.shared import salted_join, stored
from plumbline.llm.words import small, windows_of, words_of

#: Bits of the filter over the items' seeds: 2 MB whatever the size of the benchmark.
FILTER_BITS = 1 << 24
_MASK = np.uint64(FILTER_BITS - 1)


def tile(document: np.ndarray, item: np.ndarray, least: int, longest: int = 32) -> list[tuple[int, int, int]]:
    """Tiles ``(document position, item position, length)`` of at least ``least`` words.

    Running Karp-Rabin: runs of the search length that are free on both sides are found by their hashes, extended as
    far as they go, and marked longest first; a run longer than twice the search length restarts the search there.
    """
    marked_d, marked_i = np.zeros(len(document), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(longest, len(item), len(document))
    while length >= least:
        starts: dict[int, list[int]] = defaultdict(list)
        for p, h in enumerate(windows_of(item, length).tolist()):
            if not marked_i[p:p + length].any():
                starts[h].append(p)
        hashes = windows_of(document, length)
        matches, restart, done = [], 0, -1
        for at in np.flatnonzero(np.isin(hashes, np.fromiter(starts, np.uint64, len(starts)))).tolist():
            if at <= done or marked_d[at:at + length].any():
                continue
            for p in starts[int(hashes[at])]:
                room = min(len(document) - at, len(item) - p)
                same = ((document[at:at + room] == item[p:p + room])
                        & ~marked_d[at:at + room] & ~marked_i[p:p + room])
                run = room if same.all() else int(np.argmin(same))
                if run > 2 * length:
                    restart = max(restart, run)
                if run >= length:
                    matches.append((run, at, p))
        if restart:
            length = restart
            continue
        for run, at, p in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not (marked_d[at:at + run].any() or marked_i[p:p + run].any()):
                marked_d[at:at + run] = marked_i[p:p + run] = True
                tiles.append((at, p, run))
        length = length // 2 if length > 2 * least else length - 1 if length > least else 0
    return sorted(tiles)


def _seeds(seed: int, keep_all: bool, table=None):
    """Distinct seed hashes of each text; of documents only those the filter of the items knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if keep_all else np.unpackbits(np.frombuffer(table.value, np.uint8)).view(bool)
        for batch in small(batches, 1):
            words, offsets = words_of(batch.column(1))
            windows = windows_of(words, seed)
            hit = np.ones(len(windows), bool) if keep_all else known[(windows & _MASK).astype(np.int64)]
            ids, found = [], []
            where = np.flatnonzero(hit)
            edges = np.searchsorted(where, offsets)
            for i, key in enumerate(batch.column(0).to_pylist()):
                mine = where[edges[i]:edges[i + 1]]
                mine = np.unique(windows[mine[mine <= offsets[i + 1] - seed]])
                if key is not None and len(mine):
                    ids.append(np.full(len(mine), key, np.int64))
                    found.append(mine)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)),
                                                  pa.array(np.concatenate(found).view(np.int64))], ["id", "seed"])
    return run


def _tiles(seed: int):
    kind = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            documents, d = words_of(batch.column(2))
            items, t = words_of(batch.column(3))
            found, covered, sizes = [], [], []
            for i in range(batch.num_rows):
                got = tile(documents[d[i]:d[i + 1]], items[t[i]:t[i + 1]], seed)
                found.append([{"at": a, "item_at": p, "words": n} for a, p, n in got])
                covered.append(sum(n for _, _, n in got))
                sizes.append(int(t[i + 1] - t[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covered, pa.int64()),
                                              pa.array(sizes, pa.int64()), pa.array(found, kind)],
                                             ["doc_id", "item_id", "covered", "item_words", "tiles"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, percent: int = 50) -> DataFrame:
    """Pairs ``(doc_id, item_id, covered, item_words, coverage, tiles)`` in which tiles of at least ``seed`` words cover
    ``percent`` of the item's words or more.

    Words are runs without ASCII white space, A-Z lower-cased. A null or wordless text covers nothing; items of fewer
    than ``seed`` words are not looked for. Rows without an id are ignored, of repeated rows one counts; if an id has
    several texts, each is tiled and the best coverage stays. Empty tables give no pairs; further columns are ignored.

    An item's rarest seeds suffice: to be covered by ``percent``, it must share a run outside any set of its seeds that
    is too small to cover as much, so frequent phrases that many items share start no pairs by themselves. The seeds'
    filter is of fixed size; what passes it is joined exactly, dealt out by document.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
             .where("item_id IS NOT NULL").distinct())
    seeds = items.mapInArrow(_seeds(seed, True), "id long, seed long")
    # coverage needs at least ceil(words covered / seed) runs, so leaving out one run fewer of an item loses no pair
    often = seeds.groupBy("seed").agg(F.countDistinct("id").alias("items"))
    sizes = items.select(F.col("item_id").alias("id"), F.size(F.filter(
        F.split("item_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    sizes = sizes.groupBy("id").agg(F.min("words").alias("words"))
    needed = F.greatest(F.ceil(F.ceil(F.col("words") * percent / 100) / seed), F.lit(1))
    place = W.partitionBy("id").orderBy("items", "seed")
    rare = stored(seeds.join(often, "seed").join(sizes, "id").withColumn("place", F.row_number().over(place))
                  .withColumn("distinct", F.count(F.lit(1)).over(W.partitionBy("id")))
                  # an item that repeats itself has fewer seeds than runs: all of them are kept
                  .where((F.col("place") <= F.col("distinct") - needed + 1)
                         | (F.col("distinct") < F.col("words") - seed + 1))
                  .select(F.col("id").alias("item_id"), "seed"), "seeds")
    bits = (rare.select(F.expr(f"seed & {FILTER_BITS - 1}").alias("bit")).distinct()
            .groupBy(F.expr("bit div 65536").alias("page"))  # at most 256 pages of 65536 bits
            .agg(F.collect_list(F.expr("cast(bit % 65536 AS int)")).alias("bits")))
    filled = np.zeros((FILTER_BITS // 65536, 65536), np.uint8)
    for row in bits.toLocalIterator():
        filled[row["page"], row["bits"]] = 1
    table = spark.sparkContext.broadcast(np.packbits(filled.reshape(-1)).tobytes())
    hits = texts.mapInArrow(_seeds(seed, False, table), "id long, seed long").withColumnRenamed("id", "doc_id")
    pairs = salted_join(hits, rare, "seed", "doc_id").select("doc_id", "item_id").distinct()
    pairs = stored(pairs, "seed-pairs")
    both = (pairs.join(texts, "doc_id").join(items, "item_id")
            .select("doc_id", "item_id", "text", "item_text"))
    tiled = both.mapInArrow(_tiles(seed), "doc_id long, item_id long, covered long, item_words long, "
                                          "tiles array<struct<at:int,item_at:int,words:int>>")
    return (tiled.where(F.col("covered") * 100 >= F.col("item_words") * percent).where("covered > 0")
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("covered", "item_words", "tiles")).alias("x"))
            .select("doc_id", "item_id", "x.covered", "x.item_words",
                    (F.col("x.covered") / F.col("x.item_words")).alias("coverage"), "x.tiles"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, percent: int = 50) -> DataFrame:
    """The documents that hold no item, unchanged; rows without an id stay."""
    found = contaminated(docs, benchmark, seed, percent).select("doc_id").distinct()
    return docs.join(stored(found, "contaminated"), "doc_id", "left_anti").select(docs.columns)
