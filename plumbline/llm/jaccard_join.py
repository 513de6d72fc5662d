"""Exact Jaccard join of documents on word shingles, by adaptive multi-match prefixes.

All shingles are put in one global order, rare ones first. Two sets of similarity t that share at least T shingles
share at least l of them among the first ``n - T + l`` of each. Every document picks its own l: where its prefix
holds frequent shingles, a longer prefix that demands more shared shingles costs fewer candidates. A pair is verified
if it shares ``min(l of both)`` prefix shingles and the first shared one stands where it leaves room for T. Only that
first one lists the pair: near copies of a text that differ too much to link share most of its shingles, but each has
so many of its own, which come first, that no shared one leaves room.

Order and costs come from exact counts over all documents in a table of fixed size (``BUCKETS`` hashed counters, added
up by Spark). Any order is right for the method, so counters that shingles share cost time and never a pair.
Groups of copies aren't expanded: equal sets are one class from the start, and large groups of near copies are linked
through leaders before the pairs that are left between different components are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import stored
from plumbline.llm.words import shingle_sets, small
from plumbline.sources.workspace import checkpoint

#: Counters of the frequency table: 8 MB whatever the size of the corpus.
BUCKETS = 1 << 20
_CHUNK = 4096
_SHIFT = np.uint64(44)
_LONGEST = 6  # the largest l that is tried
#: Rank of a counter of 20,000, from which on its shingles are dealt out by document.
CROWD = 14_600
_VERIFY = 20.0  # cost of verifying a candidate, in prefix rows
_FEW_PAIRS = 8  # prefix rows for each pair that may be listed before leaders have linked what they can


def _scan(size: int):
    """One pass over the texts: a row per document with the digest of its set, and the counters of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in small(batches, 1):
            sizes, digests = [], []
            for found in shingle_sets(batch.column(1), size):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                np.add.at(counts, (found >> _SHIFT).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "n", "digest", "chunk", "counts"])
        parts = counts.reshape(-1, _CHUNK)
        full = np.flatnonzero(parts.any(axis=1))
        k = len(full)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(full, pa.int32()),
            pa.array([parts[i].tobytes() for i in full], pa.binary())], ["doc_id", "n", "digest", "chunk", "counts"])
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of the chunks in this task, as a stream: memory is fixed by BUCKETS."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(counts, np.int64)
            sums[chunk] = sums[chunk] + got if chunk in sums else got
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                      pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                     ["chunk", "counts"])


def least_overlap(n: int, percent: int) -> int:
    """Fewest shingles a set of ``n`` shares with any set of the similarity."""
    return -(-percent * n // 100)


def choose_matches(order: np.ndarray, excess: np.ndarray, n: int, percent: int) -> int:
    """The l with the least estimated cost: prefix rows, and candidates that could share l of them."""
    needed = least_overlap(n, percent)
    best, least = 1, np.inf
    start = n - needed + 1
    crowd = excess[order[:start + _LONGEST - 1]].cumsum()
    for tried in range(1, min(_LONGEST, needed) + 1):
        length = min(start + tried - 1, n)
        cost = length + _VERIFY * crowd[length - 1] / tried
        if cost < least:
            best, least = tried, cost
    return best


def _prefixes(size: int, percent: int, table):
    """Prefix rows of each document; a set that this task has seen a moment ago isn't repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, excess = table.value
        seen: dict[bytes, None] = {}
        names = ["token", "doc_id", "n", "at", "need", "crowd"]
        for batch in small(batches, 1):
            tokens, ids, sizes, ats, needs, crowds, lengths = [], [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                length = np.array(lengths)
                return pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids), length)),
                    pa.array(np.repeat(np.array(sizes, np.int32), length)),
                    pa.array(np.concatenate(ats).astype(np.int32)),
                    pa.array(np.repeat(np.array(needs, np.int32), length)),
                    pa.array(np.concatenate(crowds))], names)

            for doc_id, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                if not len(found) or doc_id is None:
                    continue
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue
                seen[digest] = None
                if len(seen) > 50_000:  # bounded; later repeats are joined as equal sets
                    del seen[next(iter(seen))]
                bucket = (found >> _SHIFT).astype(np.int64)
                order = np.argsort(rank[bucket], kind="stable")
                n = len(found)
                need = choose_matches(order, excess[bucket], n, percent)
                length = min(n, n - least_overlap(n, percent) + need)
                tokens.append(found[order[:length]])
                ids.append(doc_id)
                sizes.append(n)
                ats.append(np.arange(length))
                needs.append(need)
                crowds.append(rank[bucket[order[:length]]] > CROWD)
                lengths.append(length)
                if sum(lengths[-64:]) > 100_000 or len(lengths) >= 500:
                    yield flush()
                    for x in (tokens, ids, sizes, ats, needs, crowds, lengths):
                        x.clear()
            if lengths:
                yield flush()
    return run


def _verify(size: int, percent: int):
    """Keeps the pairs of texts whose sets are similar; pairs of one left document lie together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.uint64)
        for batch in small(batches, 3):
            a, b = batch.column(0), batch.column(1)
            rights = shingle_sets(batch.column(3), size)
            keep = []
            for i, (x, right) in enumerate(zip(a.to_pylist(), rights, strict=True)):
                if x != last:
                    last, left = x, next(shingle_sets(batch.column(2).slice(i, 1), size))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * shared >= percent * (len(left) + len(right) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])
    return run


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate pairs ``(a, b)``. Both joins read one exchange of the texts; a document in very many pairs
    is split by adaptive execution, as no operator above needs its rows together."""
    texts = docs.select("doc_id", "text")
    got = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
           .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
           .select("a", "b", "text_a", "text_b"))
    return got.mapInArrow(_verify(size, percent), "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows with the component of each document so far."""
    if labels is None:
        return rows.withColumn("component", F.col("doc_id"))
    got = rows.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return got.withColumn("component", F.coalesce("component", "doc_id"))


def _open_groups(rows: DataFrame) -> DataFrame:
    """Shingles that still connect different components, with the pairs that listing them would look at."""
    per = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    return (per.groupBy("token").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"),
                                     F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("token", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs")))


def _first_shared(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows whose shingle may be the first, in the global order, that the document shares with one it links to.

    No shingle before the first is shared, so the overlap is at most ``n - at``. A link needs
    ``percent / (100 + percent)`` of both sizes, and the other size is at least that of the smallest set that holds the
    shingle and at least ``percent`` of ``n``."""
    low = rows.groupBy("token").agg(F.min("n").alias("low"))
    return (rows.where(f"100L * (n - at) >= {percent}L * n").join(low, "token")
            .where(f"{100 + percent}L * (n - at) >= {percent}L * (n + low)").drop("low"))


def _room(percent: int) -> str:
    """Both sizes fit, and were the shingle the first shared one, it and what follows would leave room for the overlap
    that is needed."""
    return (f"100L * least(n, n_b) >= {percent}L * greatest(n, n_b) AND "
            f"{100 + percent}L * least(n - at, n_b - at_b) >= {percent}L * (n + n_b)")


def _enough(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as both demand; a prefix travels as one array."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(rows.join(ids, "doc_id", "left_semi").groupBy("doc_id")
                  .agg(F.collect_list("token").alias("tokens"), F.first("need").alias("need")), "prefix-sets")
    side = lambda x: sets.select(*[F.col(c).alias(d) for c, d in
                                   (("doc_id", x), ("tokens", f"tokens_{x}"), ("need", f"need_{x}"))])
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where("size(array_intersect(tokens_a, tokens_b)) >= least(need_a, need_b)").select("a", "b"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, star_rounds: int = 12) -> DataFrame:
    """``(doc_id, n_shingles, component_id, copies)`` for each document of ``docs(doc_id, text, ...)``.

    Two documents link when ``100 * |A and B| >= percent * |A or B|`` of their sets of ``size``-word shingles; the
    component is the smallest doc_id reachable by links. ``copies`` is the number of rows with the very same set.
    A null or wordless text has an empty set and links with nothing. Repeated rows give repeated rows; where rows of an
    id differ in text, the text of the least sha256 stands for all of them. Rows with a null id keep their count and
    have no component. Further columns are ignored. Long texts are read in whole; an empty table gives none.

    Shingles are compared as 64-bit hashes; sets of up to a million shingles meet a collision with a chance of 1e-7.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, digest binary, chunk int, counts binary"
    scanned = stored(docs.mapInArrow(_scan(size), schema), "shingle-sets")
    members = scanned.where("chunk IS NULL").select("doc_id", "n", "digest")
    summed = (scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition(16, "chunk")
              .mapInArrow(_add_up, "chunk int, counts binary").collect())  # 256 chunks at most: BUCKETS counters
    counts = np.zeros((BUCKETS // _CHUNK, _CHUNK), np.int64)
    for row in summed:
        counts[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    counts = counts.reshape(-1)
    rank = np.minimum(np.log2(counts + 1.0) * 1024, 65535).astype(np.uint16)
    excess = np.maximum(counts - 2.0 * counts.mean() - 3, 0).astype(np.float32)
    table = spark.sparkContext.broadcast((rank, excess))

    several = members.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
    if not several.where("x <> y AND doc_id IS NOT NULL").isEmpty():
        one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min_by("text", F.sha2("text", 256)).alias("text"))
        found = jaccard_components(one, size, percent, star_rounds).drop("n_shingles")
        return members.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
            "doc_id", "n_shingles", "component_id", "copies")

    # equal sets are one class, stood for by its smallest document
    classes = members.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"),
                                                            F.count(F.lit(1)).alias("copies"))
    copies = stored(members.where("n > 0 AND doc_id IS NOT NULL").join(classes.where("copies > 1"), "digest")
                    .select("doc_id", "rep", "copies").distinct(), "copies")

    # A counter bounds the documents of each of its shingles: up to CROWD, a shingle's rows meet in one task to see if
    # there are two; shingles of fuller counters are kept anyway, dealt out by document.
    prefixes = docs.mapInArrow(_prefixes(size, percent, table),
                               "token long, doc_id long, n int, at int, need int, crowd boolean")
    here = W.partitionBy("token", F.when(F.col("crowd"), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(0))
    shared = (prefixes.withColumn("docs", F.count(F.lit(1)).over(here)).where("docs > 1 OR crowd")
              .drop("docs", "crowd"))
    rows = stored(shared, "shared-prefixes")
    # one row for each class and shingle
    other = copies.where("doc_id <> rep").select("doc_id", "rep")
    rows = stored(rows.join(other, "doc_id", "left").withColumn("doc_id", F.coalesce("rep", "doc_id")).drop("rep")
                  .groupBy("token", "doc_id").agg(F.first("n").alias("n"), F.first("at").alias("at"),
                                                  F.first("need").alias("need")), "class-prefixes")
    bound = rows.count() // _FEW_PAIRS
    links, labels, before = None, None, float("inf")
    for _ in range(star_rounds):
        current = _labelled(rows, labels)
        cost = _open_groups(current).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()["pairs"]
        if cost <= bound or cost > 0.9 * before:
            break  # few are left, or another round would hardly spare any
        before = cost
        found = stored(_verified(docs, _leader_pairs(current, percent), size, percent), "links")
        if found.isEmpty():
            break  # leaders link no more: what is left is listed below, every pair of it
        links = found if links is None else links.union(found)
        labels = components(links)
    current = _labelled(stored(_first_shared(rows, percent), "first-shared"), labels)
    here = current.join(_open_groups(current).select("token"), "token", "left_semi")
    there = here.select("token", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "at", "component")])
    pairs = (here.join(there, "token").where("doc_id < doc_id_b AND component <> component_b").where(_room(percent))
             .select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    pairs = _enough(stored(pairs, "listed"), rows)
    found = stored(_verified(docs, stored(pairs, "candidates"), size, percent), "links")
    links = found if links is None else links.union(found)
    near = components(links).select(F.col("node").alias("rep"), F.col("component").alias("near"))
    mine = near.select(F.col("rep").alias("doc_id"), F.col("near").alias("own"))
    return (members.select("doc_id", F.col("n").alias("n_shingles")).join(copies, "doc_id", "left")
            .join(near, "rep", "left").join(mine, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("near", "own", "rep", "doc_id").alias("component_id"),
                    F.coalesce("copies", F.lit(1).cast("long")).alias("copies")))


def _leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """For each document the two leaders with which it shares most shingles. The leader of a shingle is its smallest
    document; documents already in the leader's component need none."""
    best = W.partitionBy("b").orderBy(F.desc("shared"), "a")
    leads = rows.groupBy("token").agg(F.min(F.struct("doc_id", "n", "component")).alias("lead"))
    led = rows.join(leads, "token")
    return (led.where("component <> lead.component AND 100 * least(n, lead.n) >= "
                      f"{percent} * greatest(n, lead.n)")
            .groupBy(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"))
            .agg(F.count(F.lit(1)).alias("shared")).withColumn("place", F.row_number().over(best))
            .where("place <= 2").select("a", "b"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group of near copies: the one whose id is the component's, all its columns as they are.
    Documents without words stay, as do rows without an id; of repeated rows one stays."""
    kept = (jaccard_components(docs, size, percent).where("component_id <=> doc_id").select("doc_id").distinct())
    ids = docs.where("doc_id IS NOT NULL").join(kept.where("doc_id IS NOT NULL"), "doc_id", "left_semi")
    first = W.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.sha2("text", 256))
    one = ids.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    return one.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
