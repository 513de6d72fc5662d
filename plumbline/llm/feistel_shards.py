"""Token ids in training order: fixed-stride binary shards, placed by a keyed permutation.

Documents are encoded and packed into sequences of equal length. A keyed Feistel network over the sequence numbers,
walked along its cycles until it lands below their count, gives each sequence a slot of its own; no shuffle table is
kept. Slots are cut into ranges, and each range is one file of records of equal size in slot order, so training reads
files from front to end and resumes at any step by arithmetic.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import fresh_folder
from plumbline.llm.words import mix
from plumbline.operators.ordering import running_totals

#: Fixed values of the byte-level vocabulary: the id that ends a document and pads the last sequence, bytes an id.
END = 50256
WIDTH = 2
#: The parts' table is broadcast up to this number of rows (16 bytes each), and joined by shuffle beyond it.
BROADCAST_PARTS = 1_000_000
ROUNDS = 4


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers below ``n``: a bijection of 0..n-1 chosen by ``key``."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(key)[::-1] if inverse else _keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right
    out = once(numbers.astype(np.uint64))
    while (over := np.flatnonzero(out >= n)).size:  # cycle walking
        out[over] = once(out[over])
    return out.astype(np.int64)


def _encoder(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as lines:  # installed with the tokenizers on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pack(tokenizer: str, length: int):
    """Sequences of the documents of one task, in their order; the last is padded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, size, owners = [], 0, []  # ids not yet written, and (document, end) of each
        done: list[tuple[int, bytes, int, list[int]]] = []

        def cut(last: bool) -> None:
            nonlocal held, size, owners, number
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            stop = -(-len(ids) // length) * length if last else len(ids) // length * length
            padded = np.concatenate((ids, np.full(max(0, stop - len(ids)), END, np.uint16)))
            at = 0
            for start in range(0, stop, length):
                mine = []
                while at < len(owners):
                    mine.append(owners[at][0])
                    if owners[at][1] > start + length:
                        break
                    at += 1
                    if owners[at - 1][1] == start + length:
                        break
                done.append((number, padded[start:start + length].tobytes(), min(length, len(ids) - start), mine))
                number += 1
            held, size = [ids[stop:]], max(0, len(ids) - stop)
            owners = [(d, e - stop) for d, e in owners if e > stop]

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([
                pa.array([part] * len(done), pa.int64()), pa.array([x[0] for x in done], pa.int64()),
                pa.array([x[1] for x in done], pa.binary()), pa.array([x[2] for x in done], pa.int64()),
                pa.array([x[3] for x in done], pa.list_(pa.int64()))],
                ["part", "number", "ids", "n_tokens", "doc_ids"])
            done.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                held.append(np.append(encoder.encode_to_numpy(text).astype(np.uint16), np.uint16(END)))
                size += len(held[-1])
                owners.append((doc_id, size))
                if size > 200_000:
                    cut(False)
                    yield emit()
        cut(True)
        yield emit()
    return run


def _place(n: int, key: int, per_shard: int):
    """Shard and slot of each sequence, and its record compressed for the shuffle: a sixth less than the shuffle's own
    codec leaves of token ids. One step for both: a second one in Python would need a worker of its own in every
    task, which Spark keeps beside the first for the steps that follow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            slots = permute(batch.column(0).to_numpy(zero_copy_only=False), n, key)
            yield pa.RecordBatch.from_arrays([
                pa.array(slots // per_shard, pa.int64()), pa.array(slots, pa.int64()),
                pa.array([packer.compress(x) for x in batch.column(1).to_pylist()], pa.binary())],
                ["shard", "slot", "ids"])
    return run


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        yield batch.set_column(2, "ids", pa.array([unpacker.decompress(x) for x in batch.column(2).to_pylist()],
                                                  pa.binary()))


def materialise(docs: DataFrame, path: str | None = None, tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken",
                length: int = 2048, per_shard: int = 4096, key: int = 17) -> DataFrame:
    """Write the shards below ``path`` (a new folder beside the checkpoints if not given) and return a row for each
    sequence: ``slot, shard, byte_offset, n_tokens, doc_ids, sha256``.

    Shard s is the only file in ``path/shards/shard=s`` and holds slots ``s * per_shard`` onwards: records of
    ``length`` little-endian 16-bit ids and one newline byte, so record r starts at ``r * (2 * length + 1)``. Every
    document is followed by the end mark; null and empty texts give nothing; the last sequence of each input split is
    filled up with end marks. Repeated rows are written as often; rows without an id are written, with a null in
    ``doc_ids``; an empty table gives no shard; further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or fresh_folder(spark, "token-shards")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "part long, number long, ids binary, n_tokens long, doc_ids array<long>"
    texts.mapInArrow(_pack(tokenizer, length), schema).write.option("compression", "zstd").parquet(f"{path}/sequences")
    packed = spark.read.schema(schema).parquet(f"{path}/sequences")
    parts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each input split
    totals = running_totals(parts, ["part"], ["n"]).select("part", (F.col("upto_n") - F.col("n")).alias("before"), "n")
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("parts")).first()
    n = max(1, size["all"])

    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, key))
    totals = totals.select("part", "before")
    if size["parts"] <= BROADCAST_PARTS:
        totals = F.broadcast(totals)
    numbered = packed.join(totals, "part").withColumn("place", F.col("before") + F.col("number"))
    rows = "shard long, slot long, ids binary"
    (numbered.select("place", "ids").mapInArrow(_place(n, key, per_shard), rows).repartitionByRange("shard")
     .mapInArrow(_unzip, rows).sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value"))  # bytes as they are; the line end closes a record
     .write.partitionBy("shard").text(f"{path}/shards"))
    placed = numbered.withColumn("slot", slot("place")).withColumn("shard", F.expr(f"slot div {per_shard}"))
    stride = WIDTH * length + 1
    return placed.select("slot", "shard", (F.col("slot") % per_shard * stride).alias("byte_offset"), "n_tokens",
                         "doc_ids", F.sha2("ids", 256).alias("sha256"))


def read_slots(spark: SparkSession, path: str, start: int, stop: int, length: int = 2048,
               per_shard: int = 4096) -> DataFrame:
    """``(slot, ids)`` of the slots from ``start`` up to ``stop``: reads only their shards' files."""
    stride = WIDTH * length + 1
    folders = [f"{path}/shards/shard={s}" for s in range(start // per_shard, -(-stop // per_shard))]
    files = spark.read.format("binaryFile").load(folders).select(
        F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")
    records = files.select("shard", F.explode(F.sequence(F.lit(0), F.expr(f"length(content) div {stride}") - 1))
                           .alias("r"), "content")
    found = records.select((F.col("shard") * per_shard + F.col("r")).alias("slot"),
                           F.substring("content", F.col("r") * stride + 1, F.lit(stride - 1)).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["slot", "ids"])
    return (found.where((F.col("slot") >= start) & (F.col("slot") < stop))
            .mapInArrow(run, "slot long, ids array<int>"))
