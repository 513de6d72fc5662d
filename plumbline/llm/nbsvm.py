"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear support vector machine.

Features are hashed: words, pairs of words, runs of three bytes, and classes of length and repetition. Ratios come from
counts over all labelled training documents; the hinge loss is minimised by dual coordinate descent on a bounded
sample, and a logistic curve fitted on left-out thirds of it turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import fold, stored
from plumbline.llm.words import buffer_of, mix, small, windows_of, words_of

#: Hashed features; counters and weights have this size whatever the corpus.
SIZE = 1 << 17
#: The bound of the sample that the support vector machine is fitted on, in documents.
SAMPLE = 6_000
_CHUNK = 4096
_EPOCHS = 12


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct features of each whole text; an empty text has those of length and repetition alone."""
    data, byte_at = buffer_of(texts)
    words, at = words_of(texts)
    pairs, runs = windows_of(words, 2), windows_of(words, 8)
    b = byte_at.tolist()
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        raw = data[b[i]:b[i + 1]].astype(np.uint64)
        threes = np.unique(raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) if len(raw) > 2 else raw[:0]
        window = runs[lo:max(lo, hi - 7)]
        repeated = 1 - len(np.unique(window)) / len(window) if len(window) else 0.0
        extra = np.array([1 << 40 | int(np.log2(hi - lo + 1) * 2), 2 << 40 | int(repeated * 10)], np.uint64)
        found = np.concatenate((words[lo:hi], pairs[lo:max(lo, hi - 1)] + np.uint64(1), mix(threes + np.uint64(3 << 40)),
                                mix(extra)))
        yield np.unique((found >> np.uint64(20)).astype(np.int64) & (SIZE - 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class with each feature, by chunks of features, and the features of sampled documents."""
    counts = np.zeros((2, SIZE), np.int64)
    names = ["kind", "y", "chunk", "ids"]
    for batch in small(batches, 0):
        ys, picked, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
        for y, pick, found in zip(ys, picked, features(batch.column(0)), strict=True):
            counts[y, found] += 1
            if pick:
                ids.append((y, found.astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([
            pa.array(["row"] * len(ids), pa.string()), pa.array([y for y, _ in ids], pa.int32()),
            pa.nulls(len(ids), pa.int32()), pa.array([x for _, x in ids], pa.binary())], names)
    full = [(y, k) for y in (0, 1) for k in range(SIZE // _CHUNK) if counts[y, k * _CHUNK:(k + 1) * _CHUNK].any()]
    yield pa.RecordBatch.from_arrays([
        pa.array(["count"] * len(full), pa.string()), pa.array([y for y, _ in full], pa.int32()),
        pa.array([k for _, k in full], pa.int32()),
        pa.array([counts[y, k * _CHUNK:(k + 1) * _CHUNK].tobytes() for y, k in full], pa.binary())], names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters, as a stream of fixed memory."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for y, chunk, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            got = np.frombuffer(raw, np.int64)
            sums[y, chunk] = sums[y, chunk] + got if (y, chunk) in sums else got
    yield pa.RecordBatch.from_arrays([
        pa.array([y for y, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int32()),
        pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["y", "chunk", "ids"])


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray,
              epochs: int = _EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights of the L2-regularised linear SVM with squared hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(SIZE), np.zeros(len(rows))
    ridge = 1 / (2 * costs)
    diagonal = np.array([v @ v for v in values]) + ridge
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (w[rows[i]] @ values[i]) - 1 + ridge[i] * alpha[i]
            if alpha[i] > 0 or gradient < 0:
                new = max(alpha[i] - gradient / diagonal[i], 0.0)
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                most, alpha[i] = max(most, abs(gradient)), new
        if most < 0.01:
            break
    return w


def fit_logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + exp(-(a * margin + b)))`` by Newton's method with a small ridge."""
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2),
                               x.T @ (p - y) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def _fit(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows, y = [], []
    for batch in batches:
        y += batch.column(0).to_pylist()
        rows += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    place = sorted(range(len(rows)), key=lambda i: (mix(rows[i].astype(np.uint64)).sum(dtype=np.uint64), len(rows[i])))
    rows, y = [rows[i] for i in place], np.array([y[i] for i in place])  # an order that no shuffle changes
    values = [ratio[x] / max(1e-9, float(np.linalg.norm(ratio[x]))) for x in rows]
    signs, good = np.where(y == 1, 1.0, -1.0), max(1, int(y.sum()))
    costs = np.where(y == 1, 1.0, min(10.0, max(1.0, good / max(1, len(y) - good))))
    thirds, margins = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(thirds != k)
        w = fit_hinge([rows[i] for i in inside], [values[i] for i in inside], signs[inside], costs[inside])
        for i in np.flatnonzero(thirds == k):
            margins[i] = w[rows[i]] @ values[i]
    a, b = fit_logistic(margins, y)
    w = fit_hinge(rows, values, signs, costs)
    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([w.tobytes()], pa.binary())],
                                     ["a", "b", "w"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, squares, a, b = model.value
        for batch in small(batches, 1):
            margins = np.array([scaled[x].sum() / max(1e-9, float(np.sqrt(squares[x].sum())))
                                for x in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30))), pa.float64())],
                ["doc_id", "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE):
    """``(ratio * weight, ratio ** 2, a, b)``, or None unless both classes are labelled. Labels of an id that disagree
    count as 0. The sample is the labelled training ids with the lowest hashes."""
    spark = docs.sparkSession
    known = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold("doc_id", folds) != held)
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
             .withColumn("draw", F.xxhash64(F.lit(7), "doc_id")))
    last = known.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    if last is None:
        return None
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            # by shuffle whatever the number of labels: the same plan at every size
            .join(known.select("doc_id", "y", (F.col("draw") <= last).alias("pick")).hint("merge"), "doc_id")
            .select("text", "y", "pick"))
    counted = stored(rows.mapInArrow(_count, "kind string, y int, chunk int, ids binary"), "class-counts")
    counts = np.zeros((2, SIZE))
    for row in (counted.where("kind = 'count'").select("y", "chunk", "ids").repartition(16, "chunk")
                .mapInArrow(_add_up, "y int, chunk int, ids binary").collect()):  # 64 chunks at most
        counts[row["y"], row["chunk"] * _CHUNK:(row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["ids"], np.int64)
    if not counts.any(axis=1).all():
        return None
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    got = (counted.where("kind = 'row'").select("y", "ids").repartition(1)  # the bounded sample
           .mapInArrow(lambda x: _fit(x, ratio), "a double, b double, w binary").first())
    return ((ratio * np.frombuffer(got["w"], np.float64)).astype(np.float32), (ratio ** 2).astype(np.float32),
            got["a"], got["b"])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``: the estimated probability of
    quality 1 from the whole text, and 1 where it reaches ``threshold``.

    Documents whose crc32 fold is ``held`` are never learned from. Null and empty texts are scored by their length
    alone. If the labels don't hold both classes, all scores are 0.5. Repeated rows give repeated rows, an empty table
    none; further columns are ignored.
    """
    held_out = (fold("doc_id", folds) == held).alias("held_out")
    model = train(docs, labels, folds, held)
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _score(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out, "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
