"""Pairs of strings within an edit distance, for strings so alike that no key of theirs is rare.

A string with d characters (counted with repetition) that another lacks is at least d edits away from it. Strings of one
host, one form or one naming scheme share their segments and q-grams, but still differ in this count, so the right
strings of one length are put into a tree by the characters they have: each node splits its strings by the character
count that halves them best, and knows which counts all of them and which any of them reach. Left strings descend with
their own radius and leave a node where the bound exceeds it; at a leaf the bound is taken string by string. What is
left is verified, so the result is exact, whatever the strings are.

The strings are dealt out in tiles of bounded size by length of the right one. Each pair of tiles is one group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

_LEAF = 32  # strings of a leaf
_BITS = 192  # bits of a string's character counts, a multiple of 64 below 256
_STEPS = 16  # counts of one character that are told apart
_CLASSES = 256  # characters told apart: ASCII, and 128 classes of others
_RIGHT_ROWS, _LEFT_ROWS = 1 << 16, 1 << 14  # strings of a tile; the larger a tree, the more it spares
_TILE_CHARACTERS = 1 << 22
_CHUNK = 1 << 13  # strings worked on at once
_BAND = 16  # largest radius with distances by NumPy
_EMIT = 1 << 14  # candidates worked on at once


# --- character counts -------------------------------------------------------------------------------------------------

def _characters(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters the number of their string and a class, the same for the same character; of all strings the
    number of characters."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    string = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not len(raw) or raw.max() < 128:
        return string, raw, np.diff(offsets)
    later = (raw & 0xC0) == 0x80  # bytes that go on with a character
    code, more = raw.astype(np.uint32), ~later
    for step in range(1, 4):
        more = more[:-1] & later[step:]
        code[:len(more)][more] = code[:len(more)][more] * np.uint32(257) + raw[step:][more]
    kind = np.where(raw < 128, raw, 128 + (code * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)
    return string[~later], kind[~later], np.bincount(string[~later], minlength=len(texts))


def _counts(texts: pa.LargeStringArray) -> np.ndarray:
    """Per string and class the number of characters, 255 at most."""
    out = np.zeros((len(texts), _CLASSES), np.uint8)
    for start in range(0, len(texts), _CHUNK):
        part = texts.slice(start, _CHUNK)
        string, kind, _ = _characters(part)
        found = np.bincount(string * _CLASSES + kind, minlength=len(part) * _CLASSES).reshape(-1, _CLASSES)
        out[start:start + len(part)] = np.minimum(found, 255)
    return out


def _character_bits(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides, bits of the counts that strings reach, as rows of booleans. Counts that all strings reach have no
    bit; counts that share a bit only make the bound looser."""
    top = np.maximum(left.max(0), right.max(0))
    kept = []
    for c in np.flatnonzero(top):
        for least in np.unique(np.linspace(1, top[c], min(int(top[c]), _STEPS)).astype(int)):
            sides = left[:, c] >= least, right[:, c] >= least
            if not (sides[0].all() and sides[1].all()):
                kept.append(sides)
    width = min(_BITS, max(64, -(-len(kept) // 64) * 64))
    out = np.zeros((len(left), width), bool), np.zeros((len(right), width), bool)
    for i, sides in enumerate(kept):
        for bits, side in zip(out, sides):
            bits[:, i % width] |= side
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits, one row per word."""
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


def _lacking(x: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Number of bits of ``x`` among the ``absent`` ones."""
    total = np.bitwise_count(x[0] & absent[0])
    for w in range(1, len(x)):
        total += np.bitwise_count(x[w] & absent[w])  # at most _BITS
    return total


# --- the tree ---------------------------------------------------------------------------------------------------------

def _tree(bits: np.ndarray, words: np.ndarray) -> list[tuple]:
    """Nodes ``(bits that none of its strings has, bits that all have, children, strings)``; leaves have no children.

    A bit splits a branch once, so no branch is deeper than there are bits; strings equal in all bits share a leaf."""
    nodes: list = [None]
    stack = [(0, np.arange(len(bits)))]
    while stack:
        place, rows = stack.pop()
        some, every = np.bitwise_or.reduce(words[:, rows], 1), np.bitwise_and.reduce(words[:, rows], 1)
        children = None
        if len(rows) > _LEAF and (some != every).any():
            have = bits[rows]
            n = have.sum(0, dtype=np.int64)
            split = have[:, np.abs(2 * n - len(rows)).argmin()]
            children = len(nodes), len(nodes) + 1
            nodes += [None, None]
            stack += [(children[0], rows[split]), (children[1], rows[~split])]
        nodes[place] = (~some, every, children, None if children else rows)
    return nodes


def _descend(nodes: list[tuple], right: np.ndarray, left: np.ndarray, k: np.ndarray) -> Iterator[tuple]:
    """Rows ``(of the left, of the right)`` that the bound doesn't rule out, in parts."""
    k = np.minimum(k, 255).astype(np.uint8)
    for start in range(0, len(k), _CHUNK):
        stack = [(0, np.arange(start, min(start + _CHUNK, len(k))))]
        while stack:
            place, rows = stack.pop()
            none, every, children, strings = nodes[place]
            x = left[:, rows]
            rows = rows[(_lacking(x, none) <= k[rows]) & (_lacking(~x, every) <= k[rows])]
            if not len(rows):
                continue
            if children:
                stack += [(child, rows) for child in children]
                continue
            x, most = left[:, rows, None], k[rows, None]
            for part in range(0, len(strings), _LEAF):  # more than one for strings equal in all bits
                some = strings[part:part + _LEAF]
                y = right[:, None, some]
                i, j = np.nonzero((_lacking(x, ~y) <= most) & (_lacking(~x, y) <= most))
                if len(i):
                    yield rows[i], some[j]


# --- candidates -------------------------------------------------------------------------------------------------------

def _codes(texts: pa.LargeStringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters as rows of ``width`` at least, filled up with zeros, and the number of characters."""
    string, kind, sizes = _characters(texts)
    out = np.zeros((len(texts), max(width, sizes.max())), np.uint8)
    out[string, np.arange(len(kind)) - (np.cumsum(sizes) - sizes)[string]] = kind
    return out, sizes


def _within(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, size: int, k: np.ndarray) -> np.ndarray:
    """Whether rows of classes are at most k edits apart: the usual table, a diagonal band of it for all rows at once.

    All of ``b`` have ``size`` characters, and those of ``a`` at most k more or fewer."""
    most, n = int(k.max()), len(a)
    far = np.uint8(most + 1)
    a = np.concatenate([np.zeros((most, n), np.uint8), a.T[:size + most]])  # a[most + j] is character j of all rows
    b = np.ascontiguousarray(b.T)
    # band[d] is the distance of the first i characters of b and the first i + d - most of a
    band = np.repeat(np.arange(-most, most + 1).clip(0, far).astype(np.uint8)[:, None], n, axis=1)
    band[:most] = far
    for i in range(size):
        new = band + (a[i:i + 2 * most + 1] != b[i])
        np.minimum(new[:-1], band[1:] + np.uint8(1), out=new[:-1])
        if i < most:
            new[:most - i - 1] = far
            new[most - i - 1] = i + 1
        for d in range(1, 2 * most + 1):
            np.minimum(new[d], new[d - 1] + np.uint8(1), out=new[d])
        band = np.minimum(new, far)
    return band[a_size - size + most, np.arange(n)] <= k


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates ``(a, b, k)`` among the strings of a group; those with a radius are the left ones."""
    table = pa.Table.from_batches(list(batches)).select(["size", "text", "k"])
    sides = [table.filter(table["k"].is_valid()), table.filter(table["k"].is_null())]
    if not all(side.num_rows for side in sides):
        return
    a, b = (pa.concat_arrays([c.cast(pa.large_string()) for c in side["text"].chunks]) for side in sides)
    k, size = sides[0]["k"].to_numpy().astype(np.int32), table["size"][0].as_py()
    most = int(k.max())
    left_bits, right_bits = _character_bits(_counts(a), _counts(b))
    right = _packed(right_bits)
    codes = None
    if most <= _BAND:
        codes = *_codes(a, size + most), *_codes(b, size)

    def batches_of(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        every_i, every_j = map(np.concatenate, zip(*found))
        for start in range(0, len(every_i), rows):
            i, j = every_i[start:start + rows], every_j[start:start + rows]
            if codes:
                a_codes, a_sizes, b_codes, b_sizes = codes
                usual = (b_sizes[j] == size) & (np.abs(a_sizes[i] - size) <= k[i])  # always so in sound UTF-8
                near = ~usual
                if usual.any():
                    u, v = i[usual], j[usual]
                    near[usual] = _within(a_codes[u], a_sizes[u], b_codes[v, :size], size, k[u])
                i, j = i[near], j[near]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(i)).cast(pa.string()),
                                              b.take(pa.array(j)).cast(pa.string()), pa.array(k[i])], names=["a", "b", "k"])

    rows = _rows(size, _EMIT)
    found, held = [], 0
    for pair in _descend(_tree(right_bits, right), right, _packed(left_bits), k):
        found.append(pair)
        held += len(pair[0])
        if held >= rows:
            yield from batches_of(found)
            found, held = [], 0
    if found:
        yield from batches_of(found)


# --- the join ---------------------------------------------------------------------------------------------------------

def _rows(size: int, most: int) -> int:
    """How many strings of a length to take at once."""
    return max(1, min(most, _TILE_CHARACTERS // max(size, 1)))


def _groups(left: DataFrame, right: DataFrame) -> list[tuple[int, int, int]]:
    """``(length of the right strings, tiles of the left, tiles of the right)`` where there are strings on both sides."""
    lefts = left.groupBy(F.length("a").alias("n"), "k").count().collect()  # a row per length and radius
    rights = sorted(right.groupBy(F.length("b").alias("n")).count().collect())
    if not lefts or not rights:
        return []
    n, k, count = np.array(lefts, np.int64).T
    near = np.zeros(rights[-1][0] + 2, np.int64)  # left strings that reach a length, as differences to the one before
    np.add.at(near, np.clip(n - k, 0, len(near) - 1), count)
    np.add.at(near, np.clip(n + k + 1, 0, len(near) - 1), -count)
    near = near.cumsum().tolist()
    return [(n, -(-near[n] // _rows(n, _LEFT_ROWS)), -(-count // _rows(n, _RIGHT_ROWS))) for n, count in rights if near[n]]


def tree_pairs(left: DataFrame, right: DataFrame, largest_radius: int, tasks: int) -> DataFrame:
    """All ``(a, b, distance)`` with distance <= k, of the distinct strings and radii ``(a, k)`` and the distinct strings
    ``b``; equal strings included. No radius exceeds ``largest_radius``."""
    spark = left.sparkSession
    groups = _groups(left, right)
    tiles = F.broadcast(spark.createDataFrame(groups, "size int, lefts int, rights int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda text, n: F.pmod(F.xxhash64(text), n).cast("int")
    sizes = F.explode(F.sequence(F.length("a") - F.col("k"), F.length("a") + F.col("k"))).alias("size")
    lhs = (left.select(F.col("a").alias("text"), "k", sizes).join(tiles, "size")
           .withColumn("l", dealt("text", F.col("lefts"))).withColumn("r", each(F.col("rights"))))
    rhs = (right.select(F.col("b").alias("text"), F.lit(None).cast("int").alias("k"), F.length("b").alias("size"))
           .join(tiles, "size").withColumn("r", dealt("text", F.col("rights"))).withColumn("l", each(F.col("lefts"))))
    columns = ["size", "l", "r", "text", "k"]
    parts = max(1, min(16 * tasks, sum(n * m for _, n, m in groups)))
    found = (lhs.select(columns).unionByName(rhs.select(columns)).repartition(parts, "size", "l", "r")
             .groupBy("size", "l", "r").applyInArrow(_candidates, "a string, b string, k int"))
    distance = F.levenshtein("a", "b", largest_radius)  # -1 beyond the largest, which the mask makes large
    return found.where(distance.bitwiseAND(F.lit(0x7FFFFFFF)) <= F.col("k")).select("a", "b", distance.alias("distance"))
