"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text recognises all its substrings. A text is parsed from left to right
into the longest phrases the automaton knows; a language whose text resembles it needs few of them. The phrases are
normalised by the size of the labelled text (a longer text knows longer phrases), and the fewest win.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import fold

#: Characters of labelled text in all automata together, and from one document: the bounds of the training sample.
TRAINING_CHARS = 160_000
PIECE_CHARS = 1_000
#: Symbols: letters by frequency from 1, 0 for runs of anything else, then letters not in training, then padding.
_LETTERS, _OTHER, _PAD, _SIZE = 61, 62, 63, 64
_PIECE, _ROWS = 512, 4096  # texts are parsed in pieces of so many characters, so many at a time


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, anything but letters as 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not _IS_LETTER:
        import unicodedata
        _IS_LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x30000)), bool, 0x30000))
    known = _IS_LETTER[0]
    return np.where(known[np.minimum(codes, 0x2FFFF)] & (codes < 0x30000), codes, 0)


_IS_LETTER: list[np.ndarray] = []


def suffix_automaton(symbols: list[int]) -> np.ndarray:
    """Transitions of the automaton of all substrings: a row a state, a column a symbol, -1 for none; row 0 is the
    start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(follow), _SIZE), -1, np.int32)
    for state, steps in enumerate(follow):
        for c, to in steps.items():
            table[state, c] = to
    return table


def parser(table: np.ndarray) -> np.ndarray:
    """The automaton as a parser: each entry is the next state's row offset times two, plus one if a phrase ended before
    this symbol, which then starts the next phrase. Padding leads back to the start and ends nothing."""
    missing = table < 0
    root = np.maximum(table[0], 0)
    steps = np.where(missing, root[None, :], table) * _SIZE * 2 + missing
    steps[:, _PAD] = 0
    return steps.astype(np.int32).reshape(-1)


class Model:
    """Languages, their parsers, the sizes of their texts, and the symbols of letters."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        coded = {k: letters_of(texts[k]) for k in self.languages}
        often = Counter(c for x in coded.values() for c in x.tolist() if c)
        self.symbols = np.full(0x30000, _OTHER, np.uint8)
        self.symbols[0] = 0
        for i, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:_LETTERS]):
            self.symbols[c] = i + 1
        runs = {k: self.symbols_of(coded[k]) for k in self.languages}
        self.sizes = np.array([np.log2(len(runs[k]) + 2.0) for k in self.languages])
        self.parsers = [parser(suffix_automaton(runs[k].tolist())) for k in self.languages]

    def symbols_of(self, letters: np.ndarray) -> np.ndarray:
        """Symbols with each run of non-letters as one."""
        got = self.symbols[letters]
        if not len(got):
            return got
        return got[np.concatenate(([True], (got[1:] != 0) | (got[:-1] != 0)))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols) in each language. Texts are parsed in pieces of ``_PIECE`` symbols, each of
        which begins a phrase; no symbol is left out."""
        counts = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(x) for x in texts])
        pieces = -(-sizes // _PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        for at in range(0, len(owner), _ROWS):
            mine = owner[at:at + _ROWS]
            grid = np.full((len(mine), _PIECE), _PAD, np.uint8)
            first = np.searchsorted(owner, mine)  # number of the text's first piece
            for row, (text, k) in enumerate(zip(mine.tolist(), (np.arange(at, at + len(mine)) - first).tolist(),
                                                strict=True)):
                part = texts[text][k * _PIECE:(k + 1) * _PIECE]
                grid[row, :len(part)] = part
            lengths = (grid != _PAD).sum(axis=1)
            order = np.argsort(-lengths, kind="stable")
            columns = np.ascontiguousarray(grid[order].T).astype(np.int32)
            live = np.searchsorted(-lengths[order], -np.arange(_PIECE), "left")  # rows longer than each position
            for language, steps in enumerate(self.parsers):
                state, ended = np.zeros(len(mine), np.int32), np.ones(len(mine), np.int32)
                for j in range(int(lengths.max(initial=0))):
                    n = live[j]
                    got = steps[state[:n] + columns[j, :n]]
                    ended[:n] += got & 1
                    state[:n] = got >> 1
                np.add.at(counts[:, language], mine[order], ended)
        return counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols = [self.symbols_of(letters_of(x)) for x in texts]
        cost = self.phrases(symbols) * self.sizes / np.maximum([len(x) for x in symbols], 1)[:, None]
        order = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = cost[rows, order[:, 0]]
        second = cost[rows, order[:, 1]] if len(self.languages) > 1 else best
        score = np.where(best + second > 0, second / np.where(best + second > 0, best + second, 1), 0.5)
        return [self.languages[i] for i in order[:, 0]], score


def train(docs: DataFrame, chars: int = TRAINING_CHARS, piece: int = PIECE_CHARS, seed: int = 5) -> Model | None:
    """A model from rows with ``text`` and ``lang``, on a bounded sample: ``chars`` characters in all, shared evenly by
    the languages, in pieces of ``piece`` characters of documents in the order of a hash of their id. The documents
    that may be needed are told by per-language totals over all rows. Without labelled text there is no model."""
    sized = docs.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select(
        "lang", "doc_id", F.least(F.length("text"), F.lit(piece)).alias("n"))
    totals = sized.groupBy("lang").agg(F.sum("n").alias("all")).withColumn(
        "share", F.lit(3.0 * chars) / F.count(F.lit(1)).over(_everything()) / F.col("all"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    known = docs.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    picked = (known.select("lang", "doc_id", F.substring("text", 1, piece).alias("text"), drawn.alias("draw"))
              .join(F.broadcast(totals), "lang").where("draw < share")  # a row a language
              .orderBy("draw", "doc_id").select("lang", "text").limit(8 * max(1, chars // piece) + 1000).collect())
    texts: dict[str, list[str]] = {}
    for row in picked:
        texts.setdefault(row["lang"], []).append(row["text"])
    if not texts:
        return None
    return Model({k: " ".join(v)[:max(piece, chars // len(texts))] for k, v in texts.items()})


def _everything():
    from pyspark.sql import Window
    return Window.partitionBy()


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.__new__(Model)  # plain values are broadcast: executors needn't have this package
        vars(known).update(model.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # about two million characters at a time
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 2_000_000, "right")))
                found, score = known.predict(texts.slice(at, stop - at).to_pylist())
                rows = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(found, pa.string()),
                                                  pa.array(score)], ["doc_id", "letters", "lang_pred", "score"])
                at = stop
    return run


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language whose crc32 fold isn't ``held``, on a bounded sample (``train``). ``lang_pred`` is
    the language that needs the fewest normalised phrases for the whole text, the first by name on ties, and ``und`` if
    the text is null or has no letter, or nothing could be learned. ``score`` is the runner-up's share of both costs:
    0.5 for a tie, towards 1 the clearer the winner; 0 for ``und``. Repeated rows give repeated rows, an empty table
    none; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held_out = (fold("doc_id", folds) == held).alias("held_out")
    model = train(rows.where(fold("doc_id", folds) != held))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    if model is None:
        return rows.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", letters).mapInArrow(
        _predict(spark.sparkContext.broadcast(vars(model))), f"doc_id {kind}, letters boolean, lang_pred string, score double")
    return got.select("doc_id", held_out, F.when(F.col("letters"), F.col("lang_pred")).otherwise("und")
                      .alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
