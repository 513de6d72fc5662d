"""Quality rules learned from labelled statistics: a decision list by sequential covering, in DataFrame operations.

Rules are conjunctions of thresholds that describe rejected documents. A rule is grown by the condition with the best
information gain over what it covers so far, pruned on rows it hasn't been grown on, and kept if it is right often
enough there; what it covers is set aside and the next is learned from the rest. The list becomes one Spark
conditional expression, rule by rule in the order learned.

All counting is Spark aggregation over the labelled statistics, binned once; the driver sees counts by feature and
bin, whose number doesn't depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import fold, stored

_BLANKS = " \t\n\x0b\f\r"
_WINDOW = 8

#: Statistics that rules may test; all are shares or means, so long texts are judged like short ones.
FEATURES = ("symbol_share", "bang_share", "bar_share", "upper_share", "digit_share", "mean_word", "short_share",
            "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "stop_share", "words")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) with the counts of the contract and the features; native throughout.

    Words are runs without ASCII white space; a null text has none. Every count is over the whole text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    df = df.withColumn("w", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    df = df.withColumn("h", hashes)
    # the last word's place of each window: indexes below run over windows
    windows = F.when(F.col("n_words") >= _WINDOW, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - _WINDOW),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(_WINDOW)])))
    df = df.withColumn("win", F.coalesce(windows, F.array().cast("array<bigint>")))
    df = df.withColumn("win_distinct", F.size(F.array_distinct("win")))
    # places of windows that occur twice, in order; each covers up to 8 words until the next begins
    pairs = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.col("win_distinct") < F.size("win"), pairs))
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i + 1)["h"])
                     | ((i > 0) & (x["h"] == F.get("sorted", i - 1)["h"])))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("sorted")
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(
        F.get("at", i + 1) - x, F.lit(_WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    df = df.withColumn("lines", lines).withColumn("n_lines", F.size("lines"))
    df = df.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.withColumn("solid", F.translate("text", _BLANKS, ""))

    def count(characters: str) -> Column:
        return (F.length("solid") - F.length(F.translate("solid", characters, ""))).cast("long")
    df = df.withColumn("word_chars", F.length("solid").cast("long"))
    df = df.withColumn("n_symbols", count("#*$%&|<>"))
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    features = {
        "symbol_share": F.col("n_symbols") / chars, "bang_share": count("!?") / chars, "bar_share": count("|") / chars,
        "upper_share": count("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ") / chars,
        "digit_share": count("0123456789") / chars, "mean_word": F.col("word_chars") / words,
        "short_share": F.size(F.filter("w", lambda w: F.length(w) <= 3)) / words,
        "distinct_share": F.size(F.array_distinct("h")) / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_share": count(".,;:") / words, "words": F.col("n_words").cast("double"),
    }
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select("doc_id", *counts, failed.alias("base_failed"),
                     *[features[f].cast("double").alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold


@dataclass
class DecisionList:
    """Ordered rules; the first that fits rejects, and what none fits is kept."""
    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """Number of the first rule that fits, from 1; null if none does."""
        found = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            found = F.when(_all(self.rules[i - 1]), F.lit(i)).otherwise(found)
        return found

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:.6g}"
                                                     for c in rule) for rule in self.rules)


def _all(rule: Sequence[Condition]) -> Column:
    fits = F.lit(True)
    for condition in rule:
        fits = fits & condition.column()
    return fits


def _at_most(feature: str):
    return lambda cut: cut <= F.col(feature)


def _gain(bad: float, good: float, bad_before: float, good_before: float) -> float:
    """Information gained about rejected rows, weighted by how many of them stay covered."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn(labelled: DataFrame, bins: int = 32, most_rules: int = 8, most_conditions: int = 3,
          precision: float = 0.9, least: int = 5) -> DecisionList:
    """Learn from rows of ``FEATURES`` and ``bad`` (boolean); ``doc_id`` deals them to growing (two thirds) and pruning.

    A rule is kept if, after pruning, at least ``precision`` of what it covers of the pruning rows is bad, with a
    prior of one good row, and it covers ``least`` bad rows in all. No labelled rows give an empty list.
    """
    rows = stored(labelled.select(*[F.when(~F.isnan(f), F.col(f)).alias(f) for f in FEATURES], "bad",
                                  (fold("doc_id", 3) != 0).alias("grow")), "labelled")
    picks = [i / bins for i in range(1, bins)]
    edges = rows.where("bad").agg(*[F.percentile_approx(f, picks, 10_000).alias(f) for f in FEATURES]).first()
    wide = rows.agg(*[F.percentile_approx(f, picks + [0.999], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f] or []) | set(wide[f] or [])) for f in FEATURES}
    bin_of = F.array(*[F.size(F.filter(F.array(*map(F.lit, cuts[f])).cast("array<double>"),
                                       _at_most(f))) if cuts[f] else F.lit(0) for f in FEATURES])
    rows = stored(rows.withColumn("bins", bin_of), "binned")
    found = DecisionList()
    left = F.lit(True)
    for _ in range(most_rules):
        rule = _grow(rows.where(left & F.col("grow")), cuts, most_conditions)
        rule = _prune(rows.where(left & ~F.col("grow")), rule)
        if not rule:
            break
        seen = rows.where(left & _all(rule)).agg(
            F.count_if(F.col("bad")).alias("bad"), F.count_if(F.col("bad") & ~F.col("grow")).alias("held_bad"),
            F.count_if(~F.col("bad") & ~F.col("grow")).alias("held_good")).first()
        if seen["bad"] < least or seen["held_bad"] < precision * (seen["held_bad"] + seen["held_good"] + 1):
            break
        found.rules.append(rule)
        left = left & ~F.coalesce(_all(rule), F.lit(False))
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        counts = (rows.where(_all(rule)).select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin")
                  .agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect())
        sums = {i: [[0, 0] for _ in range(len(cuts[f]) + 1)] for i, f in enumerate(FEATURES)}
        for row in counts:  # one row a feature and bin
            sums[row["f"]][row["bin"]] = [row["bad"], row["good"]]
        bad, good = (sum(n[k] for n in sums[0]) for k in (0, 1))
        best, gained = None, 0.0
        if not bad or not good:
            break
        for i, f in enumerate(FEATURES):
            b, g = bad, good
            for cut, (less_bad, less_good) in zip(cuts[f], sums[i], strict=False):
                b, g = b - less_bad, g - less_good  # at or above the cut
                for above, x, y in ((True, b, g), (False, bad - b, good - g)):
                    gain = _gain(x, y, bad, good)
                    if gain > gained + 1e-9:
                        best, gained = Condition(f, above, cut), gain
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix of the rule with the best margin of bad over good rows that it wasn't grown on."""
    if not rule:
        return rule
    counts = rows.agg(*[F.count_if(F.col("bad") & _all(rule[:k])).alias(f"bad{k}") for k in range(1, len(rule) + 1)],
                      *[F.count_if(~F.col("bad") & _all(rule[:k])).alias(f"good{k}")
                        for k in range(1, len(rule) + 1)]).first()

    def worth(k: int) -> float:
        bad, good = counts[f"bad{k}"], counts[f"good{k}"]
        return (bad - good) / (bad + good) if bad + good else -1.0
    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def labelled_statistics(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the documents that ``labels(doc_id, quality)`` covers, ``bad`` where quality is 0."""
    bad = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return statistics.join(bad, "doc_id")


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept)`` for every row
    of ``docs(doc_id, text)``, and the list.

    ``kept`` is false for ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated windows of 8) and for
    rows that a learned rule fits. A null or empty text has no words and fails. Without labels the list is empty.
    Repeated rows give repeated rows, an empty table none; further columns are ignored.
    """
    statistics = stored(with_statistics(docs), "statistics")
    rules = learn(labelled_statistics(statistics.where("NOT base_failed"), labels))
    judged = statistics.withColumn("rule", rules.rule()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
    return judged, rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. Texts are read once: their statistics are written beside
    them, the rules are learned from the statistics' columns alone, and then the kept rows are read back."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    written = stored(with_statistics(packed).withColumnRenamed("doc_id", "row"), "statistics")
    seen = written.where("NOT base_failed").select(F.col("row.doc_id").alias("doc_id"), *FEATURES)
    rules = learn(seen.join(known, "doc_id"))
    good = written.where(~F.col("base_failed") & rules.rule().isNull())
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])
