"""All pairs of strings within an edit distance, without comparing every string with every other.

Close strings share keys, and the keys are what is joined on. Three kinds of key are used, each complete by itself:

* for most strings: one of k + 1 segments, which k edits can't all change (Li, Deng, Wang, Feng: Pass-Join, PVLDB 5(3),
  2011);
* for very short strings, and for those sharing a segment with too many others (a common prefix, say): the texts left
  after deleting at most k characters, which only close strings share;
* for crowded strings too long for that, and for wide radii, where segments get too many: their q k + 1 rarest q-grams,
  which k edits can't all change either, so that the common text plays no part.

Every candidate is verified, so the result is exact. Before its distance is computed, a candidate must pass a bound on
bit sets of its characters: strings with d characters that the other lacks are at least d edits apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.workspace import checkpoint

_FEW_VARIANTS = 128  # strings with at most this many deletion variants join on them at once
_DELETION_K = 7  # largest radius with deletion variants
_SEGMENT_K = 8  # largest radius with segments
_MANY_VARIANTS = 1500  # and crowded strings up to this many
_BUCKETS = 1 << 16  # rows of the table of q-gram frequencies


def _short_limit(k: int, variants: int) -> int:
    """Longest string with at most so many deletion variants; at least k, where segments would be empty."""
    length = k
    while k <= _DELETION_K and length < 256 and sum(comb(length + 1, i) for i in range(k + 1)) <= variants:
        length += 1
    return length


def _limits(k: Column, largest: int, variants: int) -> Column:
    """The short limit for a radius column."""
    table = F.array(*[F.lit(_short_limit(i, variants)) for i in range(min(largest, _DELETION_K) + 1)])
    return F.when(k <= _DELETION_K, F.element_at(table, F.least(k, F.lit(_DELETION_K)) + 1)).otherwise(k)


# --- character sets ---------------------------------------------------------------------------------------------------

_WORDS = 4  # longs of a character set


def with_characters(strings: DataFrame, text: str) -> DataFrame:
    """Add ``<text>_set``, unless it is there: bits of the pairs (character, its first, second, ... occurrence), hashed.
    Pairs that share a bit only make the bound looser."""
    name = f"{text}_set"
    if name in strings.columns:
        return strings
    whole = F.col(text)
    each = lambda c: F.transform(
        F.sequence(F.lit(1), F.length(whole) - F.length(F.replace(whole, c, F.lit("")))),
        lambda i: F.pmod(F.xxhash64(c, i), F.lit(64 * _WORDS)).cast("int"))
    places = F.flatten(F.transform(F.array_distinct(F.filter(F.split(whole, ""), lambda c: c != F.lit(""))), each))
    word = lambda w: F.aggregate(
        F.filter("_places", lambda x: F.shiftright(x, 6) == w), F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)))))
    return (strings.withColumn("_places", places)
            .withColumn(name, F.struct(*[word(w).alias(f"w{w}") for w in range(_WORDS)])).drop("_places"))


def _may_be_close() -> Column:
    """False only for strings more than k edits apart."""
    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}_set.w{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}_set.w{w}"))))
                    for w in range(_WORDS)), F.lit(0))
    return (lacking("a", "b") <= F.col("k")) & (lacking("b", "a") <= F.col("k"))


# --- deletion variants ------------------------------------------------------------------------------------------------

def _deletions(text: Column, k: Column, largest: int) -> Column:
    """Hashes of the distinct texts made by deleting at most k characters.

    For a radius beyond _DELETION_K one key for all: strings no longer than that are all close to each other.
    """
    none = F.array().cast("array<string>")
    level = found = F.array(text)
    for i in range(1, min(largest, _DELETION_K) + 1):
        shorter = F.flatten(F.transform(level, lambda s: F.when(F.length(s) == 0, none).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda p: F.concat(F.substring(s, F.lit(1), p - 1), F.substring(s, p + 1, F.length(s)))))))
        level = F.when((k >= i) & (k <= _DELETION_K), F.array_distinct(shorter)).otherwise(none)
        found = F.concat(found, level)
    every = F.transform(F.array_distinct(found), lambda s: F.xxhash64(s, k))
    return every if largest <= _DELETION_K else F.when(k <= _DELETION_K, every).otherwise(F.array(F.xxhash64(k)))


# --- segments ---------------------------------------------------------------------------------------------------------

def _segment_start(j: Column, length: Column, k: Column) -> Column:
    """0-based start of segment j of k + 1; the last segments are the longer ones."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    return (j * base + F.greatest(F.lit(0), j - (k + 1 - longer))).cast("int")


def _left_segments(left: DataFrame) -> DataFrame:
    cut = left.withColumn("size", F.length("a")).select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j"))
    start = _segment_start(F.col("j"), F.col("size"), F.col("k"))
    width = _segment_start(F.col("j") + 1, F.col("size"), F.col("k")) - start
    return cut.select("a", "a_set", "k", F.xxhash64("size", "k", "j", F.substring("a", start + 1, width)).alias("key"))


def _right_segments(right: DataFrame) -> DataFrame:
    """Substrings of ``b`` at the places where a segment of a partner of each possible length could lie."""
    cut = (right.select("b", "b_set", F.explode("partners").alias("x")).select("b", "b_set", "x.size", "x.k")
           .select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("j")))
    k, j = F.col("k"), F.col("j")
    start = _segment_start(j, F.col("size"), k)
    width = _segment_start(j + 1, F.col("size"), k) - start
    longer_by = F.length("b") - F.col("size")
    # with at most j edits before the match and k - j after it, it can only be shifted this far
    first = F.greatest(start + F.greatest(-j, longer_by - (k - j)), F.lit(0))
    last = F.least(start + F.least(j, longer_by + (k - j)), F.length("b") - width)
    placed = cut.withColumns({"width": width, "first": first, "last": last}).where("first <= last")
    at = placed.withColumn("at", F.explode(F.sequence("first", "last")))
    return at.select("b", "b_set",
                     F.xxhash64("size", "k", "j", F.substring("b", F.col("at") + 1, F.col("width"))).alias("key"))


# --- rarest q-grams ---------------------------------------------------------------------------------------------------

def _gram_size(size: Column, k: Column) -> Column:
    """Longest q of 4 at most, for which a string of this size has more q-grams than k edits can touch."""
    return F.coalesce(*[F.when(size - q + 1 > k * q, F.lit(q)) for q in (4, 3, 2)], F.lit(1))


def _grams(text: Column, q: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_BUCKETS)).cast("int")


def _rare_grams(strings: DataFrame, text: str, frequencies: DataFrame) -> DataFrame:
    """Keys of the q k + 1 rarest q-grams of each string; a repeated q-gram counts once per occurrence."""
    bits = f"{text}_set"
    grams = strings.select(text, bits, "k", "q", F.explode(_grams(F.col(text), F.col("q"))).alias("gram"))
    ranked = grams.withColumn("bucket", _bucket(F.col("gram"))).join(F.broadcast(frequencies), "bucket")  # _BUCKETS rows
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), F.lit(1), F.col("q") * F.col("k") + 1)
    per_string = ranked.groupBy(text, bits, "k", "q").agg(rarest.alias("rarest"))  # as many as the string has characters
    keys = F.transform("rarest", lambda x, i: F.xxhash64(x["gram"], i - F.array_position("rarest", x), "q", "k"))
    return per_string.select(text, bits, "k", F.explode(keys).alias("key"))


def _gram_frequencies(*sides: tuple[DataFrame, str]) -> DataFrame:
    """Frequencies of hashed q-grams. Any common order of q-grams serves, rare first serves best."""
    grams = [df.select(F.explode(_grams(F.col(text), F.col("q"))).alias("gram")) for df, text in sides]
    return checkpoint(grams[0].unionByName(grams[1]).groupBy(_bucket(F.col("gram")).alias("bucket"))
                      .agg(F.count(F.lit(1)).alias("n")))


# --- the join ---------------------------------------------------------------------------------------------------------

def _close_pairs(left: DataFrame, right: DataFrame, largest: int, on: Sequence[str] = ("key",),
                 small: bool = False) -> DataFrame:
    """Verified pairs of equal keys. ``small`` says that the left side holds at most ``crowd`` strings."""
    near = (F.abs(F.length("a") - F.length("b")) <= F.col("k")) & _may_be_close()
    lhs = left.select("a", "a_set", "k", *on)
    distance = F.levenshtein("a", "b", largest)  # -1 beyond the largest, which the mask makes large; evaluated once
    return ((F.broadcast(lhs) if small else lhs).join(right.select("b", "b_set", *on), list(on)).where(near)
            .where(distance.bitwiseAND(F.lit(0x7FFFFFFF)) <= F.col("k")).select("a", "b", distance.alias("distance")))


_TASK = 1_000_000  # comparisons of one key in one task


def _spread(left: DataFrame, right: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` that splits the work of busy keys: the larger side is dealt out, the smaller one repeated."""
    work = F.col("n_left") * F.col("n_right")
    busy = sizes.where(work > _TASK).select("key", F.ceil(work / _TASK).cast("int").alias("parts"),
                                            (F.col("n_left") > F.col("n_right")).alias("left_is_larger"))
    out = []
    for side, text, larger in ((left, "a", F.col("left_is_larger")), (right, "b", ~F.col("left_is_larger"))):
        dealt = F.array(F.pmod(F.xxhash64(text), F.col("parts")).cast("int"))
        salts = (F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(larger, dealt)
                 .otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        out.append(side.join(busy, "key", "left").select(*side.columns, F.explode(salts).alias("salt")))
    return out[0], out[1]


#: Busy keys (over _TASK comparisons) up to this many are broadcast to the sides: each has more than 1000 strings on
#: one side, so there are fewer than a thousandth of all key rows of them.
_BUSY_BROADCAST = 1_000_000


def _salted_pairs(lhs: DataFrame, rhs: DataFrame, largest: int, small: bool) -> DataFrame:
    """Verified pairs of equal keys, with busy keys split over salts as for segments."""
    if small:
        return _close_pairs(lhs, rhs, largest, small=True)
    sizes = (lhs.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
             .join(rhs.groupBy("key").agg(F.count(F.lit(1)).alias("n_right")), "key"))
    sizes = checkpoint(sizes.where(F.col("n_left") * F.col("n_right") > _TASK))
    if sizes.isEmpty():
        return _close_pairs(lhs, rhs, largest)
    if sizes.count() <= _BUSY_BROADCAST:
        sizes = F.broadcast(sizes)
    return _close_pairs(*_spread(lhs, rhs, sizes), largest, ("key", "salt"))


def _by_deletions(left: DataFrame, right: DataFrame, largest: int, small: bool) -> DataFrame:
    """Close pairs of ``(a, k)`` and ``(b, ks)``, where ``ks`` lists the radii of possible partners."""
    k = F.col("k")
    lhs = left.select("a", "a_set", "k", F.explode(_deletions(F.col("a"), k, largest)).alias("key"))
    rhs = right.select("b", "b_set", F.explode("ks").alias("k")).select(
        "b", "b_set", F.explode(_deletions(F.col("b"), k, largest)).alias("key"))
    return _salted_pairs(lhs, rhs, largest, small)


def _radii(partners: str, keep: Callable[[Column], Column]) -> Column:
    return F.array_distinct(F.transform(F.filter(partners, keep), lambda x: x["k"]))


def _by_grams(left: DataFrame, right: DataFrame, largest: int, small: bool) -> DataFrame:
    """Close pairs of ``(a, k)`` and ``(b, partners)`` by rare q-grams."""
    k = F.col("k")
    lhs = left.withColumn("q", _gram_size(F.length("a"), k))
    kinds = F.array_distinct(F.transform("partners", lambda x: F.struct(
        x["k"].alias("k"), _gram_size(x["size"], x["k"]).alias("q"))))
    rhs = (right.select("b", "b_set", F.explode(kinds).alias("x")).select("b", "b_set", "x.k", "x.q")
           .where(F.length("b") >= F.col("q")))
    frequencies = _gram_frequencies((lhs, "a"), (rhs, "b"))
    return _salted_pairs(_rare_grams(lhs, "a", frequencies), _rare_grams(rhs, "b", frequencies), largest, small)


def edit_pairs(left: DataFrame, right: DataFrame, radius: Callable[[Column], Column], largest_radius: int,
               crowd: int = 1000, left_rows: int | None = None) -> DataFrame:
    """All ``(a, b, distance)`` with distance <= radius(length of a); equal strings included.

    ``left`` has the distinct strings ``a``, ``right`` the distinct strings ``b``. ``radius`` maps a length to an
    integer and doesn't exceed ``largest_radius``. A segment is joined on while that costs at most ``crowd`` comparisons
    per string holding it; beyond, its strings join on the finer keys instead. ``left_rows`` is the number of left strings,
    if known: up to ``crowd`` of them can't make a crowd, and their keys are few enough to be broadcast.
    """
    largest = int(largest_radius)
    small = left_rows is not None and left_rows <= crowd
    k, size = F.col("k"), F.length("a")
    few = lambda x: x["size"] <= _limits(x["k"], largest, _FEW_VARIANTS)
    many = lambda x: x["size"] <= _limits(x["k"], largest, _MANY_VARIANTS)
    wide = lambda x: x["k"] > _SEGMENT_K

    left, right = with_characters(left, "a"), with_characters(right, "b")
    lhs = left.select("a", "a_set", radius(size).cast("int").alias("k"))
    # partner lengths: those that occur on the left, where fewer than the 2 * largest + 1 around each right string
    occurring = [r[0] for r in left.select(F.length("a").alias("n")).distinct().limit(2 * largest + 2).collect()]
    if len(occurring) <= 2 * largest + 1:
        around = F.filter(F.array(*[F.lit(int(n)) for n in sorted(occurring)]).cast("array<int>"),
                          lambda n: F.abs(n - F.length("b")) <= largest)
    else:
        around = F.sequence(F.greatest(F.length("b") - largest, F.lit(0)), F.length("b") + largest)
    partners = F.filter(
        F.transform(around, lambda n: F.struct(n.alias("size"), radius(n).cast("int").alias("k"))),
        lambda x: F.abs(x["size"] - F.length("b")) <= x["k"])
    rhs = right.select("b", "b_set", partners.alias("partners"))
    is_few = size <= _limits(k, largest, _FEW_VARIANTS)
    pairs = _by_deletions(lhs.where(is_few), rhs.select("b", "b_set", _radii("partners", few).alias("ks")), largest, small)
    lhs = lhs.where(~is_few)
    rhs = rhs.select("b", "b_set", F.filter("partners", lambda x: ~few(x)).alias("partners"))
    if largest > _SEGMENT_K:
        pairs = pairs.unionByName(_by_grams(
            lhs.where(k > _SEGMENT_K), rhs.select("b", "b_set", F.filter("partners", wide).alias("partners")), largest, small))
        lhs = lhs.where(k <= _SEGMENT_K)
        rhs = rhs.select("b", "b_set", F.filter("partners", lambda x: ~wide(x)).alias("partners"))

    left_cut, right_cut = _left_segments(lhs), _right_segments(rhs)
    if small:
        return pairs.unionByName(_close_pairs(left_cut, right_cut, largest, small=True)).distinct()
    salted = ("key", "salt")
    sizes = (left_cut.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
             .join(right_cut.groupBy("key").agg(F.count(F.lit(1)).alias("n_right")), "key"))
    n_left, n_right = F.col("n_left"), F.col("n_right")
    sizes = checkpoint(sizes.where(n_left * n_right > min(_TASK, crowd)))  # of the keys that may need care
    hot = sizes.where(n_left * n_right > crowd * (n_left + n_right)).select("key")
    if hot.isEmpty():
        return pairs.unionByName(_close_pairs(*_spread(left_cut, right_cut, sizes), largest, salted)).distinct()

    cool = [side.join(hot, "key", "left_anti") for side in (left_cut, right_cut)]
    pairs = pairs.unionByName(_close_pairs(*_spread(*cool, sizes), largest, salted))
    crowded_left = checkpoint(left_cut.join(hot, "key", "left_semi").select("a", "a_set", "k").distinct())
    crowded_b = right_cut.join(hot, "key", "left_semi").select("b").distinct()
    crowded_right = checkpoint(rhs.join(crowded_b, "b", "left_semi"))
    is_many = size <= _limits(k, largest, _MANY_VARIANTS)
    pairs = pairs.unionByName(_by_deletions(
        crowded_left.where(is_many), crowded_right.select("b", "b_set", _radii("partners", many).alias("ks")), largest, False))
    crowded_long = crowded_left.where(~is_many)
    if not crowded_long.isEmpty():
        others = crowded_right.select("b", "b_set", F.filter("partners", lambda x: ~many(x)).alias("partners"))
        pairs = pairs.unionByName(_by_grams(crowded_long, others, largest, False))
    return pairs.distinct()
