"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are the distinct words of a text, A-Z lower-cased. The lexicon holds the terms whose inverse document frequency
over the corpus lies in a band: in at least ``min_df`` documents (rare terms, typos and the like, go) and in at most
``max_df_share`` of them (common terms go). A signature is the SHA-256 of the sorted distinct lexicon terms of a text;
besides the whole lexicon, ``subsets`` randomised sub-lexicons, each dropping a term by a hash of subset and term with
chance ``drop``, give one signature each. A fingerprint is the signatures joined by ``:``; the likeness of two is the
share of positions where they agree.

The edited text of a document replaces its second half by the start of the next document in ascending doc_id order.
"Next" is found without a window over all rows: the rows are sorted by a range shuffle (with a tie-break that splits
any run of equal keys), numbered by partition and position, and each points to the number after its own or to the
first of the next partition.

No pair of row and term is shuffled for the common terms: document frequencies are counted straight from the scan, the
lexicon's terms from some frequency on are broadcast, and a row's terms are looked up and gathered where its text and the
start of the next one have met. Only rarer terms, where the lexicon has more than ``FREQUENT_BROADCAST``, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space but the blank.
BLANKS = "\t\n\x0b\x0c\r"
#: The most frequent terms, up to this many (24 MB, some 100 MB as a hash table), are looked up in a broadcast.
FREQUENT_BROADCAST = 1_000_000


def _split(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, with empty strings between and around them."""
    return F.split(F.translate(text, UPPER + BLANKS, LOWER + " " * len(BLANKS)), " ")


def terms(text: Column) -> Column:
    """Distinct words (runs of non-space) of a text, A-Z lower-cased, in order of first use."""
    return F.array_remove(F.array_distinct(_split(text)), "")


def _term_keys(text: Column) -> Column:
    """The distinct terms of a text as 64-bit hashes that are quick to take, look up and compare."""
    return F.array_remove(F.array_distinct(F.transform(_split(text), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _next_rows(ordered: DataFrame) -> DataFrame:
    """``(_rid, _next)``: the row number of the next row in the order, the first row after the last one."""
    part = F.shiftright(F.col("_rid"), 33)
    bounds = ordered.groupBy(part.alias("_part")).agg(F.min("_rid").alias("_lo"), F.max("_rid").alias("_hi"))
    # one row per non-empty partition: bounded by the number of partitions, not by the rows
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bounds = bounds.withColumn("_after", F.coalesce(F.lead("_lo").over(Window.orderBy("_part")),
                                                    F.first("_lo").over(whole)))
    return (ordered.select("_rid", part.alias("_part")).join(F.broadcast(bounds), "_part")
            .select("_rid", F.when(F.col("_rid") < F.col("_hi"), F.col("_rid") + 1).otherwise(F.col("_after"))
                    .alias("_next")))


def _likeness(a: Column, b: Column, k: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0),
                       lambda s, x: s + x) / F.lit(float(k))


def term_hash(word: Column) -> Column:
    """A term as 60 bits of its MD5, which signatures are made of; taken once for each term and task."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def _broadcast_from(counts: DataFrame) -> int:
    """The least frequency from which on there are no more than FREQUENT_BROADCAST terms; 0 if that is all of them.
    One row per frequency that occurs is read: some square root of the pairs of row and term at most."""
    total, least = 0, None
    for row in counts.groupBy("_df").count().orderBy(F.desc("_df")).toLocalIterator():
        total += row["count"]
        if total > FREQUENT_BROADCAST:
            return least or row["_df"] + 1
        least = row["_df"]
    return 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", subsets: int = 4, drop: float = 1 / 3,
                 min_df: int = 2, max_df_share: float = 0.1) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row.

    A null text is empty. Document frequencies count rows, repeated rows each. The edited text keeps the first
    n − floor(n/2) code points and appends the first floor(n/2) (or all) code points of the next row's text, rows
    ordered by doc_id ascending with nulls last, then by the SHA-256 of the text; equal rows in any order. The last
    row's next is the first; a single row is its own next. Terms are compared and sorted as 60-bit hashes of their
    MD5, and a signature is the SHA-256 of those numbers in rising order, blank-separated. A text without lexicon
    terms signs the empty text, so empty texts have equal fingerprints and likeness 1. Equal texts have equal
    fingerprints. An empty table gives no rows; further columns are ignored. Terms are told apart by a 64-bit hash on the
    way; among ten million of them any two are equal with a chance of 3e-6.

    Only keys are sorted; each text is shipped once by its row, and the next row's text only as far as the edit needs.
    The row numbers come from the scan order of ``docs``, which a file scan keeps when a task runs again."""
    k = subsets + 1
    base = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn(
        "_tie", F.monotonically_increasing_id())
    ordered = (base.select("_doc", "_tie", F.length("_t").cast("long").alias("n_chars"),
                           F.unhex(F.sha2(F.col("_t"), 256)).alias("_h"))
               .orderBy(F.col("_doc").asc_nulls_last(), "_h", "_tie")
               .withColumn("_rid", F.monotonically_increasing_id()).drop("_h"))
    ordered = stored(ordered, "imatch-keys")
    links = _next_rows(ordered)
    after = ordered.select(F.col("_rid").alias("_next"), F.col("_tie").alias("_next_tie"))
    keys = stored(ordered.join(links, "_rid").join(after, "_next").select(
        "_tie", "_next_tie", "_doc", "n_chars", (F.col("n_chars") / 2).cast("long").alias("_half")), "imatch-links")
    n = keys.count()

    counts = stored(base.select(F.explode(terms(F.col("_t"))).alias("_word"))
                    .select(F.xxhash64("_word").alias("_x"), term_hash(F.col("_word")).alias("_w")).groupBy("_x")
                    .agg(F.min("_w").alias("_w"), F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= min_df),
                    "imatch-counts")
    mask = F.lit(1)
    for j in range(1, k):
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{j}:"), F.col("_w").cast("string"))), 1, 4), 16, 10)
        mask = mask + F.when(draw.cast("double") >= F.lit(drop * 65536), F.lit(1 << j)).otherwise(F.lit(0))
    lexicon = counts.where(F.col("_df") <= F.lit(max_df_share * n)).select("_x", "_w", "_df", mask.alias("_mask"))
    cut = _broadcast_from(counts)
    frequent = lexicon.where(F.col("_df") >= cut).drop("_df")

    needs = keys.select(F.col("_next_tie").alias("_tie"), F.col("_tie").alias("_for"), "_half")
    texts = base.select("_tie", "_t")  # shuffled by _tie once: both joins below reuse it
    prefixes = texts.join(needs, "_tie").select("_for", F.expr("substring(_t, 1, _half)").alias("_p"))
    edited = F.concat(F.expr("substring(_t, 1, n_chars - _half)"), F.col("_p"))
    rows = (texts.join(keys.select("_tie", "n_chars", "_half"), "_tie")
            .join(prefixes, F.col("_tie") == F.col("_for")).select("_tie", "_t", edited.alias("_e"))
            .select("_tie", _term_keys(F.col("_t")).alias("_own"), _term_keys(F.col("_e")).alias("_ed"),
                    F.unhex(F.sha2(F.col("_e"), 256)).alias("_sha")))
    no_sha = F.lit(None).cast("binary").alias("_sha")
    tagged = lambda ws, bits: F.transform(ws, lambda w: F.struct(w.alias("_x"), F.lit(bits).alias("_in"), no_sha))
    # each term of a row once, with bit 1 if in its text and bit 2 if in its edited text; one more entry keeps the row
    row = F.array(F.struct(F.lit(None).cast("long").alias("_x"), F.lit(0).alias("_in"), F.col("_sha")))
    words = rows.select("_tie", F.explode(F.concat(
        row, tagged(F.array_intersect("_own", "_ed"), 3), tagged(F.array_except("_own", "_ed"), 1),
        tagged(F.array_except("_ed", "_own"), 2))).alias("_term")).select("_tie", "_term._x", "_term._in", "_term._sha")
    entry = F.struct("_w", "_mask", "_in")
    # rows are dealt by _tie and stay so through explode and broadcast join: their terms are gathered without a shuffle
    found = (words.join(F.broadcast(frequent), "_x", "left").where("_mask IS NOT NULL OR _sha IS NOT NULL")
             .groupBy("_tie").agg(F.collect_list(entry).alias("_terms"), F.max("_sha").alias("_sha")))
    if cut > min_df:
        common = F.broadcast(counts.where(F.col("_df") >= cut).select("_x"))
        # a term here is in fewer than cut rows, at most (terms of a row) / FREQUENT_BROADCAST of all rows
        rare = (words.where("_x IS NOT NULL").drop("_sha").join(common, "_x", "left_anti")
                .join(lexicon.where(F.col("_df") < cut).drop("_df"), "_x")
                .groupBy("_tie").agg(F.collect_list(entry).alias("_more")))
        found = found.join(rare, "_tie", "left").select("_tie", "_sha", F.when(
            F.col("_more").isNull(), F.col("_terms")).otherwise(F.concat("_terms", "_more")).alias("_terms"))
    found = found.select("_tie", "_sha", F.transform(F.sort_array("_terms"), lambda x: F.struct(
        x["_w"].cast("string").alias("_w"), x["_mask"].alias("_mask"), x["_in"].alias("_in"))).alias("_terms"))

    def signatures(bit: int) -> Column:
        return F.array(*[F.unhex(F.sha2(F.concat_ws(" ", F.transform(F.filter(
            F.col("_terms"), lambda x: (x["_mask"].bitwiseAND(F.lit(1 << j)) != 0) & (x["_in"].bitwiseAND(F.lit(bit)) != 0)),
            lambda x: x["_w"])), 256)) for j in range(k)])

    signed = stored(found.select("_tie", "_sha", signatures(1).alias("_own"), signatures(2).alias("_edited")),
                    "imatch-signed")
    # the next row's signatures are only compared: half of each, 128 bits, tells them apart
    half = lambda c: F.transform(c, lambda x: F.substring(x, 1, 16))
    follow = (keys.select("_tie", "_next_tie")
              .join(signed.select(F.col("_tie").alias("_next_tie"), half(F.col("_own")).alias("_follow")), "_next_tie")
              .drop("_next_tie"))
    out = keys.select("_tie", "_doc", "n_chars").join(signed, "_tie").join(follow, "_tie")
    hexed = lambda c: F.transform(c, lambda x: F.lower(F.hex(x)))
    return out.select(F.col("_doc").alias("doc_id"), "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"),
                      F.concat_ws(":", hexed("_own")).alias("fingerprint"),
                      F.concat_ws(":", hexed("_edited")).alias("edited_fingerprint"),
                      _likeness(F.col("_own"), F.col("_edited"), k).alias("near_edited"),
                      _likeness(half(F.col("_own")), F.col("_follow"), k).alias("near_next"))
