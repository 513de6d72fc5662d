"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate from its target share of the output and its size. A document's count is the
Poisson quantile of a number drawn from a hash of seed and document, so it is repeatable and independent of the
partitioning; the document is repeated as often, and the copies are put in a random global order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import salted_join, stored

#: Rates of up to so many sources (some 5 MB) are broadcast; more are joined by a salted shuffle.
BROADCAST_SOURCES = 50_000
#: Largest mean drawn at once; greater rates are sums of independent draws of at most this mean.
STEP = 8.0
#: The chance of more than this many at a mean of STEP is below the resolution of the draw.
MOST = 60


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, of 52 bits."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p)
                              for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k whose Poisson distribution function exceeds ``u``, for rates up to STEP."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.when(acc["cdf"] > u, acc).otherwise(
            F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + 1).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step)["k"]


def target_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5,
                 total: float = 1.0) -> DataFrame:
    """``(source, rate)``. ``weights`` names the sources' shares of the output; sources it doesn't name share what is
    left by their size to the power ``temperature``, as do all sources without it. ``total`` is the size of the output
    as a multiple of the input. Sizes are code points, and one for an empty text."""
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    given = F.lit(None).cast("double")
    for name, share in (weights or {}).items():
        given = F.when(F.col("source") == name, F.lit(float(share))).otherwise(given)
    sizes = sizes.withColumn("given", given)
    power = F.when(F.col("given").isNull(), F.pow(F.col("size").cast("double"), F.lit(temperature)))
    sums = sizes.agg(F.sum("size").alias("all"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("named"),
                     F.sum(power).alias("powers"))
    rate = (F.coalesce("given", F.greatest(1 - F.col("named"), F.lit(0.0)) * power / F.col("powers"))
            * total * F.col("all") / F.col("size"))
    return sizes.join(F.broadcast(sums)).select("source", rate.alias("rate"))  # sums: a single row


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 11, temperature: float = 0.5,
              total: float = 1.0) -> DataFrame:
    """``docs`` with each row as often as its draw says, plus ``copy`` (0, 1, ...) and ``shuffle_key``, sorted by the
    latter over the whole result.

    The draw depends on seed and doc_id, so rows of one id are repeated alike; a null id or source is a value of its
    own. Empty texts count as one character in the sizes. An empty table gives no rows. Own columns named ``copy`` or
    ``shuffle_key`` give way to the new ones.
    """
    columns = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    keyed = docs.select(*columns).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rates = (target_rates(docs, weights, temperature, total)
             .select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"),
                     F.col("rate").alias("_rate")))
    rates = stored(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(rates), "_source")
    else:
        rated = salted_join(keyed, rates, "_source", "doc_id")
    steps = F.greatest(F.ceil(F.col("_rate") / STEP), F.lit(1))
    draws = F.transform(F.sequence(F.lit(1), steps), lambda i: poisson_quantile(
        uniform(str(seed), F.col("doc_id"), i), F.col("_rate") / steps).cast("long"))
    count = F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + x)
    copies = rated.withColumn("_count", count).where("_count > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.col("copy").cast("string")).cast("binary"))
    return copies.select(*columns, "copy", key.alias("shuffle_key")).orderBy("shuffle_key")
