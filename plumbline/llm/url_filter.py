"""URL filters by host-suffix and path-prefix expressions.

A URL is expanded into expressions ``host suffix + path prefix``; each rule is one expression. Expressions and rules
meet by equality of a short prefix of their SHA-256, hits are confirmed by the whole digest and the rule's own path,
and of the rules that fit the longest decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import salted_join

#: Rules up to this number (some 30 MB with digests) are broadcast; more are joined by a salted shuffle.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path from there
    up to ``?``, ``#`` or the end; both empty for null and for urls without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` from a list."""
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def _folder(path: Column) -> Column:
    """The path up to its last slash, slash included."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest fitting rule (host and path
    together) wins, then the longer host, then ``block`` before ``allow``. Without one, ``rule`` is null and the
    verdict ``default``. Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated rows
    give repeated rows; further columns are ignored; an empty table gives none.

    URLs are expanded no deeper than the deepest rule, so very long ones cost no more.
    """
    rules = rules.select("verdict", F.lower("rule_host").alias("rule_host"), "rule_path").distinct()
    rules = (rules.withColumn("expression", F.concat("rule_host", F.lit(" "), _folder(F.col("rule_path"))))
             .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8)))
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                        F.max(F.size(F.split(_folder(F.col("rule_path")), "/"))).alias("parts"),
                        F.count(F.lit(1)).alias("n")).first()
    host, path = host_and_path(F.col("url"))
    pages = (pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
             .withColumns({"host": host, "path": path}))
    labels, parts = F.split("host", r"\."), F.split(_folder(F.col("path")), "/")
    # of the parts of "/a/b/" the last is empty: i of them with their slashes are the prefixes "/", "/a/", ...
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest["labels"] or 1))),
                        lambda i: F.array_join(F.slice(labels, -i, i), "."))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit((deepest["parts"] or 1) - 1))),
                        lambda i: F.when(i == 0, F.lit("")).otherwise(
                            F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit(" "), p))))
    opened = (pages.select("page_id", "url", "host", "path", "times", F.explode(pairs).alias("expression"))
              .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8)))
    known = rules.select("short", F.col("digest").alias("rule_digest"), "verdict", "rule_host", "rule_path")
    if deepest["n"] <= BROADCAST_RULES:
        met = opened.join(F.broadcast(known), "short", "left")
    else:
        met = salted_join(opened, known, "short", "page_id", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    best = F.max(F.when(fits, F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("host"),
        F.when(F.col("verdict") == "block", 1).otherwise(0).alias("block"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")))).alias("best")
    judged = met.groupBy("page_id", "url", "host", "path", "times").agg(best)
    return (judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
