"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (cross_parsing, decision_list, decontaminate, feistel_shards, hard_negatives, html_text,
                           imatch, jaccard_join, mixing, nbsvm, secret_ledger, url_filter, whitening)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secret_ledger")
def _(spark, d):
    return secret_ledger.secret_report(table(spark, d, "documents"))


@query("op2_jaccard_join")
def _(spark, d):
    return jaccard_join.jaccard_components(table(spark, d, "documents"))


@query("op3_string_tiling")
def _(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op4_nbsvm")
def _(spark, d):
    return nbsvm.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_decision_list")
def _(spark, d):
    return decision_list.judge(table(spark, d, "documents"), table(spark, d, "labels"))[0]


@query("op6_poisson_mixing")
def _(spark, d):
    return mixing.replicate(table(spark, d, "documents"))


#: Verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op7_url_filter")
def _(spark, d):
    return url_filter.judge(table(spark, d, "pages"), url_filter.rules_table(spark, URL_RULES))


@query("op8_html_text")
def _(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query("op9_feistel_shards")
def _(spark, d):
    return feistel_shards.materialise(table(spark, d, "documents"))


@query("op10_cross_parsing")
def _(spark, d):
    return cross_parsing.identify(table(spark, d, "documents"))


@query("op11_chebyshev_whitening")
def _(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


@query("op12_four_russians_negatives")
def _(spark, d):
    return hard_negatives.mine(table(spark, d, "embeddings"))


@query("op13_imatch_fingerprints")
def _(spark, d):
    return imatch.fingerprints(table(spark, d, "documents"))
