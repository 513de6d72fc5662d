"""Secret scan over an incremental ledger of blobs.

Each version of a text is addressed by its sha256. The ledger holds, for every blob and rule version that has been
scanned, the spans found (none is an entry as well), so a later run scans only pairs it hasn't seen: new blobs under
all rules, old blobs under new rule versions. Findings go back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.llm.shared import fresh_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts (0: the whole match) and the least length."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# Patterns and lengths of the base kinds.
BASE = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                      r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
RULES = (*BASE,
         Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
         Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"))

_SPANS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob string, kind string, version int, spans {_SPANS}"


def find_spans(text: str, rule: Rule, compiled: re.Pattern[str]) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, those too short dropped; code points, end exclusive."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _fast(rule: Rule) -> re.Pattern[str]:
    """A run of one class that is too short can't hide a longer one, so such patterns carry their least length."""
    if rule.pattern == r"[0-9a-f]+":
        return re.compile(rf"[0-9a-f]{{{rule.least},}}")
    return re.compile(rule.pattern)


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = {(r.kind, r.version): (r, _fast(r)) for r in rules}
        for batch in batches:
            blobs, kinds, versions, found = [], [], [], []
            pending = batch.column(1).to_pylist()
            for i, blob in enumerate(batch.column(0).to_pylist()):
                text = batch.column(2)[i].as_py() or ""
                for pair in pending[i]:
                    rule, compiled = by_kind[pair["kind"], pair["version"]]
                    blobs.append(blob)
                    kinds.append(rule.kind)
                    versions.append(rule.version)
                    found.append([{"start": a, "stop": b} for a, b in find_spans(text, rule, compiled)])
            yield pa.RecordBatch.from_arrays([
                pa.array(blobs, pa.string()), pa.array(kinds, pa.string()), pa.array(versions, pa.int32()),
                pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                ["blob", "kind", "version", "spans"])
    return run


def read_ledger(spark, path: str) -> DataFrame:
    """All entries so far; an absent ledger is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``versions(key, text)``, append it, and return the addressed rows
    ``(key, blob)``.

    One version stands for all with the same content; only its text is shuffled. The append is Spark's own commit, so
    a lost executor or a repeated run leaves no half entries, and an entry written twice is read once.
    """
    spark = versions.sparkSession
    texts = versions.select(F.col(f"`{key}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    addressed = texts.select("path", F.sha2("text", 256).alias("blob"))
    known = read_ledger(spark, path).select("blob", "kind", "version").distinct()
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    pending = (addressed.groupBy("blob").agg(F.min("path").alias("path"))
               .join(seen, "blob", "left")
               .withColumn("pending", F.when(F.col("seen").isNull(), wanted)
                           .otherwise(F.filter(wanted, lambda x: ~F.array_contains("seen", x))))
               .where("size(pending) > 0").select("blob", "path", "pending"))
    # a path may have had several texts: the address decides
    work = (texts.join(pending.withColumnRenamed("path", "at"), F.col("path").eqNullSafe(F.col("at")))
            .where(F.sha2("text", 256) == F.col("blob")).select("blob", "pending", "text"))
    work.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(path)
    return addressed


def findings(addressed: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(path, blob, spans)`` for every addressed row: the spans of the given rule versions, by start and then by
    kind as listed. Entries of a blob are few, so they are put together before they meet its paths; a blob with very
    many paths is split by adaptive execution, as nothing above the join needs its rows together."""
    spark = addressed.sparkSession
    order = {(r.kind, r.version): i for i, r in enumerate(rules)}
    place = F.create_map(*[x for (kind, version), i in order.items()
                           for x in (F.lit(f"{kind}:{version}"), F.lit(i))])
    entries = (read_ledger(spark, path).where(F.size("spans") > 0)
               .withColumn("k", place[F.concat_ws(":", "kind", "version")]).where("k IS NOT NULL")
               .select("blob", "k", "kind", F.explode("spans").alias("s"))
               .select("blob", F.struct(F.col("s.start").alias("start"), "k", "kind",
                                        F.col("s.stop").alias("stop")).alias("span")))
    found = entries.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    return addressed.join(found, "blob", "left")


def secret_report(versions: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES,
                  base: Sequence[Rule] = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``versions``: the key, the count of each base kind, ``base_sha256`` (of the base spans as
    ``kind:start:end``, comma-joined) and ``spans`` (all spans, joined likewise).

    A null text is an empty one; empty texts have no spans; repeated rows and ids give repeated rows, each with the
    spans of its own text; an empty table gives no rows; further columns are ignored. Without a ``path`` the ledger is
    a new one in the shared folder.
    """
    path = path or fresh_folder(versions.sparkSession, "ledger")
    got = findings(scan_new(versions, path, rules, key, text), path, rules)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,k:int,kind:string,stop:int>>"))
    kinds = [r.kind for r in base]

    def shown(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    ours = F.filter(spans, lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(F.col("path").alias(key), *map(count, kinds), F.sha2(shown(ours), 256).alias("base_sha256"),
                      shown(spans).alias("spans"))
