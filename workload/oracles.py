"""The registered queries in DuckDB SQL, written from the definitions: cross joins for edit distances, plain windows for
ranks and distribution functions, string_agg for chunk hashes."""

from __future__ import annotations

from plumbline.operators.content import PII_POLICY

AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                 "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
ITEM_COLUMNS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}

TARGET = """WITH changed AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 7 THEN -1 ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 67 = 4 THEN ' ' || o_orderstatus ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 53 = 2 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 71 = 8 THEN NULL WHEN o_orderkey % 307 = 6 THEN o_orderdate + INTERVAL 10 YEAR
      ELSE o_orderdate END AS o_orderdate,
    CASE WHEN o_orderkey % 41 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0),
target AS (
  SELECT * FROM changed
  UNION ALL SELECT * FROM changed WHERE o_orderkey % 101 = 1
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM changed WHERE o_orderkey % 211 = 5),
target_v2 AS (
  SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus AS "o_orderStatus", o_totalprice AS "totalPrice",
    o_orderdate, o_orderdate + INTERVAL 20 MINUTE AS loaded_at FROM target)
"""

CONTACTS = """WITH contacts AS (
  SELECT c_name, c_mktsegment,
    CASE WHEN c_nationkey < 16 THEN lower(replace(c_name, '#', '.')) || '@example.com'
      ELSE '555-' || lpad(c_custkey::VARCHAR, 7, '0') END AS contact,
    '10.0.' || c_nationkey || '.' || (c_custkey % 256) AS address FROM customer)
"""

EVENT_DOCUMENTS = """WITH documents_after AS (
  SELECT CASE WHEN event_type = 'error' THEN replace(props, '"k"', '"code"')
    WHEN event_type = 'purchase' THEN replace(props, '{', '{"note": "paid", ') ELSE props END AS props FROM events)
"""


def times(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def text(column: str, kind: str, escape: bool = True) -> str:
    """Canonical text of a column."""
    if kind == "timestamp_ntz":
        return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
    if kind == "string" and escape:
        return f"replace(replace({column}, '\\', '\\\\'), '|', '\\|')"
    return f"{column}::VARCHAR"


def row_text(columns: dict[str, str]) -> str:
    return " || '|' || ".join(f"coalesce({text(c, k)}, '\\N')" for c, k in columns.items())


def number(hash_sql: str, i: int) -> str:
    return f"('0x' || substr({hash_sql}, {1 + 15 * i}, 15))::BIGINT"


def digest(rows: str, hash_sql: str) -> str:
    return (f"{rows} || ':' || coalesce(sum({number(hash_sql, 0)}), 0)::VARCHAR || ':' || "
            f"coalesce(sum({number(hash_sql, 1)}), 0)::VARCHAR")


def case(*cases: tuple[str, str, str], otherwise: tuple[str, str] = ("PASS", "HIGH")) -> str:
    """status and severity columns."""
    if not cases:
        return f"'{otherwise[0]}' AS status, '{otherwise[1]}' AS severity"
    out = []
    for name, at in (("status", 1), ("severity", 2)):
        whens = " ".join(f"WHEN {c[0]} THEN '{c[at]}'" for c in cases)
        out.append(f"CASE {whens} ELSE '{otherwise[at - 1]}' END AS {name}")
    return ", ".join(out)


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def quantile(values: str, p: float) -> str:
    """The next sample value, or the mean of both neighbours of an exact position in an even-sized sample."""
    n, at = f"len({values})", f"(len({values}) * {p})"
    return (f"CASE WHEN {at} <> floor({at}) THEN {values}[ceil({at})::INT] "
            f"WHEN {n} % 2 = 0 THEN ({values}[{at}::INT] + {values}[{at}::INT + 1]) / 2 ELSE {values}[{at}::INT + 1] END")


def ks(selects: str, alpha: float = 0.05) -> str:
    """``selects`` gives CTEs ending in u("column", v, s, t): a row per value, s or t being 1."""
    return f"""{selects}, cdf AS (
  SELECT "column", sum(s) OVER w AS cs, sum(t) OVER w AS ct, sum(s) OVER a AS n1, sum(t) OVER a AS n2 FROM u
  WINDOW w AS (PARTITION BY "column" ORDER BY v), a AS (PARTITION BY "column")),
d AS (SELECT "column", max(n1)::BIGINT AS n_source, max(n2)::BIGINT AS n_target,
  max(abs(cs::DOUBLE / n1 - ct::DOUBLE / n2)) AS statistic FROM cdf GROUP BY ALL),
e AS (SELECT *, sqrt(n_source::DOUBLE * n_target / (n_source + n_target)) AS en FROM d),
l AS (SELECT *, (en + 0.12 + 0.11 / en) * statistic AS arg FROM e),
p AS (SELECT *, CASE WHEN statistic = 0 OR arg < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(
  range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)
  * exp(-2.0::DOUBLE * k * k * arg * arg))))) END AS p_value FROM l)"""


def ks_result(selects: str) -> str:
    return ks(selects) + f"""
SELECT "column", n_source, n_target, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
  p_value < 0.05 AS significant,
  {case(("least(n_source, n_target) < 11", "SKIPPED", "MEDIUM"), ("p_value < 0.05", "FAIL", "HIGH"))} FROM p"""


NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


def paired_values(columns: list[str], distinct: bool = False) -> str:
    d = "DISTINCT " if distinct else ""
    return TARGET + ", u AS (" + union(
        [f"SELECT * FROM (SELECT {d}'{c}' AS \"column\", {c}::DOUBLE AS v, {s} AS s, {t} AS t FROM {name} "
         f"WHERE {c} IS NOT NULL)" for c in columns for name, s, t in (("orders", 1, 0), ("target", 0, 1))]) + ")"


def column_stats(columns: dict[str, str], table: str, digits: int = 6) -> str:
    parts = []
    for c, kind in columns.items():
        numeric = kind in ("bigint", "int", "double")
        mean = f"round(avg({c}::DOUBLE), {digits})" if numeric else f"round(avg(try_cast({c}::VARCHAR AS DOUBLE)), 6)" \
            if kind == "string" else "NULL::DOUBLE"
        sd = f"round(stddev_samp({c}::DOUBLE), 6)" if numeric else \
            f"round(stddev_samp(try_cast({c}::VARCHAR AS DOUBLE)), 6)" if kind == "string" else "NULL::DOUBLE"
        t = text(c, kind, escape=False)
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS total_count, count(*) - count({c}) AS null_count,
  {text(f"min({c})", kind, False)} AS min_value, {text(f"max({c})", kind, False)} AS max_value, {mean} AS mean,
  {sd} AS stddev, min(length({t}))::INT AS min_length, max(length({t}))::INT AS max_length,
  round(avg(length({t})), 6) AS avg_length, count(DISTINCT {c}) AS distinct_count FROM {table}""")
    return union(parts)


def chi_square(scaled: bool) -> str:
    expected = "e * nt / ns" if scaled else "e"
    counts = union([f"""SELECT '{c}' AS "column", coalesce(s.v, t.v) AS v, coalesce(s.n, 0)::DOUBLE AS e,
  coalesce(t.n, 0)::DOUBLE AS o
  FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) s
  FULL JOIN (SELECT {c} AS v, count(*) AS n FROM target WHERE {c} IS NOT NULL GROUP BY 1) t ON s.v = t.v"""
                    for c in ("o_orderstatus", "o_orderpriority")])
    return TARGET + f""", c AS ({counts}),
n AS (SELECT *, sum(e) OVER (PARTITION BY "column") AS ns, sum(o) OVER (PARTITION BY "column") AS nt FROM c),
x AS (SELECT "column", count(*) AS categories, max(ns)::BIGINT AS n_source, max(nt)::BIGINT AS n_target,
  coalesce(sum(CASE WHEN e > 0 THEN (o - {expected}) ** 2 / ({expected}) END), 0.0) AS statistic,
  count(*) - 1 AS degrees_of_freedom FROM n GROUP BY "column"),
p AS (SELECT *, CASE WHEN degrees_of_freedom = 0 OR statistic = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 3000),
  lambda k: exp(-statistic / 2 + (degrees_of_freedom / 2.0 + k) * ln(statistic / 2)
    - lgamma(degrees_of_freedom / 2.0 + k + 1)))) END AS p_value FROM x)
SELECT "column", categories, n_source, n_target, round(statistic, 6) AS statistic, degrees_of_freedom,
  abs(round(p_value, 6)) AS p_value, p_value < 0.05 AS significant, {case(("p_value < 0.05", "FAIL", "HIGH"))} FROM p"""


def outlier_rate(table: str, columns: list[str], distinct: bool) -> str:
    d = "DISTINCT " if distinct else ""
    parts = [f"SELECT * FROM (SELECT {d}'{c}' AS \"column\", {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL)"
             for c in columns]
    return f"""WITH u AS ({union(parts)}),
b AS (SELECT "column", avg(v) AS m, stddev_pop(v) AS sd, list(v ORDER BY v) AS x FROM u GROUP BY 1),
q AS (SELECT "column", m, sd, {quantile("x", 0.25)} AS q1, {quantile("x", 0.75)} AS q3 FROM b),
f AS (SELECT u."column", v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS i, abs(v - m) / sd > 3 AS z
  FROM u JOIN q USING ("column")),
r AS (SELECT "column", count(*) AS n, count(*) FILTER (i) AS iqr_outliers, count(*) FILTER (z) AS z_outliers,
  count(*) FILTER (i OR z) AS outliers FROM f GROUP BY 1)
SELECT *, round(outliers * 100.0::DOUBLE / n, 6) AS outlier_pct,
  {case(("n < 11", "SKIPPED", "MEDIUM"), ("outliers * 100.0 / n > 10", "FAIL", "MEDIUM"),
        ("outliers > 0", "WARN", "MEDIUM"))} FROM r"""


def moments(column: str, table: str, prefix: str) -> str:
    return (f"SELECT '{column}' AS \"column\", avg({column}) AS {prefix}_mean, stddev_pop({column}) AS {prefix}_stddev, "
            f"median({column}) AS {prefix}_median FROM {table}")


def frequencies(column: str, source: str, target: str, denominator: str) -> str:
    sides = []
    for name, table in (("s", source), ("t", target)):
        whole = "(SELECT sum(n) FROM top_{0})".format(name) if denominator == "fetched" else \
            f"(SELECT count({column}) FROM {table})"
        sides.append(f"""top_{name} AS (SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, value LIMIT 50),
{name} AS (SELECT value::VARCHAR AS value, n::DOUBLE / {whole} AS f FROM top_{name} ORDER BY n DESC, top_{name}.value LIMIT 20)""")
    return ", ".join(sides) + """, shifts AS (SELECT coalesce(s.value, t.value) AS value, coalesce(s.f, 0) AS source_frequency,
  coalesce(t.f, 0) AS target_frequency, abs(coalesce(t.f, 0) - coalesce(s.f, 0)) AS shift
  FROM s FULL JOIN t ON s.value = t.value)"""


SHIFTS = """ SELECT value, round(source_frequency, 6) AS source_frequency, round(target_frequency, 6) AS target_frequency,
  round(shift, 6) AS shift FROM shifts"""

SIMILARITY = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE " \
             "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def greedy(table: str, column: str) -> str:
    """One sequential pass over the values in the order of (md5, value)."""
    return f"""WITH RECURSIVE vals AS (SELECT v, row_number() OVER (ORDER BY md5(v), v) AS rn
  FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE {column} IS NOT NULL)),
pass AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS leaders
  UNION ALL SELECT vals.rn, CASE WHEN len(list_filter(leaders, lambda l: levenshtein(l, v) <= 3)) = 0
    THEN list_append(leaders, v) ELSE leaders END FROM pass JOIN vals ON vals.rn = pass.i + 1),
leaders AS (SELECT unnest(leaders) AS leader FROM pass WHERE i = (SELECT max(rn) FROM vals)),
members AS (SELECT leader, v AS value, levenshtein(leader, v) AS distance,
  row_number() OVER (PARTITION BY v ORDER BY md5(leader), leader) AS k FROM leaders JOIN vals ON levenshtein(leader, v) <= 3
  WHERE v NOT IN (SELECT leader FROM leaders))
"""


def normal_name(name: str) -> str:
    snake = f"lower(regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g'))"
    return f"regexp_replace(regexp_replace({snake}, '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"


V2_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "string", "o_orderStatus": "string", "totalPrice": "double",
              "o_orderdate": "timestamp_ntz", "loaded_at": "timestamp_ntz"}


def column_mapping() -> str:
    def values(columns, table, side):
        return union([f"SELECT DISTINCT '{c}' AS c, {text(chr(34) + c + chr(34), k, False)} AS v FROM {table} "
                      f"WHERE \"{c}\" IS NOT NULL" for c, k in columns.items()])
    names = union([f"SELECT '{s}' AS source_column, '{t}' AS target_column, '{sk}' AS source_type, '{tk}' AS target_type"
                   for s, sk in ORDER_COLUMNS.items() for t, tk in V2_COLUMNS.items()])
    a, b = "normal_s", "normal_t"
    return TARGET + f""", s AS ({values(ORDER_COLUMNS, "orders", "s")}), t AS ({values(V2_COLUMNS, "target_v2", "t")}),
sizes AS (SELECT c, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT s.c AS sc, t.c AS tc, count(*) AS n FROM s JOIN t ON s.v = t.v GROUP BY 1, 2),
grid AS ({names}),
named AS (SELECT *, {normal_name("source_column")} AS normal_s, {normal_name("target_column")} AS normal_t FROM grid),
scored AS (SELECT source_column, target_column, source_type, target_type,
  {SIMILARITY.format(a=a, b=b)} AS name_similarity, coalesce(shared.n, 0)::DOUBLE / sizes.n AS value_overlap
  FROM named LEFT JOIN shared ON sc = source_column AND tc = target_column LEFT JOIN sizes ON sizes.c = source_column),
judged AS (SELECT *, CASE WHEN name_similarity = 1 THEN 1.0 ELSE 0.5 * name_similarity + 0.5 * value_overlap END AS confidence
  FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY source_column ORDER BY confidence DESC, target_column DESC) AS k FROM judged)
SELECT source_column, source_type, target_column, target_type, round(name_similarity, 6) AS name_similarity,
  round(value_overlap, 6) AS value_overlap, round(confidence, 6) AS confidence, confidence >= 0.4 AS mapped,
  {case(("confidence < 0.4", "FAIL", "HIGH"), ("source_type <> target_type", "FAIL", "HIGH"),
        ("confidence < 0.7", "WARN", "MEDIUM"))} FROM best WHERE k = 1"""


def reconcile(keys: str) -> str:
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys.split(", "))
    return f""", sk AS (SELECT {keys}, count(*) AS n FROM s GROUP BY ALL), tk AS (SELECT {keys}, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows,
  (SELECT coalesce(sum(n), 0) FROM sk s WHERE NOT EXISTS (SELECT 1 FROM tk t WHERE {on}))::BIGINT AS missing_rows,
  (SELECT coalesce(sum(n), 0) FROM tk t WHERE NOT EXISTS (SELECT 1 FROM sk s WHERE {on}))::BIGINT AS extra_rows,
  (SELECT count(*) FROM sk s WHERE NOT EXISTS (SELECT 1 FROM tk t WHERE {on})) AS missing_keys,
  (SELECT count(*) FROM tk t WHERE NOT EXISTS (SELECT 1 FROM sk s WHERE {on})) AS extra_keys,
  (SELECT coalesce(sum(n), 0) FROM sk s WHERE EXISTS (SELECT 1 FROM tk t WHERE {on}))::BIGINT AS matched_rows)
SELECT *, {case(("missing_rows > 0 OR extra_rows > 0", "FAIL", "HIGH"))} FROM m"""


def chunk_digests(chunk: str) -> str:
    h = f"md5({row_text(ORDER_COLUMNS)})"
    side = "SELECT {c} AS chunk, count(*) AS n, {d} AS digest FROM (SELECT *, {h} AS h FROM {t}) GROUP BY 1"
    parts = [side.format(c=chunk, d=digest("count(*)", "h"), h=h, t=t) for t in ("orders", "target")]
    return TARGET + f""", s AS ({parts[0]}), t AS ({parts[1]}),
m AS (SELECT coalesce(s.chunk, t.chunk)::BIGINT AS chunk, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows,
  coalesce(s.digest, '0:0:0') AS source_digest, coalesce(t.digest, '0:0:0') AS target_digest
  FROM s FULL JOIN t ON s.chunk = t.chunk)
SELECT *, {case(("source_digest <> target_digest", "FAIL", "HIGH"))} FROM m"""


def rank_chunks() -> str:
    side = ("SELECT (rn - 1) // 1000 AS chunk, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS digest FROM "
            "(SELECT h, row_number() OVER (ORDER BY o_orderkey, h) AS rn FROM (SELECT o_orderkey, md5({0}) AS h FROM {1})) "
            "GROUP BY 1")
    s, t = (side.format(row_text(ORDER_COLUMNS), name) for name in ("orders", "target"))
    return TARGET + f""", s AS ({s}), t AS ({t}),
m AS (SELECT coalesce(s.chunk, t.chunk)::BIGINT AS chunk, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows,
  s.digest AS source_digest, t.digest AS target_digest FROM s FULL JOIN t ON s.chunk = t.chunk)
SELECT *, {case(("source_digest IS DISTINCT FROM target_digest", "FAIL", "HIGH"))} FROM m"""


def fingerprint(columns: dict[str, str], table: str, algorithm: str) -> str:
    return (f"SELECT count(*) AS n_rows, {digest('count(*)', 'h')} AS digest, "
            f"{algorithm}({digest('count(*)', 'h')}) AS fingerprint FROM "
            f"(SELECT {algorithm}({row_text(columns)}) AS h FROM {table})")


# Personal data by value, as DuckDB (RE2) patterns; card numbers are found by their windows below.
PII_SQL_PATTERNS: dict[str, str] = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(^|[^0-9])(\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}([^0-9]|$)",
    "ssn": r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9-]|$)",
    "card_number": "",
    "ip_address": r"(^|[^0-9.])((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([^0-9]|$)",
}

LUHN = ("(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d}[i]::INT "
        "WHEN {d}[i]::INT * 2 > 9 THEN {d}[i]::INT * 2 - 9 ELSE {d}[i]::INT * 2 END)) % 10 = 0)")


def pii_cells(table: str, texts: list[str]) -> str:
    parts = []
    for c in texts:
        for kind, pattern in PII_SQL_PATTERNS.items():
            risk, regulations, protection = PII_POLICY[kind]
            if kind == "card_number":
                # groups of digits with one blank or hyphen between them; each run of groups is one candidate
                runs = f"regexp_extract_all({c}, '[0-9]+(?:[ -][0-9]+)*')"
                groups = (f"list_transform(list_filter({runs}, lambda r: length(r) > 12), "
                          "lambda r: string_split_regex(r, '[ -]'))")
                windows = (f"flatten(list_transform({groups}, lambda g: flatten(list_transform(range(1, len(g) + 1), "
                           "lambda i: list_transform(range(i, least(i + 19, len(g) + 1)), "
                           "lambda j: array_to_string(g[i:j], ''))))))")
                hit = (f"len(list_filter({windows}, lambda m: length(m) BETWEEN 13 AND 19 AND "
                       f"{LUHN.format(d='reverse(m)')})) > 0")
            else:
                hit = f"regexp_matches({c}, '{pattern}')"
            parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS pii_type, count({c}) AS checked_rows, "
                         f"count(*) FILTER ({hit}) AS matching_rows, false AS named, '{risk}' AS risk, "
                         f"'{regulations}' AS regulations, '{protection}' AS recommendation FROM {table}")
    return union(parts)


def pii_scan(table: str, texts: list[str]) -> str:
    return f"""WITH cells AS ({pii_cells(table, texts)})
SELECT *, round(matching_rows::DOUBLE / checked_rows, 6) AS match_rate,
  round(matching_rows::DOUBLE / checked_rows, 6) AS confidence, {case(otherwise=("FAIL", "HIGH"))}
FROM cells WHERE matching_rows > 0"""


def hours(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 3600000000.0::DOUBLE"


def checks(cte: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    """(name, measured, from, operator and limit, severity)"""
    parts = [f"SELECT '{name}' AS \"check\", round(({measured})::DOUBLE, 6) AS measured, "
             f"CASE WHEN ({measured})::DOUBLE {test} THEN 'PASS' ELSE 'FAIL' END AS status, "
             f"CASE WHEN ({measured})::DOUBLE {test} THEN 'HIGH' ELSE '{severity}' END AS severity FROM {table}"
             for name, measured, table, test, severity in rows]
    return cte + union(parts)


MISSING = "count(*) FILTER ({0} IS NULL)"
DUPLICATES = "(SELECT count(*) AS n FROM (SELECT {0} FROM {1} WHERE {0} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"


def _rules(run: str, target: str) -> list[str]:
    def row(stage, rule, column, cases, source, otherwise=("PASS", "HIGH")):
        name = f"'{column}'" if column else "NULL::VARCHAR"
        return (f"SELECT '{run}' AS run_id, '{stage}' AS stage, '{rule}' AS rule, 'orders' AS \"table\", {name} AS \"column\", "
                f"{case(*cases, otherwise=otherwise)} FROM ({source})")
    n = f"SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM {target}) AS t"
    parts = [
        row("table_profiling", "row_count_reconciliation", None,
            [("s = t", "PASS", "HIGH"), ("abs(t - s) * 100.0 / s <= 1.0", "WARN", "MEDIUM")], n, ("FAIL", "HIGH")),
        row("table_profiling", "duplicate_primary_key", None, [("n > 0", "FAIL", "HIGH")],
            f"SELECT count(*) AS n FROM (SELECT o_orderkey FROM {target} GROUP BY 1 HAVING count(*) > 1)"),
        row("table_profiling", "referential_integrity", None, [("n > 0", "FAIL", "HIGH")],
            f"SELECT count(*) AS n FROM {target} WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        row("reconciliation", "row_reconciliation", None, [("m > 0 OR e > 0", "FAIL", "HIGH")],
            f"SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {target})) AS m, "
            f"(SELECT count(*) FROM {target} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS e"),
        row("reconciliation", "missing_records", None, [("m > 0", "FAIL", "HIGH")],
            f"SELECT count(*) AS m FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {target})"),
        row("freshness", "temporal_sequence", "o_orderdate", [("n > 0", "FAIL", "HIGH")],
            f"SELECT count(*) AS n FROM {target} WHERE o_orderdate > {AS_OF}"),
        row("freshness", "timestamp_integrity", "o_orderdate", [("n > 0", "FAIL", "MEDIUM")],
            f"SELECT count(*) AS n FROM {target} WHERE o_orderdate IS NULL"),
        row("freshness", "stale_partition", "o_orderdate", [(f"{hours(AS_OF, 'o')} > 24 * 720", "WARN", "MEDIUM")],
            f"SELECT min(o_orderdate) AS o FROM {target}"),
    ]
    for c in ORDER_COLUMNS:
        parts.append(row("column_profiling", "null_completeness_ratio", c, [("abs(a - b) > 1", "FAIL", "HIGH")],
                         f"SELECT (SELECT {MISSING.format(c)} * 100.0 / count(*) FROM orders) AS a, "
                         f"(SELECT {MISSING.format(c)} * 100.0 / count(*) FROM {target}) AS b"))
    for c in ("o_orderstatus", "o_orderpriority"):
        parts.append(row("column_profiling", "whitespace_encoding", c, [("n > 0", "FAIL", "MEDIUM")],
                         f"SELECT count(*) AS n FROM {target} WHERE {c} <> trim({c})"))
    return parts


RULES = TARGET + ", rules AS (" + union(_rules("faulty", "target") + _rules("clean", "orders")) + ")"
COUNTS = """count(*) AS rules_checked, count(*) FILTER (status = 'PASS') AS rules_passed,
  count(*) FILTER (status = 'FAIL') AS rules_failed, count(*) FILTER (status = 'WARN') AS rules_warned,
  count(*) FILTER (status = 'SKIPPED') AS rules_skipped,
  count(*) FILTER (status = 'FAIL' AND severity = 'HIGH') AS high_failures,
  count(*) FILTER (status = 'FAIL' AND severity = 'MEDIUM') AS medium_failures,
  count(*) FILTER (status = 'FAIL' AND severity = 'LOW') AS low_failures"""
STATUS = "CASE WHEN high_failures > 0 THEN 'FAIL' WHEN medium_failures > 0 OR rules_warned > 0 THEN 'WARN' ELSE 'PASS' END"


def gate(blocks: str) -> str:
    return RULES + f""", plan AS (SELECT * FROM (VALUES (1, 'Table Profiling', 'table_profiling', true),
  (2, 'Column Profiling', 'column_profiling', true), (3, 'Pattern Analysis + Reconciliation', 'pattern_analysis', false),
  (3, 'Pattern Analysis + Reconciliation', 'reconciliation', false),
  (4, 'Semantic Validation + Freshness', 'semantic', false), (4, 'Semantic Validation + Freshness', 'freshness', false))
  AS v(stage_no, stage_name, stage, blocks)),
c AS (SELECT run_id, stage, {COUNTS} FROM rules GROUP BY 1, 2),
o AS (SELECT run_id, stage_no, stage_name, stage, {STATUS} AS own, max(CASE WHEN blocks AND ({blocks}) THEN 1 ELSE 0 END) OVER
  (PARTITION BY run_id ORDER BY stage_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c JOIN plan USING (stage))
SELECT run_id, stage_no, stage_name, stage, CASE WHEN coalesce(b, 0) = 1 THEN 'WARN' ELSE own END AS status,
  coalesce(b, 0) = 1 AS skipped,
  CASE WHEN coalesce(b, 0) = 1 THEN 'Skipped: an earlier stage reported a blocking failure' END AS reason FROM o"""


LATEST = f"""SELECT "table", run_id, {times("last_validated_at")} AS last_validated_at, last_key, chunk_index FROM (
  SELECT event_type AS "table", 'run-' || user_id AS run_id, ts AS last_validated_at, event_id::VARCHAR AS last_key,
    event_id % 7 AS chunk_index,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id % 7 DESC, event_id::VARCHAR DESC) AS k
  FROM events) WHERE k = 1"""

FORMAT_SQL = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$", "phone": r"^[+]?[\d\s\-()]{7,15}$", "date_iso": r"^\d{4}-\d{2}-\d{2}",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "ip_address": r"^(\d{1,3}\.){3}\d{1,3}$"}

ORACLES: dict[str, str] = {
    "a1_read_table": "SELECT * FROM customer",
    "a2_document_fields": EVENT_DOCUMENTS + """, f AS (SELECT props, unnest(json_keys(props)) AS field FROM documents_after),
v AS (SELECT field, list_position(json_keys(props), field) - 1 AS pos, json_type(props, '$."' || field || '"') AS t,
  json_extract_string(props, '$."' || field || '"') AS s FROM f),
g AS (SELECT field, pos, s, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN t = 'VARCHAR' THEN 'string'
  ELSE lower(t) END AS kind FROM v)
SELECT field, count(*) AS present, count(*) FILTER (kind = 'null') AS nulls,
  (SELECT string_agg(DISTINCT kind, '|' ORDER BY kind) FROM g g2 WHERE g2.field = g.field) AS types,
  max(CASE WHEN kind = 'string' THEN length(s) END)::INT AS max_length, min(pos)::INT AS ordinal,
  (SELECT count(props) FROM documents_after) AS documents,
  count(*) < (SELECT count(props) FROM documents_after) OR count(*) FILTER (kind = 'null') > 0 AS nullable
FROM g GROUP BY field""",
    "a3_sample_rows": f"SELECT * REPLACE ({times('o_orderdate')} AS o_orderdate) FROM "
                      "(SELECT * FROM orders ORDER BY md5(o_orderkey || '|7'), o_orderkey LIMIT 100)",
    "a4_distinct_values": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL",
    "a5_top_values": "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    "a6_write_results": RULES + " SELECT DISTINCT run_id FROM rules",
    "a7_read_results": RULES + " SELECT * FROM rules WHERE run_id = 'faulty'",
    "a7_numeric_run_ids": """SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS run_id, n_name AS "column", 'PASS' AS status
FROM nation""",
    "a8_checkpoint_upsert": LATEST,
    "a8_checkpoint_log": LATEST,

    "b1_row_count_reconcile": TARGET + f""", n AS (SELECT (SELECT count(*) FROM orders) AS n_source,
  (SELECT count(*) FROM target) AS n_target)
SELECT *, round(abs(n_target - n_source) * 100.0::DOUBLE / n_source, 6) AS diff_pct, n_source = 0 AS source_empty,
  {case(("n_source = n_target", "PASS", "HIGH"), ("abs(n_target - n_source) * 100.0 / n_source <= 1.0", "WARN", "MEDIUM"),
        otherwise=("FAIL", "HIGH"))} FROM n""",
    "b2_table_fingerprint": fingerprint(ITEM_COLUMNS, "lineitem", "md5"),
    "b2_compare_fingerprint": TARGET + f""", s AS ({fingerprint(ORDER_COLUMNS, "orders", "sha256")}),
t AS ({fingerprint(ORDER_COLUMNS, "target", "sha256")})
SELECT s.n_rows AS source_n_rows, s.fingerprint AS source_fingerprint, t.n_rows AS target_n_rows,
  t.fingerprint AS target_fingerprint, {case(("s.fingerprint <> t.fingerprint", "FAIL", "HIGH"))} FROM s, t""",
    "b3_column_catalog": TARGET + union([
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{k}' AS data_type, NULL::INT AS declared_length, "
        f"count(*) AS total_count, count(*) - count({c}) AS null_count, "
        + (f"max(length({c}))::INT" if k == "string" else "NULL::INT") + " AS max_length, "
        + (f"max(length(split_part(abs({c})::VARCHAR::DECIMAL(38,10)::VARCHAR, '.', 1)))::INT AS max_digits, "
           f"max(length(rtrim(split_part(abs({c})::VARCHAR::DECIMAL(38,10)::VARCHAR, '.', 2), '0')))::INT AS max_scale"
           if k in ("bigint", "double") else "NULL::INT AS max_digits, NULL::INT AS max_scale") + " FROM target"
        for i, (c, k) in enumerate(ORDER_COLUMNS.items(), 1)]),
    "b3_schema_compatibility": TARGET + ", s AS (" + union(
        [f"SELECT '{c}' AS c, {i} AS o, '{k}' AS t, count({c}) AS v FROM orders"
         for i, (c, k) in enumerate(ORDER_COLUMNS.items(), 1)]) + "), t AS (" + union(
        [f"SELECT '{c}' AS c, {i} AS o, '{k}' AS t, count(\"{c}\") AS v FROM target_v2"
         for i, (c, k) in enumerate(V2_COLUMNS.items(), 1)]) + f"""),
j AS (SELECT lower(coalesce(s.c, t.c)) AS name, s.c AS source_column, s.o AS source_ordinal, s.t AS source_data_type,
  s.v AS source_values, t.c AS target_column, t.o AS target_ordinal, t.t AS target_data_type, t.v AS target_values,
  CASE WHEN t.c IS NULL THEN 'missing' WHEN s.c IS NULL THEN 'extra' WHEN s.o <> t.o THEN 'moved'
    WHEN s.v > 0 AND t.v = 0 THEN 'emptied' END AS issue FROM s FULL JOIN t ON lower(s.c) = lower(t.c))
SELECT *, {case(("issue IS NOT NULL", "FAIL", "HIGH"))} FROM j""",
    "b4_schema_drift": TARGET + ", s AS (" + union(
        [f"SELECT lower('{c}') AS name FROM orders HAVING count({c}) > 0" for c in ORDER_COLUMNS]) + "), t AS (" + union(
        [f"SELECT lower('{c}') AS name FROM target_v2 HAVING count(\"{c}\") > 0" for c in V2_COLUMNS]) + """)
SELECT name, 'added' AS change, 'FAIL' AS status, 'HIGH' AS severity FROM t WHERE name NOT IN (SELECT name FROM s)
UNION ALL SELECT name, 'removed', 'FAIL', 'HIGH' FROM s WHERE name NOT IN (SELECT name FROM t)""",
    "b4_field_drift": EVENT_DOCUMENTS + """, s AS (SELECT DISTINCT unnest(json_keys(props)) AS name FROM events),
t AS (SELECT DISTINCT unnest(json_keys(props)) AS name FROM documents_after)
SELECT name, 'added' AS change, 'FAIL' AS status, 'HIGH' AS severity FROM t WHERE name NOT IN (SELECT name FROM s)
UNION ALL SELECT name, 'removed', 'FAIL', 'HIGH' FROM s WHERE name NOT IN (SELECT name FROM t)""",
    "b5_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "b6_orphaned_keys": TARGET + f""", o AS (SELECT o_custkey, o_custkey NOT IN (SELECT c_custkey FROM customer) AS lost
  FROM target WHERE o_custkey IS NOT NULL),
m AS (SELECT count(*) AS checked_rows, count(*) FILTER (lost) AS orphaned_rows,
  count(DISTINCT o_custkey) FILTER (lost) AS orphaned_keys FROM o)
SELECT *, {case(("orphaned_rows > 0", "FAIL", "HIGH"))} FROM m""",
    "b6_orphaned_rows": TARGET + """ SELECT o_orderkey, o_custkey FROM target LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_custkey IS NOT NULL AND c_custkey IS NULL""",
    "b7_constraint_check": TARGET + ", v AS (" + union([
        *[f"SELECT 'not_null({c})' AS \"constraint\", 'NOT NULL' AS kind, {MISSING.format(c)} AS violations FROM target"
          for c in ("o_orderkey", "o_orderdate", "o_orderpriority")],
        "SELECT 'price_positive', 'CHECK', count(*) FILTER (NOT o_totalprice > 0) FROM target",
        "SELECT 'status_known', 'CHECK', count(*) FILTER (NOT o_orderstatus IN ('O', 'F', 'P')) FROM target",
        "SELECT 'primary_key(o_orderkey)', 'PRIMARY KEY', count(*) - count(DISTINCT o_orderkey) FROM target",
        "SELECT 'unique(o_custkey, o_orderdate)', 'UNIQUE', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n "
        "FROM target WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, o_orderdate)",
        "SELECT 'fk_customer', 'FOREIGN KEY', count(*) FROM target WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    ]) + f""") SELECT *, {case(("violations > 0 AND kind IN ('PRIMARY KEY', 'FOREIGN KEY')", "FAIL", "HIGH"),
                             ("violations > 0", "FAIL", "MEDIUM"))} FROM v""",
    "b8_volume_check": TARGET + f""", n AS (SELECT count(*) AS n_rows, 15000::BIGINT AS baseline_rows,
  abs(count(*) - 15000) * 100.0::DOUBLE / 15000 AS d FROM target)
SELECT n_rows, baseline_rows, round(d, 6) AS deviation_pct,
  {case(("n_rows = 0", "FAIL", "HIGH"), ("d > 10", "FAIL", "MEDIUM"))} FROM n""",

    "c1_column_stats": TARGET + column_stats(ORDER_COLUMNS, "target"),
    "c1_column_stats_items": "SELECT * REPLACE (round(mean, 4) AS mean) FROM ("
    + column_stats(ITEM_COLUMNS, "lineitem", digits=9) + ")",
    "c2_null_rate_delta": TARGET + ", r AS (" + union([
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM orders) AS source_total_count, count(*) AS target_total_count, "
        f"(SELECT {MISSING.format(c)} * 100.0::DOUBLE / count(*) FROM orders) AS a, "
        f"{MISSING.format(c)} * 100.0::DOUBLE / count(*) AS b FROM target" for c in ORDER_COLUMNS]) + f""")
SELECT "column", source_total_count, target_total_count, round(a, 6) AS source_null_pct, round(b, 6) AS target_null_pct,
  round(abs(b - a), 6) AS delta_pct, {case(("abs(b - a) > 1", "FAIL", "HIGH"))} FROM r""",
    "c3_cardinality_delta": TARGET + ", r AS (" + union([
        f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM orders) AS source_distinct_count, "
        f"count(DISTINCT {c}) AS target_distinct_count FROM target" for c in ORDER_COLUMNS]) + f"""),
p AS (SELECT *, abs(target_distinct_count - source_distinct_count) * 100.0::DOUBLE / source_distinct_count AS c FROM r)
SELECT * EXCLUDE (c), round(c, 6) AS change_pct, {case(("c > 10", "FAIL", "MEDIUM"))} FROM p""",
    "c4_range_drift": TARGET + ", r AS (" + union([
        f"SELECT '{c}' AS \"column\", (SELECT min({c})::VARCHAR FROM orders) AS source_min_value, "
        f"min({c})::VARCHAR AS target_min_value, (SELECT max({c})::VARCHAR FROM orders) AS source_max_value, "
        f"max({c})::VARCHAR AS target_max_value, (SELECT avg({c}) FROM orders) AS sm, avg({c}) AS tm FROM target"
        for c in NUMERIC]) + f"""),
d AS (SELECT *, source_min_value <> target_min_value AS min_changed, source_max_value <> target_max_value AS max_changed,
  abs(tm - sm) / abs(sm) * 100 AS drift FROM r)
SELECT "column", source_min_value, target_min_value, source_max_value, target_max_value, round(sm, 6) AS source_mean,
  round(tm, 6) AS target_mean, min_changed, max_changed, round(drift, 6) AS mean_drift_pct,
  {case(("min_changed OR max_changed OR drift > 5", "FAIL", "MEDIUM"))} FROM d""",
    "c5_type_compatibility": TARGET + ", r AS (" + union([
        f"SELECT '{c}' AS name, '{s}' AS source_data_type, '{t}' AS target_data_type, {need} AS needed_length, "
        f"{length} AS target_declared_length, {digits} AS lost_digits FROM orders HAVING count(*) > 0" for c, s, t, need, length, digits in (
            ("o_orderkey", "bigint", "decimal(10,0)", "NULL::INT", "NULL::INT",
             "greatest(max(length(o_orderkey::VARCHAR)) - 10, 0)::INT"),
            ("o_custkey", "bigint", "string", "NULL::INT", "3", "0"),
            ("o_orderstatus", "string", "string", "max(length(o_orderstatus))::INT", "1", "0"),
            ("o_orderdate", "timestamp_ntz", "timestamp_ntz", "NULL::INT", "NULL::INT", "0"))]) + f"""),
l AS (SELECT *, coalesce(greatest(needed_length - target_declared_length, 0), 0)::INT AS lost_length, 0 AS lost_scale FROM r)
SELECT *, {case(("lost_length + lost_digits > 0", "FAIL", "HIGH"),
                ("source_data_type <> target_data_type", "WARN", "MEDIUM"))} FROM l""",
    "c6_whitespace_check": TARGET + ", r AS (" + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS checked_rows, count(*) FILTER ({c} <> trim({c})) AS spaced_rows, "
        f"count(DISTINCT {c}) FILTER ({c} <> trim({c})) AS spaced_values FROM target"
        for c in ("o_orderstatus", "o_orderpriority")])
        + f") SELECT *, {case(('spaced_rows > 0', 'FAIL', 'MEDIUM'))} FROM r",
    "c6_whitespace_documents": "WITH r AS (" + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS checked_rows, count(*) FILTER (regexp_matches({c}, '{p}')) AS spaced_rows, "
        f"count(DISTINCT {c}) FILTER (regexp_matches({c}, '{p}')) AS spaced_values FROM documents"
        for c in ("text", "source") for p in (r"^[\s\p{Z}\x{FEFF}\x0B]|[\s\p{Z}\x{FEFF}\x0B]$",)])
        + f") SELECT *, {case(('spaced_rows > 0', 'FAIL', 'MEDIUM'))} FROM r",
    "c7_format_consistency": CONTACTS + ", r AS (" + union([
        f"SELECT '{c}' AS \"column\", count(*) AS checked, '{f}' AS format, "
        f"avg(CASE WHEN regexp_matches({c}, '{p}') THEN 1.0 ELSE 0.0 END) AS rate "
        f"FROM (SELECT DISTINCT {c} FROM contacts WHERE {c} IS NOT NULL)"
        for c in ("c_name", "c_mktsegment", "contact", "address") for f, p in FORMAT_SQL.items()])
        + f""") SELECT "column", checked, format, round(rate, 6) AS match_rate,
  {case(("rate > 0.5 AND rate < 0.8", "WARN", "MEDIUM"))} FROM r""",

    "d1_ks_test": ks_result(paired_values(NUMERIC)),
    "d1_ks_balances": ks_result("""WITH u AS (SELECT 'balance' AS "column", c_acctbal AS v, 1 AS s, 0 AS t FROM customer
  UNION ALL SELECT 'balance', s_acctbal, 0, 1 FROM supplier)"""),
    "d1_ks_distinct": ks_result(paired_values(NUMERIC, distinct=True)),
    "d2_chi_square": chi_square(True),
    "d2_chi_square_unscaled": chi_square(False),
    "d3_iqr_outliers": f"""WITH b AS (SELECT list(value ORDER BY value) AS x FROM events WHERE value IS NOT NULL),
q AS (SELECT {quantile("x", 0.25)} AS q1, {quantile("x", 0.75)} AS q3 FROM b)
SELECT event_id, round(value, 6) AS value, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "d3_iqr_bounds_linear": "WITH q AS (" + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS sd, quantile_cont({c}, 0.25) AS q1, "
        f"quantile_cont({c}, 0.75) AS q3 FROM lineitem" for c in ("l_quantity", "l_extendedprice")]) + """)
SELECT "column", n, round(m, 6) AS mean, round(sd, 6) AS stddev, round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM q""",
    "d4_zscore": """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
  / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z_score FROM customer""",
    "d4_zscore_outliers": """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT event_id, event_type, round((value - m) / sd, 6) AS z_score FROM events JOIN s USING (event_type)
WHERE abs((value - m) / sd) > 3""",
    "d5_outlier_rate": outlier_rate("events", ["value", "user_id"], False),
    "d5_outlier_rate_distinct": outlier_rate("lineitem", ["l_extendedprice", "l_tax"], True),
    "d6_drift_score": ks(paired_values(["o_totalprice", "o_custkey"])) + ", sm AS (" + union(
        [moments(c, "orders", "source") for c in ("o_totalprice", "o_custkey")]) + "), tm AS (" + union(
        [moments(c, "target", "target") for c in ("o_totalprice", "o_custkey")]) + """)
SELECT "column", round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS significant,
  round(source_mean, 6) AS source_mean, round(source_stddev, 6) AS source_stddev,
  round(source_median, 6)::DOUBLE AS source_median,
  round(target_mean, 6) AS target_mean, round(target_stddev, 6) AS target_stddev,
  round(target_median, 6)::DOUBLE AS target_median,
  round(least(1.0, 0.5 * statistic + 0.3 * abs(target_mean - source_mean) / abs(source_mean)
    + 0.2 * abs(target_stddev - source_stddev) / source_stddev), 6) AS drift_score
FROM p JOIN sm USING ("column") JOIN tm USING ("column")""",
    "d7_frequency_shift": TARGET + ", " + frequencies("o_orderstatus", "orders", "target", "fetched") + SHIFTS,
    "d7_frequency_shift_dates": TARGET + """, ms AS (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders),
mt AS (SELECT strftime(o_orderdate, '%Y-%m') AS month FROM target), """ + frequencies("month", "ms", "mt", "table") + SHIFTS,
    "d7_frequency_verdict": TARGET + ", " + frequencies("o_orderpriority", "orders", "target", "fetched") + f""",
m AS (SELECT count(*) AS "values", count(*) FILTER (shift > 0.001) AS shifted_values,
  round(max(shift), 6) AS largest_shift FROM shifts)
SELECT *, {case(("shifted_values > 5", "FAIL", "MEDIUM"), ("shifted_values > 0", "WARN", "MEDIUM"))} FROM m""",
    "d8_distribution_summary": "WITH b AS (" + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS sd, skewness({c}) AS k, "
        f"list({c} ORDER BY {c}) AS x FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
        + f"""), q AS (SELECT *, {quantile("x", 0.25)} AS a, {quantile("x", 0.5)} AS b, {quantile("x", 0.75)} AS c FROM b)
SELECT "column", n, round(m, 4) AS mean, round(sd, 6) AS stddev, round(k, 6) AS skewness, round(a, 6) AS q1,
  round(b, 6) AS median, round(c, 6) AS q3, round(c - a, 6) AS iqr FROM q""",

    "e1_with_similarity": f"""SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance,
  round({SIMILARITY.format(a="p_name", b="p_type")}, 6) AS similarity FROM part""",
    "e2_fuzzy_match": f"""WITH s AS (SELECT DISTINCT url AS a FROM pages WHERE url IS NOT NULL),
t AS (SELECT DISTINCT replace(regexp_replace(url, '^http:', 'https:'), '#top', '') AS b FROM pages WHERE url IS NOT NULL),
p AS (SELECT a, b, levenshtein(a, b) AS distance, row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) AS k
  FROM s, t),
m AS (SELECT a, b, distance, {SIMILARITY.format(a="a", b="b")} AS sim FROM p WHERE k = 1)
SELECT a AS source_value, b AS target_value, distance::INT AS distance, round(sim, 6) AS similarity FROM m
WHERE sim >= 0.85 AND sim < 1""",
    "e3_fuzzy_pairs": """WITH v AS (SELECT DISTINCT p_name AS v FROM part WHERE p_name IS NOT NULL)
SELECT x.v AS a, y.v AS b, levenshtein(x.v, y.v)::INT AS distance FROM v x JOIN v y ON x.v < y.v
WHERE levenshtein(x.v, y.v) <= 3""",
    "e3_fuzzy_duplicates": greedy("part", "p_name")
    + "SELECT leader, value, distance::INT AS distance FROM members WHERE k = 1",
    "e3_fuzzy_groups_names": greedy("customer", "c_name") + f"""SELECT leader, count(*) + 1 AS size,
  min(distance)::INT AS distance, {case(otherwise=("FAIL", "MEDIUM"))} FROM members WHERE k = 1 GROUP BY leader""",
    "e4_column_mapping": column_mapping(),

    "f1_reconcile_keys": TARGET + ", s AS (SELECT o_orderkey FROM orders), t AS (SELECT o_orderkey FROM target)"
    + reconcile("o_orderkey"),
    "f1_key_presence": TARGET + """, s AS (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT o_orderkey, count(*) AS n FROM target GROUP BY 1)
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.n, 0) AS n_source, coalesce(t.n, 0) AS n_target,
  CASE WHEN t.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' ELSE 'matched' END AS presence
FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey""",
    "f1_missing_rows": TARGET + f""" SELECT * REPLACE ({times('o_orderdate')} AS o_orderdate) FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)""",
    "f1_extra_rows": TARGET + f""" SELECT * REPLACE ({times('o_orderdate')} AS o_orderdate) FROM target
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "f1_reconcile_null_keys": TARGET + ", s AS (SELECT o_custkey, o_orderdate FROM orders), "
    "t AS (SELECT o_custkey, o_orderdate FROM target)" + reconcile("o_custkey, o_orderdate"),
    "f2_row_hash": TARGET + f" SELECT o_orderkey, md5({row_text(ORDER_COLUMNS)}) AS row_hash FROM target",
    "f2_row_hash_sha256": "SELECT doc_id, sha256(" + row_text(
        {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"})
    + ") AS row_hash FROM documents",
    "f3_chunk_hash_range": chunk_digests("o_orderkey // 500"),
    "f3_chunk_hash_hash": chunk_digests("('0x' || substr(md5(o_orderkey::VARCHAR), 1, 12))::BIGINT % 64"),
    "f3_chunk_hash_rank": rank_chunks(),
    "f4_duplicate_excess": TARGET + f""", m AS (SELECT count(*) AS duplicate_keys, sum(n - 1)::BIGINT AS excess_rows
  FROM (SELECT count(*) AS n FROM target GROUP BY o_orderkey HAVING count(*) > 1))
SELECT *, {case(("duplicate_keys > 0", "FAIL", "HIGH"))} FROM m""",
    "f5_reconcile_increment": TARGET + """, a AS (SELECT floor(avg(o_orderkey)) AS low, max(o_orderkey) AS high FROM orders),
s AS (SELECT o_orderkey FROM orders, a WHERE o_orderkey > low AND o_orderkey <= high),
t AS (SELECT o_orderkey FROM target, a WHERE o_orderkey > low AND o_orderkey <= high)""" + reconcile("o_orderkey"),
    "f5_increment_composite": """WITH s AS (SELECT l_orderkey, l_linenumber FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 7 = 0 AND l_linenumber = 2))"""
    + reconcile("l_orderkey, l_linenumber"),
    "b2_fingerprint_types": """SELECT count(*) AS source_n_rows, count(*) AS target_n_rows, 'PASS' AS status,
  'HIGH' AS severity FROM orders""",
    "c4_range_types": """SELECT 'o_totalprice' AS "column", false AS min_changed, false AS max_changed, 'PASS' AS status,
  'HIGH' AS severity FROM orders HAVING count(*) > 0""",
    "c5_narrowing": f"""WITH r AS (SELECT 'big' AS name, 'bigint' AS source_data_type,
  CASE WHEN max(o_orderkey) * 1000000 > 2147483647 THEN greatest(max(length((o_orderkey * 1000000)::VARCHAR)) - 10, 1)
    ELSE 0 END::INT AS lost_digits, 0 AS lost_scale FROM orders
  UNION ALL SELECT 'small', 'bigint', 0, 0
  UNION ALL SELECT 'price', 'double', 0, max(length(rtrim(split_part(o_totalprice::VARCHAR, '.', 2), '0')))::INT FROM orders)
SELECT *, 'int' AS target_data_type, NULL::INT AS needed_length, NULL::INT AS target_declared_length, 0 AS lost_length,
  {case(("lost_digits + lost_scale > 0", "FAIL", "HIGH"), otherwise=("WARN", "MEDIUM"))} FROM r""",
    "g3_pii_line_numbers": pii_scan("(SELECT concat_ws(' ', 'line', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
                                    "strftime(l_shipdate, '%Y%m%d')) AS note FROM lineitem)", ["note"]),
    "g3_pii_cards": pii_scan("(SELECT 'n ' || c_custkey || ' ' || (4000000000000000 + c_custkey * 7) || ' 12345678' AS note "
                             "FROM customer)", ["note"]),
    "f5_increment_null_keys": TARGET + """,
s AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey ELSE -1 END AS k FROM orders),
t AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey ELSE -1 END AS k FROM target)""" + reconcile("k"),
    "f5_stream_reconcile": TARGET + """ SELECT CASE WHEN o_orderkey IN (SELECT o_orderkey FROM target) THEN 'matched'
  ELSE 'missing' END AS presence, count(DISTINCT o_orderkey) AS keys, count(*) AS source_rows FROM orders GROUP BY 1""",

    "f5_stream_two_batches": TARGET + """, s AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey FROM orders),
k AS (SELECT o_orderkey, count(*) AS n FROM s GROUP BY o_orderkey),
t AS (SELECT DISTINCT o_orderkey FROM target),
p AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.o_orderkey IS NOT DISTINCT FROM k.o_orderkey) THEN 'matched'
  ELSE 'missing' END AS presence, n FROM k)
SELECT presence, count(*) AS keys, sum(n)::BIGINT AS source_rows FROM p GROUP BY presence
UNION ALL SELECT 'extra' AS presence, count(*) AS keys, 0::BIGINT AS source_rows FROM t
  WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.o_orderkey IS NOT DISTINCT FROM t.o_orderkey) HAVING count(*) > 0""",

    "g1_business_rules": TARGET + ", r AS (" + union([
        f"SELECT '{name}' AS rule_name, round((SELECT {e} FROM orders)::DOUBLE, 2) AS s, round({e}::DOUBLE, 2) AS t FROM target"
        for name, e in (("order_count", "count(*)"), ("total_revenue", "sum(o_totalprice)"),
                        ("avg_order_value", "avg(o_totalprice)"),
                        ("finished_ratio", "(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*))"),
                        ("largest_order", "max(o_totalprice)"))]) + f"""),
d AS (SELECT *, CASE WHEN s = t THEN 0.0 ELSE abs(t - s) / abs(s) * 100 END AS drift FROM r)
SELECT rule_name, s AS source_value, t AS target_value, round(drift, 6) AS drift_pct,
  {case(("drift > 0.1", "FAIL", "HIGH"))} FROM d""",
    "g1_rule_query": TARGET + f""", r AS (
  SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))::DOUBLE AS s,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM target GROUP BY o_custkey))::DOUBLE AS t)
SELECT 'busiest_customer' AS rule_name, s AS source_value, t AS target_value,
  round(abs(t - s) / s * 100, 6) AS drift_pct, {case(("s <> t", "FAIL", "HIGH"))} FROM r""",
    "g2_temporal_order": f"""WITH m AS (SELECT 'o_orderdate' AS earlier, 'l_shipdate' AS later, count(*) AS checked_rows,
  count(*) FILTER (o_orderdate > l_shipdate) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT *, {case(("violations > 0", "FAIL", "MEDIUM"))} FROM m""",
    "g3_pii_scan": pii_scan("documents", ["text", "lang", "source"]),
    "g3_pii_conversations": pii_scan("conversations", ["role", "text"]),
    "g3_pii_risk": CONTACTS + ", cells AS (" + pii_cells("contacts", ["c_name", "c_mktsegment", "contact", "address"]) + """),
f AS (SELECT risk FROM cells WHERE matching_rows > 0 UNION ALL SELECT 'MEDIUM' UNION ALL SELECT 'MEDIUM')
SELECT CASE WHEN count(*) FILTER (risk = 'HIGH') > 0 THEN 'HIGH' WHEN count(*) FILTER (risk = 'MEDIUM') > 0 THEN 'MEDIUM'
  WHEN count(*) > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level, count(*) AS findings FROM f""",

    "h1_freshness": f"""WITH m AS (SELECT max(ts) AS newest FROM events)
SELECT 'ts' AS "column", {times("newest")} AS newest, round({hours(EVENTS_AS_OF, "newest")}, 6) AS age_hours,
  {case((f"{hours(EVENTS_AS_OF, 'newest')} > 24", "FAIL", "MEDIUM"))} FROM m""",
    "h1_freshness_by_type": f"""WITH m AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1)
SELECT event_type, 'ts' AS "column", {times("newest")} AS newest, round({hours(EVENTS_AS_OF, "newest")}, 6) AS age_hours,
  {case((f"{hours(EVENTS_AS_OF, 'newest')} > 48", "FAIL", "MEDIUM"))} FROM m""",
    "h2_future_timestamps": TARGET + f""", m AS (SELECT 'o_orderdate' AS "column", count(*) AS total_count,
  count(*) FILTER (o_orderdate > {AS_OF}) AS future_count FROM target)
SELECT *, {case(("future_count > 0", "FAIL", "HIGH"))} FROM m""",
    "h3_pipeline_lag": TARGET + f""", m AS (SELECT max(loaded_at) AS newest,
  max(epoch_us(loaded_at) - epoch_us(o_orderdate)) / 60000000.0::DOUBLE AS worst,
  avg(epoch_us(loaded_at) - epoch_us(o_orderdate)) / 60000000.0::DOUBLE AS typical FROM target_v2)
SELECT 'loaded_at' AS "column", {times("newest")} AS newest, round(worst, 6) AS max_delay_minutes,
  round(typical, 6) AS avg_delay_minutes, round({hours(AS_OF, "newest")} * 60, 6) AS lag_minutes,
  {case((f"{hours(AS_OF, 'newest')} * 60 > 15", "FAIL", "HIGH"))} FROM m""",
    "h4_null_timestamps": TARGET + ", m AS (" + union([
        f"SELECT '{c}' AS \"column\", count(*) AS total_count, {MISSING.format(c)} AS null_count FROM target_v2"
        for c in ("o_orderdate", "loaded_at")]) + f""")
SELECT *, round(null_count * 100.0::DOUBLE / total_count, 6) AS null_pct, {case(("null_count > 0", "FAIL", "MEDIUM"))} FROM m""",
    "h5_stale_data": f"""WITH m AS (SELECT o_orderpriority, min(o_orderdate) AS oldest FROM orders GROUP BY 1)
SELECT o_orderpriority, 'o_orderdate' AS "column", {times("oldest")} AS oldest,
  round({hours(AS_OF, "oldest")}, 6) AS age_hours, {case((f"{hours(AS_OF, 'oldest')} > 24 * 720", "WARN", "MEDIUM"))} FROM m""",

    "i1_row_count": checks(TARGET, [("row_count > 0", "count(*)", "target", "> 0", "HIGH")]),
    "i2_missing": checks(TARGET, [
        ("missing_count(o_orderkey) = 0", MISSING.format("o_orderkey"), "target", "= 0", "HIGH"),
        ("missing_percent(o_orderpriority) < 5", MISSING.format("o_orderpriority") + " * 100.0::DOUBLE / count(*)", "target",
         "< 5", "HIGH"),
        ("missing_count(o_orderdate) = 0", MISSING.format("o_orderdate"), "target", "= 0", "HIGH")]),
    "i3_duplicates": checks(TARGET, [
        ("duplicate_count(o_orderkey) = 0", "n", DUPLICATES.format("o_orderkey", "target"), "= 0", "HIGH")]),
    "i4_invalid": checks(CONTACTS, [
        ("invalid_percent(contact) < 2", f"count(*) FILTER (NOT regexp_matches(contact, '{FORMAT_SQL['email']}')) "
         "* 100.0::DOUBLE / count(*)", "contacts", "< 2", "HIGH")]),
    "i5_required_columns": checks(TARGET, [
        ("required columns: o_orderkey, o_orderpriority, loaded_at",
         "1 + (count(o_orderkey) = 0)::INT + (count(loaded_at) = 0)::INT", "target_v2", "= 0", "HIGH")]),
    "i6_bound": checks(TARGET, [("min(o_totalprice) >= 0", "min(o_totalprice)", "target", ">= 0", "HIGH")]),
    "i7_freshness": checks("", [("freshness(ts) < 2h", hours(EVENTS_AS_OF, "max(ts)"), "events", "< 2", "MEDIUM")]),
    "i8_references": checks(TARGET, [
        ("values in (l_orderkey) must exist in orders (o_orderkey)",
         "count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM target))", "lineitem", "= 0", "HIGH")]),
    "i9_volume_anomaly": f"""WITH c AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n_rows FROM events
  GROUP BY 1),
h AS (SELECT *, count(*) OVER w AS history, avg(n_rows) OVER w AS m, stddev_samp(n_rows) OVER w AS sd FROM c
  WINDOW w AS (ORDER BY bucket RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 6 HOUR PRECEDING)),
z AS (SELECT *, CASE WHEN sd > 0 THEN (n_rows - m) / sd WHEN n_rows = m THEN 0.0 END AS z FROM h)
SELECT {times("bucket")} AS bucket, n_rows, history, round(m, 6) AS mean_rows, round(sd, 6) AS stddev_rows,
  round(z, 6) AS z_score,
  {case(("history < 3", "SKIPPED", "MEDIUM"), ("CASE WHEN sd > 0 THEN abs(z) > 3 ELSE n_rows <> m END", "FAIL", "MEDIUM"))}
FROM z""",
    "i9_volume_outage": f"""WITH f AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n FROM events
  WHERE ts::DATE <> DATE '2024-01-15' GROUP BY 1),
c AS (SELECT g.bucket, coalesce(n, 0) AS n_rows FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM f),
  (SELECT max(bucket) FROM f), INTERVAL 6 HOUR)) AS bucket) g LEFT JOIN f ON g.bucket = f.bucket),
h AS (SELECT *, count(*) OVER w AS history, avg(n_rows) OVER w AS m, stddev_samp(n_rows) OVER w AS sd FROM c
  WINDOW w AS (ORDER BY bucket RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 6 HOUR PRECEDING)),
z AS (SELECT *, CASE WHEN sd > 0 THEN (n_rows - m) / sd WHEN n_rows = m THEN 0.0 END AS z FROM h)
SELECT {times("bucket")} AS bucket, n_rows, history, round(m, 6) AS mean_rows, round(sd, 6) AS stddev_rows,
  round(z, 6) AS z_score,
  {case(("history < 3", "SKIPPED", "MEDIUM"), ("CASE WHEN sd > 0 THEN abs(z) > 3 ELSE n_rows <> m END", "FAIL", "MEDIUM"))}
FROM z""",
    "i10_run_checks": checks(TARGET, [
        ("row_count > 0", "count(*)", "target", "> 0", "HIGH"),
        ("missing_count(o_orderkey) = 0", MISSING.format("o_orderkey"), "target", "= 0", "HIGH"),
        ("duplicate_count(o_orderkey) = 0", "n", DUPLICATES.format("o_orderkey", "target"), "= 0", "HIGH"),
        ("missing_percent(o_orderpriority) < 5", MISSING.format("o_orderpriority") + " * 100.0::DOUBLE / count(*)", "target",
         "< 5", "HIGH"),
        ("min(o_totalprice) >= 0", "min(o_totalprice)", "target", ">= 0", "HIGH"),
        ("freshness(o_orderdate) < 2h", hours(AS_OF, "max(o_orderdate)"), "target", "< 2", "MEDIUM"),
        ("required columns: o_orderkey, o_custkey", "(count(o_orderkey) = 0)::INT + (count(o_custkey) = 0)::INT", "target",
         "= 0", "HIGH"),
        ("values in (o_custkey) must exist in customer (c_custkey)",
         "count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer))", "target", "= 0", "HIGH")]),

    "j1_rollup": RULES + f", c AS (SELECT run_id, stage, {COUNTS} FROM rules GROUP BY 1, 2) SELECT *, {STATUS} AS status FROM c",
    "j2_go_live": RULES + f""", c AS (SELECT run_id, {COUNTS} FROM rules GROUP BY 1)
SELECT *, {STATUS} AS overall_status, high_failures > 0 AS go_live_blocked,
  CASE WHEN high_failures > 0 THEN 'BLOCK' WHEN medium_failures > 0 OR rules_warned > 0 THEN 'PROCEED_WITH_CAUTION'
    ELSE 'PROCEED' END AS recommendation FROM c""",
    "j3_top_failures": RULES + """, f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
  CASE severity WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, "table", "column" NULLS FIRST, rule, stage)::INT AS position
  FROM rules WHERE status = 'FAIL' AND severity IN ('HIGH', 'MEDIUM'))
SELECT run_id, position, stage, rule, "table", "column", severity FROM f WHERE position <= 5""",
    "j3_failure_counts": RULES + """ SELECT run_id, severity, count(*) AS failures FROM rules WHERE status = 'FAIL'
GROUP BY 1, 2""",
    "j4_run_report": RULES + f""", c AS (SELECT run_id, stage, {COUNTS} FROM rules GROUP BY 1, 2),
r AS (SELECT run_id, {COUNTS} FROM rules GROUP BY 1),
o AS (SELECT run_id, {STATUS} AS overall_status, high_failures > 0 AS go_live_blocked FROM r)
SELECT run_id, overall_status, go_live_blocked, stage, {STATUS} AS status, rules_checked, rules_failed AS listed_failures
FROM c JOIN o USING (run_id)""",
    "j5_stage_gate": gate("high_failures > 0"),
    "j5_stage_gate_audit": gate("false"),
}
