"""The queries that SQL can express, in DuckDB SQL written from their definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Kind, pattern, group whose length counts (0: the whole match) and least length, as in the contract; base kinds first.
SECRETS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
]


def _matches(at: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: lengths of the matches and of the pieces between them, added up."""
    return f"""SELECT doc_id, {at} AS k, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
      SELECT doc_id, m, v, sum(length(p) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
        SELECT doc_id, i, m, v, p, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
          SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v,
            unnest(ps[:len(ms)]) AS p FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs,
              regexp_split_to_array(t, '{pattern}') AS ps FROM d))))
      WHERE length(v) >= {least}"""


def _secrets() -> str:
    parts = "\n  UNION ALL ".join(_matches(i, *x) for i, x in enumerate(SECRETS))
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k){}, '')"
    base = " FILTER (k < 3)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({parts})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, sha256({joined.format(base)}) AS base_sha256, {joined.format('')} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLES["op1_secret_ledger"] = _secrets()

ORACLES["op7_url_filter"] = """WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'),
  ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
  ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0
  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fits AS (SELECT v.r, h || p AS rule, verdict, row_number() OVER (PARTITION BY v.r ORDER BY length(h || p) DESC,
    length(h) DESC, verdict DESC) AS place
  FROM v JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM v LEFT JOIN fits ON v.r = fits.r AND place = 1"""

ORACLES["op6_poisson_mixing"] = """WITH sizes AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size
  FROM documents GROUP BY source),
rates AS (SELECT source, pow(size::DOUBLE, 0.5) / sum(pow(size::DOUBLE, 0.5)) OVER () * sum(size) OVER () / size AS rate
  FROM sizes),
parts AS (SELECT source, rate, greatest(ceil(rate / 8.0), 1)::BIGINT AS steps FROM rates),
terms AS (SELECT source, k, exp(-rate / steps) * pow(rate / steps, k) / factorial(k::INTEGER) AS p
  FROM parts, (SELECT unnest(range(0, 33)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS up_to FROM terms),
draws AS (SELECT doc_id, source, i, ('0x' || substr(md5('11|' || doc_id || '|' || i), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents JOIN parts USING (source), unnest(range(1, steps + 1)) AS t(i)),
counts AS (SELECT doc_id, count(k) AS n FROM draws LEFT JOIN cdf ON draws.source = cdf.source AND up_to <= u
  GROUP BY doc_id)
SELECT d.*, copy, md5('order11|' || doc_id || '|' || copy) AS shuffle_key
FROM documents d JOIN counts USING (doc_id), unnest(range(0, n)) AS t(copy)"""

ORACLES["op12_four_russians_negatives"] = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10
    ELSE label END AS lab, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.lab AS alab, v.vec_id, v.lab, list_dot_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, alab, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE lab = alab AND vec_id <> anchor_id QUALIFY positive_rank <= 5),
neg AS (SELECT p.anchor_id, positive_id, positive_rank, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND s.lab <> p.alab AND 30 * positive_score <= 100 * s.score
    AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score,
  positive_rank::INTEGER AS positive_rank FROM neg"""

_WORDS = ("list_distinct(list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))")

ORACLES["op13_imatch_fingerprints"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(t)) AS r, count(*) OVER () AS total
  FROM d),
e AS (SELECT o.doc_id, o.r, o.total, o.t, length(o.t) AS n_chars, CASE WHEN o.r = o.total THEN 1 ELSE o.r + 1 END AS nr,
    substring(o.t, 1, length(o.t) - length(o.t) // 2) || substring(nx.t, 1, length(o.t) // 2) AS et
  FROM o JOIN o nx ON nx.r = CASE WHEN o.r = o.total THEN 1 ELSE o.r + 1 END),
w AS (SELECT r, 0 AS kind, unnest({_WORDS.format('t')}) AS w FROM e
  UNION ALL SELECT r, 1 AS kind, unnest({_WORDS.format('et')}) AS w FROM e),
lex AS (SELECT w FROM w WHERE kind = 0 GROUP BY w HAVING count(*) >= 2 AND count(*) <= 0.1 * (SELECT count(*) FROM e)),
js AS (SELECT unnest(range(0, 5)) AS j),
m AS (SELECT w.r, w.kind, js.j, ('0x' || substr(md5(w.w), 1, 15))::BIGINT AS t FROM w JOIN lex USING (w) CROSS JOIN js
  WHERE js.j = 0 OR ('0x' || substr(md5(js.j || ':' || ('0x' || substr(md5(w.w), 1, 15))::BIGINT), 1, 4))::INTEGER
    >= 65536.0 / 3),
agg AS (SELECT r, kind, j, string_agg(t::VARCHAR, ' ' ORDER BY t) AS s FROM m GROUP BY r, kind, j),
sig AS (SELECT e.r, k.kind, js.j, sha256(coalesce(agg.s, '')) AS h FROM e CROSS JOIN (VALUES (0), (1)) k(kind)
  CROSS JOIN js LEFT JOIN agg ON agg.r = e.r AND agg.kind = k.kind AND agg.j = js.j),
fp AS (SELECT r, kind, string_agg(h, ':' ORDER BY j) AS f FROM sig GROUP BY r, kind),
ne AS (SELECT a.r, (count(*) FILTER (WHERE a.h = b.h) / 5.0)::DOUBLE AS near_edited FROM sig a JOIN sig b
  ON a.r = b.r AND a.j = b.j AND a.kind = 0 AND b.kind = 1 GROUP BY a.r),
nn AS (SELECT e.r, (count(*) FILTER (WHERE a.h = b.h) / 5.0)::DOUBLE AS near_next FROM e JOIN sig a ON a.r = e.r
  AND a.kind = 0 JOIN sig b ON b.r = e.nr AND b.kind = 0 AND b.j = a.j GROUP BY e.r)
SELECT e.doc_id, e.n_chars, sha256(e.et) AS edited_sha256, f0.f AS fingerprint, f1.f AS edited_fingerprint,
  near_edited, near_next
FROM e JOIN fp f0 ON f0.r = e.r AND f0.kind = 0 JOIN fp f1 ON f1.r = e.r AND f1.kind = 1 JOIN ne ON ne.r = e.r
  JOIN nn ON nn.r = e.r"""
