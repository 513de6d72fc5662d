"""Whitening, hard negatives and I-Match fingerprints against brute force: nulls, non-finite entries, repeats, ties,
empty tables and clashing column names."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.llm import hard_negatives, imatch, whitening
from plumbline.llm.oracles import ORACLES

EMB = "vec_id long, embedding array<float>, label int, _y string, _key int, component string, _row int"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "c", 2) for i, v, l in rows], EMB)


def random_rows(n, d, seed=3, scale=0.2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) * scale * np.linspace(1.5, 0.2, d)
    return [(i, [float(np.float32(x)) for x in base[i]], int(rng.integers(0, 4))) for i in range(n)]


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    n, s = len(x), x.sum(0)
    xc = x - s / n
    w, u = np.linalg.eigh(xc.T @ xc / n)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    dev = [int(sum(int(t) ** 2 for t in (n * row - s).astype(np.int64))) for row in x]
    return w, (xc @ u) / np.sqrt(w), dev, np.trace(xc.T @ xc / n)


@pytest.mark.parametrize("d,k", [(3, 32), (48, 8)])
def test_whitening_against_eigh(spark, d, k):
    rows = random_rows(300, d)
    rows += [(900, None, 1), (901, [0.1] * (d - 1) + [float("nan")], 1), (902, [None] * d, 1),
             (903, [float("inf")] * d, 1), (None, rows[0][1], 2), (5, rows[5][1], 0)]
    got = whitening.whiten(embeddings(spark, rows), components=k, guard=8).toPandas()
    kept = [r for r in rows[:300]] + [rows[-2], rows[-1]]
    w, white, dev, trace = brute_whitening([r[1] for r in kept], k)
    assert set(got["component"]) == set(range(1, min(k, d) + 1))
    assert (got["n"] == len(kept)).all()
    assert got["identity_error"].iloc[0] <= 1e-4
    per = got.sort_values("component").groupby("component").first()
    assert np.allclose(per["explained"].to_numpy(), w / trace, rtol=1e-9)
    for c in range(1, min(k, d) + 1):
        col = got[got["component"] == c].sort_values(["vec_id", "whitened"], na_position="last")
        ref = sorted(((r[0] if r[0] is not None else 1 << 62, white[i, c - 1]) for i, r in enumerate(kept)))
        ref = np.array([v for _, v in ref])
        sign = np.sign(ref @ col["whitened"].to_numpy()) or 1
        assert np.allclose(np.sort(col["whitened"].to_numpy() * sign), np.sort(ref), atol=1e-8)
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(dev)


def test_whitening_without_components(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [0.5, 0.25], 1)])).count() == 0
    assert whitening.whiten(embeddings(spark, [(i, [0.5, 0.25], 1) for i in range(5)])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None, 1), (2, [], 1)])).count() == 0


def test_whitening_pads_short_vectors(spark):
    rows = random_rows(50, 4) + [(99, [0.3], 1)]
    got = whitening.whiten(embeddings(spark, rows)).toPandas()
    padded = [r[1] for r in rows[:50]] + [[0.3, 0.0, 0.0, 0.0]]
    w, _, dev, _ = brute_whitening(padded, 4)
    assert np.allclose(np.sort(got["eigenvalue"].unique())[::-1], w, rtol=1e-9)
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(dev)


def test_four_russians_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for d in (1, 8, 13, 64):
        q = rng.integers(-300, 300, size=(40, d))
        a = rng.integers(-300, 300, size=(7, d))
        bits = 11
        got = hard_negatives.scores(hard_negatives.tables(a), hard_negatives.bit_planes(q, bits))
        assert np.array_equal(got, a @ q.T)


def brute_negatives(rows):
    kept = [(i, l, v) for i, v, l in rows if i is not None and l is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    lab = {j: (l + 1) % 10 if i % 7 == 0 else l for j, (i, l, _) in enumerate(kept)}
    d = max(len(v) for _, _, v in kept)
    q = [np.floor(256 * np.array(list(v) + [0.0] * (d - len(v)), dtype=np.float64)).astype(np.int64) for _, _, v in kept]
    out = []
    for a, (aid, _, _) in enumerate(kept):
        if aid % 100:
            continue
        sc = {j: int(q[a] @ q[j]) for j in range(len(kept))}
        order = sorted(range(len(kept)), key=lambda j: (-sc[j], kept[j][0]))
        pos = [j for j in order if lab[j] == lab[a] and kept[j][0] != aid][:5]
        for pr, p in enumerate(pos, 1):
            ps = sc[p]
            negs = [j for j in order if lab[j] != lab[a] and 30 * ps <= 100 * sc[j] <= 90 * ps][:10]
            out += [(aid, kept[p][0], r, kept[j][0], ps, sc[j], pr) for r, j in enumerate(negs, 1)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(9) * 0.3], int(rng.integers(0, 3)))
            for i in range(0, 700)]
    rows += [(1000, rows[100][1], rows[100][2]), (1001, rows[100][1], 1 - rows[100][2] % 2), (1002, None, 1),
             (None, rows[3][1], 1), (1003, rows[4][1], None), (1004, [float("nan")] * 9, 1), (100, rows[100][1], 2),
             (1005, [0.5], 0)]
    got = sorted(tuple(r) for r in hard_negatives.mine(embeddings(spark, rows)).collect())
    assert got == brute_negatives(rows)
    assert len(got) > 50


def test_hard_negatives_empty(spark):
    assert hard_negatives.mine(embeddings(spark, [])).count() == 0
    assert hard_negatives.mine(embeddings(spark, [(1, [0.1, 0.2], 1), (2, [0.3, 0.1], 1)])).count() == 0


WORDS = [f"w{i}" for i in range(60)]


def corpus():
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(WORDS[:10 + i % 50], size=int(rng.integers(5, 40)))) for i in range(60)]
    texts += [texts[3], texts[3].upper(), None, "", " \t\n", "Été \U0001F600 w1 w2", "x"]
    long = " ".join(rng.choice(WORDS, size=30_000))
    texts += [long, long]
    ids = list(range(len(texts)))
    ids[5] = 4  # a repeated id with another text
    ids[-1] = None
    return list(zip(ids, texts))


def test_imatch_against_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows],
                                 "doc_id long, text string, _t string, _rid string, _w int")
    got = imatch.fingerprints(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"),
                                            "text": [t for _, t in rows]}))
    want = con.execute(ORACLES["op13_imatch_fingerprints"]).df()
    cols = sorted(want.columns)
    got["doc_id"], want["doc_id"] = got["doc_id"].astype("Int64"), want["doc_id"].astype("Int64")
    a = got[cols].astype(str).sort_values(cols).reset_index(drop=True)
    b = want[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert a.equals(b)
    same = got[got["doc_id"].isin([3, 60])]
    assert same["fingerprint"].nunique() == 1
    assert (got["near_edited"].between(0, 1)).all() and len(got) == len(rows)


def test_imatch_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.fingerprints(docs).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["near_edited"] == 1.0 and one["n_chars"] == 5


@pytest.mark.parametrize("most", [0, 5, 1_000_000])
def test_imatch_gathers_common_terms_where_the_texts_are(spark, monkeypatch, most):
    """However few terms are broadcast the rows are the same; with all of them no row of a term is shuffled."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    plans, stored = {}, imatch.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    want = sorted(map(str, imatch.fingerprints(docs).collect()))
    monkeypatch.setattr(imatch, "stored", watched)
    monkeypatch.setattr(imatch, "FREQUENT_BROADCAST", most)
    assert sorted(map(str, imatch.fingerprints(docs).collect())) == want
    if most == 1_000_000:
        assert "Exchange hashpartitioning" not in plans["imatch-signed"].split("Generate explode")[0]
