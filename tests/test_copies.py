"""Similarity joins and clusters where many rows share a vector, by blocks and by broadcast, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import cluster, similarity
from threadloom.operators.similarity import _Side, near_places


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 6)).round(3)
    base[7] = 0
    vectors = base[rng.integers(0, 40, 150)]
    ids = [f"r{i:03d}" for i in range(150)]
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
    return ids, vectors, np.round(unit @ unit.T, 6)


@pytest.fixture(scope="module")
def df(spark, rows):
    kinds = "tuv"
    return spark.createDataFrame([(i, [float(x) for x in v], kinds[k % 3], kinds[k % 2]) for k, (i, v) in enumerate(zip(*rows[:2], strict=True))], "id string, embedding array<double>, entity_type string, other string")


def test_blocks_of_one_derived_table(spark, rows, df):
    """A table derived by expressions, joined with itself by blocks: the plan named one column twice."""
    x = rows[1]
    x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= 0.65
    for how in ({}, {"values": 0, "block": 16}):
        got = {r["id"]: (r["cluster"], r["core"]) for r in cluster.density_clusters(cluster.standardised(df), 0.35, 3, **how).collect()}
        core = near.sum(1) >= 3
        assert {i for i, (_, c) in got.items() if c} == {rows[0][k] for k in np.flatnonzero(core)}
        for a, b in zip(*np.nonzero(near & core & core[:, None]), strict=True):
            assert got[rows[0][a]][0] == got[rows[0][b]][0]


@pytest.mark.parametrize("how", [{}, {"values": 0, "block": 16}])
def test_pairs_of_one_type(rows, df, how):
    ids, _, s = rows
    want = {(ids[a], ids[b], "tuv"[a % 3], float(s[a, b])) for a in range(150) for b in range(a + 1, 150) if a % 3 == b % 3 and s[a, b] >= 0.1}
    got = [tuple(r) for r in similarity.same_type_pairs(df, 0.1, **how).select("a", "b", "entity_type", "similarity").collect()]
    assert len(got) == len(want) and {g[:3] for g in got} == {w[:3] for w in want}
    sims = {w[:2]: w[3] for w in want}
    assert all(abs(g[3] - sims[g[:2]]) < 2e-6 for g in got)


@pytest.mark.parametrize("how", [{}, {"values": 0, "block": 16}])
def test_best_of_copies(rows, df, how):
    ids, _, s = rows
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in similarity.searched(df, df, 4, 0.2, **how).collect())
    want = [(ids[a], r + 1, ids[b]) for a in range(150) for r, b in enumerate(sorted((b for b in range(150) if s[a, b] >= 0.2), key=lambda b: (-s[a, b], b))[:4])]
    assert got == want


@pytest.mark.parametrize("rule", ["leader", "sweep"])
def test_clusters_of_copies_in_batches(rows, df, rule):
    ids, _, s = rows
    chosen, want = [], []
    for i in range(150):
        near = [k for k in chosen if s[k, i] >= 0.3]
        if not near:
            chosen.append(i)
        want.append(i if not near else max(near, key=lambda k: (s[k, i], -k)) if rule == "leader" else near[0])
    run = {"leader": cluster.leader_clusters, "sweep": cluster.sweep_clusters}[rule]
    got = {r["id"]: r["cluster"] for r in run(df, 0.3, batch=9).collect()}
    assert got == {ids[i]: ids[k] for i, k in enumerate(want)}
    assert {r["id"] for r in cluster.without_duplicates(df, 0.3, batch=9).collect()} == {ids[i] for i in chosen}


def test_matches_of_both_directions_once(rows, df):
    entities = df.selectExpr("id", "embedding", "case entity_type when 't' then 'user' when 'u' then 'expert' else 'both' end as source_type")
    got = [tuple(r)[:2] for r in similarity.other_source_matches(entities, entities.filter("substring(id, 4, 1) in ('0', '1')"), 0.1, 2).collect()]
    assert len(got) == len(set(got))


def test_tiles_as_a_whole_product():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m = rng.normal(size=(70, 5))
    m[5] = np.nan
    side = _Side(pa.table({"id": list(range(70)), "embedding": m.tolist()}))
    assert len(side) == 69
    s = np.round(side.vectors @ side.vectors.T, 6)
    for k, least in ((None, 0.2), (3, 0.2), (3, -1.0), (100, 0.9)):
        got = {(int(a), int(b)) for i, j, _ in near_places(side, side, least, k, rows=16, block=11) for a, b in zip(i, j, strict=True)}
        floor = np.maximum(least, np.sort(s, axis=1)[:, -k][:, None] if k and k <= 69 else least)
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= floor), strict=True)}


def test_capitals_as_in_sql(spark):
    """One upper-case letter for ß, as DuckDB writes it, not two."""
    import duckdb

    from threadloom.functions.text import capital
    from threadloom.operators.themes import topic_titles

    words = ["ßerst", "élan", "ярус", "x", "", "1st", "ﬁnd", "ǆep"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string").orderBy("i").select(capital(F.col("word"))).collect()]
    assert got == [duckdb.execute("select upper(?[1]) || ?[2:]", [w, w]).fetchone()[0] for w in words]
    assert topic_titles(spark.createDataFrame([("c", 1, "ßerst")], "cluster string, place int, text string")).first()["title"] == "ẞerst"


def test_thousandths_as_in_sql(spark):
    """SQL rounds a thousand times the double: 509.49999999999994 for 0.5095."""
    import duckdb

    given = [0.509500, 0.511500, 0.234500, 0.500500, 0.512500, 0.999500, 0.2]
    rows = [(f"e{k}", [x, float(np.sqrt(1 - x * x))]) for k, x in enumerate(given)]
    edges = similarity.semantic_edges(spark.createDataFrame([("c", [1.0, 0.0])], "id string, embedding array<double>"), spark.createDataFrame(rows, "id string, embedding array<double>"), 0.1, 9)
    got = {r["target_entity_id"]: (r["confidence"], r["evidence"]) for r in edges.collect()}
    assert got == {f"e{k}": (x, duckdb.execute("SELECT printf('Semantic similarity: %.3f', round(?::DOUBLE, 3))", [x]).fetchall()[0][0]) for k, x in enumerate(given)}


def _pairs_are_sent_on(df) -> bool:
    """Whether rows that come out of the comparing tasks are shuffled, or were written before."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depths, above = [len(x) - len(x.lstrip(" :+-")) for x in lines], []
    for at in [n for n, x in enumerate(lines) if "MapInArrow" in x]:
        depth = depths[at]
        for n in range(at, -1, -1):
            if depths[n] < depth:
                depth = depths[n]
                above.append(lines[n])
    return not above or any("Exchange" in x or "Join" in x for x in above)


def test_pairs_of_copies_leave_their_task_as_rows(spark, rows, df):
    """Pairs were written for vectors, then shuffled twice to meet the copies: disk grew with the square of the rows."""
    assert not _pairs_are_sent_on(similarity.same_type_pairs(df, 0.1))
    # a class of several bundles, a row that comes twice, a vector without direction
    many = [(f"m{k:03d}", [1.0, 0.0], "t") for k in range(300)] + [("m000", [1.0, 0.0], "t"), ("n", [1.0, 0.1], "t"), ("n", [1.0, 0.1], "u"), ("z", [0.0, 0.0], "t"), ("y", [0.0, 0.0], "t")]
    got = similarity.same_type_pairs(spark.createDataFrame(many, "id string, embedding array<double>, entity_type string"), 0.1).collect()
    ids = sorted(i for i, _, kind in many if kind == "t" and i not in "yz")
    want = sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if a < b)
    assert sorted((r["a"], r["b"]) for r in got) == want
    assert {(r["entity_type"], r["similarity"], "n" in (r["a"], r["b"])) for r in got} == {("t", 1.0, False), ("t", 0.995037, True)}


def test_matches_with_copies_leave_their_task_as_rows(spark, rows):
    """All matches of an expert entity, with copies on both sides and rows that come twice."""
    ids, vectors, s = rows
    source = ["user", "expert", "both"]
    kind = "id string, embedding array<double>, source_type string"
    entities = spark.createDataFrame([(i, [float(x) for x in v], source[k % 3]) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))] * 2, kind)
    out = similarity.other_source_matches(entities, entities.filter("source_type = 'expert'"), 0.1)
    assert not _pairs_are_sent_on(out)
    got = [tuple(r) for r in out.collect()]
    want = {(ids[a], ids[b]) for a in range(150) for b in range(1, 150, 3) if a % 3 != 1 and s[a, b] >= 0.1}
    assert len(got) == len(want) and {g[:2] for g in got} == want
