"""Nearest neighbours against all pairs, and exact samples."""

import math
import random

import numpy as np

from caseloom.operators import neighbours, sampling


def vectors(seed=1, n=400, dim=8, kinds=12):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(kinds, dim))
    rows = [(i, [float(x) for x in middles[i % kinds] + 0.3 * r.normal(size=dim)]) for i in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, [x * 1e200 for x in rows[5][1]]), (n + 3, [0.0] * dim), (n + 4, None), (n + 5, []),
                   (n + 6, [float("nan")] * dim), (n + 7, [1.0] * (dim + 1))]


def brute(rows, asked, k, dim=8):
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and len(v) == dim and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    return {q: sorted(((-float(unit[q] @ v), i) for i, v in unit.items() if i != q))[:k] for q in asked if q in unit}


def test_exact_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 37)
    monkeypatch.setattr(neighbours, "QUERY_PART", 5)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.filter("vec_id % 50 = 0 OR vec_id >= 400")
    got = {}
    for x in neighbours.nearest_exact(df, queries, 5, "vec_id", "embedding", exclude_self=True).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.id, x.similarity))
    want = brute(rows, [i for i, _ in rows if i % 50 == 0 or i >= 400], 5)
    for q, best in want.items():
        mine = sorted(got[q])
        assert [s for _, _, s in mine] == sorted((s for _, _, s in mine), reverse=True)
        assert all(abs(-b[0] - m[2]) < 1e-9 for b, m in zip(best, mine)), q
    assert {i for _, i, _ in got[400]} >= {3, 401} and 403 not in got and 404 not in got


def test_index_finds_most_and_files_every_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 16)
    rows = vectors(2, 900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = neighbours.build_index(df, "vec_id", "embedding")
    assert index.table.count() == 903 and index.table.select("id").distinct().count() == 903 and index.sizes.agg({"parts": "max"}).first()[0] > 1
    found = neighbours.search(index, df, 5, "vec_id", "embedding", exclude_self=True)
    assert found.groupBy("query_id").count().filter("count <> 5").count() == 0
    exact = neighbours.nearest_exact(df, df.filter("vec_id % 50 = 0"), 5, "vec_id", "embedding", exclude_self=True)
    r = neighbours.recall(found, exact).first()
    assert r.n_queries == 19 and r.recall >= 0.9 and index.probes < len(index.centroids)
    none = neighbours.build_index(df.limit(0), "vec_id", "embedding")
    assert neighbours.search(index, df.limit(0), 5, "vec_id", "embedding").count() == 0 and none.table.count() == 0


def test_samples_are_exact_and_nested(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", rng.choice(["a"] * 30 + ["b", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, s string").repartition(5)
    small, large = ({(r.key, r.s) for r in sampling.stratified_sample(df, "s", "key", n).collect()} for n in (50, 400))
    sizes = {s: sum(x == s for _, x in rows) for s in ("a", "b", None)}
    for n, got in ((50, small), (400, large)):
        assert len(got) == n
        assert all(abs(sum(x == s for _, x in got) - n * size / 3000) < 1 for s, size in sizes.items())
    assert small <= large
    assert sampling.stratified_sample(df, "s", "key", 10_000).count() == 3000 and sampling.stratified_sample(df.limit(0), "s", "key", 5).count() == 0
    plan = sampling.stratified_sample(df, "s", "key", 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task cuts its rows before the shuffle
    assert math.isclose(sum(r["take"] for r in sampling.allocate(df.groupBy(df.s.alias("stratum")).count().withColumnRenamed("count", "n"), 7).collect()), 7)


def test_a_vector_leaves_python_once_for_all_its_lists(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id long, v array<double>")
    centroids = np.eye(3)
    filed = neighbours._nearest_lists(rows, centroids, 2)
    plan = filed._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(lists" in plan and "MapInPandas" in plan
    got = {}
    for r in filed.collect():
        got.setdefault(r.id, []).append(r.list)
    want = {}
    for r in rows.collect():
        score = centroids @ np.array(r.v)
        want[r.id] = sorted(np.argsort(-score, kind="stable")[:2].tolist())
    assert {i: sorted(x) for i, x in got.items()} == want
