"""The inverted-file index against exact search."""

import numpy as np
import pytest

from sparkrecall.operators import index as I
from sparkrecall.operators import vectors as N

MEM, ASK = "id string, user_id string, vector array<float>", "request_id string, user_id string, vector array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.6
    rows = [(f"m{k:05}", "hot" if k % 3 else f"u{k % 7}", [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [("zero", "hot", [0.0] * 24), ("none", "hot", None), ("twin-a", "hot", rows[0][2]), ("twin-b", "hot", rows[0][2])]
    memories = spark.createDataFrame(rows, MEM).repartition(4)
    queries = spark.createDataFrame([(f"q{k}", "hot", rows[k][2]) for k in range(0, 3000, 20)] + [("qz", "hot", [0.0] * 24), ("qn", "hot", None)], ASK)
    return memories, queries


def hits(df):
    return {(r["request_id"], r["id"]) for r in df.collect()}


@pytest.mark.parametrize("by_user", [False, True])
def test_recall_by_probes(spark, tables, tmp_path, by_user):
    memories, queries = tables
    I.write_index(memories, f"{tmp_path}/i")
    stored, centroids, probes = I.read_index(spark, f"{tmp_path}/i")
    assert stored.count() == memories.count() and len(centroids) == 108 and 1 < probes < 70
    memories = memories.filter("vector is not null")
    real = queries.filter("request_id not in ('qz', 'qn')")
    exact = hits(N.knn_blocks(real, memories) if by_user else N.knn_global(real, memories))
    near = hits(I.knn_index(queries, stored, centroids, probes, by_user=by_user))
    assert len(near & exact) >= 0.9 * len(exact) and not {i for _, i in near} & {"zero", "none"}
    assert hits(I.knn_index(queries, stored, centroids, len(centroids), by_user=by_user)) == exact
    fewer = len(hits(I.knn_index(queries, stored, centroids, 1, by_user=by_user)) & exact)
    assert 0 < fewer <= len(near & exact)


def test_ranks_and_ties(spark, tables):
    memories, queries = tables
    centroids, probes = I.fit_lists(memories, 8)
    got = I.knn_index(queries.filter("request_id = 'q0'"), I.listed(memories, centroids), centroids, probes, 3).orderBy("rank").collect()
    assert [(r["id"], r["rank"], round(r["score"], 6)) for r in got] == [("m00000", 1, 2.0), ("twin-a", 2, 2.0), ("twin-b", 3, 2.0)]


def test_a_hot_list_is_split(spark, tables, monkeypatch):
    """One list holds all, in chunks of 100 and blocks of 20."""
    memories, queries = tables
    centroids, probes = I.fit_lists(memories, 1)
    memories = memories.filter("vector is not null")
    monkeypatch.setattr(I, "block_hits", lambda q, m, k: N.block_hits(q, m, k, 100, 20))
    real = queries.filter("request_id not in ('qz', 'qn')")
    assert hits(I.knn_index(real, I.listed(memories, centroids), centroids, probes)) == hits(N.knn_global(real, memories))


def test_nothing(spark, tables, tmp_path):
    none = spark.createDataFrame([], MEM)
    I.write_index(none, f"{tmp_path}/i")
    centroids, probes = I.fit_lists(none)
    assert len(centroids) == 0 and I.knn_index(tables[1], I.listed(none, centroids), centroids, probes).count() == 0
    blank = spark.createDataFrame([("a", "u", None), ("b", "u", [])], MEM)
    assert len(I.fit_lists(blank)[0]) == 0 and I.listed(blank, I.fit_lists(blank)[0]).count() == 2
