import random

import numpy as np
import pytest

from sparkrecall.llm import gam
from tests.llm.helpers import ROWS, docs, none

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_tree_and_quadrants():
    g, h = np.array([-5.0, -5, 5, 5, -1, -1]), np.full(6, 3.0)
    step = gam.tree(g, h)
    assert step[0] == step[1] > 0 > step[2] == step[3] and step[4] == step[5] > 0
    assert (gam.tree(g, h, least=100) == gam.tree(g, h, leaves=1)).all()
    grid = np.where(np.add.outer(np.arange(4) >= 2, np.arange(4) >= 1) == 1, 3.0, -3.0)
    gain, step = gam.quadrants(grid, np.ones((4, 4)))
    assert gain > 0 and (np.sign(step) == -np.sign(grid)).all()


def test_learns_additive_and_pair_effects():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(gam.FEATURES)))
    z = 2 * (x[:, 0] > 0.5) - 1 + 3 * ((x[:, 1] > 0) ^ (x[:, 2] > 0)) - 1.5
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (z[3000:] > 0)).mean() > 0.9


def test_score_is_a_sum_of_entries():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, len(gam.FEATURES))), rng.integers(0, 2, 300).astype(float)
    m = gam.fit(x, y)
    z = m.bias + sum(t[(x[5, k] >= c).sum()] for k, (c, t) in enumerate(zip(m.cuts, m.tables))) + sum(
        g[(x[5, i] >= m.coarse[i]).sum(), (x[5, j] >= m.coarse[j]).sum()] for (i, j), g in zip(m.pairs, m.grids)
    )
    assert abs(m.score(x[5:6])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_held_out(spark):
    got = {r["doc_id"]: r for r in gam.op3_gam_quality(spark, SF).collect()}
    known = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    good, bad = ([g["score"] for g, q in known if g["held_out"] and q == v] for v in (1, 0))
    assert len(bad) > 5 and np.mean([a > b for a in good for b in bad]) > 0.97
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("given", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 0), (0, 0, 0), (7, 0, 0), (99, 1, 0), (None, 1, 0), (9, None, None)]])
def test_awkward(spark, given):
    model = gam.train(docs(spark), labels(spark, given))
    got = gam.score(docs(spark), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    if not given:
        assert {r["score"] for r in got} == {0.5}
    assert gam.score(none(spark), model).count() == 0 and gam.train(none(spark), labels(spark, given)).bias == 0


def test_bound_on_training_rows(spark):
    rnd = random.Random(0)
    rows = [(k, " ".join(["ab"] * rnd.randrange(1, 30)), "en", "a") for k in range(100)]
    model = gam.train(docs(spark, rows), labels(spark, [(k, k % 2, 0) for k in range(100)]), train_rows=10)
    assert sum(len(c) for c in model.cuts) <= 10 * len(gam.FEATURES)


def plain_tree(g, h, leaves=3, least=2.0, l2=2.0):
    """The same tree by trying every split of every leaf."""
    parts, value = [list(range(len(g)))], lambda p: sum(g[i] for i in p) ** 2 / (sum(h[i] for i in p) + l2)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, p in enumerate(parts):
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if min(sum(h[i] for i in a), sum(h[i] for i in b)) >= least:
                    gain = value(a) + value(b) - value(p)
                    if gain > best[0] + 1e-12:
                        best = (gain, (k, a, b))
        if best[1] is None:
            break
        k, a, b = best[1]
        parts = [p for j, p in enumerate(parts) if j != k] + [a, b]
    out = [0.0] * len(g)
    for p in parts:
        for i in p:
            out[i] = -sum(g[j] for j in p) / (sum(h[j] for j in p) + l2)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tree_against_all_splits(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=9) * 5, rng.random(9) * 4
    assert np.allclose(gam.tree(g, h), plain_tree(g.tolist(), h.tolist()))


@pytest.mark.parametrize("seed", range(5))
def test_quadrants_against_all_cuts(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
    best = -1.0
    for i in range(1, 4):
        for j in range(1, 5):
            parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 4)) for c, d in ((0, j), (j, 5))]
            best = max(best, sum(g[p].sum() ** 2 / (h[p].sum() + 2.0) for p in parts) - g.sum() ** 2 / (h.sum() + 2.0))
    assert abs(gam.quadrants(g, h)[0] - best) < 1e-9


def test_fit_against_plain_boosting(monkeypatch):
    """Two rounds of cyclic boosting over the features, by loops over the rows."""
    monkeypatch.setattr(gam, "ROUNDS", 2)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 0)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    model = gam.fit(x, y)
    z, tables = [float(np.log(y.mean() / (1 - y.mean())))] * 60, [[0.0] * (len(c) + 1) for c in model.cuts]
    for _ in range(2):
        for k in range(3):
            at = [sum(v >= c for c in model.cuts[k]) for v in x[:, k]]
            p = [1 / (1 + np.exp(-v)) for v in z]
            size = len(tables[k])
            g = [sum(p[i] - y[i] for i in range(60) if at[i] == b) for b in range(size)]
            h = [sum(p[i] * (1 - p[i]) for i in range(60) if at[i] == b) for b in range(size)]
            step = [gam.RATE * s for s in plain_tree(g, h)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            z = [v + step[a] for v, a in zip(z, at)]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))
