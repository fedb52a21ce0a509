import random

import duckdb
import pytest

from sparkrecall.llm import mixing
from tests.llm.helpers import ROWS, docs, none


def by_sql(rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return sorted(map(str, con.sql(mixing.SQL).fetchall()))


@pytest.mark.parametrize("seed", [None, 1])
def test_same_as_sql(spark, seed):
    rows = ROWS
    if seed is not None:
        rnd = random.Random(seed)
        rows = [(k, "w " * rnd.choice([1, 5, 30, 400]), "en", rnd.choice(["a", "b", "c", "d", None])) for k in range(300)]
    got = mixing.mix(docs(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == by_sql(rows)


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by giving out and taking back until nobody is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    open_, left, out = set(order), share * sum(sizes.values()), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_and_sums(spark):
    rnd = random.Random(4)
    rows = [(k, "w " * rnd.randrange(1, 60), "en", rnd.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(900)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
    want = shares(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes) and all(r["source_size"] == sizes[r["source"]] for r in got)


def test_documents_come_as_often_as_taken(spark):
    counts, own = {}, docs(spark)
    for r in mixing.mixed_documents(own).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    want = {}
    for r in mixing.mix(own).collect():
        if r["taken"] or not r["size"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 1)
    assert counts == want and mixing.mixed_documents(own).columns == own.columns


def test_empty(spark):
    assert mixing.mix(none(spark)).count() == 0 and mixing.mixed_documents(none(spark)).count() == 0


def test_only_the_boundary_is_summed_again(spark, monkeypatch):
    """Below the first level the sums read a table of the boundary buckets' rows alone."""
    from pyspark.sql import functions as F

    rnd, written = random.Random(9), []
    rows = spark.createDataFrame([(s, rnd.randrange(1, 50), rnd.randrange(1 << 60)) for s in ("a", "b", None) for _ in range(4000)], "source string, size long, h long")
    whole = mixing.keep(rows, "rows")
    keep = mixing.keep

    def noted(df, name, **how):
        out = keep(df, name, **how)
        written.append((name, out.count(), {f.rsplit("/", 2)[1] for f in df.inputFiles()}))
        return out

    monkeypatch.setattr(mixing, "keep", noted)
    budgets = whole.groupBy("source").agg((F.sum("size") * 0.3).alias("budget"))
    cut = {r["source"]: (r["cut"], r["used"]) for r in mixing._cut(whole, budgets).collect()}
    for s in ("a", "b", None):
        run, budget = 0, sum(r["size"] for r in rows.collect() if r["source"] == s) * 0.3
        for h, size in sorted((r["h"], r["size"]) for r in rows.collect() if r["source"] == s):
            if run + size > budget:
                break
            run += size
        assert cut[s] == (h, run)
    own = {f.rsplit("/", 2)[1] for f in whole.inputFiles()}
    boundary = [n for name, n, _ in written if name == "mix-boundary"]
    assert len(boundary) == 1 and boundary[0] < 30  # of 12,000 rows, those in the three boundary buckets
    levels = [read for name, _, read in written if name == "mix-level"]
    assert len(levels) == len(mixing.SHIFTS) and own & levels[0] and not any(own & read for read in levels[2:])
