import re

import numpy as np
import pytest
import xxhash

from sparkrecall.llm import simhash
from sparkrecall.llm.components import connected_components
from tests.llm.helpers import ROWS, docs, none


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    got = sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(docs(spark)).collect())
    assert got == sorted((str(i), plain(t)) for i, t, *_ in ROWS)


def test_embedding_bounds_distance(spark):
    rng = np.random.default_rng(0)
    rows = [(int(x), int(x) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5)))) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)]
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    df = df.select(F.bit_count(simhash.embedding("a").bitwiseXOR(simhash.embedding("b"))).alias("low"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("far"))
    assert all(r["low"] <= r["far"] for r in df.collect())


@pytest.mark.parametrize("most", [0, 3, 64])
def test_links_keep_components(spark, most):
    """Chains and balls of near fingerprints, with every bound on cells: the components are those of all pairs."""
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(-(1 << 63), (1 << 63) - 1, 12):
        x = int(base)
        for _ in range(15):
            fps.add(x)
            for b in rng.integers(0, 63, rng.integers(1, 4)):
                x ^= 1 << int(b)
    fps = sorted(fps)
    want = groups([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2], fps)
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most)
    got = {f: f for f in fps} | {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == want


def test_documents(spark):
    got = {}
    for r in simhash.near_duplicates(docs(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got[0] == got[1] == {0} and got[2] == got[3] == got[4] == {2} and got[9] == {9} and got[None] == {None} and got[-3] == {-3}
    kept = simhash.keep_first(docs(spark))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [-3, 0, 2, 5, 6, 7, 8, 9, 12, None])) and kept.columns == docs(spark).columns


def test_grids_meet_all_near_points(spark):
    """Every pair within two bits shares a cell of every set of grids, however fine."""
    rng = np.random.default_rng(2)
    for blocks in simhash.GRIDS:
        masks = [m & (1 << 64) - 1 for m in simhash._cells(blocks)]
        assert len(masks) == blocks * (blocks - 1) // 2
        for _ in range(300):
            a = int(rng.integers(0, 1 << 63))
            b = a ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            p, q = ((x | x >> 1) & simhash._HALF | ((x & x >> 1) & simhash._HALF) << 1 for x in (a, b))
            assert any(p & m == q & m for m in masks)


def test_half_of_the_rows_in_one_group(spark):
    """A hub: thousands of fingerprints one bit from one, and half of all rows under one id or none."""
    rnd = np.random.default_rng(8)
    hub = 0x0123456789ABCDEF
    fps = {hub} | {hub ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(a)}
    links = simhash.links(spark.createDataFrame([(f,) for f in sorted(fps)], "fp long"), 8)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert set(roots) == fps and set(roots.values()) == {min(fps)}
    words = [f"word{k}" for k in range(500)]
    rows = [(None if k % 2 else 7, " ".join(rnd.choice(words, 30)), "en", "a") for k in range(60)]
    got = simhash.keep_first(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t) for i, t, *_ in rows)


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (700, 701), (701, 700)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 700: 700, 701: 700}


def test_empty(spark):
    assert simhash.near_duplicates(none(spark)).count() == 0 and simhash.keep_first(none(spark)).count() == 0


def test_nothing_unique_is_lost(spark):
    """Rows without an id and different texts of one id: a row of each group stays."""
    from corpus_pipeline import near_duplicates

    one, two, three, four = (" ".join(f"{c}{k * k}" for k in range(40)) for c in "abcd")
    rows = [(1, one, "en", "a"), (5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"), (None, one, "en", "a"), (None, three, "en", "a"), (None, three, "en", "a"), (None, four, "en", "a")]
    got = sorted(((r["doc_id"], r["text"]) for r in near_duplicates(spark, docs(spark, rows), "").collect()), key=str)
    assert got == sorted([(1, one), (5, two), (None, three), (None, four)], key=str)
