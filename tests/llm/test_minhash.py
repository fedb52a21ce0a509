import random
import re

import pytest

from sparkrecall.llm import minhash
from tests.llm.helpers import ROWS, docs, none


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def pair(spark, texts):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(texts)], "k int, a string, b string")
    df = minhash.with_bins(minhash.with_bins(df, "a", "x"), "b", "y")
    return [r[0] for r in df.orderBy("k").select(minhash.likeness("x", "y")).collect()]


def test_likeness_near_jaccard(spark):
    rnd, texts = random.Random(0), []
    for _ in range(60):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 8, 40, 300, 2000]))]
        other = own[: rnd.randrange(len(own) + 1)] + [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(len(own)))]
        texts.append((" ".join(own), " ".join(other)))
    got = pair(spark, texts)
    want = [len(shingles(a) & shingles(b)) / max(1, len(shingles(a) | shingles(b))) for a, b in texts]
    assert max(abs(g - w) for g, w in zip(got, want)) < 0.13
    assert abs(sum(g - w for g, w in zip(got, want))) / len(got) < 0.02


def test_wordless(spark):
    assert pair(spark, [("", " "), ("", "a b"), ("a b", "a  b"), ("a b c d e f", "a b c d e f")]) == [1.0, 0.0, 1.0, 1.0]


def xx(spark, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", F.xxhash64("t").alias("h"))
    return {r["t"]: r["h"] for r in df.distinct().collect()}


HOT = [*ROWS, *[(None, f"nameless {k % 7}", "en", "a") for k in range(30)], *[(5, f"five {k % 9}", "en", "a") for k in range(30)]]


def in_order(spark, rows):
    h = xx(spark, [t or "" for _, t, *_ in rows])
    return sorted(((i is not None, i or 0, h[t or ""], t or "") for i, t, *_ in rows))


@pytest.mark.parametrize("bits,hot", [(1, 4096), (10, 4096), (8, 5), (1, 1)])
def test_next_document(spark, monkeypatch, bits, hot):
    """Also with most rows under no id or under one, and with runs parted and equal rows made one."""
    monkeypatch.setattr(minhash, "RUN_BITS", bits)
    monkeypatch.setattr(minhash, "HOT_ROWS", hot)
    got = minhash.with_next(minhash.in_runs(docs(spark, HOT).repartition(3)), ["text"])
    order = in_order(spark, HOT)
    want = [(i if k else None, t, order[(n + 1) % len(order)][3]) for n, (k, i, _, t) in enumerate(order)]
    assert sorted(str((r["doc_id"], r["text"], r["next_text"])) for r in got.collect()) == sorted(map(str, want))


def test_tasks_follow_the_bytes(spark, monkeypatch):
    """Ids like hashes are runs of their own, and still a few tasks; a third of all rows equal is one row to be moved; the rows of
    one id are dealt to many runs."""
    rnd = random.Random(6)
    rows = [(rnd.randrange(-(1 << 60), 1 << 60), f"text {k}", "en", "a") for k in range(600)] + [(7, "the same", "en", "a")] * 300 + [(9, f"nine {k}", "en", "a") for k in range(300)]
    monkeypatch.setattr(minhash, "HOT_ROWS", 50)
    runs = minhash.in_runs(docs(spark, rows))
    assert runs.rdd.getNumPartitions() == 4
    own = runs.filter("not _ghost").select("doc_id", "_sub", "_copies").collect()
    assert [r["_copies"] for r in own if r["doc_id"] == 7] == [300] and len({r["_sub"] for r in own if r["doc_id"] == 9}) > 200
    order = in_order(spark, rows)
    want = [(i, t, order[(n + 1) % len(order)][3]) for n, (_, i, _, t) in enumerate(order)]
    got = minhash.with_next(runs, ["text"]).collect()
    assert sorted((r["doc_id"], r["text"], r["next_text"]) for r in got) == sorted(want)


def test_densification(spark):
    """Few shingles leave most bins empty; equal sets fill alike, and likeness stays unbiased on average."""
    rnd, texts, want = random.Random(3), [], []
    for _ in range(150):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(9)]
        other = own[:7] + [f"v{rnd.randrange(10**6)}" for _ in range(2)]
        texts.append((" ".join(own), " ".join(other)))
        a, b = (shingles(t) for t in texts[-1])
        want.append(len(a & b) / len(a | b))
    got = pair(spark, texts)
    assert abs(sum(got) - sum(want)) / len(want) < 0.03
    assert pair(spark, [("a b c d e f", "a  b c d e f ")]) == [1.0]


def test_query(spark, tmp_path):
    """op5's columns, each made anew in Python over a small table."""
    import hashlib

    rows = [(k * 3, " ".join(f"w{(k * j) % 37}" for j in range(k % 40)) + "é" * (k % 3), "en", "a") for k in range(60)] + [(1, None, "en", "a"), (2, "", "en", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in minhash.op5_one_permutation_minhash(spark, str(tmp_path)).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(order)
    every = {}
    for n, (i, t) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for text, print_ in ((t, got[i]["fingerprint"]), (edited, got[i]["edited_fingerprint"])):
            assert every.setdefault(text, print_) == print_
        for other, near in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingles(t), shingles(other)
            assert abs(got[i][near] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15


def test_fingerprints(spark):
    got = {(r["doc_id"], r["fingerprint"]) for r in minhash.fingerprints(docs(spark)).collect()}
    by = dict(got)
    assert by[0] == by[1] and len(by[0]) == minhash.BINS * 2 and set(by[2]) == {"0"} == set(by[4]) and len(got) == 13
    assert minhash.fingerprints(none(spark)).count() == 0 and minhash.with_next(minhash.in_runs(none(spark)), ["text"]).count() == 0


def test_one_row_follows_itself(spark):
    rows = minhash.with_next(minhash.in_runs(docs(spark, ROWS[:1])), ["text"]).collect()
    assert len(rows) == 1 and rows[0]["next_text"] == rows[0]["text"]


def test_long_texts(spark, tmp_path):
    """A text of two million characters next to short ones."""
    import hashlib

    long = " ".join(f"word{k * 7919 % 100_003}" for k in range(200_000))
    rows = [(1, "a few short words here", "en", "a"), (2, long, "en", "a"), (3, long[: len(long) // 2], "en", "a")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in minhash.op5_one_permutation_minhash(spark, str(tmp_path)).collect()}
    half = len(long) // 2
    edited = long[: len(long) - half] + rows[2][1][:half]
    assert got[2]["n_chars"] == len(long) and got[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    a, b = shingles(long), shingles(rows[2][1])
    assert abs(got[2]["near_next"] - len(a & b) / len(a | b)) < 0.13
