import random

import numpy as np
import pytest

from sparkrecall.llm import toxicity
from tests.llm.helpers import ROWS, docs, none


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"word{rnd.randrange(400)}" for _ in range(rnd.randrange(10, 120))]
        toxic, junk = rnd.random() < 0.25, rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["scoundrel", "Villain,", f"rogue{rnd.randrange(500)}x"]))
        if junk:
            words = [w + "%%" for w in words]
        rows.append((k, " ".join(words), "en", "a"))
        labels.append((k, int(not junk), int(toxic)))
    return rows, labels


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    rows, labels = corpus(1500)
    own, known = docs(spark, rows), {i: (q, t) for i, q, t in labels}
    chain = toxicity.train(own, frame(spark, labels))
    assert "scoundrel" in chain.vocabulary and chain.names == toxicity.CHAIN and [len(b) for b in chain.before] == [0, 1, 2]
    got = [(r, known[r["doc_id"]]) for r in toxicity.score(own, chain).withColumn("out", toxicity.held_out()).collect() if r["out"]]
    assert len(got) > 200
    assert np.mean([(r["toxic"] >= 0.5) == t for r, (_, t) in got]) > 0.97
    assert np.mean([(r["low_quality"] >= 0.5) == (q == 0) for r, (q, _) in got]) > 0.97
    assert all(r["severe"] < 0.5 for r, (_, t) in got if not t and r["toxic"] < 0.2)
    kept = {r["doc_id"] for r in toxicity.kept_documents(own, frame(spark, labels)).collect()}
    assert np.mean([(i in kept) != t for i, (_, t) in known.items()]) > 0.97


def test_finder_finds_the_words():
    texts = ["Foo foobar % barfoo", "", "ÉCOLE écoles naïve", "a ^ b ^ab abcd abcde abcdef"]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*map(toxicity.words, texts))))}
    find = toxicity.Finder(vocabulary)
    for t in texts:
        assert sorted(find(t)) == sorted(vocabulary[w] for w in toxicity.words(t))


def test_chain_uses_earlier_answers():
    rng = np.random.default_rng(0)
    rows = [list(np.flatnonzero(rng.random(6) < 0.5)) for _ in range(600)]
    first = np.array([float(0 in r) for r in rows])
    chain = toxicity.fit_chain(rows, {"a": first, "b": first}, {str(k): k for k in range(6)}, np.arange(600) % 3)
    assert chain.before[1][0] > 0.5 and ((chain.score(rows) > 0.5) == (first[:, None] == 1)).all()


@pytest.mark.parametrize("given", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1), (7, 1, 1)], [(0, 1, 0), (0, 0, 1), (7, 0, 1), (99, 1, 0), (None, 1, 0), (9, None, None), (12, 1, 0)]])
def test_awkward(spark, given):
    own = docs(spark)
    chain = toxicity.train(own, frame(spark, given))
    got = toxicity.score(own, chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r[c] <= 1 for r in got for c in toxicity.CHAIN)
    kept = toxicity.kept_documents(own, frame(spark, given))
    assert kept.columns == own.columns and kept.count() == sum(r["toxic"] < toxicity.REJECT for r in got)
    assert toxicity.score(none(spark), chain).count() == 0 and toxicity.kept_documents(none(spark), frame(spark, given)).count() == 0


def test_fit_against_plain_descent():
    """The weights are those at which the penalised likelihood has no slope left, as a plain descent finds them."""
    rng = np.random.default_rng(4)
    rows = [list(np.flatnonzero(rng.random(5) < 0.4)) for _ in range(300)]
    dense = rng.random((300, 1))
    x = np.zeros((300, 7))
    for k, r in enumerate(rows):
        x[k, r] = 1
    x[:, 5], x[:, 6] = dense[:, 0], 1
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 2] + dense[:, 0])))).astype(float)
    at, owner = toxicity._flat(rows)
    w, v, b = toxicity.fit_logistic(at, owner, dense, y, 5, rounds=3000)
    plain, penalty = np.zeros(7), np.array([1.0] * 6 + [0.0])
    for _ in range(20000):
        p = 1 / (1 + np.exp(-x @ plain))
        plain -= 0.01 * (x.T @ (p - y) + penalty * plain)
    assert np.abs(np.concatenate([w, v, [b]]) - plain).max() < 0.02


def test_out_of_fold_answers_do_not_see_their_row():
    """Turning the labels of one fold round leaves the first model's answers for that fold as they were."""
    rng = np.random.default_rng(6)
    rows = [list(np.flatnonzero(rng.random(6) < 0.5)) for _ in range(200)]
    y = np.array([float(0 in r) for r in rows])
    folds = np.arange(200) % 3
    turned = np.where(folds == 0, 1 - y, y)
    at, owner = toxicity._flat(rows)
    guesses = []
    for labels in (y, turned):
        rest = folds != 0
        place, picked = np.cumsum(rest) - 1, rest[owner]
        w, v, b = toxicity.fit_logistic(at[picked], place[owner[picked]], np.zeros((int(rest.sum()), 0)), labels[rest], 6)
        guesses.append(np.bincount(owner, w[at], 200)[folds == 0] + b)
    assert np.allclose(*guesses)


def test_query(spark, tmp_path):
    """op7's rows are the chain's sums, added up in plain Python."""
    import math
    import zlib

    rows, labels = corpus(400, 3)
    docs(spark, rows + [(None, "no id, scoundrel", "en", "a"), (5000, None, "en", "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op7_toxicity_chain(spark, str(tmp_path)).collect()
    chain = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    texts = {i: t for i, t, *_ in rows} | {None: "no id, scoundrel", 5000: ""}
    assert len(got) == len(texts)
    for r in got:
        found, before = [chain.vocabulary[w] for w in toxicity.words(texts[r["doc_id"]]) if w in chain.vocabulary], []
        for k, name in enumerate(toxicity.CHAIN):
            z = chain.bias[k] + sum(chain.weights[k][i] for i in found) + sum(p * w for p, w in zip(before, chain.before[k]))
            before.append(1 / (1 + math.exp(-max(-35, min(35, z)))))
            assert abs(r[name] - before[-1]) < 1e-6
        assert r["rejected"] == int(before[1] >= toxicity.REJECT)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_one_labelled_id_on_half_of_the_rows(spark):
    """What is learned from is bounded by the labels, whatever number of rows an id has."""
    rows, labels = corpus(200, 4)
    many = rows + [(1, f"text {k}", "en", "a") for k in range(300)]
    known = toxicity.labelled(frame(spark, labels))
    from sparkrecall.llm.common import texts

    own = toxicity.one_text(texts(docs(spark, many)).join(known, "doc_id")).collect()
    assert len(own) == 200 and {r["doc_id"]: r["text"] for r in own}[1] == min([rows[1][1], *(f"text {k}" for k in range(300))])
