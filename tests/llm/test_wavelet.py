import zlib

import numpy as np
import pytest

from sparkrecall.llm import wavelet
from sparkrecall.llm.tokens import Encoder, tokenizer_path
from tests.llm.helpers import ROWS, docs, none


@pytest.mark.parametrize("n,top,bits", [(1, 2, 1), (511, 3, 2), (512, 70000, 17), (1300, 40, 6), (5000, 49407, 16)])
def test_matrix(n, top, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    m = wavelet.WaveletMatrix.build(ids, bits)
    assert (m.decode() == ids).all() and (m.access(np.arange(n)) == ids).all()
    for token in {int(ids[0]), int(ids[-1]), 0, top}:
        own = np.flatnonzero(ids == token)
        assert m.count(token) == len(own) and m.occurrences(token).tolist() == own.tolist() and m.select(token, len(own)) == -1
        for at in (0, n // 2, n):
            assert m.rank(token, at) == (ids[:at] == token).sum()


def expected():
    code = Encoder(tokenizer_path())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for i, text, *_ in order:
        ids = code.tokenizer.encode(text or "", add_special_tokens=False).ids + [wavelet.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [40, 1 << 21])
def test_files(spark, tmp_path, shard):
    path = f"{tmp_path}/w"
    wavelet.write_shards(docs(spark).repartition(3), path, shard_tokens=shard)
    shards = wavelet.read_shards(spark, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_documents(shards).collect())
    assert got == [(s, i, n, c) for i, s, n, c, _ in expected()]
    ids = [t for *_, own in expected() for t in own]
    token = max(set(ids), key=ids.count)
    assert sum(r["n"] for r in wavelet.count_token(shards, token).collect()) == ids.count(token)
    assert wavelet.locate_token(shards, token).count() == ids.count(token)


def test_empty(spark, tmp_path):
    wavelet.write_shards(none(spark), f"{tmp_path}/w")
    assert wavelet.read_documents(wavelet.read_shards(spark, f"{tmp_path}/w")).count() == 0


def test_frequent_id():
    """A quarter of a shard: found in one walk up the planes."""
    ids = np.random.default_rng(3).integers(0, 49000, 400_000)
    ids[::4] = 77
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.occurrences(77) == np.flatnonzero(ids == 77)).all() and not len(m.occurrences(1 << 20))


def test_half_of_the_rows_share_an_id(spark, tmp_path):
    """Rows of one id, and without one, are dealt out by their texts and stand together, in a fixed order."""
    from pyspark.sql import functions as F

    rows = [(k if k % 4 == 0 else (None if k % 4 == 1 else 50), f"text number {k % 40}", "en", "a") for k in range(120)]
    wavelet.write_shards(docs(spark, rows).repartition(5), f"{tmp_path}/w", shard_tokens=60)
    got = sorted(wavelet.read_documents(wavelet.read_shards(spark, f"{tmp_path}/w")).collect(), key=lambda r: r["start"])
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(f"text number {k}",) for k in range(40)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted((i is not None, i or 0, h[t], t) for i, t, *_ in rows)
    code, at = Encoder(tokenizer_path()), 0
    for r, (known, i, _, t) in zip(got, order, strict=True):
        ids = code.tokenizer.encode(t, add_special_tokens=False).ids + [wavelet.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
