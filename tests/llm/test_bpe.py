import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from sparkrecall.llm import bpe
from tests.llm.helpers import ROWS, docs, none

import public_tokenizers


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def code():
    return bpe.ByteBPE(bpe.vocabulary_path())


def ids(code, text):
    return np.frombuffer(code.encode(text), "<u4").tolist()


ALPHABET = "aaabcdeABC'sltdvm 012  \n\t\x1c\x85\xa0éßΩжя中文字🙂́​.,;!?-_<|>"


def test_tree_against_loops():
    rnd = random.Random(1)
    for n in [1, 2, 3, 7, 8, 9, 64, 2500]:
        values = [rnd.randrange(20) for _ in range(n)]
        tree = bpe.PairTree(list(values))
        for _ in range(60):
            assert tree.tree[1] == min(values) and tree.leftmost() == values.index(min(values))
            at = rnd.randrange(n)
            values[at] = rnd.choice([rnd.randrange(20), bpe.NONE])
            tree.put(at, values[at])


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], bpe.NONE), i) for i in range(len(parts) - 1))
        if least == bpe.NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_merges_against_loops(code):
    rnd = random.Random(2)
    for _ in range(400):
        piece = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(1, 40))).encode()
        assert bpe.merged(piece, code.ranks) == (naive(piece, code.ranks) if piece not in code.ranks else [code.ranks[piece]])


def test_random_texts_against_the_library(code, library):
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(60)))
        assert ids(code, text) == library.encode_ordinary(text), repr(text)
        assert code.decode(code.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9000, "日本語" * 4000, " " * 5000 + "x", "\n" * 3000, "x1" * 20_000, "".join(chr(97 + k * k % 26) for k in range(12_000))], ids=range(7))
def test_long_matches_against_the_library(code, library, text):
    assert ids(code, text) == library.encode_ordinary(text)
    assert code.decode(code.encode(text)) == text.encode()


def test_long_text_piece_by_piece(code, library, monkeypatch):
    text = " ".join(f"word{k} Ünïcode\n" for k in range(2000))
    monkeypatch.setattr(bpe, "PART_CHARS", 1000)
    monkeypatch.setattr(bpe, "CACHE_MATCHES", 50)  # emptied again and again
    assert ids(code, text) == library.encode_ordinary(text)


def test_query_on_awkward_rows(spark, tmp_path, library):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in bpe.op12_segment_tree_bpe(spark, str(tmp_path)).fillna({"doc_id": -99}).collect())
    want = []
    for i, text, *_ in ROWS:
        own = library.encode_ordinary(text or "")
        want.append((-99 if i is None else i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(none(spark)).count() == 0 and bpe.decode(bpe.encode(none(spark))).count() == 0


def test_query_on_the_smallest_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in bpe.op12_segment_tree_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        own = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(own) and got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
