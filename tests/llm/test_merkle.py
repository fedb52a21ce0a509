import hashlib
import zlib

import duckdb
import pandas as pd
import pytest

from sparkrecall.llm import merkle
from tests.llm.helpers import ROWS, docs, none


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source = row
    fields = (i, source, lang, None if text is None else len(text), text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tampered(row):
    i, text, *rest = row
    low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    # the size is a field of its own and stays
    fields = (i, rest[1], rest[0], None if text is None else len(text), low)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def up(nodes, at, fan=merkle.FAN):
    """The siblings (left, right) of a leaf at each level, and the root."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // fan * fan : at // fan * fan + fan]
        path.append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        nodes = [digest("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
        at //= fan
    return path, nodes[0]


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    order = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k, v in by.items()}
    subroots = [up([leaf(r) for r in order[k]], 0)[1] for k in langs]
    out = []
    for at, lang in enumerate(langs):
        above, root = up(subroots, at)
        for k, r in enumerate(order[lang]):
            path = up([leaf(x) for x in order[lang]], k)[0] + above
            now = tampered(r) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for left, right in path:
                now = digest(left + now + right)
            out.append((r[0], leaf(r), subroots[at], root, digest("".join(a + b for a, b in path)), now, now == root))
    return sorted(map(repr, out))


def query(spark, tmp_path, table):
    table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])) for r in got)


def many(sizes):
    out = []
    for lang, n in sizes.items():
        out += [(len(out) * 7919 % 100_003, f"Text {k} of {lang} É", lang, "a" if k % 3 else None) for k in range(n)]
    return out


@pytest.mark.parametrize("rows", [ROWS, many({"en": 73, None: 9, "é": 8, "": 1, "z": 65, "a": 2, "b": 1, "c": 1, "d": 64, "e": 3}), many({"en": 1}), many({"en": 600})], ids=["awkward", "trees", "one", "deep"])
def test_against_loops(spark, tmp_path, rows):
    assert query(spark, tmp_path, docs(spark, rows).repartition(3)) == expected(rows)


def test_equal_rows_and_shared_ids(spark, tmp_path):
    """A third of all rows equal, a third under one id, some without an id."""
    rows = [(5, "Same", "en", "a")] * 40 + [(6, f"Other {k}", "en", "a") for k in range(40)] + [(k if k % 9 else None, f"own {k}", "en", "b") for k in range(40)]
    assert query(spark, tmp_path, docs(spark, rows).repartition(4)) == expected(rows)


def test_empty(spark, tmp_path):
    assert query(spark, tmp_path, none(spark)) == []


def test_against_sql(spark, tmp_path):
    rows = many({"en": 90, None: 10, "fr": 1, "é": 17}) + [(-4, None, "en", None), (10**12, "", "en", "a")]
    got = query(spark, tmp_path, docs(spark, rows).coalesce(1))
    documents = pd.DataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(merkle.SQL).fetchall()
    assert got == sorted(map(repr, want))


def test_manifest_finds_a_changed_row(spark):
    """A proof made once holds for the row as it was, for no other and in no other place."""
    from pyspark.sql import functions as F

    made = merkle.manifest(docs(spark, many({"en": 30, "fr": 5})), more={"text": F.col("text")})
    roots = made.select("*", merkle.folded(F.col("leaf")).alias("own"), merkle.folded(F.unhex(F.sha2("text", 256))).alias("other")).collect()
    assert all(r["own"] == bytes(r["root"]).hex() != r["other"] for r in roots) and len({r["other"] for r in roots}) == 35
    assert {r["n"] for r in roots} == {30, 5} and sorted(r["at"] for r in roots) == sorted([*range(30), *range(5)])
