import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from sparkrecall.llm import fim
from tests.llm.helpers import ROWS, docs, none

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    own = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(own[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def own(i, text, summaries=None):
    n, form, p, m, out = fim.transformed(i, (text or "").encode(), summaries or fim.Summaries())
    return n, form, p, m, out.decode()


def random_text(rnd, size):
    return "".join(rnd.choice("ab é日🙂<>PSM \n\t\x0b\x1c\xa0") for _ in range(size))


@pytest.mark.parametrize("most", [8, 64, 4096])
def test_against_loops(monkeypatch, most):
    """Chunks of every size, whose borders fall within words, white space and characters."""
    monkeypatch.setattr(fim, "CHUNK_MOST", most)
    monkeypatch.setattr(fim, "STRETCH", 100)
    rnd, known = random.Random(most), fim.Summaries(5000)
    for k in range(1500):
        text = random_text(rnd, rnd.randrange(rnd.choice([4, 60, 900])))
        assert own(k, text, known) == plain(k, text), repr(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "a " * 30_000, " a" * 30_000, "日" * 20_000, "x" * 9000 + " " * 9000 + "y" * 9000, "", " ", "a", "a<P>b"], ids=range(10))
def test_long_and_odd_texts(text):
    assert [own(k, text) for k in range(12)] == [plain(k, text) for k in range(12)]


def test_every_place():
    text = random_text(random.Random(5), 3000).encode()
    known = fim.Chunked(text, fim.Summaries())
    ends = [m.end() for m in UNIT.finditer(text.decode())]
    assert len(known.parts) > 3 and [known.place(k)[1] for k in range(known.n + 1)] == [0, *ends]


def test_shared_passages_share_chunks():
    rnd = random.Random(8)
    passage = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000)).encode()
    known = fim.Summaries()
    fim.Chunked(b"one beginning " + passage, known)
    before = len(known.known)
    second = fim.Chunked(b"quite another, longer beginning " + passage + b" end", known)
    assert len(known.known) - before <= 4 and len(second.parts) > 40
    assert all(fim.summary(c) == s for c, s in known.known.items())


def test_rolling_hash_depends_on_its_window_alone():
    import numpy as np

    data = np.frombuffer(random.Random(4).randbytes(500), np.uint8)
    whole = fim.rolling(data)
    assert all(fim.rolling(data[k - fim.WINDOW + 1 : k + 1])[-1] == whole[k] for k in range(fim.WINDOW, 500))


def rows(df):
    return sorted(repr(tuple(None if pd.isna(v) else (int(v) if not isinstance(v, str) else v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_query_on_awkward_rows(spark, tmp_path):
    more = [(20 + k, f"text {k} <{'PSM'[k % 3]}> with a marker", "en", "a") for k in range(4)] + [(40 + k, "  lead and tail \n" * k, "en", "a") for k in range(20)]
    table = docs(spark, ROWS + more)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_chunked_fim(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in ROWS + more], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert rows(got) == rows(con.sql(fim.SQL).df())
    want = sorted((repr(i), *plain(i, t)[:4], hashlib.sha256(plain(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS + more)
    assert rows(got) == rows(pd.DataFrame([w[1:] for w in want], columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]).assign(doc_id=[None if w[0] == "None" else int(w[0]) for w in want]))
    assert fim.fill_in_middle(none(spark)).count() == 0


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows(fim.op11_chunked_fim(spark, sf).toPandas()) == rows(con.sql(fim.SQL).df())


def test_shares():
    forms = [own(k, "some words to be cut somewhere")[1] for k in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.5) < 0.03 and abs(forms.count("spm") / (4000 - forms.count("plain")) - 0.8) < 0.03
