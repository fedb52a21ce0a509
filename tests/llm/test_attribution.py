import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.llm import attribution
from sparkrecall.llm.common import texts
from sparkrecall.llm.tokens import Encoder, tokenizer_path
from tests.llm.helpers import ROWS, docs, none


def plain(spans, start, end, rule):
    if end <= start:
        return 0.0, 0
    n = cross = 0
    for s, e in spans:
        inside = max(0, min(e, end) - max(s, start))
        cross += inside > 0 and inside < e - s
        point = s if rule == "start" else s + (e - s - 1) // 2
        n += inside / (e - s) if rule == "split" else start <= point < end
    return n, cross


@pytest.mark.parametrize("rule", attribution.RULES)
def test_allocation(rule):
    rng = np.random.default_rng(1)
    for _ in range(60):
        ends = np.cumsum(rng.integers(1, 9, 20))
        starts = ends - rng.integers(1, 2, 20) - np.minimum(rng.integers(0, 3, 20), np.diff(np.concatenate([[0], ends])) - 1)
        spans = np.stack([starts, ends], 1)
        low = rng.integers(0, 90, 15)
        high = low + rng.integers(-3, 40, 15)
        n, cross = attribution.allocate(spans, low, high, rule)
        for k in range(15):
            want = plain(spans.tolist(), low[k], high[k], rule)
            assert abs(n[k] - want[0]) < 1e-9 and cross[k] == want[1], (rule, low[k], high[k])


@pytest.mark.parametrize("rule", attribution.RULES)
def test_chunks_add_up(spark, rule):
    rows = texts(docs(spark)).withColumn("sections", attribution.chunks(7))
    got = {}
    for r in attribution.attribute(rows, rule).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    code, want = Encoder(tokenizer_path()), {}
    for i, t, *_ in ROWS:
        want[i] = want.get(i, 0) + len(code.tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert {k: round(v, 6) for k, v in got.items()} == want


def test_fields_and_sections(spark):
    rows = spark.createDataFrame([(1, "ab cd", "x", None), (2, None, "y z", None)], "doc_id long, text string, title string, other string")
    got = {(r["doc_id"], r["section"]): (r["start"], r["end"], r["n_tokens"]) for r in attribution.attribute_fields(rows, ["title", "text", "other"]).collect()}
    assert got[(1, "title")] == (0, 1, 1.0) and got[(1, "text")] == (2, 7, 2.0) and got[(1, "other")] == (8, 8, 0.0) and got[(2, "text")] == (4, 4, 0.0)
    sections = spark.createDataFrame([(1, "all", 0, 99), (1, "none", 3, 3), (1, "back", 4, 2), (7, "lost", 0, 3), (None, "null", 0, 3)], "doc_id long, section string, start long, end long")
    got = {r["section"]: r["n_tokens"] for r in attribution.attribute_sections(rows, sections).collect()}
    assert got == {"all": 2.0, "none": 0.0, "back": 0.0}
    with pytest.raises(ValueError):
        attribution.attribute(rows, "other")


def test_empty(spark):
    rows = texts(none(spark)).withColumn("sections", attribution.chunks())
    assert attribution.attribute(rows).count() == 0
    empty = texts(docs(spark)).withColumn("sections", F.lit(None).cast(attribution.SECTION))
    assert attribution.attribute(empty).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_of_a_slice_are_their_own(spark, rule):
    """Copies, repeated rows, a null id and sections beyond their text, all in one slice, against one document at a time."""
    code = Encoder(tokenizer_path())
    rng = np.random.default_rng(3)
    rows = []
    for i, t, *_ in ROWS + ROWS[:3]:
        n = len(t or "")
        low = rng.integers(-20, n + 30, 9)
        own = [(f"s{k}", int(a), int(a + rng.integers(-5, 60))) for k, a in enumerate(low)]
        rows.append((i, t, [*own, ("all", 0, n), ("far", n, n + 50), ("null", None, None)]))
    table = spark.createDataFrame(rows, f"doc_id long, text string, sections {attribution.SECTION}").coalesce(1)
    got = sorted([str(r["doc_id"]), r["section"], r["start"], r["end"], round(r["n_tokens"], 6), r["n_crossing"]] for r in attribution.attribute(table, rule).collect())
    want = []
    for i, t, own in rows:
        spans = code.tokenizer.encode(t or "", add_special_tokens=False).offsets
        if len(spans) > 3000:
            own = own[-3:]
        for name, a, b in own:
            n, cross = plain(spans, a or 0, b or 0, rule)
            want.append([str(i), name, a or 0, b or 0, round(float(n), 6), cross])
    long = {w[0] for w in want} - {"9"}
    assert [g for g in got if g[0] in long] == sorted(w for w in want if w[0] in long)
    assert all(w in got for w in want) and len(got) == 12 * len(rows)
