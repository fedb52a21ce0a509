"""Readers, writers and the journal."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.operators import journal as J
from sparkrecall.operators import sessions as S
from sparkrecall.sources import tables

T0 = dt.datetime(2024, 1, 1, 23, 59)


def test_requests_of_strings_and_lists(spark, tmp_path):
    rows = [
        {"request_id": "a", "ts": "2024-01-01T00:00:00Z", "userId": "u", "sessionId": "s", "input": [{"role": "user", "content": "[1,2]"}, {"role": "user", "content": [{"type": "input_text", "text": "hi"}, {"type": "file", "file_url": "f"}]}]},
        {"request_id": "b", "userId": "u", "sessionId": "s", "memory_settings": {"recent_rounds_full": 2}, "input": [{"role": "user", "content": []}, {"role": "user"}]},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    a, b = tables.read_requests(spark, str(tmp_path)).orderBy("request_id").collect()
    assert a["input"][0]["content_text"] == "[1,2]" and a["input"][0]["content_items"] is None
    assert a["input"][1]["content_text"] is None and [x["type"] for x in a["input"][1]["content_items"]] == ["input_text", "file"]
    assert b["recent_rounds_full"] == 2 and b["input"][0]["content_items"] == [] and b["input"][1]["content_text"] is None


def sample(spark):
    m = [("user", "q", None), ("assistant", None, [("input_text", "é \"x\"", None, None)])]
    return spark.createDataFrame([("u", "s", k, f"i{k}", T0, m, "q") for k in (1, 2)], schemas.ROUNDS)


def test_sessions_round_trip(spark, tmp_path):
    tables.write_sessions(sample(spark), f"{tmp_path}/s")
    back = tables.read_sessions(spark, f"{tmp_path}/s")
    assert sorted(back.collect()) == sorted(sample(spark).collect())


def test_memories_round_trip(spark, tmp_path):
    path = f"{tmp_path}/m"
    assert tables.read_memories(spark, path).count() == 0
    m = spark.createDataFrame([("a", "u", "t", [1.0, 2.0], "h", T0, T0), ("b", "u", "t", [1.0], "h", T0, T0), ("c", "v", "t", None, "h", T0, T0)], schemas.MEMORIES)
    rejected = tables.write_memories(m, path, dims=2)
    assert sorted(r["id"] for r in rejected.collect()) == ["b", "c"]
    assert [r["id"] for r in tables.read_memories(spark, path).collect()] == ["a"]
    bucket = m.select(tables.user_bucket()).first()[0]
    assert tables.read_memories(spark, path, [bucket]).count() == 1 and tables.read_memories(spark, path, [bucket + 1]).count() == 0


def test_contexts_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("h", "u", "s", "r", "{}", "[]", "q", "k", "o", T0, T0)], schemas.CONTEXTS)
    tables.write_contexts(c, f"{tmp_path}/c")
    assert tables.read_contexts(spark, f"{tmp_path}/c").collect() == c.collect()


def calls(spark):
    items = [("input_text", "see", None, None), ("file", None, None, "/x/a.png"), ("input_text", "this", None, None), ("file", None, None, "http://h/b.pdf?v=1"), ("file", None, None, "")]
    rows = [("r1", T0, "u", "s", None, [("user", None, items), ("assistant", " \n", None), (None, "bye", None)]), ("r2", T0 + dt.timedelta(minutes=2), "u", "s", None, [("user", "x", None)])]
    return spark.createDataFrame(rows, schemas.REQUESTS)


def test_journal(spark, tmp_path):
    saved = spark.createDataFrame([("u", "/x/a.png", "assets/1-a.png")], "user_id string, file_url string, local_path string")
    e = J.journal_entries(calls(spark), saved).orderBy("request_id", "pos").collect()
    assert [(r["type"], r["role"], r["content"], r["local_path"]) for r in e] == [
        ("file", None, None, "assets/1-a.png"), ("file", None, None, "http://h/b.pdf?v=1"), ("message", "user", "see this", None), ("message", "unknown", "bye", None), ("message", "user", "x", None)
    ]
    manifest = tables.journal(calls(spark), saved, f"{tmp_path}/j")
    assert sorted((r["file_url"], r["category"]) for r in manifest.collect()) == [("/x/a.png", "assets"), ("http://h/b.pdf?v=1", "raw")]
    tables.journal(calls(spark), saved, f"{tmp_path}/j")
    back = tables.read_journal(spark, f"{tmp_path}/j")
    assert back.count() == 10 and sorted(p.name for p in (tmp_path / "j" / "user_id=u").iterdir()) == ["date=2024-01-01", "date=2024-01-02"]


def test_attachments(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    urls = [f"{tmp_path}/a.png", f"file://{tmp_path}/a.png", f"{tmp_path}/missing.pdf"]
    manifest = spark.createDataFrame([("u", x, "raw", f"raw/{k}") for k, x in enumerate(urls)], "user_id string, file_url string, category string, dest string")
    got = {r["file_url"]: (r["local_path"], r["content"]) for r in tables.ingest_attachments(manifest, [str(tmp_path)]).collect()}
    assert got[urls[0]][0] == "raw/0" and bytes(got[urls[1]][1]) == b"png" and got[urls[2]] == (None, None)


def test_attachments_are_read_where_their_rows_are(spark, tmp_path, monkeypatch):
    """No list of local files goes through the driver; what lies outside of the folders, or is no file, is missing."""
    from pyspark.sql.classic.dataframe import DataFrame

    def listed(*_):
        raise AssertionError("a list on the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", listed)
    monkeypatch.setattr(tables, "FILE_BYTES", 10)
    inside, outside = tmp_path / "in", tmp_path / "in-not"
    for folder in (inside, outside, inside / "_sub"):
        folder.mkdir()
        (folder / "a.bin").write_bytes(b"bytes of " + folder.name.encode())
    (inside / "empty").write_bytes(b"")
    urls = [f"{inside}/a.bin", f"file:{inside}/a.bin", f"{inside}/_sub/a.bin", f"{inside}/empty"]
    lost = [f"{outside}/a.bin", f"{inside}/../in-not/a.bin", f"{inside}", f"{inside}/a.bin/b", f"{inside}/{'x' * 300}", "http://h/a.bin", "", None]
    manifest = spark.createDataFrame([(u, f"raw/{k}") for k, u in enumerate(urls * 2 + lost)], "file_url string, dest string")
    rows = tables.ingest_attachments(manifest, [f"file://{inside}/", f"{tmp_path}/none"]).collect()
    got = {r["dest"]: (r["local_path"], r["content"] and bytes(r["content"]), r["length"]) for r in rows}
    want = [b"bytes of in", b"bytes of in", b"bytes of _sub", b""] * 2
    assert len(rows) == len(got) == len(want) + len(lost)
    assert [got[f"raw/{k}"] for k in range(len(want))] == [(f"raw/{k}", w, len(w)) for k, w in enumerate(want)]
    assert all(got[f"raw/{k}"] == (None, None, None) for k in range(len(want), len(got)))


def test_attachments_by_pattern(spark, tmp_path):
    """Patterns go through Spark's reader."""
    for k in (1, 2):
        (tmp_path / f"p{k}").mkdir()
        (tmp_path / f"p{k}" / "a").write_bytes(b"a%d" % k)
    manifest = spark.createDataFrame([(f"{tmp_path}/p1/a", "1"), (f"{tmp_path}/p2/a", "2"), (f"{tmp_path}/p3/a", "3")], "file_url string, dest string")
    got = {r["dest"]: (r["local_path"], r["content"] and bytes(r["content"])) for r in tables.ingest_attachments(manifest, [f"{tmp_path}/p[12]"]).collect()}
    assert got == {"1": ("1", b"a1"), "2": ("2", b"a2"), "3": (None, None)}


def test_no_shared_folder_on_a_cluster():
    """Only a local session may fall back to a folder of its own."""

    class Unset:
        def get(self, *_):
            return None

    class Cluster:
        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(Unset)

        conf = Unset()

    with pytest.raises(ValueError):
        tables.scratch(Cluster, "x")


def test_empty_tables(spark):
    none = spark.createDataFrame([], schemas.REQUESTS)
    saved = spark.createDataFrame([], "user_id string, file_url string, local_path string")
    assert J.journal_entries(none, saved).count() == 0 and S.rounds_of_requests(none).count() == 0
    assert J.attachment_manifest(J.extract_files(none)).select(F.count("*")).first()[0] == 0
