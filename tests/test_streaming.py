"""Streams give what the batch gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.operators import memory as M
from sparkrecall.operators import sessions as S
from sparkrecall.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def files(df, path, parts):
    """One file per part, in order, so that a stream of one file a batch replays them."""
    for k, own in enumerate(parts):
        own.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    rnd, ttl, cap = random.Random(3), 100, 3
    calls = sorted((T0 + dt.timedelta(seconds=rnd.randrange(900)), f"i{k:02d}", rnd.choice("ab")) for k in range(24))
    rows = spark.createDataFrame([("u", s, t, i, i, "[]") for t, i, s in calls], "user_id string, session_id string, ts timestamp, round_id string, first_user_text string, messages string")
    parts = [rows.filter((F.col("ts") >= T0 + dt.timedelta(seconds=a)) & (F.col("ts") < T0 + dt.timedelta(seconds=a + 450))) for a in (0, 450)]
    out = run(streams.stream_sessions(files(rows, f"{tmp_path}/in", parts), cap, ttl, False), "w1", "update", tmp_path).collect()
    got = {}
    for r in out:  # the last state of each session: its largest time, and all rounds given with it
        got.setdefault(r["session_id"], []).append((r["ts"], r["round_id"]))
    batch = rows.withColumn("round_no", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("session_id").orderBy("ts", "round_id")))
    want = {}
    for s in ("a", "b"):
        own = S.segments(batch.filter(F.col("session_id") == s), ttl)
        last = own.agg(F.max("segment")).first()[0]
        want[s] = [r["round_id"] for r in S.keep_last_rounds(own.filter(F.col("segment") == last), cap).orderBy("round_no").collect()]
    for s, ids in want.items():
        latest = max(t for t, _ in got[s])
        assert ids[-1] in [i for t, i in got[s] if t == latest]
        assert set(ids) <= {i for _, i in got[s]}


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("u", "s", T0 + dt.timedelta(seconds=t)) for t in (0, 50, 500, 9000)], "user_id string, session_id string, ts timestamp")
    parts = [rows.filter(F.col("ts") < T0 + dt.timedelta(seconds=600)), rows.filter(F.col("ts") > T0 + dt.timedelta(seconds=600))]
    out = run(streams.stream_session_windows(files(rows, f"{tmp_path}/in", parts), 100, "10 minutes"), "w2", "append", tmp_path)
    assert sorted((r["first_ts"], r["rounds"]) for r in out.collect()) == [(T0, 2), (T0 + dt.timedelta(seconds=500), 1)]


def test_memories(spark, tmp_path):
    def act(r, pos, event, id_, text, s):
        return (r, pos, "u", id_, text, event, None, [1.0], T0 + dt.timedelta(seconds=s))

    schema = schemas.ACTIONS + ", vector array<float>, ts timestamp"
    one, two = [act("r1", 0, "ADD", None, "tea", 1)], [act("r2", 0, "UPDATE", "m", "new", 2), act("r2", 1, "DELETE", "n", None, 2)]
    rows = spark.createDataFrame(one + two, schema)
    table = spark.createDataFrame([(i, "u", "old", [1.0], i, T0, T0) for i in ("m", "n")], schemas.MEMORIES)
    versions = {-1: table}

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{batch_id}")
        versions[batch_id] = spark.read.parquet(f"{tmp_path}/v{batch_id}")

    stream = files(rows, f"{tmp_path}/in", [spark.createDataFrame(x, schema) for x in (one, two)])
    q = streams.stream_memories(stream, lambda: versions[max(versions)], write, f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    assert q.exception() is None and sorted(versions) == [-1, 0, 1]
    got = sorted((r["id"], r["data"]) for r in versions[1].collect())
    assert got == sorted((r["id"], r["data"]) for r in M.apply_actions(table, rows).collect()) and len(got) == 2


def test_journal(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "message", "x", T0), ("v", 1, "message", "y", T0)], "user_id string, pos int, type string, content string, timestamp timestamp")
    q = streams.stream_journal(files(rows, f"{tmp_path}/in", [rows]), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(240)
    assert q.exception() is None
    assert sorted((r["user_id"], r["content"]) for r in spark.read.json(f"{tmp_path}/out").collect()) == [("u", "x"), ("v", "y")]


def test_fact_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=1)), ("b", T0)], "doc_id string, ts timestamp")
    out = run(streams.stream_fact_dedup(files(rows, f"{tmp_path}/in", [rows])), "w5", "append", tmp_path)
    assert sorted(r["doc_id"] for r in out.collect()) == ["a", "b"]
