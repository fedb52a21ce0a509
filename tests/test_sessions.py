"""Sessions: the literal cases, and expiry, cap and point in time against a plain fold over calls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.functions import text as T
from sparkrecall.operators import contexts as C
from sparkrecall.operators import sessions as S

T0 = dt.datetime(2024, 1, 1)


def rounds(spark, texts, user="u", session="s"):
    rows = [(user, session, k + 1, f"id{k}", T0 + dt.timedelta(seconds=k), [("user", q, None), *[("assistant", a, None) for a in answers]], q) for k, (q, *answers) in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.ROUNDS)


def asked(spark, query, recent=1):
    return spark.createDataFrame([("r", "u", "s", recent, query)], "request_id string, user_id string, session_id string, recent_rounds_full int, query_text string")


def history(spark, texts, query, recent=1, threshold=0.35, strategy=T.REVERSIBLE):
    c = S.classify_rounds(S.split_recent(rounds(spark, texts), asked(spark, query, recent)), threshold)
    return [(r["role"], r["content"]) for r in S.history_messages(c, strategy).orderBy("pos").collect()], c


def test_one_round_per_call(spark):
    m = [("user", "q1", None), ("assistant", "a1", None), ("user", "q2", None), ("assistant", "a2", None)]
    r = S.rounds_of_requests(spark.createDataFrame([("r1", T0, "u", "s", None, m)], schemas.REQUESTS)).collect()
    assert len(r) == 1 and len(r[0]["messages"]) == 4 and r[0]["first_user_text"] == "q1"


def test_first_user_text_skips_others(spark):
    m = [("assistant", "hello", None), ("user", "first real question", None)]
    r = S.rounds_of_requests(spark.createDataFrame([("r1", T0, "u", "s", None, m)], schemas.REQUESTS)).first()
    assert r["first_user_text"] == "first real question"


def test_cap(spark):
    old = rounds(spark, [(f"old{k}",) for k in range(1, 11)])
    new = rounds(spark, [("new",)]).withColumn("ts", F.lit(T0 + dt.timedelta(hours=1)))
    kept = S.keep_last_rounds(S.append_rounds(old, new), 10).orderBy("round_no").collect()
    assert len(kept) == 10 and kept[0]["first_user_text"] == "old2" and kept[-1]["first_user_text"] == "new"
    assert {r["updated_at"] for r in kept} == {T0 + dt.timedelta(hours=1)}


def test_relevant_round_in_full(spark):
    got, _ = history(spark, [("python questions please", "sure"), ("last", "ok")], "python questions")
    assert got == [("user", "python questions please"), ("assistant", "sure"), ("user", "last"), ("assistant", "ok")]


def test_irrelevant_round(spark):
    got, c = history(spark, [("zzzz", "the answer"), ("last", "ok")], "python programming code", threshold=0.7)
    assert got[0] == ("user", "zzzz") and got[2:] == [("user", "last"), ("assistant", "ok")]
    digest = got[1][1].removeprefix("[previous response omitted] Retrieve more: hash=").removesuffix("]")
    assert len(digest) == 24 and int(digest, 16) >= 0
    rows = C.context_rows(C.compressed(c), F.lit(T0))
    assert [(r["hash"], r["omitted_text"], r["kept_text"]) for r in rows.collect()] == [(digest, "the answer", "zzzz")]
    want = spark.createDataFrame([(digest,), ("unknown",)], "hash string")
    found = {r["hash"]: (r["found"], r["omitted_messages"]) for r in C.retrieve_contexts(rows, want, F.lit(T0)).collect()}
    assert found == {digest: (True, '[{"content": "the answer", "role": "assistant"}]'), "unknown": (False, None)}
    later = F.lit(T0 + dt.timedelta(days=2))
    assert not any(r["found"] for r in C.retrieve_contexts(rows, want, later).collect())
    assert C.missing_contexts(rows, want, later).count() == 2


def test_omit(spark):
    got, c = history(spark, [("zzzz", "the answer"), ("last", "ok")], "python", threshold=0.7, strategy=T.OMIT)
    assert got[1] == ("assistant", "[previous response omitted]")
    assert C.strategy_of(T.OMIT).contexts(C.compressed(c), F.lit(T0)).count() == 0
    with pytest.raises(ValueError):
        C.strategy_of("other")


def test_empty_query_compresses_all(spark):
    got, _ = history(spark, [("a question", "x"), ("last", "ok")], "", threshold=0.0)
    assert len(got) == 4 and got[1][1].startswith("[previous")


def test_short_text_counts_at_threshold_zero(spark):
    got, _ = history(spark, [("a", "x"), ("last", "ok")], "b", threshold=0.0)
    assert got[1] == ("assistant", "x")


def test_round_of_one_message_still_gives_two(spark):
    got, _ = history(spark, [("zzzz",), ("last", "ok")], "python", threshold=0.7)
    assert len(got) == 4


def test_round_without_messages_gives_nothing(spark):
    base = rounds(spark, [("zzzz", "a"), ("last", "ok")])
    base = base.withColumn("messages", F.when(F.col("round_no") == 1, F.array().cast(base.schema["messages"].dataType)).otherwise(F.col("messages")))
    c = S.classify_rounds(S.split_recent(base, asked(spark, "python")), 0.7)
    assert S.history_messages(c).count() == 2 and S.history_text(c).first()["history"] == "user: last\nassistant: ok"


def test_default_recent_rounds(spark):
    got, _ = history(spark, [(f"q{k}", f"a{k}") for k in range(5)], "zz", recent=None, threshold=0.9)
    assert len(got) == 10 and got[4:] == [x for k in (2, 3, 4) for x in (("user", f"q{k}"), ("assistant", f"a{k}"))]


def test_history_text_clips_question(spark):
    _, c = history(spark, [("z" * 300, "a"), ("last", "ok")], "python", threshold=0.7)
    text = S.history_text(c).first()["history"].split("\n")
    assert text[0] == "user: " + "z" * 200 + "..." and text[2:] == ["user: last", "assistant: ok"]


def test_absent_session(spark):
    keys = spark.createDataFrame([("u", "s"), ("u", "none")], "user_id string, session_id string")
    got = {r["session_id"]: len(r["rounds"]) for r in S.get_sessions(rounds(spark, [("q", "a")]), keys).collect()}
    assert got == {"s": 1, "none": 0}


def test_upsert_renews(spark):
    _, c = history(spark, [("zzzz", "a"), ("last", "ok")], "python", threshold=0.7)
    first = C.context_rows(C.compressed(c), F.lit(T0))
    second = C.context_rows(C.compressed(c), F.lit(T0 + dt.timedelta(hours=5)))
    got = C.upsert_contexts(first, second).collect()
    assert len(got) == 1 and got[0]["expires_at"] == T0 + dt.timedelta(hours=29)


def fold(calls, ttl, cap):
    """Rounds left after calls (time, id) of one session, in order."""
    kept, last = [], None
    for t, i in calls:
        if last is not None and t - last >= ttl:
            kept = []
        kept, last = [*kept, i][-cap:], t
    return kept, last


@pytest.mark.parametrize("seed", [1, 2])
def test_expiry_cap_and_point_in_time(spark, seed):
    rnd, ttl, cap = random.Random(seed), 100, 4
    calls = {s: sorted((rnd.randrange(2000), f"{s}-{k}") for k in range(rnd.randrange(1, 40))) for s in ("a", "b", "c")}
    rows = [("u", s, k + 1, i, T0 + dt.timedelta(seconds=t), [("user", i, None)], i) for s, own in calls.items() for k, (t, i) in enumerate(own)]
    df = spark.createDataFrame(rows, schemas.ROUNDS)
    now = 1950
    got = S.keep_last_rounds(S.expire_sessions(df.filter(F.col("ts") <= F.lit(T0 + dt.timedelta(seconds=now))), F.lit(T0 + dt.timedelta(seconds=now)), ttl), cap)
    want = []
    for own in calls.values():
        kept, last = fold([c for c in own if c[0] <= now], ttl, cap)
        want += kept if last is not None and now - last < ttl else []
    assert sorted(r["round_id"] for r in got.collect()) == sorted(want)
    asks = [(s, t, f"{s}@{t}") for s in calls for t in (0, 500, 1000, 1500, 2100)]
    requests = spark.createDataFrame([("u", s, T0 + dt.timedelta(seconds=t), r) for s, t, r in asks], "user_id string, session_id string, ts timestamp, request_id string")
    got = sorted((r["request_id"], r["round_id"]) for r in S.session_as_of(df, requests, cap, ttl).collect())
    want = []
    for s, t, r in asks:
        kept, last = fold([c for c in calls[s] if c[0] <= t], ttl, cap)
        want += [(r, i) for i in kept] if last is not None and t - last < ttl else []
    assert got == sorted(want)
