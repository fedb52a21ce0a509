import pytest

from sparkrecall import schemas
from sparkrecall.operators import validate as V

TEXT = [("user", "hi", None)]


@pytest.mark.parametrize(
    "user,session,recent,messages,reasons",
    [
        ("u1", "s1", None, TEXT, []),
        ("a.b:c_d-1", "s1", 3, TEXT, []),
        ("", "s1", None, TEXT, ["user_id"]),
        ("../escape", "s1", None, TEXT, ["user_id"]),
        ("u1\n", "s1", None, TEXT, ["user_id"]),
        ("x" * 128, "x" * 129, None, TEXT, ["session_id"]),
        (None, None, None, TEXT, ["user_id", "session_id"]),
        ("u1", "s1", 0, TEXT, ["recent_rounds_full"]),
        ("u1", "s1", None, [], ["empty_input"]),
        ("u1", "s1", None, None, ["empty_input"]),
        ("u1", "s1", None, [("robot", "hi", None)], ["role"]),
        ("u1", "s1", None, [("user", None, [("video", None, None, None)])], ["item_type"]),
        ("u1", "s1", None, [("user", None, [("file", None, None, "f")])], []),
    ],
)
def test_requests(spark, user, session, recent, messages, reasons):
    df = spark.createDataFrame([("r", None, user, session, recent, messages)], schemas.REQUESTS)
    good, bad = V.validate_requests(df)
    assert good.count() == (not reasons)
    assert [r["reasons"] for r in bad.collect()] == ([reasons] if reasons else [])


def test_scores_and_usage(spark):
    hits = spark.createDataFrame([(0.0, 2.0), (2.5, 1.0), (-0.1, 1.0), (1.0, 2.1), (None, 1.0)], "score double, importance double")
    assert [tuple(r) for r in V.valid_scores(hits).collect()] == [(0.0, 2.0)]
    usage = spark.createDataFrame([(1, 2, 3), (-1, 0, 0), (None, 0, 0)], "input_tokens long, output_tokens long, total_tokens long")
    assert [tuple(r) for r in V.valid_usage(usage).collect()] == [(1, 2, 3), (0, 0, 0)]


def test_user_dir(spark):
    names = ["u1", "../escape", "a/../../b", "a/../b", "/etc", "", ".", "..", "a/b", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(V.safe_user_dir("n")).collect()] == [True, False, False, True, False, True, True, False, True, False]
