"""Texts, hashes and names against plain Python on awkward strings."""

import hashlib
import json
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.functions import text as T

ODD = [
    "", " ", "a", "hello world", "  two spaces　here\t\n ", "quote \" back \\ slash / end", "ctrl \x01 \x1f \x7f \b \f", "emoji \U0001f642 éüß",
    "\u0085next\x1cline", "\\u001F literal", "\\\\u001B \x1b", "ABCİΣ", "x" * 250,
]


def one(spark, values, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").orderBy("i").select(column).collect()]


def messages(spark, rows):
    return spark.createDataFrame([(rows,)], f"m array<{schemas.MESSAGE}>")


def item(kind, text=None, image=None, file=None):
    return (kind, text, image, file)


def test_extract_text_cases(spark):
    cases = [
        ("hello world", None, "hello world"),
        (None, [item("input_text", "look"), item("input_image", image="http://i")], "look"),
        (None, [item("input_image", image="http://i")], ""),
        (None, [], ""),
        (None, [item("input_text", "a"), item("input_text", ""), item("input_text", "b")], "a b"),
        (None, None, ""),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a string, b array<{schemas.ITEM}>")
    assert [r[0] for r in df.orderBy("i").select(T.extract_text("a", "b")).collect()] == [c[2] for c in cases]


def test_message_texts(spark):
    df = messages(spark, [("user", "first question", None), ("assistant", "answer", None), ("tool", "", None), ("user", None, [item("input_text", "second question")])])
    row = df.select(T.messages_to_text("m"), T.last_user_query("m"), T.first_user_text("m"), T.messages_to_query("m")).first()
    assert row[0] == "user: first question\nassistant: answer\nuser: second question"
    assert row[1:] == ("second question", "first question", "answer")


def test_query_of_silent_assistant(spark):
    df = messages(spark, [("user", "q", None), ("assistant", "", None)])
    assert df.select(T.messages_to_query("m")).first()[0] == "user: q"
    df = messages(spark, [("system", "s", None)])
    assert df.select(T.messages_to_query("m"), T.last_user_query("m"), T.first_user_text("m")).first()[:] == ("system: s", "", "")
    assert messages(spark, []).select(T.messages_to_text("m"), T.last_user_query("m")).first()[:] == ("", "")


def test_bigrams(spark):
    got = one(spark, ["hello", "a", "", "AbAb", None], T.char_bigrams("t"))
    assert [sorted(g) if g is not None else None for g in got] == [["el", "he", "ll", "lo"], [], [], ["ab", "ba"], []]


@pytest.mark.parametrize("a,b,low,high", [("hello", "hello", 1, 1), ("hello", "xyz", 0, 0.1), ("", "x", 0, 0), ("a", "a", 0, 0), ("hello world", "hello", 1, 1)])
def test_overlap(spark, a, b, low, high):
    assert low <= spark.range(1).select(T.bigram_overlap(F.lit(a), F.lit(b))).first()[0] <= high


def test_white_space_and_ids(spark):
    assert one(spark, ODD, T.normalize_ws("t")) == [" ".join(t.split()) for t in ODD]
    assert one(spark, ODD, T.non_blank("t")) == [bool(t.strip()) for t in ODD]
    want = [hashlib.sha256(f"u1\0{' '.join(t.split())}".encode()).hexdigest() for t in ODD]
    assert one(spark, ODD, T.memory_doc_id(F.lit("u1"), "t")) == want
    assert one(spark, ["fact"], T.memory_doc_id(F.lit("u1"), "t")) != one(spark, ["fact"], T.memory_doc_id(F.lit("u2"), "t"))


def test_canonical_json_and_hash(spark):
    rows = [("user", t, None) for t in ODD] + [("assistant", None, [item("input_text", 'a "b"'), item("file", file="http://f")]), ("assistant", None, [])]
    want = [{"role": r, "content": t if t is not None else [dict(zip(("type", "text", "image_url", "file_url"), x)) for x in items]} for r, t, items in rows]
    text = json.dumps(want, ensure_ascii=False, sort_keys=True)
    df = messages(spark, rows)
    assert df.select(T.canonical_messages_json("m")).first()[0] == text
    digest = hashlib.sha256(f"u\0s\0r\0{text}".encode()).hexdigest()[:24]
    assert df.select(T.context_hash(F.lit("u"), F.lit("s"), F.lit("r"), "m")).first()[0] == digest


def test_clip_and_marker(spark):
    assert one(spark, ["x" * 200, "x" * 201], T.clip_question("t")) == ["x" * 200, "x" * 200 + "..."]
    assert one(spark, ["abc"], T.omission_marker("t")) == ["[previous response omitted] Retrieve more: hash=abc]"]
    assert one(spark, ["abc"], T.omission_marker(None, T.OMIT)) == ["[previous response omitted]"]
    with pytest.raises(ValueError):
        T.omission_marker(None, "other")


URLS = [
    "http://h/a/b.PNG?x=1", "https://h/a.tar.gz", "http://h/", "http://h", "https://h/dir/", "/tmp/photo.jpg", "a.png?x", "file:///tmp/x.mp3", "file:///", "http://h/a;p=1.png", "http://h/%20x.Mp4#f",
    "ftp://h/file.wav", "noname.", ".png", "http://h/.png", "http://h/a b.pdf",
]


def test_attachment_names(spark):
    def name(u):
        p = urlparse(u)
        path = p.path if p.scheme in ("http", "https", "file") else u
        return Path(path or "/").name or ("download" if p.scheme in ("http", "https") else "file")

    def category(u):
        p = urlparse(u)
        return "assets" if Path(p.path if p.scheme else u).suffix.lower() in T.MEDIA_SUFFIXES else "raw"

    want = [f"{category(u)}/{hashlib.md5(u.encode()).hexdigest()[:8]}-{name(u)}" for u in URLS]
    assert one(spark, URLS, T.attachment_dest("t")) == want


def test_context_message(spark):
    got = spark.range(1).select(T.context_message(F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert got == T.CONTEXT_HEADER + "- a\n- b"


def test_bigrams_of_a_long_text_in_one_pass(spark):
    """Every character once, also outside the basic plane; 200,000 characters take well under the time of a quadratic pass."""
    import time

    text = "aB\U0001f642é İ" * 33_000
    df = spark.createDataFrame([(text,), ("\U0001f642\U0001f643",), ("x",), (None,)], "t string").select("t", T.char_bigrams("t").alias("g"))
    began = time.time()
    got = {r["t"]: sorted(r["g"]) for r in df.collect()}
    assert time.time() - began < 20
    low = text.lower()
    assert got[text] == sorted({low[i : i + 2] for i in range(len(low) - 1)}) and got["\U0001f642\U0001f643"] == ["\U0001f642\U0001f643"] and got["x"] == [] == got[None]
