"""Queries of what reads and writes tables, runs as a stream, or takes another's model or module: each goes out to files in
the shared folder and comes back, or runs a stream over all there is, and returns what was read back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.functions import text as T
from sparkrecall.operators import contexts as C
from sparkrecall.operators import journal as J
from sparkrecall.operators import memory as M
from sparkrecall.operators import vectors as N
from sparkrecall.plans import jobs
from sparkrecall.plans import views as W
from sparkrecall.plans.queries import RELEVANT, _classified, _contexts, _facts, _rounds, _saved, as_of, memory_actions, query
from sparkrecall.sources import tables as X
from sparkrecall.streaming import streams

# Sources and sinks


@query
def s1_read_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON lines, every other message with a list of items, read back."""
    path = X.scratch(spark, "requests")
    one = F.transform("input", lambda m: F.when(m["content_items"].isNotNull(), F.to_json(F.struct(m["role"].alias("role"), m["content_items"].alias("content")))).otherwise(F.to_json(F.struct(m["role"].alias("role"), m["content_text"].alias("content")))))
    head = F.to_json(F.struct("request_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("user_id").alias("userId"), F.col("session_id").alias("sessionId"), F.struct("recent_rounds_full").alias("memory_settings")))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(', "input": ['), F.array_join(one, ", "), F.lit("]}"))
    W.requests(spark, d, W.itemised).select(line).write.text(path)
    r = X.read_requests(spark, path)
    return r.select("request_id", "user_id", "session_id", "recent_rounds_full", F.unix_seconds("ts").alias("at"), F.size("input").alias("n_messages"), T.messages_to_text("input").alias("text"))


@query
def s2_sessions(spark, d):
    path = X.scratch(spark, "sessions")
    X.write_sessions(_rounds(spark, d), path)
    return X.read_sessions(spark, path).select("user_id", "session_id", "round_no", "round_id", F.size("messages").alias("n_messages"), "first_user_text")


@query
def s3_memories(spark, d):
    """The memory table written and read; then only the folders of two users, whose other rows are filtered out."""
    path = X.scratch(spark, "memories")
    X.write_memories(W.memories(spark, d), path, 64)
    return X.read_memories(spark, path).select("id", "user_id", "data", "hash", F.size("vector").alias("dims"), F.unix_seconds("created_at").alias("created"))


@query
def s4_contexts(spark, d):
    path = X.scratch(spark, "contexts")
    X.write_contexts(_contexts(spark, d), path)
    return X.read_contexts(spark, path).select("hash", "user_id", "session_id", "round_id", "kept_message", "omitted_messages", "kept_text", F.unix_seconds("expires_at").alias("expires"))


def _entry_columns(e: DataFrame) -> DataFrame:
    return e.select("request_id", "user_id", F.col("date").cast("string").alias("day"), "pos", "type", "role", "content", "original_url", "local_path", F.unix_seconds("timestamp").alias("at"))


@query
def s5_journal_files(spark, d):
    path = X.scratch(spark, "journal")
    X.write_journal(J.journal_entries(W.page_requests(spark, d), _saved(spark, d)), path)
    return _entry_columns(X.read_journal(spark, path))


def _page_files(pages: DataFrame, path: str) -> DataFrame:
    """page_id and file_url of pages (page_id, html) that tasks store as files, a zero byte behind each; one page, one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            urls = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = html + b"\0"
                folder, name = f"{(page or 0) % 1000:03}", f"{page}-{hashlib.md5(data).hexdigest()}.html"
                store.create_dir(f"{base}/{folder}")
                with store.open_output_stream(f"{base}/{folder}/{name}") as out:
                    out.write(data)
                urls.append(f"{path}/{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(urls, pa.string())], names=["page_id", "file_url"])

    return pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("html")).mapInArrow(run, "page_id long, file_url string")


@query
def s6_ingest_attachments(spark, d):
    """Pages stored as files, then taken in by a manifest of which one url in three leads nowhere."""
    path = X.scratch(spark, "pages")
    stored = X.written(_page_files(W.table(spark, d, "pages"), path), "stored-pages")
    url = F.when(F.coalesce(F.col("page_id") % 3, F.lit(0)) == 0, F.concat("file_url", F.lit(".lost"))).otherwise(F.col("file_url"))
    manifest = stored.select("page_id", url.alias("file_url"), F.concat(F.lit("raw/"), F.col("page_id").cast("string")).alias("dest"))
    return X.ingest_attachments(manifest, [path]).select("page_id", "local_path", F.coalesce("length", F.lit(-1)).alias("length"), F.md5("content").alias("digest"))


@query
def j5_journal(spark, d):
    """Journal entries as written, and attachments, by user."""
    path = X.scratch(spark, "journal")
    manifest = X.journal(W.page_requests(spark, d), _saved(spark, d), path)
    entries = X.read_journal(spark, path).groupBy("user_id").agg(F.count("*").alias("entries"), F.count("content").alias("messages"), F.min("date").cast("string").alias("first_day"))
    files = manifest.groupBy("user_id").agg(F.count("*").alias("attachments"), F.max("dest").alias("last_dest"))
    return entries.join(files, "user_id")


# Streams: what there is goes through as micro-batches, and the state or table after the last is returned


def _calls(spark, d) -> DataFrame:
    return W.event_rounds(spark, d).select("user_id", "session_id", "ts", "round_id", "first_user_text", F.to_json("messages").alias("messages"))


@query
def w1_stream_sessions(spark, d):
    """Store calls that arrive in two lots; the state of every session after the last lot that touched it."""
    source, out, checkpoint = (X.scratch(spark, n) for n in ("calls", "states", "checkpoint"))
    calls, was = _calls(spark, d), spark.conf.get(streams.STATE_STORE, None)
    low, high = calls.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    middle = F.unix_seconds("ts") < ((low or 0) + (high or 0)) // 2
    spark.conf.set(streams.STATE_STORE, streams.ROCKSDB)
    try:
        for lot, own in enumerate((middle, ~middle)):
            calls.filter(own).write.mode("append").parquet(source)
            rows = streams.stream_sessions(spark.readStream.schema(calls.schema).parquet(source), forget=False)
            write = lambda batch, k, lot=lot: batch.withColumn("step", F.lit(lot)).write.mode("append").parquet(out)
            rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(streams.STATE_STORE, was) if was else spark.conf.unset(streams.STATE_STORE)
    states = spark.read.schema(streams.SESSION_ROWS + ", step int").parquet(out)
    last = F.max("step").over(Window.partitionBy("user_id", "session_id"))
    return states.withColumn("last", last).filter("step = last").select("user_id", "session_id", "round_no", "round_id", "first_user_text")


@query
def w2_stream_session_windows(spark, d):
    """The segments that have closed an hour before the last event."""
    source, out, checkpoint = (X.scratch(spark, n) for n in ("calls", "windows", "checkpoint"))
    calls = _calls(spark, d)
    calls.write.parquet(source)
    rows = streams.stream_session_windows(spark.readStream.schema(calls.schema).parquet(source))
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rows.schema).parquet(out)
    return found.select("user_id", "session_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("expires_at").alias("expires_us"), "rounds")


@query
def w3_stream_memories(spark, d):
    """The actions of l14 as a stream of two lots; the memory table after both."""
    source, out, checkpoint = (X.scratch(spark, n) for n in ("actions", "memories", "checkpoint"))
    actions, versions = memory_actions(spark, d), []

    def read() -> DataFrame:
        return spark.read.schema(schemas.MEMORIES).parquet(versions[-1]) if versions else W.memories(spark, d)

    def write(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/{batch}")
        versions.append(f"{out}/{batch}")

    for lot in (0, 1):
        actions.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == lot).write.mode("append").parquet(source)
        streams.stream_memories(spark.readStream.schema(actions.schema).parquet(source), read, write, checkpoint).awaitTermination()
    return read().select("id", "user_id", "data", "hash", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))


@query
def w4_stream_journal(spark, d):
    source, out, checkpoint = (X.scratch(spark, n) for n in ("entries", "journal", "checkpoint"))
    entries = J.journal_entries(W.page_requests(spark, d), _saved(spark, d))
    entries.write.parquet(source)
    streams.stream_journal(spark.readStream.schema(entries.schema).parquet(source), out, checkpoint).awaitTermination()
    return _entry_columns(X.read_journal(spark, out))


@query
def w5_stream_fact_dedup(spark, d):
    """Documents as facts of their sources, each fact once."""
    source, out, checkpoint = (X.scratch(spark, n) for n in ("facts", "distinct", "checkpoint"))
    facts = W.table(spark, d, "documents").select(F.col("source").alias("user_id"), T.memory_doc_id("source", "text").alias("doc_id"), F.timestamp_seconds(F.lit(W.EPOCH)).alias("ts"))
    facts.write.parquet(source)
    rows = streams.stream_fact_dedup(spark.readStream.schema(facts.schema).parquet(source))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(facts.schema).parquet(out).select("user_id", "doc_id")


# Models and modules of the caller's own


def _whole(texts: list[str]) -> list[list[str]]:
    return [[t] for t in texts]


def _sizes(texts: pd.Series) -> pd.Series:
    return pd.Series([[float(len(t)), 1.0] if t else None for t in texts])


def _echo(system: list[str], user: list[str]) -> list[tuple[str, str]]:
    return [(json.dumps({"facts": [u]}), json.dumps({"prompt_tokens": len(s), "completion_tokens": len(u), "total_tokens": len(s) + len(u)})) for s, u in zip(system, user)]


def _update_first(old: list[str], facts: list[str]) -> list[tuple[str, str]]:
    """The first memory gets the first fact's words."""
    out = []
    for o, f in zip(old, facts):
        first = json.loads(o)[0]
        out.append((json.dumps({"memory": [{"id": first["id"], "text": json.loads(f)[0], "event": "UPDATE", "old_memory": first["text"]}]}), '{"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7}'))
    return out


@query
def u1_batch_extractor(spark, d):
    return M.extract_facts(W.requests(spark, d), M.batch_extractor(_whole)).select("request_id", "user_id", "fact_pos", "fact")


@query
def u1_model_extractor(spark, d):
    found, usage = M.model_extractor(_echo, F.lit("2024-05-06").cast("date"), "Today is {date}.")(W.requests(spark, d))
    return found.join(usage, "request_id").select("request_id", "fact_pos", "fact", "input_tokens", "output_tokens", "total_tokens")


@query
def u2_embedder(spark, d):
    own = N.embed_texts(W.table(spark, d, "conversations").select("conv_id", "turn", "text"), _sizes)
    return own.select("conv_id", "turn", F.col("vector")[0].cast("double").alias("first"), F.size("vector").alias("dims"))


@query
def u3_model_decider(spark, d):
    facts, memories = _facts(spark, d), W.memories(spark, d)
    actions, usage = M.model_decider(_update_first)(facts.drop("vector"), M.fact_hits(facts, memories, 5), memories)
    return actions.join(usage, "request_id").select("request_id", "pos", "user_id", "id", "text", "event", "old_memory", "total_tokens")


@query
def u4_strategies(spark, d):
    """Both strategies by name: the marker of every compressed round, and whether its messages are kept by hash."""
    rounds, out = C.compressed(_classified(spark, d)), None
    for name in (T.REVERSIBLE, T.OMIT):
        strategy = C.strategy_of(name)
        kept = strategy.contexts(rounds, as_of()).select("hash", F.lit(True).alias("stored"))
        own = strategy.marker(rounds).join(kept, "hash", "left").select(F.lit(strategy.name).alias("strategy"), "request_id", "round_no", "marker", F.coalesce("stored", F.lit(False)).alias("kept"))
        out = own if out is None else out.unionByName(own)
    return out


def _nothing(queries: DataFrame, memories: DataFrame, k: int, threshold: float) -> DataFrame:
    return M.retrieve(queries, memories.filter(F.lit(False)), k, threshold)


@query
def u5_recall_module(spark, d):
    """Recall with a memory search of one's own, which finds nothing."""
    found = jobs.recall(W.requests(spark, d), _rounds(spark, d), W.memories(spark, d), as_of(), N.hashed_bigrams(64), threshold=RELEVANT, retrieve=_nothing)
    return found.history.select("request_id", "pos", "role", "content")


def _counting(requests: DataFrame, memories: DataFrame, *_: object) -> jobs.Remembered:
    n = F.size("input").cast("long")
    return jobs.Remembered(memories, None, requests.select("request_id", n.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), (n + 1).alias("total_tokens")))


@query
def u5_store_modules(spark, d):
    """Store with a long-term memory and a journal of one's own: usage by request, and attachments of its user."""
    path, saved = X.scratch(spark, "journal"), _saved(spark, d)
    r = W.page_requests(spark, d)
    none = spark.createDataFrame([], schemas.ROUNDS)
    done = jobs.store(r, none, W.memories(spark, d), as_of(), long_term=_counting, journal=lambda own: X.journal(own, saved, path))
    files = done.attachments.groupBy("user_id").agg(F.count("*").alias("attachments"))
    entries = X.read_journal(spark, path).groupBy("request_id").agg(F.count("*").alias("entries"))
    return done.usage.join(r.select("request_id", "user_id"), "request_id").join(files, "user_id").join(entries, "request_id").select("request_id", "user_id", "total_tokens", "attachments", "entries")


@query
def l18_recall_as_of(spark, d):
    """Every signup recalls its session as of its own time; all other events are what was stored."""
    e = W.table(spark, d, "events").filter("event_type = 'signup'")
    ask = F.array(T.message(F.lit("user"), F.lit("what was it")))
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    asked = e.select(F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), name("u").alias("user_id"), name("s").alias("session_id"), F.lit(5).alias("recent_rounds_full"), ask.alias("input"))
    rounds = W.event_rounds(spark, d, F.col("event_type") != "signup")
    found = jobs.recall(asked, rounds, W.memories(spark, d), None, N.hashed_bigrams(64), retrieve=_nothing, cap=5)
    return found.history.select("request_id", "pos", "role", "content")


@query
def l19_store_usage(spark, d):
    """Tokens of every store call: a model extracts, another decides where the user has memories."""
    done = jobs.store(W.requests(spark, d), _rounds(spark, d), W.memories(spark, d), as_of(), N.hashed_bigrams(64), M.model_extractor(_echo, F.lit("2024-05-06").cast("date"), "Today is {date}."), M.model_decider(_update_first))
    return done.usage
