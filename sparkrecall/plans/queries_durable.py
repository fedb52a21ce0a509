"""Queries of jobs over stored tables that touch only what changes, of exact stores, remembered models and indexed searches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecall.operators import index as I
from sparkrecall.operators import journal as J
from sparkrecall.operators import sessions as S
from sparkrecall.operators import vectors as N
from sparkrecall.plans import durable as D
from sparkrecall.plans import views as W
from sparkrecall.plans.queries import _contexts, _rounds, _saved, as_of, memory_actions, query
from sparkrecall.plans.queries_io import _calls, _entry_columns
from sparkrecall.sources import tables as X
from sparkrecall.sources.models import ModelCache
from sparkrecall.streaming import streams

#: Few, so that other users share the buckets of the two whose memories change.
BUCKETS = 16


def _stored(spark: SparkSession, d: str) -> D.BucketTable:
    table = D.memory_table(spark, X.scratch(spark, "memory-table"), BUCKETS)
    table.rewrite(W.memories(spark, d), list(range(BUCKETS)), "first")
    return table


def _columns(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "user_id", "data", "hash", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"), *more)


@query
def l14_pruned_merge(spark, d):
    """The actions of two users merged into the stored table; which write each row stands in tells the folders that were rewritten."""
    table = _stored(spark, d)
    D.merge_actions(table, memory_actions(spark, d).filter("user_id in ('u1', 'u4')"), "second")
    return _columns(table.read(marked=True), "version")


@query
def w3_durable_merge(spark, d):
    """The actions of l14 as a stream of two lots into the stored table, which is opened anew for the second; the batches are then
    sent once more under the numbers they had."""
    source, checkpoint = (X.scratch(spark, n) for n in ("actions", "checkpoint"))
    actions, path, lots = memory_actions(spark, d), _stored(spark, d).path, []
    for k in (0, 1):
        lots.append(actions.filter(F.pmod(F.xxhash64("request_id"), F.lit(2)) == k))
        lots[-1].write.mode("append").parquet(source)
        table = D.memory_table(spark, path, BUCKETS)
        D.stream_memory_table(spark.readStream.schema(actions.schema).parquet(source), table, checkpoint).awaitTermination()
    for k, lot in enumerate(lots):
        D.merge_actions(table, lot, f"stream/{k}")
    return _columns(table.read())


@query
def l19_store_log(spark, d):
    """Stored rounds, two batches of calls appended to the log, and the buckets of more than one folder compacted."""
    log, r = D.session_log(spark, X.scratch(spark, "session-log"), BUCKETS), W.requests(spark, d)
    log.append(_rounds(spark, d), "stored")
    for k in (0, 1):
        D.log_requests(log, r.filter(F.col("conv_id") % 2 == k), f"calls {k}")
    D.compact_sessions(log, as_of(), "compact")
    return D.logged_sessions(log, as_of()).select("user_id", "session_id", "round_no", F.size("messages").alias("n_messages"))


@query
def l19_store_exact(spark, d):
    """Every call sees the memories that its user's earlier calls left."""
    return D.remember_exact(W.requests(spark, d), W.memories(spark, d), N.hashed_bigrams(64)).memories.select("id", "user_id", "data")


@query
def l7_index_recall(spark, d):
    """Nearest memories by the stored index for the stated query set, against the exact search: hits of each query, and whether nine
    of ten exact hits are found over all."""
    path, asked, memories = X.scratch(spark, "index"), W.vector_queries(spark, d), W.memories(spark, d)
    I.write_index(memories, path)
    found = X.written(I.knn_index(asked, *I.read_index(spark, path)), "found")
    exact = X.written(N.knn_global(asked, memories), "exact")
    both = exact.select("request_id", "id").join(found.select("request_id", "id"), ["request_id", "id"]).count()
    return found.groupBy("request_id").agg(F.count("*").alias("n_hits")).withColumn("reached", F.lit(both >= 0.9 * exact.count()))


def _numbered(system: list[str], user: list[str]) -> list[tuple[str, str]]:
    """Every call has an answer of its own, which tells calls apart."""
    return [(json.dumps({"facts": [uuid.uuid4().hex]}), '{"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}') for _ in user]


@query
def u1_model_cache(spark, d):
    """Documents' texts given to a model in two batches that share a third of the documents: answers and calls of every text."""
    path, docs = X.scratch(spark, "models"), W.table(spark, d, "documents")
    said = None
    for k in (0, 1):
        ask = ModelCache(spark, path, BUCKETS).answers("numbered")
        rows = docs.filter(F.col("doc_id") % 3 != k).select(F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")).alias("request_id"), F.col("source").alias("user_id"), F.lit("s").alias("system"), F.coalesce("text", F.lit("")).alias("user"))
        got = ask(rows, _numbered, "system", "user").join(rows.select("request_id", F.md5("user").alias("digest")), "request_id")
        said = got if said is None else said.unionByName(got)
    return said.groupBy("digest").agg(F.count("*").alias("rows"), F.count_distinct("response").alias("calls"))


@query
def r11_stored_contexts(spark, d):
    """Contexts stored in two batches, a third of them first with another expiry, and looked up by hash, with hashes nobody has."""
    table, c = D.context_table(spark, X.scratch(spark, "contexts"), BUCKETS), _contexts(spark, d)
    early = c.withColumn("created_at", F.timestamp_seconds(F.lit(W.EPOCH))).withColumn("expires_at", F.timestamp_seconds(F.lit(W.EPOCH)))
    table.append(early, "first")
    table.append(c.filter(F.ascii("hash") % 3 != 0), "second")
    asked = c.select("hash").union(W.requests(spark, d).select(F.substring(F.md5("request_id"), 1, 24)))
    return D.find_contexts(table, asked, as_of()).select("hash", "found", "round_id", "omitted_messages")


@query
def s5_journal_table(spark, d):
    """The journal in two batches, then compacted."""
    table, r = D.journal_table(spark, X.scratch(spark, "journal"), BUCKETS), W.page_requests(spark, d)
    for k in (0, 1):
        D.log_journal(table, J.journal_entries(r.filter(F.col("page_id") % 2 == k), _saved(spark, d)), f"pages {k}")
    table.compact("compact")
    return _entry_columns(table.read())


@query
def w4_durable_journal(spark, d):
    """The journal as a stream of two lots, the second after a restart; the first is sent once more under its number."""
    source, path, checkpoint = (X.scratch(spark, n) for n in ("entries", "journal", "checkpoint"))
    r = W.page_requests(spark, d)
    for k in (0, 1):
        entries = J.journal_entries(r.filter(F.col("page_id") % 2 == k), _saved(spark, d))
        entries.write.mode("append").parquet(source)
        table = D.journal_table(spark, path, BUCKETS)
        D.stream_journal_table(spark.readStream.schema(entries.schema).parquet(source), table, checkpoint).awaitTermination()
    D.log_journal(table, entries, "stream/0")
    return _entry_columns(table.read())


@query
def w1_stream_from_table(spark, d):
    """The earlier half of all store calls as a stored table by the batch operators; a stream starts from it and takes the later half;
    the sessions are then read from the stream's state."""
    source, checkpoint, stored = (X.scratch(spark, n) for n in ("calls", "checkpoint", "stored"))
    calls, was = _calls(spark, d), spark.conf.get(streams.STATE_STORE, None)
    low, high = calls.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    early = F.unix_seconds("ts") < ((low or 0) + (high or 0)) // 2
    first = S.append_rounds(calls.filter(early).withColumn("round_no", F.lit(0)), calls.withColumn("round_no", F.lit(0)).limit(0))
    segments = S.segments(first).withColumn("last", F.max("segment").over(Window.partitionBy(*S.KEYS))).filter("segment = last")
    kept = S.keep_last_rounds(segments).drop("segment", "last", "updated_at")
    kept.write.parquet(stored)
    calls.filter(~early).write.parquet(source)
    spark.conf.set(streams.STATE_STORE, streams.ROCKSDB)
    try:
        rows = streams.stream_sessions(spark.readStream.schema(calls.schema).parquet(source), forget=False, stored=spark.read.parquet(stored))
        rows.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        states = X.written(streams.session_states(spark, checkpoint), "states")
    finally:
        spark.conf.set(streams.STATE_STORE, was) if was else spark.conf.unset(streams.STATE_STORE)
    return states.select("user_id", "session_id", "round_no", "round_id", "first_user_text")
