"""Every registered query: one per operation, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecall.functions import text as T
from sparkrecall.operators import contexts as C
from sparkrecall.operators import journal as J
from sparkrecall.operators import memory as M
from sparkrecall.operators import sessions as S
from sparkrecall.operators import validate as V
from sparkrecall.operators import vectors as N
from sparkrecall.plans import jobs
from sparkrecall.plans import views as W
from sparkrecall.sources.tables import check_dims

QUERIES = {}
#: Settings of the queries on conversations, which have few rounds each.
RECENT, RELEVANT, CAP = 1, 0.7, 50


def query(f):
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(W.EPOCH + 3600))


# Validation

@query
def v1_validate_requests(spark, d):
    r = W.requests(spark, d)
    k = F.col("conv_id") % 7
    r = r.withColumn("user_id", F.when(k == 0, "../escape").when(k == 1, "").when(k == 2, F.concat("user_id", F.lit("\n"))).when(k == 3, F.repeat(F.lit("x"), 129)).otherwise(F.col("user_id")))
    r = r.withColumn("recent_rounds_full", F.when(k == 4, 0).otherwise(1))
    r = r.withColumn("input", F.when(k == 5, F.transform("input", lambda m: m.withField("role", F.lit("robot")))).otherwise(F.col("input")))
    good, bad = V.validate_requests(r)
    return good.select("conv_id", F.lit("").alias("reasons")).union(bad.select("conv_id", F.array_join("reasons", ",")))


@query
def v2_valid_scores(spark, d):
    e = W.table(spark, d, "embeddings").select("vec_id", (1 + 5 * F.col("embedding")[0].cast("double")).alias("score"), (1 + 5 * F.col("embedding")[1].cast("double")).alias("importance"))
    return V.valid_scores(e).select("vec_id", F.round("score", 6).alias("score"))


@query
def v3_valid_usage(spark, d):
    n = F.char_length("text").cast("long")
    c = W.table(spark, d, "conversations").select("conv_id", "turn", (n - 100).alias("input_tokens"), F.when(F.col("turn") % 2 == 0, n).alias("output_tokens"), (2 * n).alias("total_tokens"))
    return V.valid_usage(c)


@query
def v4_safe_user_dir(spark, d):
    k = F.col("page_id") % 5
    name = F.when(k == 0, "../escape").when(k == 1, "/etc").when(k == 2, "a/../../b").when(k == 3, "a/../b").otherwise(F.concat(F.lit("u"), F.col("page_id").cast("string")))
    return W.table(spark, d, "pages").select("page_id", V.safe_user_dir(name).alias("safe"))


@query
def v5_non_blank(spark, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, " \t\n").when(k == 1, " 　").otherwise(F.col("text"))
    return W.table(spark, d, "documents").select("doc_id", T.non_blank(text).alias("kept"))


# Texts and hashes

@query
def t1_extract_text(spark, d):
    return W.itemised(spark, d).select("conv_id", "turn", T.extract_text("content_text", "content_items").alias("text"))


@query
def t2_messages_to_text(spark, d):
    return W.requests(spark, d, W.itemised).select("conv_id", T.messages_to_text("input").alias("text"))


@query
def t3_last_user_query(spark, d):
    return W.requests(spark, d, W.itemised).select("conv_id", T.last_user_query("input").alias("text"))


@query
def t4_first_user_text(spark, d):
    return W.requests(spark, d, W.itemised).select("conv_id", T.first_user_text("input").alias("text"))


@query
def t5_flatten_messages(spark, d):
    r = W.requests(spark, d, W.itemised).select("conv_id", F.posexplode(T.flatten_messages("input")).alias("pos", "m"))
    return r.select("conv_id", "pos", "m.role", "m.content")


@query
def t6_messages_to_query(spark, d):
    return W.requests(spark, d, W.itemised).select("conv_id", T.messages_to_query("input").alias("text"))


@query
def t7_char_bigrams(spark, d):
    c = W.table(spark, d, "conversations").select("conv_id", "turn", T.char_bigrams("text").alias("b"))
    return c.select("conv_id", "turn", F.size("b").alias("n"), F.md5(F.array_join(F.sort_array("b"), "|")).alias("digest"))


@query
def t8_bigram_overlap(spark, d):
    c = W.table(spark, d, "conversations").select("conv_id", "turn", T.char_bigrams("text").alias("b"))
    before = F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("p", before).filter("p is not null").select("conv_id", "turn", F.round(T.overlap("p", "b"), 6).alias("score"))


@query
def t9_normalize_ws(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.md5(T.normalize_ws("text")).alias("digest"))


@query
def t10_memory_doc_id(spark, d):
    return W.table(spark, d, "documents").select("doc_id", T.memory_doc_id("source", "text").alias("id"))


@query
def t11_canonical_json(spark, d):
    return W.requests(spark, d).select("conv_id", T.canonical_messages_json("input").alias("json"))


@query
def t12_context_hash(spark, d):
    return W.requests(spark, d).select("conv_id", T.context_hash("user_id", "session_id", F.lit("r1"), "input").alias("hash"))


@query
def t13_clip_question(spark, d):
    return W.table(spark, d, "conversations").select("conv_id", "turn", T.clip_question("text").alias("text"))


@query
def t14_omission_marker(spark, d):
    h = F.substring(F.md5("text"), 1, 24)
    return W.table(spark, d, "conversations").select("conv_id", "turn", T.omission_marker(h).alias("marker"), T.omission_marker(None, T.OMIT).alias("plain"))


@query
def t15_attachment_category(spark, d):
    return W.page_requests(spark, d).select("page_id", T.attachment_category("file_url").alias("category"))


@query
def t16_attachment_dest(spark, d):
    return W.page_requests(spark, d).select("page_id", T.attachment_dest("file_url").alias("dest"))


@query
def t17_context_message(spark, d):
    r = W.requests(spark, d).select("conv_id", T.context_message(F.transform("input", T.text_of)).alias("content"))
    return r


# Sessions

def _rounds(spark, d):
    return S.build_rounds(W.messages(spark, d))


@query
def r1_build_rounds(spark, d):
    return _rounds(spark, d).select("user_id", "session_id", "round_no", "round_id", F.size("messages").alias("n_messages"), "first_user_text")


@query
def r2_append_rounds(spark, d):
    old = W.event_rounds(spark, d, F.col("event_type") != "click")
    new = W.event_rounds(spark, d, F.col("event_type") == "click")
    return S.append_rounds(old, new).select("user_id", "round_id", "round_no", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated"))


@query
def r3_keep_last_rounds(spark, d):
    return S.keep_last_rounds(W.event_rounds(spark, d), CAP).select("user_id", "round_no", "round_id")


@query
def r4_expire_sessions(spark, d):
    return S.expire_sessions(W.event_rounds(spark, d), W.last_event(spark, d)).select("user_id", "round_no", "round_id")


@query
def r5_get_sessions(spark, d):
    m = W.requests(spark, d)
    keys = m.select("user_id", F.when(F.col("conv_id") % 4 == 0, "none").otherwise(F.col("session_id")).alias("session_id")).distinct()
    return S.get_sessions(_rounds(spark, d), keys).select("user_id", "session_id", F.size("rounds").alias("n_rounds"))


def _split(spark, d):
    asked = W.requests(spark, d).select("request_id", "user_id", "session_id", "recent_rounds_full", T.last_user_query("input").alias("query_text"))
    asked = asked.withColumn("query_bigrams", T.char_bigrams("query_text"))
    return S.split_recent(S.with_bigrams(_rounds(spark, d)), asked)


def _classified(spark, d):
    return S.classify_rounds(_split(spark, d), RELEVANT)


@query
def r6_split_recent(spark, d):
    return _split(spark, d).select("request_id", "round_no", "recent")


@query
def r7_classify_rounds(spark, d):
    return _classified(spark, d).select("request_id", "round_no", F.round("score", 6).alias("score"), F.coalesce("relevant", F.lit(True)).alias("shown_full"))


@query
def r8_compress_rounds(spark, d):
    own = C.compress_rounds(C.compressed(_classified(spark, d)))
    return own.select("request_id", "round_no", F.col("kept.role").alias("role"), F.col("kept.content_text").alias("kept"), "marker")


@query
def r8_compress_rounds_omit(spark, d):
    own = C.compress_rounds(C.compressed(_classified(spark, d)), T.OMIT)
    return own.select("request_id", "round_no", F.col("kept.content_text").alias("kept"), "marker")


def _contexts(spark, d):
    return C.context_rows(C.compressed(_classified(spark, d)), as_of())


@query
def r9_context_rows(spark, d):
    c = _contexts(spark, d)
    return c.select("hash", "user_id", "session_id", "round_id", "kept_message", "omitted_messages", "query_text", "kept_text", "omitted_text", F.unix_seconds("expires_at").alias("expires"))


def _later(c: DataFrame) -> DataFrame:
    """The same rounds, some of them compressed again an hour later."""
    again = c.filter("ascii(hash) % 2 = 0")
    return again.withColumn("created_at", F.timestamp_seconds(F.lit(W.EPOCH + 7200))).withColumn("expires_at", F.timestamp_seconds(F.lit(W.EPOCH + 7200 + 86400)))


@query
def r10_upsert_contexts(spark, d):
    c = _contexts(spark, d)
    return C.upsert_contexts(c, _later(c)).select("hash", F.unix_seconds("created_at").alias("created"), F.unix_seconds("expires_at").alias("expires"))


@query
def r11_retrieve_contexts(spark, d):
    c = _contexts(spark, d)
    c = c.withColumn("expires_at", F.when(F.ascii("hash") % 3 == 0, F.timestamp_seconds(F.lit(W.EPOCH))).otherwise(F.col("expires_at")))
    asked = c.select("hash").union(W.requests(spark, d).select(F.substring(F.md5("request_id"), 1, 24)))
    return C.retrieve_contexts(c, asked.distinct(), as_of()).select("hash", "found", "round_id", "omitted_messages")


@query
def r11_missing_contexts(spark, d):
    c = _contexts(spark, d)
    asked = c.select("hash").union(W.requests(spark, d).select(F.substring(F.md5("request_id"), 1, 24)))
    return C.missing_contexts(c, asked.distinct(), as_of())


@query
def r12_history_messages(spark, d):
    return S.history_messages(_classified(spark, d)).select("request_id", "pos", "role", "content")


@query
def r13_history_text(spark, d):
    return S.history_text(_classified(spark, d)).select("request_id", "history")


@query
def r14_session_as_of(spark, d):
    asked = W.event_rounds(spark, d, F.col("event_type") == "signup").select("user_id", "session_id", "ts", F.col("round_id").alias("request_id"))
    rounds = W.event_rounds(spark, d, F.col("event_type") != "signup")
    return S.session_as_of(rounds, asked, 5).select("request_id", "round_id")


# Long-term memory

@query
def s3_memory_dims(spark, d):
    m = W.memories(spark, d)
    m = m.withColumn("vector", F.when(F.ascii(F.substring("id", -1, 1)) % 2 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")))
    good, bad = check_dims(m, 64)
    return good.select("id", F.lit(True).alias("kept")).union(bad.select("id", F.lit(False)))


@query
def l1_extraction_inputs(spark, d):
    return M.extraction_inputs(W.requests(spark, d, W.itemised), F.lit("2024-05-06").cast("date"), "Today is {date}.").select("request_id", "system", "user")


@query
def l2_extract_facts(spark, d):
    return M.extract_facts(W.requests(spark, d)).select("request_id", "fact_pos", "fact")


@query
def l3_parse_facts(spark, d):
    k = F.col("doc_id") % 4
    fact = F.to_json(F.array(F.col("text"), F.col("source")))
    response = F.when(k == 0, "not json").when(k == 1, "{}").otherwise(F.concat(F.lit('{"facts": '), fact, F.lit("}")))
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), response.alias("response"))
    return M.parse_facts(docs)


@query
def l4_sum_usage(spark, d):
    n = F.col("n_chars").cast("string")
    k = F.col("doc_id") % 3
    usage = F.when(k == 0, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": 2, "total_tokens": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit('{"prompt_tokens": '), n, F.lit("}"))).otherwise("[]")
    docs = W.table(spark, d, "documents").select("source", usage.alias("usage"))
    return M.sum_usage(M.usage_from_response(docs), "source")


@query
def l5_embed_texts(spark, d):
    """The places of each text's vector that are not zero."""
    docs = W.table(spark, d, "conversations").select("conv_id", "turn", "text")
    v = N.embed_texts(docs, N.hashed_bigrams(64)).select("conv_id", "turn", F.posexplode("vector").alias("place", "value"))
    return v.filter("value <> 0").select("conv_id", "turn", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def l6_knn(spark, d):
    return N.knn_blocks(W.vector_queries(spark, d), W.memories(spark, d), 10).select("request_id", "id", F.round("score", 6).alias("score"), "rank")


@query
def l6_knn_blocks(spark, d):
    """The same search in small blocks on either side: every chunk of a user's memories meets every block of the queries."""
    return N.knn_blocks(W.vector_queries(spark, d), W.memories(spark, d), 10, 20, 3).select("request_id", "id", F.round("score", 6).alias("score"), "rank")


@query
def l7_knn_global(spark, d):
    return N.knn_global(W.vector_queries(spark, d), W.memories(spark, d), 10).select("request_id", "id", F.round("score", 6).alias("score"), "rank")


def _facts(spark, d):
    """Queries as facts, all of one user's in one request."""
    q = W.vector_queries(spark, d)
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return q.select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("request_id"), "user_id", pos.alias("fact_pos"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("fact"), "vector")


@query
def l8_similar_memories(spark, d):
    return M.similar_memories(_facts(spark, d), W.memories(spark, d), 5).select("request_id", "id", "pos", "text")


@query
def l9_route_requests(spark, d):
    m = W.memories(spark, d).withColumn("user_id", F.when(F.col("user_id").isin("u0", "u1"), "nobody").otherwise(F.col("user_id")))
    facts = _facts(spark, d)
    direct, other = M.route_requests(facts.select("request_id").distinct(), M.similar_memories(facts, m, 5))
    return direct.select("request_id", F.lit("add").alias("path")).union(other.select("request_id", F.lit("decide")))


@query
def l10_direct_adds(spark, d):
    docs = W.table(spark, d, "documents")
    facts = docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("request_id"), F.col("source").alias("user_id"), F.lit(0).alias("fact_pos"), F.col("text").alias("fact"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    return M.direct_adds(facts).select("request_id", "user_id", "id", "event")


@query
def l11_decision_inputs(spark, d):
    m = W.messages(spark, d)
    request = F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("request_id")
    old = m.filter("role = 'assistant'").select(request, F.col("turn").alias("pos"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.col("content_text").alias("text"))
    new = m.filter("role = 'user'").select(request, F.col("turn").alias("fact_pos"), F.col("content_text").alias("fact"))
    return M.decision_inputs(old, new)


def _decided(spark, d):
    m = W.memories(spark, d).withColumn("id", T.memory_doc_id("user_id", "data"))
    q = W.vector_queries(spark, d)
    fact = F.when(F.col("vec_id") % 40 == 0, F.concat(F.lit("memory  "), F.col("vec_id").cast("string"))).when(F.col("vec_id") % 100 == 20, "m").otherwise(F.concat(F.lit("memory edited "), F.col("vec_id").cast("string")))
    user = F.when(F.col("vec_id") % 60 == 20, "nobody").otherwise(F.col("user_id"))
    facts = q.select("request_id", user.alias("user_id"), F.lit(0).alias("fact_pos"), fact.alias("fact"), "vector")
    hits = N.knn_blocks(facts.select("request_id", "user_id", "vector"), m, 5).withColumn("fact_pos", F.lit(0))
    return M.decide(facts.drop("vector"), hits, m)


@query
def l12_decide(spark, d):
    return _decided(spark, d).select("request_id", "pos", "id", "text", "event", "old_memory")


@query
def l13_parse_actions(spark, d):
    e = W.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("request_id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_id"))
    k = F.col("vec_id") % 6
    good = F.concat(F.lit('{"memory": [{"id": "a'), F.col("vec_id").cast("string"), F.lit('", "text": "one", "event": "UPDATE", "old_memory": "zero"}, {"id": "b", "text": "two", "event": "NONE"}]}'))
    response = F.when(k == 0, "{broken").when(k == 1, '{"memory": null}').when(k == 2, '{"other": 1}').when(k == 3, "[1]").when(k == 4, '{"memory": []}').otherwise(good)
    facts = e.select("request_id", "user_id", F.lit(0).alias("fact_pos"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("fact"))
    return M.parse_actions(e.withColumn("response", response), facts).select("request_id", "pos", "id", "text", "event", "old_memory")


def memory_actions(spark, d):
    """Up to three actions on each memory, of every kind, in one batch."""
    e = W.table(spark, d, "embeddings")
    v = F.col("vec_id")
    events = ["ADD", "UPDATE", "DELETE", "NONE", "other"]
    first = F.element_at(F.array(*map(F.lit, events)), (v % 5 + 1).cast("int"))
    steps = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("pos"), first.alias("event"), F.concat(F.lit("first "), v.cast("string")).alias("text")),
            F.when(v % 7 == 0, F.struct(F.lit(1).alias("pos"), F.lit("update").alias("event"), F.concat(F.lit("second "), v.cast("string")).alias("text"))),
            F.when(v % 11 == 0, F.struct(F.lit(2).alias("pos"), F.lit("DELETE").alias("event"), F.lit("").alias("text"))),
            F.when(v % 13 == 0, F.struct(F.lit(3).alias("pos"), F.lit("UPDATE").alias("event"), F.concat(F.lit("third "), v.cast("string")).alias("text"))),
        )
    )
    own = e.select(F.concat(F.lit("q"), v.cast("string")).alias("request_id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_id"), F.concat(F.lit("v"), v.cast("string")).alias("id"), F.col("embedding").alias("vector"), F.explode(steps).alias("s"))
    return own.select("request_id", "s.pos", "user_id", "id", "s.text", "s.event", F.lit(None).cast("string").alias("old_memory"), "vector", F.timestamp_seconds(F.lit(W.EPOCH + 60)).alias("ts"))


@query
def l14_apply_actions(spark, d):
    m = M.apply_actions(W.memories(spark, d), memory_actions(spark, d))
    return m.select("id", "user_id", "data", "hash", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))


@query
def l15_action_counts(spark, d):
    a = memory_actions(spark, d)
    return M.action_counts(a.withColumn("event", F.when(F.col("event") == "other", None).otherwise(F.col("event"))))


def _retrieved(spark, d):
    q = W.vector_queries(spark, d).withColumn("query_text", F.when(F.col("vec_id") % 100 == 0, "").otherwise("q"))
    m = W.memories(spark, d).withColumn("data", F.when(F.ascii(F.substring("id", -1, 1)) % 5 == 0, "").otherwise(F.col("data")))
    return M.retrieve(q, m, 10)


@query
def l16_retrieve(spark, d):
    return _retrieved(spark, d).select("request_id", "id", "memory", F.round("score", 6).alias("score"), F.round("importance", 6).alias("importance"), "rank")


@query
def l17_memory_context(spark, d):
    return M.memory_context(_retrieved(spark, d)).select("request_id", "role", "content")


def _recall(spark, d):
    """Recall of every conversation: its history, with the memories of the user found by the vector of the same number."""
    vectors = W.table(spark, d, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("request_id"), F.col("embedding").alias("vector"))
    asked = W.requests(spark, d).withColumn("query_text", T.last_user_query("input"))
    memories = W.memories(spark, d)
    retrieved = M.retrieve(asked.select("request_id", "user_id", "query_text").join(vectors, "request_id"), memories, 10)
    return jobs.build_history(asked, _rounds(spark, d), retrieved, 3, RELEVANT, T.REVERSIBLE)[0]


@query
def l18_recall(spark, d):
    return _recall(spark, d).select("request_id", "pos", "role", "content")


@query
def l18_recall_embedded(spark, d):
    """The whole recall job with the default embedder; facts of the conversations are the memories."""
    asked = W.requests(spark, d)
    at = as_of()
    facts = M.line_facts(asked).select(T.memory_doc_id("user_id", "fact").alias("id"), "user_id", "fact").groupBy("id", "user_id").agg(F.min("fact").alias("data"))
    memories = N.embed_texts(facts, N.hashed_bigrams(64), "data")
    memories = memories.withColumn("hash", F.col("id")).withColumn("created_at", at).withColumn("updated_at", at)
    return jobs.recall(asked, _rounds(spark, d), memories, at, N.hashed_bigrams(64), threshold=RELEVANT).history.select("request_id", "pos", "role", "content")


def _stored(spark, d):
    return jobs.store(W.requests(spark, d), _rounds(spark, d), W.memories(spark, d), as_of(), N.hashed_bigrams(64))


@query
def l19_store_rounds(spark, d):
    return _stored(spark, d).rounds.select("user_id", "session_id", "round_no", F.size("messages").alias("n_messages"))


@query
def l19_store_memories(spark, d):
    return _stored(spark, d).memories.select("id", "user_id", "data")


# Journal and attachments

@query
def j1_extract_files(spark, d):
    return J.extract_files(W.page_requests(spark, d)).select("request_id", "message_idx", "item_idx", "file_url")


@query
def j2_attachment_manifest(spark, d):
    return J.attachment_manifest(J.extract_files(W.page_requests(spark, d)))


def _saved(spark, d):
    """Two of three attachments are saved."""
    manifest = J.attachment_manifest(J.extract_files(W.page_requests(spark, d)))
    return manifest.filter("char_length(file_url) % 3 <> 0").select("user_id", "file_url", F.col("dest").alias("local_path"))


@query
def j3_resolve_paths(spark, d):
    return J.resolve_paths(J.extract_files(W.page_requests(spark, d)), _saved(spark, d)).select("request_id", "item_idx", "local_path")


@query
def j4_journal_entries(spark, d):
    e = J.journal_entries(W.page_requests(spark, d), _saved(spark, d))
    return e.select("request_id", "user_id", "pos", "type", "role", "content", "original_url", "local_path", F.unix_seconds("timestamp").alias("at"))


def session_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d).select("user_id", "session_id", "request_id", "pos", "role", "content")
