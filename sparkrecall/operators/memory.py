"""Long-term memory: facts of requests, similar memories, decisions, and their ordered merge into the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall.functions import text as T
from sparkrecall.operators.vectors import knn_blocks
from sparkrecall.schemas import SCORE, TOP_K

#: A template for models; {date} is filled in. Only facts about the user, from the user's own messages, are wanted.
EXTRACTION_PROMPT = 'Today is {date}. List the facts about the user that the user\'s own messages state. Answer in JSON: {"facts": [...]}.'
#: From this score on the default rule takes a fact as a new wording of its best hit.
UPDATE_SCORE = 1.8

USAGE = "request_id string, input_tokens long, output_tokens long, total_tokens long"
#: A stage gives its rows, or its rows and their usage (request_id and the three counters).
Staged = DataFrame | tuple[DataFrame, DataFrame]
Extractor = Callable[[DataFrame], Staged]
Decider = Callable[[DataFrame, DataFrame, DataFrame], Staged]


def staged(found: Staged) -> tuple[DataFrame, DataFrame | None]:
    """A stage's rows and their usage, if it has any."""
    return found if isinstance(found, tuple) else (found, None)


def extraction_inputs(requests: DataFrame, date: Column, prompt: str = EXTRACTION_PROMPT) -> DataFrame:
    """L1: the two texts of a model call per request; requests without text are left out."""
    text = T.messages_to_text("input")
    own = requests.select("request_id", "user_id", text.alias("_text")).filter(T.non_blank("_text"))
    system = F.replace(F.lit(prompt), F.lit("{date}"), F.date_format(date, "yyyy-MM-dd"))
    return own.select("request_id", "user_id", system.alias("system"), F.concat(F.lit("Input:\n"), F.col("_text")).alias("user"))


def line_facts(requests: DataFrame) -> DataFrame:
    """U1's default: every non-blank line of a user message is a fact."""
    lines = F.flatten(F.transform(F.filter("input", lambda m: m["role"] == "user"), lambda m: F.split(T.text_of(m), "\n")))
    own = requests.select("request_id", "user_id", F.transform(F.filter(lines, T.non_blank), lambda t: F.trim(t)).alias("facts"))
    return own.select("request_id", "user_id", F.posexplode("facts").alias("fact_pos", "fact"))


def one_by_one(call: Callable[..., list], *columns: list) -> list:
    """A model's results for a batch; where the batch fails, each row's alone, None for those that fail by themselves."""
    try:
        return list(call(*columns))
    except Exception:
        out = []
        for row in zip(*columns):
            try:
                out += list(call(*[[v] for v in row]))
            except Exception:
                out.append(None)
        return out


def batch_extractor(extract: Callable[[list[str]], list[list[str]]]) -> Extractor:
    """U1 for a model: a function of a batch of texts that gives each one's facts; a text that fails, also by itself, has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = one_by_one(extract, batch["text"].tolist())
            rows = [(r, u, k, f) for r, u, own in zip(batch["request_id"], batch["user_id"], facts) for k, f in enumerate(own or [])]
            yield pd.DataFrame(rows, columns=["request_id", "user_id", "fact_pos", "fact"])

    def apply(requests: DataFrame) -> DataFrame:
        users = F.filter("input", lambda m: m["role"] == "user")
        own = requests.select("request_id", "user_id", T.messages_to_text(users).alias("text")).filter(T.non_blank("text"))
        return own.mapInPandas(run, "request_id string, user_id string, fact_pos int, fact string")

    return apply


#: A model call for a batch: two lists of texts in, a list of (response, usage as the provider's JSON) out.
Model = Callable[[list[str], list[str]], list[tuple[str, str]]]
#: How a model is asked: rows (request_id, user_id and two texts) in, (request_id, user_id, response, usage) out, made once.
Answers = Callable[[DataFrame, Model, str, str], DataFrame]


def _answers(rows: DataFrame, model: Model, first: str, second: str) -> DataFrame:
    """The model's answers, made once and written, as they are used several times; a row that fails has an empty one.
    `sources.models.ModelCache` is another way, which keeps answers over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [g or ("", "") for g in one_by_one(model, batch[first].tolist(), batch[second].tolist())]
            yield pd.DataFrame({"request_id": batch["request_id"], "user_id": batch["user_id"], "response": [g[0] for g in got], "usage": [g[1] for g in got]})

    from sparkrecall.sources.tables import written

    said = rows.select("request_id", "user_id", first, second).mapInPandas(run, "request_id string, user_id string, response string, usage string")
    return written(said, "answers")


def model_extractor(model: Model, date: Column, prompt: str = EXTRACTION_PROMPT, answers: Answers = _answers) -> Extractor:
    """U1 by L1, a model and L3: facts, and usage of the calls whose answer is JSON. Each request is asked about once."""

    def apply(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        said = answers(extraction_inputs(requests, date, prompt), model, "system", "user")
        facts = parse_facts(said).join(requests.select("request_id", "user_id"), "request_id").select("request_id", "user_id", "fact_pos", "fact")
        return facts, usage_from_response(said.filter(F.try_parse_json("response").isNotNull()).select("request_id", "usage"))

    return apply


def model_decider(model: Model, answers: Answers = _answers) -> Decider:
    """U3 by L11, a model and L13: ordered actions, and usage. Only requests with both memories and facts are asked about."""

    def apply(facts: DataFrame, hits: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = decision_inputs(first_seen(hits, memories), facts).join(facts.select("request_id", "user_id").distinct(), "request_id")
        said = answers(asked, model, "old_memories", "facts")
        return parse_actions(said.select("request_id", "user_id", "response"), facts), usage_from_response(said.select("request_id", "usage"))

    return apply


def extract_facts(requests: DataFrame, extractor: Extractor = line_facts) -> DataFrame:
    """L2: (request_id, user_id, fact_pos, fact)."""
    return staged(extractor(requests))[0]


def parse_facts(responses: DataFrame) -> DataFrame:
    """L3: the strings of the JSON field `facts` of each response; none for invalid JSON."""
    parsed = F.from_json("response", "struct<facts: array<string>>")
    own = responses.filter(F.try_parse_json("response").isNotNull()).select("request_id", parsed.alias("p"))
    return own.select("request_id", F.posexplode("p.facts").alias("fact_pos", "fact"))


def usage_from_response(responses: DataFrame) -> DataFrame:
    """L4: counters of a provider's usage object; missing ones, and unreadable objects, count 0."""
    p = F.from_json("usage", "struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>")
    names = {"input_tokens": "prompt_tokens", "output_tokens": "completion_tokens", "total_tokens": "total_tokens"}
    own = responses.withColumn("_p", p)
    return own.select(*[c for c in responses.columns if c != "usage"], *[F.coalesce(F.col(f"_p.{v}"), F.lit(0).cast("long")).alias(k) for k, v in names.items()])


def sum_usage(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


def fact_hits(facts: DataFrame, memories: DataFrame, k: int = TOP_K) -> DataFrame:
    """L6 for facts (request_id, user_id, fact_pos, vector): each one's k best memories; no score threshold here."""
    keyed = facts.withColumn("_key", F.to_json(F.struct("request_id", "fact_pos")))
    hits = knn_blocks(keyed.select(F.col("_key").alias("request_id"), "user_id", "vector"), memories, k)
    return hits.withColumnRenamed("request_id", "_key").join(keyed.select("_key", "request_id", "fact_pos"), "_key").drop("_key")


def first_seen(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """L8 from hits with request_id and fact_pos: each memory of a request once, where it is first seen, with its text."""
    first = hits.filter(F.col("id") != "").groupBy("request_id", "user_id", "id").agg(F.min(F.struct("fact_pos", "rank", "score")).alias("f"))
    w = Window.partitionBy("request_id").orderBy("f.fact_pos", "f.rank")
    own = first.select("request_id", "user_id", "id", F.row_number().over(w).alias("pos"), "f.fact_pos", "f.rank", "f.score")
    return own.join(memories.select("user_id", "id", F.col("data").alias("text")), ["user_id", "id"])


def similar_memories(facts: DataFrame, memories: DataFrame, k: int = TOP_K) -> DataFrame:
    """The memories that any fact of a request finds, once each, in the order in which they are first seen.

    facts: request_id, user_id, fact_pos, vector. `fact_pos`, `rank`, `score` are those of the first sight.
    """
    return first_seen(fact_hits(facts, memories, k), memories)


def route_requests(requests: DataFrame, similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with no hit at all, which add directly; the others, which need decisions)."""
    some = similar.select("request_id").distinct()
    return requests.join(some, "request_id", "left_anti"), requests.join(some, "request_id", "left_semi")


def direct_adds(facts: DataFrame) -> DataFrame:
    """Every fact with a vector as an ADD; of facts with one id the last of a request stays."""
    own = facts.filter("vector is not null").withColumn("id", T.memory_doc_id("user_id", "fact"))
    w = Window.partitionBy("id").orderBy(F.col("request_id").desc(), F.col("fact_pos").desc())
    own = own.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return own.select("request_id", F.col("fact_pos").alias("pos"), "user_id", "id", F.col("fact").alias("text"), F.lit("ADD").alias("event"), F.lit(None).cast("string").alias("old_memory"), "vector")


def decision_inputs(similar: DataFrame, facts: DataFrame) -> DataFrame:
    """Per request the old memories and the facts as JSON, both in order."""
    old = similar.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("a"))
    old = old.select("request_id", F.to_json(F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))).alias("old_memories"))
    new = facts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("fact_pos", "fact"))).alias("a"))
    new = new.select("request_id", F.to_json(F.transform("a", lambda x: x["fact"])).alias("facts"))
    return old.join(new, "request_id")


def rule_decider(update_score: float = UPDATE_SCORE) -> Decider:
    """U3's default in SQL: a fact already stored is NONE; one close to its best hit updates it, keeping the longer
    text; any other is an ADD."""

    def decide(facts: DataFrame, hits: DataFrame, memories: DataFrame) -> DataFrame:
        best = hits.filter("rank = 1").join(memories.select("user_id", "id", F.col("data").alias("old")), ["user_id", "id"])
        best = best.select("request_id", "fact_pos", F.col("id").alias("hit"), "score", "old")
        own = facts.withColumn("doc_id", T.memory_doc_id("user_id", "fact")).join(best, ["request_id", "fact_pos"], "left")
        close = F.coalesce(F.col("score") >= update_score, F.lit(False))
        same = F.coalesce(F.col("doc_id") == F.col("hit"), F.lit(False))
        event = F.when(same, "NONE").when(close, "UPDATE").otherwise("ADD")
        text = F.when(~same & close & (F.char_length("old") > F.char_length("fact")), F.col("old")).otherwise(F.col("fact"))
        return own.select(
            "request_id", F.col("fact_pos").alias("pos"), "user_id", F.when(event == "ADD", F.col("doc_id")).otherwise(F.col("hit")).alias("id"),
            text.alias("text"), event.alias("event"), F.when(event == "UPDATE", F.col("old")).alias("old_memory"),
        )

    return decide


def decide(facts: DataFrame, hits: DataFrame, memories: DataFrame, decider: Decider | None = None) -> DataFrame:
    """Ordered actions. hits: L6 rows with request_id and fact_pos."""
    return staged((decider or rule_decider())(facts, hits, memories))[0]


def parse_actions(responses: DataFrame, facts: DataFrame) -> DataFrame:
    """Actions of the JSON array `memory` of each response (request_id, user_id, response).

    Invalid JSON, or `memory` null: every fact is added. No key `memory`, or no object: no actions.
    """
    kind = F.schema_of_variant(F.try_parse_json("response"))
    schema = "struct<memory: array<struct<id: string, text: string, event: string, old_memory: string>>>"
    own = responses.select("request_id", "user_id", kind.alias("_kind"), F.from_json("response", schema).alias("_p"))
    has_null = F.col("_kind").rlike(r"^OBJECT<(.*, )?memory: VOID[,>]")
    failed = own.filter(F.col("_kind").isNull() | has_null)
    good = own.filter(F.col("_kind").startswith("OBJECT") & ~has_null)
    actions = good.select("request_id", "user_id", F.posexplode("_p.memory").alias("pos", "a")).select("request_id", "pos", "user_id", "a.id", "a.text", "a.event", "a.old_memory")
    added = facts.join(failed.select("request_id"), "request_id", "left_semi")
    none = F.lit(None).cast("string")
    return actions.unionByName(added.select("request_id", F.col("fact_pos").alias("pos"), "user_id", none.alias("id"), F.col("fact").alias("text"), F.lit("ADD").alias("event"), none.alias("old_memory")))


def apply_actions(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """The table after all actions, applied in (ts, request_id, pos) order.

    actions: request_id, pos, user_id, id, text, event, vector, ts. An ADD goes to the id of its text and replaces a
    row whole; an UPDATE changes text, vector and time of an existing row and leaves its hash; a DELETE removes it;
    anything else, and UPDATE or DELETE without an id, or a text without a vector, is skipped.

    The fold needs two facts per id: its last ADD or DELETE, and its last UPDATE, which counts if it is later. So it
    is one aggregation with partial sums, a left join to the table and an anti join for new rows, both of which
    can be split where an id or a user is hot.
    """
    event = F.upper("event")
    own = actions.withColumn("_event", event).filter(
        ((F.col("_event") == "DELETE") & (F.coalesce("id", F.lit("")) != ""))
        | ((F.col("_event") == "UPDATE") & (F.coalesce("id", F.lit("")) != "") & F.col("vector").isNotNull())
        | ((F.col("_event") == "ADD") & F.col("vector").isNotNull() & F.col("text").isNotNull())
    )
    target = F.when(F.col("_event") == "ADD", T.memory_doc_id("user_id", "text")).otherwise(F.col("id"))
    own = own.withColumn("id", target).withColumn("_seq", F.struct("ts", "request_id", "pos"))
    base = F.max(F.when(F.col("_event").isin("ADD", "DELETE"), F.struct("_seq", "_event", "text", "vector", "user_id"))).alias("base")
    update = F.max(F.when(F.col("_event") == "UPDATE", F.struct("_seq", "text", "vector"))).alias("upd")
    fold = own.groupBy("id").agg(base, update)
    later = F.col("upd").isNotNull() & (F.col("base").isNull() | (F.col("upd._seq") > F.col("base._seq")))
    fold = fold.withColumn("upd", F.when(later, F.col("upd")))

    def rows(joined: DataFrame, old: bool) -> DataFrame:
        def pick(added: Column, before: str) -> Column:
            return F.when(F.col("base").isNotNull(), added).otherwise(F.col(before)) if old else added

        at = F.col("base._seq.ts")
        changed = F.col("upd").isNotNull()
        return joined.select(
            "id", pick(F.col("base.user_id"), "user_id").alias("user_id"),
            F.when(changed, F.col("upd.text")).otherwise(pick(F.col("base.text"), "data")).alias("data"),
            F.when(changed, F.col("upd.vector")).otherwise(pick(F.col("base.vector"), "vector")).alias("vector"),
            pick(F.col("id"), "hash").alias("hash"), pick(at, "created_at").alias("created_at"),
            F.when(changed, F.col("upd._seq.ts")).otherwise(pick(at, "updated_at")).alias("updated_at"),
        )

    kept = memories.join(fold, "id", "left").filter("base is null or base._event = 'ADD'")
    new = fold.filter("base._event = 'ADD'").join(memories.select("id"), "id", "left_anti")
    return rows(kept, True).unionByName(rows(new, False))


def action_counts(actions: DataFrame) -> DataFrame:
    """Actions per user and event, in capitals, NONE if missing."""
    return actions.groupBy("user_id", F.upper(F.coalesce("event", F.lit("NONE"))).alias("event")).agg(F.count("*").alias("n"))


def retrieve(queries: DataFrame, memories: DataFrame, k: int = TOP_K, threshold: float = SCORE) -> DataFrame:
    """Hits over the threshold after top-k, with text; importance is the score. queries: request_id, user_id,
    query_text, vector; an empty query finds nothing."""
    asked = queries.filter((F.coalesce("query_text", F.lit("")) != "") & F.col("vector").isNotNull())
    hits = knn_blocks(asked, memories, k).filter(F.col("score") >= threshold)
    own = hits.join(memories.select("user_id", "id", F.col("data").alias("memory"), "created_at"), ["user_id", "id"]).filter(F.coalesce("memory", F.lit("")) != "")
    return own.select("request_id", "user_id", "id", "memory", "score", F.col("score").alias("importance"), "created_at", "rank")


def memory_context(retrieved: DataFrame) -> DataFrame:
    """One system message per request that lists its memories in rank order; no row without memories."""
    own = retrieved.groupBy("request_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "memory"))).alias("a"))
    return own.select("request_id", "user_id", F.lit("system").alias("role"), T.context_message(F.transform("a", lambda x: x["memory"])).alias("content"))
