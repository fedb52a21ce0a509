"""The two whole jobs: store a batch of requests, and recall for a batch of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.functions import text as T
from sparkrecall.operators import contexts as C
from sparkrecall.operators import memory as M
from sparkrecall.operators import sessions as S
from sparkrecall.operators.vectors import embed_texts, hashed_bigrams
from sparkrecall.sources.tables import written


@dataclass
class Recalled:
    history: DataFrame
    retrieved: DataFrame
    contexts: DataFrame


@dataclass
class Stored:
    """Tables after a batch of store calls; what was done; the calls' token usage (a row per request, 0 without a model);
    and, where a journal was asked for, its attachments."""

    rounds: DataFrame
    memories: DataFrame
    actions: DataFrame | None
    usage: DataFrame | None = None
    attachments: DataFrame | None = None


def build_history(requests: DataFrame, rounds: DataFrame, retrieved: DataFrame, recent: int, threshold: float, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(history rows with the memory context first, the classified rounds). U5: any function of this shape may take its place."""
    asked = requests.select("request_id", *S.KEYS, "recent_rounds_full", "query_text", T.char_bigrams("query_text").alias("query_bigrams"))
    classified = S.classify_rounds(S.split_recent(S.with_bigrams(rounds), asked, recent), threshold)
    rows = S.history_messages(classified, strategy).select("request_id", *S.KEYS, "pos", "role", "content")
    context = M.memory_context(retrieved).join(requests.select("request_id", "session_id"), "request_id").select("request_id", *S.KEYS, F.lit(0).alias("pos"), "role", "content")
    w = Window.partitionBy("request_id").orderBy("pos")
    return context.unionByName(rows).withColumn("pos", F.row_number().over(w) - 1), classified


def recall(
    requests: DataFrame, rounds: DataFrame, memories: DataFrame, as_of: Column | None, embedder=None, k: int = schemas.TOP_K, score: float = schemas.SCORE,
    recent: int = schemas.RECENT_FULL, threshold: float = schemas.RELEVANCE, strategy: str = T.REVERSIBLE, ttl: int | None = schemas.SESSION_TTL,
    history: Callable = build_history, retrieve: Callable = M.retrieve, cap: int = schemas.ROUNDS_KEPT,
) -> Recalled:
    """History rows (request_id, pos, role, content) of each request, its retrieved memories and new context rows.

    With `as_of` all requests see the sessions of that time. With None each sees its session as of its own `ts` (R14):
    what was stored by then, expired and cut to `cap` rounds. Memories are those of the table either way.
    """
    asked = requests.withColumn("query_text", T.last_user_query("input"))
    asked = written(asked, "asked")
    vectors = embed_texts(asked.select("request_id", "user_id", "query_text").filter("query_text <> ''"), embedder or hashed_bigrams(), "query_text")
    retrieved = written(retrieve(vectors, memories, k, score), "retrieved")
    mine = S.asked_only(rounds, asked)
    if as_of is None:
        live = S.session_as_of(mine, asked.select("request_id", *S.KEYS, "ts"), cap, ttl or schemas.SESSION_TTL)
    else:
        live = mine if ttl is None else S.expire_sessions(mine, as_of, ttl)
    rows, classified = history(asked, live, retrieved, recent, threshold, strategy)
    shown = C.compressed(classified)
    if as_of is None:
        shown, as_of = shown.join(asked.select("request_id", F.col("ts").alias("asked_at")), "request_id"), F.col("asked_at")
    kept = C.strategy_of(strategy).contexts(shown, as_of)
    return Recalled(rows, retrieved, kept)


@dataclass
class Remembered:
    memories: DataFrame
    actions: DataFrame
    usage: DataFrame


def remember(requests: DataFrame, memories: DataFrame, embedder=None, extractor=M.line_facts, decider=None, k: int = schemas.TOP_K) -> Remembered:
    """The long-term side of L19: facts, their nearest memories, actions, and the table after them. Facts, hits and decisions
    are written to the shared folder as they come, as each is used several times.

    A request whose facts find no memory at all adds them as they are (L9, L10); the decider is asked about the others
    only. Usage is that of the extractor and the decider, summed by request.
    """
    embed = embedder or hashed_bigrams()
    found, used = M.staged(extractor(requests))
    facts = written(embed_texts(found, embed, "fact"), "facts")
    hits = written(M.fact_hits(facts, memories, k), "hits")
    direct, other = M.route_requests(facts.select("request_id").distinct(), hits)
    added = M.direct_adds(facts.join(direct, "request_id", "left_semi"))
    asked = facts.join(other, "request_id", "left_semi").drop("vector")
    decided, more = M.staged((decider or M.rule_decider())(asked, hits, memories))
    columns = ["request_id", "pos", "user_id", "id", "text", "event", "old_memory"]
    decided = written(decided.select(columns), "decided")
    # a decider may change a fact's words: those texts get vectors of their own, all others keep the fact's
    known = facts.select(F.col("fact").alias("text"), "vector").groupBy("text").agg(F.first("vector").alias("vector"))
    texts = decided.select(columns).join(known, "text", "left")
    fresh = embed_texts(texts.filter("vector is null and text is not null").drop("vector"), embed, "text")
    kept = texts.filter("vector is not null or text is null").unionByName(fresh)
    every = added.select(*columns, "vector").unionByName(kept.select(*columns, "vector")).join(requests.select("request_id", "ts"), "request_id")
    counters = [u.select("request_id", "input_tokens", "output_tokens", "total_tokens") for u in (used, more) if u is not None]
    sums = reduce(DataFrame.unionByName, counters) if counters else None
    usage = requests.select("request_id")
    for c in ("input_tokens", "output_tokens", "total_tokens"):
        usage = usage.withColumn(c, F.lit(0).cast("long"))
    usage = M.sum_usage(usage if sums is None else usage.unionByName(sums), "request_id")
    return Remembered(M.apply_actions(memories, every), added.select(columns).unionByName(decided.select(columns)), usage)


def store(
    requests: DataFrame, rounds: DataFrame, memories: DataFrame, as_of: Column, embedder=None, extractor=M.line_facts, decider=None, k: int = schemas.TOP_K,
    cap: int = schemas.ROUNDS_KEPT, ttl: int | None = schemas.SESSION_TTL, long_term: Callable = remember, journal: Callable | None = None,
) -> Stored:
    """Sessions and memories after a batch of store calls; all calls see the memories as of the batch's start.

    U5: `long_term` may be any function of the shape of `remember`; `journal` takes the requests, writes them where it
    will and returns the attachments (or None), as `sources.tables.journal` with its other arguments given does.
    """
    new = S.append_rounds(rounds, S.rounds_of_requests(requests).drop("request_id"))
    live = new if ttl is None else S.expire_sessions(new, as_of, ttl)
    done = long_term(requests, memories, embedder, extractor, decider, k)
    return Stored(S.keep_last_rounds(live, cap), done.memories, done.actions, done.usage, journal(requests) if journal else None)


def waves(requests: DataFrame) -> DataFrame:
    """Adds `wave`: a user's calls in order; batches of one wave each make every call see the one before."""
    return requests.withColumn("wave", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "request_id")))


def store_in_waves(requests: DataFrame, rounds: DataFrame, memories: DataFrame, as_of: Column, keep: Callable[[DataFrame, str], DataFrame], **how) -> Stored:
    """L19, exact: one batch per wave; `keep` writes a table and reads it back, so that waves do not pile up in one plan.

    Only the tables' rows of users who store go through the waves; all others are put beside them at the end, with
    sessions expired and cut as everywhere.
    """
    users = requests.select("user_id").distinct()
    ttl, cap = how.get("ttl", schemas.SESSION_TTL), how.get("cap", schemas.ROUNDS_KEPT)
    idle = rounds.join(users, "user_id", "left_anti")
    idle = S.keep_last_rounds(idle if ttl is None else S.expire_sessions(idle, as_of, ttl), cap)
    others = memories.join(users, "user_id", "left_anti")
    rounds, memories = keep(rounds.join(users, "user_id", "left_semi"), "rounds"), keep(memories.join(users, "user_id", "left_semi"), "memories")
    numbered = keep(waves(requests), "waves")
    last = numbered.agg(F.max("wave")).first()[0] or 0
    done, used = Stored(rounds, memories, None), None
    for wave in range(1, last + 1):
        done = store(numbered.filter(F.col("wave") == wave).drop("wave"), done.rounds, done.memories, as_of, **how)
        usage = done.usage if used is None else used.unionByName(done.usage)
        used = keep(usage, "usage")
        done = Stored(keep(done.rounds, "rounds"), keep(done.memories, "memories"), done.actions, used)
    return Stored(done.rounds.unionByName(idle, allowMissingColumns=True), done.memories.unionByName(others), done.actions, done.usage)
