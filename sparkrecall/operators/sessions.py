"""Sessions: rounds of messages, their expiry and cap, and what a recall sees of them.

Rounds are rows keyed (user_id, session_id, round_no). Every window here runs over one session, so that a table
partitioned by those keys is shuffled once for all of them; `row_number() <= n` is cut down before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall.functions import text as T
from sparkrecall.schemas import RECENT_FULL, RELEVANCE, ROUNDS_KEPT, SESSION_TTL

KEYS = ("user_id", "session_id")


def round_id(*parts: str) -> Column:
    """Eight hexadecimal digits from a round's keys, so that a rerun gives the same id."""
    return F.substring(F.md5(F.concat_ws("\0", *[F.col(p).cast("string") for p in parts])), 1, 8)


def build_rounds(messages: DataFrame, order: str = "turn") -> DataFrame:
    """A round per (user_id, session_id, round_no) of message rows (role, content_text, content_items, ts)."""
    m = F.struct("role", "content_text", "content_items")
    own = messages.groupBy(*KEYS, "round_no").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), m.alias("m")))).alias("all"), F.max("ts").alias("ts"))
    own = own.withColumn("messages", F.transform("all", lambda x: x["m"]))
    return own.select(*KEYS, "round_no", round_id(*KEYS, "round_no").alias("round_id"), "ts", "messages", T.first_user_text("messages").alias("first_user_text"))


def rounds_of_requests(requests: DataFrame) -> DataFrame:
    """R1 for whole requests: one store call is one round, whatever it holds; numbered by arrival within the batch."""
    w = Window.partitionBy(*KEYS).orderBy("ts", "request_id")
    return requests.select(
        *KEYS, F.row_number().over(w).alias("round_no"), round_id("request_id").alias("round_id"), "ts", F.col("input").alias("messages"), T.first_user_text("input").alias("first_user_text"), "request_id"
    )


def append_rounds(sessions: DataFrame, new_rounds: DataFrame) -> DataFrame:
    """R2: stored rounds, then new ones, renumbered from 1; `updated_at` is the session's last write."""
    both = sessions.withColumn("_new", F.lit(0)).unionByName(new_rounds.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*KEYS)
    number = F.row_number().over(w.orderBy("_new", "ts", "round_no"))
    return both.withColumn("_no", number).withColumn("updated_at", F.max("ts").over(w)).drop("_new", "round_no").withColumnRenamed("_no", "round_no")


def keep_last_rounds(rounds: DataFrame, n: int = ROUNDS_KEPT, order: tuple[str, ...] = ("round_no",)) -> DataFrame:
    """The newest n rounds of each session."""
    w = Window.partitionBy(*KEYS).orderBy(*[F.col(c).desc() for c in order])
    return rounds.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def segments(rounds: DataFrame, ttl: int = SESSION_TTL, order: tuple[str, ...] = ("ts", "round_no")) -> DataFrame:
    """Adds `segment`: it grows by one where a write follows a gap of at least ttl seconds."""
    w = Window.partitionBy(*KEYS).orderBy(*order)
    gap = F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")
    return rounds.withColumn("segment", F.sum(F.when(gap >= ttl, 1).otherwise(0)).over(w))


def expire_sessions(rounds: DataFrame, as_of: Column, ttl: int = SESSION_TTL, order: tuple[str, ...] = ("ts", "round_no")) -> DataFrame:
    """The rounds that a read at `as_of` finds: those after the last gap, none if the session is idle by then."""
    w = Window.partitionBy(*KEYS)
    own = segments(rounds, ttl, order).withColumn("_last", F.max("segment").over(w)).withColumn("_ts", F.max("ts").over(w))
    alive = as_of.cast("double") - F.col("_ts").cast("double") < ttl
    return own.filter((F.col("segment") == F.col("_last")) & alive).drop("segment", "_last", "_ts")


def asked_only(rounds: DataFrame, asked: DataFrame) -> DataFrame:
    """The rounds of the sessions that are asked for: a semi join on the keys alone, before anything else is done."""
    return rounds.join(asked.select(*KEYS).distinct(), list(KEYS), "left_semi")


def get_sessions(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys with their rounds as an array in order; an absent session has an empty one."""
    own = asked_only(sessions, keys).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("round_no", "round_id", "ts", "messages", "first_user_text"))).alias("rounds"))
    found = keys.join(own, list(KEYS), "left")
    return found.withColumn("rounds", F.coalesce("rounds", F.array().cast(own.schema["rounds"].dataType)))


def split_recent(rounds: DataFrame, requests: DataFrame, default: int = RECENT_FULL) -> DataFrame:
    """Each request's rounds with `recent`: whether it is one of the newest N.

    requests: request_id, keys, recent_rounds_full and any more columns, e.g. the query. Rounds with a request_id (those
    of R14) belong to that request alone.
    """
    mine = [c for c in requests.columns if c not in KEYS]
    joined = requests.join(rounds, [*KEYS, "request_id"] if "request_id" in rounds.columns else list(KEYS))
    w = Window.partitionBy(*KEYS, "request_id").orderBy(F.col("round_no").desc())
    recent = F.row_number().over(w) <= F.coalesce(F.col("recent_rounds_full"), F.lit(default))
    return joined.withColumn("recent", recent).select(*KEYS, *mine, *[c for c in rounds.columns if c not in KEYS and c not in mine], "recent")


def with_bigrams(rounds: DataFrame) -> DataFrame:
    """A round's bigrams once per round, before many requests meet it."""
    return rounds.withColumn("round_bigrams", T.char_bigrams("first_user_text"))


def classify_rounds(split: DataFrame, threshold: float = RELEVANCE) -> DataFrame:
    """Adds `score` and `relevant` (null for recent rounds): query and round text must not be empty, and their
    bigrams overlap by the threshold. Uses the columns query_bigrams and round_bigrams where they are made already."""
    q = F.col("query_bigrams") if "query_bigrams" in split.columns else T.char_bigrams("query_text")
    r = F.col("round_bigrams") if "round_bigrams" in split.columns else T.char_bigrams("first_user_text")
    scored = split.withColumn("score", F.when(~F.col("recent"), T.overlap(q, r)))
    both = (F.coalesce(F.col("query_text"), F.lit("")) != "") & (F.coalesce(F.col("first_user_text"), F.lit("")) != "")
    return scored.withColumn("relevant", F.when(~F.col("recent"), both & (F.col("score") >= threshold))).drop("query_bigrams", "round_bigrams")


def history_messages(classified: DataFrame, strategy: str = T.REVERSIBLE) -> DataFrame:
    """(user_id, session_id, request_id, pos, role, content): older rounds full or compressed, then recent ones."""
    full = F.col("recent") | F.col("relevant")
    shown = _shown(strategy)
    rows = classified.withColumn("_shown", F.when(full, F.transform("messages", lambda m: F.struct(m["role"].alias("role"), T.text_of(m).alias("content")))).otherwise(shown))
    rows = rows.select(*KEYS, "request_id", "round_no", F.posexplode("_shown").alias("part", "m"))
    w = Window.partitionBy(*KEYS, "request_id").orderBy("round_no", "part")
    return rows.select(*KEYS, "request_id", F.row_number().over(w).alias("pos"), "m.role", "m.content")


def _shown(strategy: str) -> Column:
    """A compressed round: its first message and the marker; nothing for a round without messages."""
    first = F.try_element_at("messages", F.lit(1))
    kept = F.struct(first["role"].alias("role"), T.text_of(first).alias("content"))
    marker = F.struct(F.lit("assistant").alias("role"), T.omission_marker(omitted_hash(), strategy).alias("content"))
    return F.when(F.size("messages") > 0, F.array(kept, marker)).otherwise(F.array().cast("array<struct<role:string,content:string>>"))


def omitted_hash() -> Column:
    return T.context_hash("user_id", "session_id", "round_id", F.slice("messages", 2, 1 << 30))


def history_text(classified: DataFrame, strategy: str = T.REVERSIBLE) -> DataFrame:
    """The history as one block of `role: text` lines per request; a compressed round's question is clipped."""
    full = F.col("recent") | F.col("relevant")
    lines = F.filter(F.transform("messages", lambda m: F.when(T.text_of(m) != "", F.concat(m["role"], F.lit(": "), T.text_of(m)))), lambda t: t.isNotNull())
    first = F.try_element_at("messages", F.lit(1))
    marker = F.concat(F.lit("assistant: "), T.omission_marker(omitted_hash(), strategy))
    short = F.when(F.size("messages") > 0, F.array(F.concat(first["role"], F.lit(": "), T.clip_question(T.text_of(first))), marker)).otherwise(F.array().cast("array<string>"))
    rows = classified.withColumn("_lines", F.when(full, lines).otherwise(short))
    per = rows.groupBy(*KEYS, "request_id").agg(F.array_sort(F.collect_list(F.struct("round_no", F.col("_lines").alias("l")))).alias("all"))
    return per.select(*KEYS, "request_id", F.array_join(F.flatten(F.transform("all", lambda x: x["l"])), "\n").alias("history"))


def session_as_of(rounds: DataFrame, requests: DataFrame, n: int = ROUNDS_KEPT, ttl: int = SESSION_TTL) -> DataFrame:
    """The rounds that each recall sees: stored at or before its time, expiry and cap applied.

    Stores and recalls of a session are put in one order; every store knows its number and segment, and each recall
    takes those of the last store before it. Then an equality join on session and segment with a bound on the
    number; no join of times.
    """
    w = Window.partitionBy(*KEYS).orderBy("ts", "round_no")
    stores = segments(rounds, ttl).withColumn("no", F.row_number().over(w))
    seen = stores.select(*KEYS, "ts", F.lit(0).alias("kind"), "no", "segment", F.lit(None).cast("string").alias("request_id"))
    asked = requests.select(*KEYS, "ts", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("long").alias("segment"), F.col("request_id").cast("string").alias("request_id"))
    past = Window.partitionBy(*KEYS).orderBy("ts", "kind", "no", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    both = seen.unionByName(asked)
    last = [F.last(c, ignorenulls=True).over(past).alias(f"last_{c}") for c in ("no", "segment")]
    last_ts = F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(past).alias("last_ts")
    asked = both.select("*", *last, last_ts).filter((F.col("kind") == 1) & (F.col("ts").cast("double") - F.col("last_ts").cast("double") < ttl))
    asked = asked.select(*KEYS, "request_id", F.col("last_segment").alias("segment"), "last_no")
    seen = stores.join(asked, [*KEYS, "segment"]).filter((F.col("no") <= F.col("last_no")) & (F.col("no") > F.col("last_no") - n))
    return seen.select(*KEYS, "request_id", *[c for c in rounds.columns if c not in KEYS])
