"""Jobs over stored tables that touch only what changes: merges of memories by bucket, a log of rounds, exact stores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.operators import contexts as C
from sparkrecall.operators import memory as M
from sparkrecall.operators import sessions as S
from sparkrecall.operators.vectors import embed_texts, hashed_bigrams
from sparkrecall.plans.jobs import Remembered
from sparkrecall.sources.buckets import BucketTable
from sparkrecall.sources.tables import written

# Memories


def memory_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The memory table in buckets by user; `rewrite` its first rows, if it has any, under a batch name of one's own."""
    return BucketTable(spark, path, schemas.MEMORIES, "user_id", buckets)


def merge_actions(table: BucketTable, actions: DataFrame, batch: str) -> list[int]:
    """L14 on a stored table: reads and writes the buckets of the actions' users only; gives their numbers.

    Actions name memories of their own user, as a search for that user gives them. A batch that was merged before changes nothing.
    """
    if table.done(batch):
        return []
    actions = written(actions, "actions")
    touched = table.buckets_of(actions)
    table.rewrite(M.apply_actions(table.read(touched), actions), touched, batch)
    return touched


def stream_memory_table(actions: DataFrame, table: BucketTable, checkpoint: str, name: str = "stream"):
    """W3 on a stored table: every micro-batch is merged once, also when it is replayed after a restart, as its number stands
    in the table's ledger."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_actions(table, batch, f"{name}/{number}")

    return actions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Sessions


def session_log(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Rounds in buckets by user: what is stored is appended, and compacted now and then."""
    return BucketTable(spark, path, schemas.ROUNDS, "user_id", buckets)


def log_requests(log: BucketTable, requests: DataFrame, batch: str) -> bool:
    """S2 and R2 for a batch of store calls: their rounds are appended; no stored session is read or written."""
    return log.append(S.rounds_of_requests(requests).drop("request_id"), batch)


def logged_sessions(log: BucketTable, as_of: Column | None = None, users: DataFrame | None = None, cap: int = schemas.ROUNDS_KEPT, ttl: int = schemas.SESSION_TTL, buckets: list[int] | None = None) -> DataFrame:
    """The sessions that the log and its compacted part make up: numbered from 1 in the order of arrival, expired (with `as_of`)
    and cut. With users (user_id), only their buckets are read."""
    if users is not None:
        buckets = log.buckets_of(users)
    rows = log.read(buckets, marked=True)
    rows = rows.join(users.select("user_id").distinct(), "user_id", "left_semi") if users is not None else rows
    number = F.row_number().over(Window.partitionBy(*S.KEYS).orderBy("version", "round_no"))
    rows = rows.withColumn("_no", number).drop("round_no", "version").withColumnRenamed("_no", "round_no")
    live = rows if as_of is None else S.expire_sessions(rows, as_of, ttl)
    return S.keep_last_rounds(live, cap)


def compact_sessions(log: BucketTable, as_of: Column, batch: str, least: int = 2, cap: int = schemas.ROUNDS_KEPT, ttl: int = schemas.SESSION_TTL) -> list[int]:
    """Rewrites the buckets that have at least `least` folders, without rounds that have expired or lie beyond the cap."""
    folders: dict[int, int] = {}
    for b, *_ in log.state():
        folders[b] = folders.get(b, 0) + 1
    touched = [b for b, n in sorted(folders.items()) if n >= least]
    if touched and not log.done(batch):
        log.rewrite(logged_sessions(log, as_of, cap=cap, ttl=ttl, buckets=touched), touched, batch)
    return touched


# Contexts and journals


def context_table(spark: SparkSession, path: str, buckets: int = 256) -> BucketTable:
    """S4 in buckets by hash: new rows are appended; a look-up reads the buckets of the hashes it asks for, and no other."""
    return BucketTable(spark, path, schemas.CONTEXTS, "hash", buckets)


def find_contexts(table: BucketTable, hashes: DataFrame, as_of: Column) -> DataFrame:
    """R11 on the stored table; of rows with one hash the latest counts."""
    asked = written(hashes.select("hash").distinct(), "asked")
    rows = table.read(table.buckets_of(asked)).join(asked, "hash", "left_semi")
    return C.retrieve_contexts(C.upsert_contexts(rows, rows.limit(0)), asked, as_of)


def compact_contexts(table: BucketTable, as_of: Column, batch: str, least: int = 2) -> list[int]:
    """Rewrites the buckets of several folders with the latest row of each hash, and none that has expired."""
    folders = [b for b, *_ in table.state()]
    touched = sorted({b for b in folders if folders.count(b) >= least})
    if touched and not table.done(batch):
        rows = table.read(touched)
        table.rewrite(C.upsert_contexts(rows, rows.limit(0)).filter(F.col("expires_at") > as_of.cast("timestamp")), touched, batch)
    return touched


JOURNAL = "user_id string, request_id string, pos int, type string, role string, content string, original_url string, local_path string, timestamp timestamp, date date"


def journal_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """S5 for many users: entries in buckets by user instead of a folder for each user and day; files are bounded by rows, a hot user's
    entries are dealt to several tasks, and `compact` joins small ones. One user's journal is one bucket, ordered by time."""
    return BucketTable(spark, path, JOURNAL, "user_id", buckets)


def log_journal(table: BucketTable, entries: DataFrame, batch: str) -> bool:
    """J5's write: adds `date`, the UTC day of an entry."""
    return table.append(entries.withColumn("date", F.to_date("timestamp")), batch)


def stream_journal_table(entries: DataFrame, table: BucketTable, checkpoint: str, name: str = "stream"):
    """W4 on the stored table: every micro-batch is appended once."""

    def write(batch: DataFrame, number: int) -> None:
        log_journal(table, batch, f"{name}/{number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Exact stores

#: Store calls of a user that go through in the first round, and stored hits that a fact brings along beyond the k it may need.
CALLS, SPARE = 500, 40
#: A user whose calls all went through has twice as many in the next round, up to so many times the first.
GROWN = 4
#: (id, score, text) of a fact's hits, best first.
Hits = list[tuple[str, float, str]]
#: A call's decisions: user, facts and each one's hits in; (event, id, text, old text) in order out.
CallDecider = Callable[[str, list[str], list[Hits]], list[tuple[str, str | None, str | None, str | None]]]


def doc_id(user: str, text: str) -> str:
    """T10 for one text."""
    return hashlib.sha256(f"{user}\0{' '.join(text.split())}".encode()).hexdigest()


def rule_call(update_score: float = M.UPDATE_SCORE) -> CallDecider:
    """The rule of `memory.rule_decider` for one call."""

    def decide(user: str, facts: list[str], hits: list[Hits]) -> list[tuple[str, str | None, str | None, str | None]]:
        out = []
        for fact, found in zip(facts, hits):
            own = doc_id(user, fact)
            if not found or (found[0][0] != own and found[0][1] < update_score):
                out.append(("ADD", own, fact, None))
            elif found[0][0] == own:
                out.append(("NONE", own, fact, None))
            else:
                id_, _, old = found[0]
                out.append(("UPDATE", id_, old if len(old) > len(fact) else fact, old))
        return out

    return decide


class Live:
    """A user's memories as the calls of a round have left them: those they changed, with their vectors."""

    def __init__(self, dims: int):
        self.place: dict[str, int] = {}
        self.gone: set[str] = set()
        self.unseen: set[int] = set()
        self.ids: list[str] = []
        self.texts: list[str] = []
        self.vectors = np.zeros((16, dims))

    def changed(self, id_: str) -> bool:
        return id_ in self.place or id_ in self.gone

    def put(self, id_: str, text: str, vector: np.ndarray) -> None:
        at = self.place.get(id_)
        if at is None:
            at = self.place[id_] = len(self.ids)
            self.ids.append(id_)
            self.texts.append(text)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.gone.discard(id_)
        self.texts[at], self.vectors[at] = text, vector
        (self.unseen.add if np.isnan(vector).any() else self.unseen.discard)(at)

    def drop(self, id_: str) -> None:
        self.gone.add(id_)
        if id_ in self.place:
            self.unseen.add(self.place[id_])

    def hits(self, query: np.ndarray, k: int) -> Hits:
        """The k best, by score and then by id."""
        raw = self.vectors[: len(self.ids)] @ query
        if self.unseen:
            raw[list(self.unseen)] = -np.inf
        # what is equal to twelve digits may differ in the next
        least = np.partition(raw, len(raw) - k)[len(raw) - k] - 1e-11 if len(raw) > k else -np.inf
        near = np.flatnonzero((raw >= least) & (raw > -np.inf)).tolist()
        scores = np.round(1 + raw[near], 12).tolist()
        return sorted([(self.ids[at], s, self.texts[at]) for at, s in zip(near, scores)], key=lambda h: (-h[1], h[0]))[:k]


def unit(vector) -> np.ndarray:
    x = np.asarray(vector, np.float64)
    size = np.sqrt((x * x).sum())
    return x / size if size else np.full(len(x), np.nan)


ACTED = "request_id string, pos int, user_id string, id string, text string, event string, old_memory string, vector array<float>, ts timestamp"


def _act(k: int, most: int, decide: CallDecider, embed: Callable[[pd.Series], pd.Series]) -> Callable:
    """A user's calls of a round, one after the other, each with the memories that the ones before have left.

    A fact's stored hits come along, up to `most`; those that a call of this round changed count no more, and what it made of them is
    searched here. Where so many have changed that the k best can't be told, the round ends for this user before that call.
    """

    def run(calls: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if calls.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in ACTED.split(", ")])
        user, hits = calls["user_id"].iloc[0], hits.sort_values(["request_id", "fact_pos", "rank"])
        starts = np.flatnonzero(~hits[["request_id", "fact_pos"]].duplicated().to_numpy())
        asked = hits[["request_id", "fact_pos"]].iloc[starts]
        stored = dict(zip(zip(asked["request_id"], asked["fact_pos"]), zip(starts.tolist(), [*starts[1:].tolist(), len(hits)])))
        hit_ids, hit_scores, hit_texts = hits["id"].to_numpy(), hits["score"].to_numpy(), hits["text"].to_numpy()
        calls = calls.sort_values(["call_no", "request_id", "fact_pos"])
        live, out, made = Live(len(calls["vector"].iloc[0])), [], {}
        requests, all_facts, all_vectors, places, times = (calls[c].tolist() for c in ("request_id", "fact", "vector", "fact_pos", "ts"))
        firsts = np.flatnonzero(~calls[["call_no", "request_id"]].duplicated().to_numpy()).tolist()
        for first, end in zip(firsts, [*firsts[1:], len(calls)]):
            request, facts, vectors, found, open_ = requests[first], all_facts[first:end], all_vectors[first:end], [], False
            for pos, vector in zip(places[first:end], vectors):
                low, high = stored.get((request, pos), (0, 0))
                left = [(i, s, t) for i, s, t in zip(hit_ids[low:high], hit_scores[low:high].tolist(), hit_texts[low:high]) if not live.changed(i)]
                open_ |= high - low == most and len(left) < k
                found.append(sorted(left + live.hits(unit(vector), k), key=lambda h: (-h[1], h[0]))[:k])
            if open_:
                break
            acts = decide(user, facts, found) if any(found) else [("ADD", None, f, None) for f in facts]
            known = dict(zip(facts, vectors))
            made.update(known)
            for pos, (event, id_, text, old) in enumerate(acts):
                name, vector = (event or "NONE").upper(), None
                if name in ("ADD", "UPDATE") and text is not None:
                    if text not in known and text not in made:
                        made[text] = embed(pd.Series([text])).iloc[0]
                    vector = known[text] if text in known else made[text]
                if name == "ADD" and vector is not None:
                    id_ = doc_id(user, text)
                    live.put(id_, text, unit(vector))
                elif name == "UPDATE" and id_ and vector is not None and id_ not in live.gone:
                    live.put(id_, text, unit(vector))
                elif name == "DELETE" and id_:
                    live.drop(id_)
                out.append((request, pos, user, id_, text, event, old, vector, times[first]))
            if not acts:
                out.append((request, 0, user, None, None, "NONE", None, None, times[first]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ACTED.split(", ")])

    return run


def remember_exact(requests: DataFrame, memories: DataFrame, embedder=None, extractor=M.line_facts, decider: CallDecider | None = None, k: int = schemas.TOP_K, calls: int = CALLS, spare: int = SPARE) -> Remembered:
    """L19's long-term side with every call seeing what the user's earlier calls stored; of the shape of `jobs.remember`.

    In a round, the next calls of every user, `calls` of them in the first, meet the stored memories by `knn_blocks`, which splits large
    users, and then run one after the other in a task that holds no more than these calls, their facts and k + spare hits for each. What
    they did is applied, and the rest goes into the next round. A user whose calls all went through has twice as many in the next round, up
    to GROWN * calls, and one whose round ended early as many as went through, or `calls`; so a user with n calls takes about n / (GROWN * calls)
    rounds, all users at once. Calls are in the order of their times, then of their ids.
    """
    embed, decide = embedder or hashed_bigrams(), decider or rule_call()
    found, used = M.staged(extractor(requests))
    facts = embed_texts(found, embed, "fact").join(requests.select("request_id", "ts"), "request_id")
    facts = written(facts.select("request_id", "user_id", "fact_pos", "fact", "vector", "ts"), "facts")
    users = facts.select("user_id").distinct()
    others, mine = memories.join(users, "user_id", "left_anti"), memories.join(users, "user_id", "left_semi")
    order = Window.partitionBy("user_id").orderBy("ts", "request_id")
    pending = written(facts.select("request_id", "user_id", "ts").distinct().withColumn("call_no", F.row_number().over(order)), "pending")
    actions = None
    pending = pending.withColumn("take", F.lit(calls))
    while not pending.isEmpty():
        nearest = Window.partitionBy("user_id").orderBy("call_no")
        now = pending.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= F.col("take")).select("request_id", "call_no")
        own = written(facts.join(now, "request_id"), "round-facts")
        hits = M.fact_hits(own.select("request_id", "user_id", "fact_pos", "vector"), mine, k + spare)
        hits = written(hits.join(mine.select("user_id", "id", F.col("data").alias("text")), ["user_id", "id"]), "round-hits")
        acted = own.groupBy("user_id").cogroup(hits.groupBy("user_id")).applyInPandas(_act(k, k + spare, decide, embed), ACTED)
        acted = written(acted, "acted")
        mine = written(M.apply_actions(mine, acted.filter("event <> 'NONE' or id is not null")), "memories")
        actions = acted if actions is None else actions.union(acted)
        went = acted.groupBy("user_id").agg(F.count_distinct("request_id").cast("int").alias("went"))
        more = F.when(F.col("went") < F.col("take"), F.greatest("went", F.lit(calls))).otherwise(F.least(2 * F.col("take"), F.lit(GROWN * calls)))
        rest = pending.join(acted.select("request_id").distinct(), "request_id", "left_anti").join(went, "user_id")
        pending = written(rest.select("request_id", "user_id", "ts", "call_no", more.alias("take")), "pending")
    actions = actions if actions is not None else requests.sparkSession.createDataFrame([], ACTED)
    counters = requests.select("request_id", *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])
    usage = M.sum_usage(counters if used is None else counters.unionByName(used.select(counters.columns)), "request_id")
    return Remembered(mine.unionByName(others), actions.select("request_id", "pos", "user_id", "id", "text", "event", "old_memory"), usage)
