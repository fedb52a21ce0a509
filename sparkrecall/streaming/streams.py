"""Store calls as a stream: session state, expiry windows, memory merges, journals and fact dedup."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkrecall.operators.memory import apply_actions
from sparkrecall.schemas import ROUNDS_KEPT, SESSION_TTL

#: The setting of the state store, and the store that `stream_sessions` needs.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROUND_STATE = "rounds array<struct<ts: bigint, round_id: string, first_user_text: string, messages: string>>, last_ts bigint"
SESSION_ROWS = "user_id string, session_id string, round_no int, round_id string, ts timestamp, first_user_text string, messages string"


class SessionProcessor(StatefulProcessor):
    """Keeps a session's last n rounds. The whole array is one value, since expiry belongs to the session and every
    write renews it; gaps are judged by the events' own times, so a replay gives what the batch gives."""

    def __init__(self, n: int = ROUNDS_KEPT, ttl: int = SESSION_TTL, forget: bool = True):
        self.n, self.ttl, self.forget = n, ttl, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", ROUND_STATE, ttlDurationMs=self.ttl * 1000 if self.forget else None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("round_no")
        rounds = [(r.ts.value // 1000, r.round_id, r.first_user_text, r.messages) for r in rows.itertuples()]
        self.state.update((rounds[-self.n :], rounds[-1][0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        rounds = [tuple(r) for r in found[0]] if found else []
        last = found[1] if found else None
        new = pd.concat(list(rows)).sort_values(["ts", "round_id"])
        for r in new.itertuples():
            ts = r.ts.value // 1000  # microseconds, as Spark has them
            if last is not None and ts - last >= self.ttl * 1_000_000:
                rounds = []
            rounds = [*rounds, (ts, r.round_id, r.first_user_text, r.messages)][-self.n :]
            last = ts
        self.state.update((rounds, last))
        yield pd.DataFrame(
            {
                "user_id": key[0], "session_id": key[1], "round_no": range(1, len(rounds) + 1), "round_id": [r[1] for r in rounds],
                "ts": pd.Series([r[0] for r in rounds], dtype="datetime64[us]"), "first_user_text": [r[2] for r in rounds], "messages": [r[3] for r in rounds],
            }
        )

    def close(self) -> None:
        pass


def stream_sessions(rounds: DataFrame, n: int = ROUNDS_KEPT, ttl: int = SESSION_TTL, forget: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """After each batch, the rounds of every session it touched.

    stored: sessions to start from, as rows like those that come out; taken up when the stream first starts.

    rounds: user_id, session_id, ts, round_id, first_user_text, messages (as JSON). Needs the RocksDB state store. With
    `forget` the store drops a session's state once it has been idle for ttl by the clock; a stream that watches the clock
    never ends by itself, so a replay that should (trigger availableNow) turns this off. What comes out is the same.
    """
    own = rounds.select("user_id", "session_id", "ts", "round_id", "first_user_text", "messages")
    first = None if stored is None else stored.select("user_id", "session_id", "round_no", "ts", "round_id", "first_user_text", "messages").groupBy("user_id", "session_id")
    return own.groupBy("user_id", "session_id").transformWithStateInPandas(SessionProcessor(n, ttl, forget), SESSION_ROWS, "update", "ProcessingTime" if forget else "None", first)


def session_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stream of `stream_sessions` holds, read from its checkpoint, in the form of its rows."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "session").load()
    value = held.select("key.*", F.posexplode("value.rounds").alias("at", "r"))
    return value.select("user_id", "session_id", (F.col("at") + 1).alias("round_no"), "r.round_id", F.timestamp_micros("r.ts").alias("ts"), "r.first_user_text", "r.messages")


def stream_session_windows(rounds: DataFrame, ttl: int = SESSION_TTL, late: str = "1 hour") -> DataFrame:
    """Each session's segments between gaps, when they have closed; rows later than the watermark are dropped."""
    own = rounds.withWatermark("ts", late).groupBy("user_id", "session_id", F.session_window("ts", f"{ttl} seconds").alias("w"))
    return own.agg(F.count("*").alias("rounds")).select("user_id", "session_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("expires_at"), "rounds")


def stream_memories(actions: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Applies each micro-batch of actions to the memory table.

    read() gives the table of the last batch written, write(table, batch_id) a new version; a batch that is replayed
    writes the same version again, so `write` must overwrite the version of its batch_id.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        write(apply_actions(read(), batch), batch_id)

    return actions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_journal(entries: DataFrame, path: str, checkpoint: str):
    """Appends journal entries by user and UTC day."""
    own = entries.withColumn("date", F.to_date("timestamp"))
    return own.writeStream.format("json").partitionBy("user_id", "date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fact_dedup(facts: DataFrame, within: str = "1 day") -> DataFrame:
    """The first of each user's equal facts (by doc_id) within the watermark."""
    return facts.withWatermark("ts", within).dropDuplicatesWithinWatermark(["doc_id"])


def new_checkpoint(base: str) -> str:
    return f"{base}/stream-{uuid.uuid4().hex}"
