"""Compressed rounds and the table of what they leave out, retrievable by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall.functions import text as T
from sparkrecall.operators.sessions import KEYS, omitted_hash
from sparkrecall.schemas import CONTEXT_TTL


class Reversible:
    """U4: the marker names a hash, and the omitted messages go to the context table."""

    name = T.REVERSIBLE

    def marker(self, rounds: DataFrame) -> DataFrame:
        return compress_rounds(rounds, self.name)

    def contexts(self, rounds: DataFrame, as_of: Column, ttl: int = CONTEXT_TTL) -> DataFrame:
        return context_rows(rounds, as_of, ttl)


class Omit:
    """U4: the marker is a plain note, and nothing is kept."""

    name = T.OMIT

    def marker(self, rounds: DataFrame) -> DataFrame:
        return compress_rounds(rounds, self.name)

    def contexts(self, rounds: DataFrame, as_of: Column, ttl: int = CONTEXT_TTL) -> DataFrame:
        return context_rows(rounds, as_of, ttl).filter(F.lit(False))


def strategy_of(name: str) -> Reversible | Omit:
    found = {s.name: s for s in (Reversible, Omit)}.get(name)
    if found is None:
        raise ValueError(f"unknown context strategy: {name}")
    return found()


def compress_rounds(rounds: DataFrame, strategy: str = T.REVERSIBLE) -> DataFrame:
    """Rounds that have messages with `hash`, `kept` (the first message) and `marker`; hash is null under omit."""
    strategy_of(strategy)
    some = rounds.filter(F.size("messages") > 0)
    hash_ = omitted_hash() if strategy == T.REVERSIBLE else F.lit(None).cast("string")
    some = some.withColumn("hash", hash_).withColumn("kept", F.element_at("messages", 1))
    return some.withColumn("marker", T.omission_marker("hash", strategy))


def compressed(classified: DataFrame) -> DataFrame:
    """The rounds of R7 that are shown compressed."""
    return classified.filter(~F.col("recent") & ~F.coalesce(F.col("relevant"), F.lit(False)))


def context_rows(rounds: DataFrame, as_of: Column, ttl: int = CONTEXT_TTL) -> DataFrame:
    """One row per compressed round (with query_text): kept and omitted messages as JSON and text."""
    some = compress_rounds(rounds)
    omitted = F.slice("messages", 2, 1 << 30)
    kept_json = T.canonical_messages_json(F.array("kept"))
    kept = F.substring(kept_json, F.lit(2), F.char_length(kept_json) - 2)
    texts = F.array_join(F.filter(F.transform(omitted, T.text_of), lambda t: t != ""), "\n")
    return some.select(
        "hash", *KEYS, "round_id", kept.alias("kept_message"), T.canonical_messages_json(omitted).alias("omitted_messages"), "query_text",
        T.text_of(F.col("kept")).alias("kept_text"), texts.alias("omitted_text"), as_of.cast("timestamp").alias("created_at"),
        F.timestamp_seconds(as_of.cast("timestamp").cast("double") + ttl).alias("expires_at"),
    )


def upsert_contexts(contexts: DataFrame, new: DataFrame) -> DataFrame:
    """Of equal hashes the latest row stays, with its expiry."""
    w = Window.partitionBy("hash").orderBy(F.col("created_at").desc(), F.col("query_text"))
    return contexts.unionByName(new).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def retrieve_contexts(contexts: DataFrame, hashes: DataFrame, as_of: Column) -> DataFrame:
    """Each asked hash with its row; `found` is false for unknown and expired ones."""
    live = contexts.filter(F.col("expires_at") > as_of.cast("timestamp")).select("hash", *KEYS, "round_id", "omitted_messages", "query_text", "created_at")
    return hashes.join(live.withColumn("_live", F.lit(True)), "hash", "left").withColumn("found", F.coalesce("_live", F.lit(False))).drop("_live")


def missing_contexts(contexts: DataFrame, hashes: DataFrame, as_of: Column) -> DataFrame:
    """The asked hashes that are unknown or expired."""
    return hashes.join(contexts.filter(F.col("expires_at") > as_of.cast("timestamp")), "hash", "left_anti")
