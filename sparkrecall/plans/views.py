"""The driver's tables in the shapes of the data model: conversations as messages, events as timed store calls,
embeddings as memories, documents as facts, pages as attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecall import schemas
from sparkrecall.functions import text as T

EPOCH = 1_704_067_200
ITEMS = f"array<{schemas.ITEM}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per message with its round: a leading system message joins round 1."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    number = F.greatest(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w), F.lit(1)).cast("int")
    return c.select(
        "conv_id", "turn", _name("u", F.col("conv_id") % 50).alias("user_id"), _name("s", F.col("conv_id")).alias("session_id"), number.alias("round_no"), "role",
        F.col("text").alias("content_text"), F.lit(None).cast(ITEMS).alias("content_items"), F.timestamp_seconds(F.lit(EPOCH) + number * 60).alias("ts"),
    )


def item(kind: str, text: Column | None = None, image: Column | None = None, file: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = (F.lit(kind), text, image, file)
    return F.struct(*[(none if p is None else p).alias(n) for n, p in zip(("type", "text", "image_url", "file_url"), parts)])


def itemised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, every other one with a list of items: the text, an image, a file and a closing text."""
    even = F.col("turn") % 2 == 0
    url = F.concat(F.lit("http://h/"), F.col("turn").cast("string"))
    items = F.array(item("input_text", F.col("content_text")), item("input_image", image=url), item("file", file=url), item("input_text", F.lit("end")))
    m = messages(spark, sf_dir)
    return m.withColumn("content_items", F.when(even, items)).withColumn("content_text", F.when(~even, F.col("content_text")))


def requests(spark: SparkSession, sf_dir: str, source=messages) -> DataFrame:
    """One request per conversation, with all its messages."""
    m = F.struct("role", "content_text", "content_items").alias("m")
    own = source(spark, sf_dir).groupBy("conv_id", "user_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("turn", m))).alias("a"), F.max("ts").alias("ts"))
    return own.select(
        "conv_id", _name("r", F.col("conv_id")).alias("request_id"), "ts", "user_id", "session_id", F.lit(1).alias("recent_rounds_full"), F.transform("a", lambda x: x["m"]).alias("input")
    )


def event_rounds(spark: SparkSession, sf_dir: str, kinds: Column | None = None) -> DataFrame:
    """Events as rounds of one message; a user's events are one session."""
    e = table(spark, sf_dir, "events")
    e = e if kinds is None else e.filter(kinds)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    text = F.concat_ws(" ", "event_type", "props")
    return e.select(
        _name("u", F.col("user_id")).alias("user_id"), _name("s", F.col("user_id")).alias("session_id"), F.row_number().over(w).alias("round_no"),
        F.col("event_id").cast("string").alias("round_id"), F.col("ts").cast("timestamp").alias("ts"), F.array(T.message(F.lit("user"), text)).alias("messages"), text.alias("first_user_text"),
    )


def last_event(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the last event, as a literal."""
    found = table(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    return F.timestamp_micros(F.lit(found or 0))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.lit(EPOCH))
    return e.select(
        _name("v", F.col("vec_id")).alias("id"), _name("u", F.col("label")).alias("user_id"), _name("memory ", F.col("vec_id")).alias("data"), F.col("embedding").alias("vector"),
        _name("h", F.col("vec_id")).alias("hash"), at.alias("created_at"), at.alias("updated_at"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of the searches: every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    return e.select(
        "vec_id", "label", _name("q", F.col("vec_id")).alias("request_id"), _name("u", F.col("label")).alias("user_id"), F.lit("query").alias("query_text"), F.col("embedding").alias("vector")
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages with a text, an attachment of one of six kinds of name, and that attachment once more."""
    p = table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", "[?#].*$", "")
    suffix = F.element_at(F.array(*map(F.lit, (".PNG", ".mp3", ".pdf", ".mp4", ".tar.gz", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    url = F.concat(base, F.lit("/f"), F.col("page_id").cast("string"), suffix, F.lit("?v=1"))
    text = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("see "), F.col("url"))).otherwise(F.lit("  "))
    items = F.array(item("input_text", text), item("file", file=url), item("file", file=url), item("file"))
    m = F.struct(F.when(F.col("page_id") % 5 != 0, F.lit("user")).alias("role"), F.lit(None).cast("string").alias("content_text"), items.alias("content_items"))
    return p.select(
        _name("r", F.col("page_id")).alias("request_id"), F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id")).alias("ts"), _name("u", F.col("page_id") % 20).alias("user_id"),
        F.lit("s").alias("session_id"), F.lit(None).cast("int").alias("recent_rounds_full"), F.array(m).alias("input"), "page_id", url.alias("file_url"),
    )
