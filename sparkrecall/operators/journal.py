"""Journal entries and attachment manifests of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrecall.functions import text as T


def extract_files(requests: DataFrame) -> DataFrame:
    """(request_id, user_id, message_idx, item_idx, file_url) of every file item with a url."""
    m = requests.select("request_id", "user_id", F.posexplode("input").alias("message_idx", "m"))
    items = m.select("request_id", "user_id", "message_idx", F.posexplode("m.content_items").alias("item_idx", "x"))
    return items.filter((F.col("x.type") == "file") & (F.coalesce("x.file_url", F.lit("")) != "")).select("request_id", "user_id", "message_idx", "item_idx", F.col("x.file_url").alias("file_url"))


def attachment_manifest(files: DataFrame) -> DataFrame:
    """Each user's distinct urls with category and destination."""
    own = files.select("user_id", "file_url").distinct()
    return own.select("user_id", "file_url", T.attachment_category("file_url").alias("category"), T.attachment_dest("file_url").alias("dest"))


def resolve_paths(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Adds local_path: where the file was saved (saved: user_id, file_url, local_path), else its url."""
    paths = saved.select("user_id", "file_url", "local_path").dropDuplicates(["user_id", "file_url"])
    return files.join(paths, ["user_id", "file_url"], "left").withColumn("local_path", F.coalesce("local_path", "file_url"))


def journal_entries(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Per message its file entries in order, then one entry of its text if that is more than white space.

    (request_id, user_id, pos, type, role, content, original_url, local_path, timestamp)
    """
    none = F.lit(None).cast("string")
    files = resolve_paths(extract_files(requests), saved)
    files = files.select("request_id", "user_id", "message_idx", F.lit(0).alias("kind"), "item_idx", F.lit("file").alias("type"), none.alias("role"), none.alias("content"), F.col("file_url").alias("original_url"), "local_path")
    m = requests.select("request_id", "user_id", F.posexplode("input").alias("message_idx", "m")).withColumn("content", T.text_of(F.col("m")))
    texts = m.filter(T.non_blank("content")).select(
        "request_id", "user_id", "message_idx", F.lit(1).alias("kind"), F.lit(0).alias("item_idx"), F.lit("message").alias("type"), F.coalesce("m.role", F.lit("unknown")).alias("role"), "content", none.alias("original_url"), none.alias("local_path")
    )
    times = requests.select("request_id", F.col("ts").alias("timestamp"))
    w = Window.partitionBy("request_id").orderBy("message_idx", "kind", "item_idx")
    both = files.unionByName(texts).withColumn("pos", F.row_number().over(w))
    return both.join(times, "request_id").select("request_id", "user_id", "pos", "type", "role", "content", "original_url", "local_path", "timestamp")
