"""Readers and writers: requests, sessions, contexts, memories, journals and attachments."""

from __future__ import annotations

import errno
import os
import re
import stat
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkrecall import schemas
from sparkrecall.operators.journal import attachment_manifest, extract_files, journal_entries

#: Folders by hash of the user, and rows of one folder that a task writes; larger folders are written by several tasks.
USER_BUCKETS, TASK_ROWS = 64, 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local session without one has a
    temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("sparkrecall.scratch", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparkrecall-")
        spark.conf.set("sparkrecall.scratch", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: what is used several times is made once, and a lost executor
    costs no more than its own tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines, whose content is a string or a list of items.

    Content is read as a variant, which tells the string "[1]" from a list.
    """
    raw = spark.read.schema(
        "request_id string, ts timestamp, userId string, sessionId string, memory_settings struct<recent_rounds_full: int>, input array<struct<role: string, content: variant>>"
    ).json(path)
    return normalise_requests(raw)


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Requests with variant content as the REQUESTS schema: exactly one of content_text and content_items is set."""
    item = f"array<{schemas.ITEM}>"
    text = "case when schema_of_variant(m.content) = 'STRING' then try_variant_get(m.content, '$', 'string') end"
    items = f"case when schema_of_variant(m.content) <> 'STRING' then try_variant_get(m.content, '$', '{item}') end"
    messages = F.expr(f"transform(input, m -> named_struct('role', m.role, 'content_text', {text}, 'content_items', {items}))")
    return raw.select("request_id", "ts", F.col("userId").alias("user_id"), F.col("sessionId").alias("session_id"), F.col("memory_settings.recent_rounds_full").alias("recent_rounds_full"), messages.alias("input"))


def write_sessions(rounds: DataFrame, path: str, mode: str = "error") -> None:
    """One row per session, its rounds as a JSON array in order."""
    own = rounds.groupBy("user_id", "session_id").agg(
        F.array_sort(F.collect_list(F.struct("round_no", "round_id", "ts", "messages", "first_user_text"))).alias("r"), F.max("ts").alias("updated_at")
    )
    own.select("user_id", "session_id", F.to_json("r").alias("rounds"), "updated_at").write.mode(mode).parquet(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The rounds of stored sessions as rows."""
    entry = f"array<struct<round_no: int, round_id: string, ts: timestamp, messages: array<{schemas.MESSAGE}>, first_user_text: string>>"
    own = spark.read.parquet(path).select("user_id", "session_id", F.explode(F.from_json("rounds", entry)).alias("r"))
    return own.select("user_id", "session_id", "r.*").select("user_id", "session_id", "round_no", "round_id", "ts", "messages", "first_user_text")


def check_dims(memories: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(memories whose vector has `dims` numbers, the rest)."""
    good = F.coalesce(F.size("vector") == dims, F.lit(False))
    return memories.filter(good), memories.filter(~good)


def user_bucket(buckets: int = USER_BUCKETS):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def write_memories(memories: DataFrame, path: str, dims: int = schemas.DIMS, buckets: int = USER_BUCKETS, mode: str = "error") -> DataFrame:
    """S3: the memory table in folders by hash of the user; returns the rows with other dimensions, which are not written.

    A folder is dealt to a task for each TASK_ROWS of the table's mean folder, by a hash of the id, so that neither a large
    table nor a hot user is one task's.
    """
    good, rejected = check_dims(memories, dims)
    parts = max(1, -(-good.count() // (buckets * TASK_ROWS)))
    salted = good.withColumn("bucket", user_bucket(buckets)).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    salted.repartition("bucket", "_part").drop("_part").write.mode(mode).partitionBy("bucket").parquet(path)
    return rejected


def read_memories(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """S3: the memory table, or given buckets of it; an empty table where there is none yet."""
    try:
        own = spark.read.schema(schemas.MEMORIES + ", bucket int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.MEMORIES)
    return (own.filter(F.col("bucket").isin(buckets)) if buckets is not None else own).drop("bucket")


def write_contexts(contexts: DataFrame, path: str, mode: str = "append") -> None:
    """The context table; clustered by hash, so that a look-up reads few row groups."""
    contexts.sortWithinPartitions("hash").write.mode(mode).parquet(path)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONTEXTS).parquet(path)


def write_journal(entries: DataFrame, path: str) -> None:
    """Appends entries as JSON lines to one folder per user and UTC day; request order within a file."""
    own = entries.withColumn("date", F.to_date("timestamp"))
    own.repartition("user_id", "date").sortWithinPartitions("user_id", "date", "timestamp", "request_id", "pos").write.mode("append").partitionBy("user_id", "date").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id string, date date, request_id string, pos int, type string, role string, content string, original_url string, local_path string, timestamp timestamp").json(path)


#: Bytes of files that a task hands on at once; a larger file alone.
FILE_BYTES = 8_000_000


def _file_bytes(path: str | None, roots: tuple[str, ...]) -> bytes | None:
    """A file below one of the folders, or one of them itself; none if there is no such file."""
    if path is None or path.startswith("//") or os.path.normpath(path) != path or not any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots):
        return None
    try:
        if not stat.S_ISREG(os.stat(path).st_mode):
            return None
        with open(path, "rb") as f:
            return f.read()
    except (FileNotFoundError, NotADirectoryError, ValueError):
        return None
    except OSError as e:
        if e.errno not in (errno.ENAMETOOLONG, errno.ELOOP):
            raise
        return None


def ingest_attachments(manifest: DataFrame, paths: list[str]) -> DataFrame:
    """The manifest with each local file's bytes; local_path is its place in the store, null for a missing file.

    Local urls are paths, with or without file://; only files at or below the given paths count. The manifest is dealt to tasks, each
    of which opens the files that its rows name: no list of files goes through the driver, and no contents are moved. Paths of another file
    system, and patterns, go through Spark's own reader, which lists their files on the driver.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    near = [p for p in paths if (p.startswith("file:") or not re.match(r"[\w.+-]+:", p)) and not re.search(r"[*?\[{]", p)]
    roots = tuple(os.path.abspath(re.sub("^file:/+", "/", p)) for p in near)
    far = [p for p in paths if p not in near]
    kinds = StructType(manifest.schema.fields + StructType().add("content", "binary").add("length", "long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, contents, size, start = batch.column("_path").to_pylist(), [], 0, 0
            for k, path in enumerate(urls):
                contents.append(_file_bytes(path, roots))
                size += len(contents[-1] or b"")
                if size >= FILE_BYTES or k + 1 == len(urls):
                    own = batch.slice(start, k + 1 - start).drop_columns(["_path"])
                    lengths = pa.array([None if c is None else len(c) for c in contents], pa.int64())
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(contents, pa.binary()), lengths], names=[*own.schema.names, "content", "length"])
                    contents, size, start = [], 0, k + 1

    # a count of its own, as otherwise the few bytes of a manifest would be one task's
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.withColumn("_path", plain("file_url")).repartition(tasks).mapInArrow(run, kinds)
    if far:
        found = _listed_files(found, far, plain)
    return found.withColumn("local_path", F.when(F.col("length").isNotNull(), F.col("dest")))


def _listed_files(found: DataFrame, paths: list[str], plain: Callable) -> DataFrame:
    """What tasks did not find, by Spark's reader. Files are listed and narrowed to the urls before a byte of them is read."""
    own, had = found.withColumn("_path", plain("file_url")), F.col("length").isNotNull()
    read = found.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = read.load(paths).select("path").join(own.filter(~had).select("_path").distinct(), plain("path") == F.col("_path"), "left_semi")
    asked = [r["path"] for r in listed.toLocalIterator()]
    if not asked:
        return found
    files = read.load(asked).select(plain("path").alias("_path"), F.col("content").alias("_content"), F.col("length").alias("_length"))
    both = own.join(files, "_path", "left")
    return both.withColumns({"content": F.coalesce("content", "_content"), "length": F.coalesce("length", "_length")}).select(found.columns)


def journal(requests: DataFrame, saved: DataFrame, path: str) -> DataFrame:
    """Writes the journal of requests; returns the manifest of their attachments. A missing time is now."""
    own = requests.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    write_journal(journal_entries(own, saved), path)
    return attachment_manifest(extract_files(own))
