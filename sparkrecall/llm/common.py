"""Shared helpers: the shared work folder, intermediate tables and bounded slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of text that a Python task works on at once; a longer text is worked on alone.
BATCH_BYTES, BATCH_ROWS = 2_000_000, 512

#: Word separators of the documents' word rule: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster has none to offer, as its machines
    don't see each other's, and is told so.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("sparkrecall.work.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="sparkrecall-")
        spark.conf.set("sparkrecall.work.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written, shuffle files go as soon as they are of no more use, and Spark hands Python tasks batches of so
#: many bytes (a larger row alone), not of 10,000 rows of any size.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def keep(df: DataFrame, name: str, codec: str = "zstd", level: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors.

    While it writes, shuffle files go as soon as their query ends. Another thread's query that ends meanwhile keeps its
    result; only should it be run once more, it starts from its sources.
    """
    spark = df.sparkSession
    path, was = new_path(spark, name), {k: spark.conf.get(k, None) for k in _WRITING}
    out = df.write.option("compression", codec)
    out = out if level is None else out.option("parquet.compression.codec.zstd.level", level)
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        out.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `keep` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for place in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, a null text as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: int | str, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most` bytes in its column of texts or media; a longer one is alone."""
    column = batch.column(text) if isinstance(text, int) else batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = min(batch.num_rows, start + rows, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, end - start)
        start = end
