"""Tables in folders by bucket, of which a write touches only those it has rows for, and a ledger that says which folders count.

A write makes new folders first and appends to the ledger last, in one file, so that it counts whole or not at all; folders
of a write that failed are never read. `rewrite` puts new folders in the place of some buckets, `append` adds to them. A write
carries the name of its batch, and a name the ledger knows is not written again: a batch that is replayed, also after
a restart, changes nothing. Earlier versions stay readable. One writer at a time; any number of readers.

What comes to the driver is the ledger's state: a row for each bucket and for each append since its last rewrite.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one bucket that a task writes; a larger bucket, or a hot key's, is written by several tasks.
TASK_ROWS = 1_000_000
LEDGER = "version int, batch string, kind string, bucket int, folder string, rows long"


class BucketTable:
    """A table at `path` in `buckets` buckets by a hash of the column `key`.

    Rows without a key are in bucket 0; an empty table reads as no rows; columns beyond the schema are left behind.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, task_rows: int = TASK_ROWS):
        self.spark, self.path, self.schema, self.key, self.buckets, self.task_rows = spark, path, schema, key, buckets, task_rows

    def bucket(self, key: str | None = None) -> Column:
        """A row's bucket, by the first 32 bits of its key's md5."""
        return F.coalesce(F.pmod(F.conv(F.substring(F.md5(key or self.key), 1, 8), 16, 10).cast("long"), F.lit(self.buckets)), F.lit(0)).cast("int")

    def ledger(self) -> DataFrame:
        """Every write so far, a row for each bucket it touched."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def version(self) -> int:
        """The last version; 0 before the first write."""
        return self.ledger().agg(F.max("version")).first()[0] or 0

    def done(self, batch: str) -> bool:
        return not self.ledger().filter(F.col("batch") == batch).isEmpty()

    def state(self, version: int | None = None) -> list[tuple[int, str, int]]:
        """(bucket, folder, rows) that make up the table, or made it up at a version."""
        known = self.ledger() if version is None else self.ledger().filter(F.col("version") <= version)
        last = known.filter("kind = 'rewrite'").groupBy("bucket").agg(F.max("version").alias("since"))
        live = known.join(last, "bucket", "left").filter("bucket is not null and folder is not null and version >= coalesce(since, 0)")
        return [(r["bucket"], r["folder"], r["rows"]) for r in live.orderBy("version", "bucket").select("bucket", "folder", "rows").collect()]

    def read(self, buckets: list[int] | None = None, version: int | None = None, marked: bool = False) -> DataFrame:
        """The rows, of some buckets if asked for; marked: with the `version` that wrote them. Other folders are not even listed."""
        paths = [f"{self.path}/data/folder={folder}/bucket={b}" for b, folder, _ in self.state(version) if buckets is None or b in buckets]
        extra = ", folder string, bucket int"
        if paths:
            rows = self.spark.read.schema(self.schema + extra).option("basePath", f"{self.path}/data").parquet(*paths)
        else:
            rows = self.spark.createDataFrame([], self.schema + extra)
        own = [F.col(c) for c in self.spark.createDataFrame([], self.schema).columns]
        return rows.select(*own, *([F.split("folder", "-")[0].cast("int").alias("version")] if marked else []))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that rows of keys fall in: numbers up to the number of buckets."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, kind: str, touched: list[int], batch: str) -> None:
        version = self.version() + 1
        folder = f"{version}-{uuid.uuid4().hex}"
        target = f"{self.path}/data/folder={folder}"
        columns = self.spark.createDataFrame([], self.schema).columns
        salt = F.pmod(F.xxhash64(*[c for c, t in rows.select(columns).dtypes if t in ("string", "timestamp", "int", "bigint")]), F.lit(self._tasks(touched)))
        dealt = rows.select(*columns, self.bucket().alias("bucket"), salt.alias("_salt")).repartition("bucket", "_salt").drop("_salt")
        dealt.write.option("maxRecordsPerFile", self.task_rows).partitionBy("bucket").parquet(target)
        try:
            counts = {r["bucket"]: r["n"] for r in self.spark.read.schema(self.schema + ", bucket int").parquet(target).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        except AnalysisException:  # nothing was written
            counts = {}
        if kind == "rewrite":  # a bucket that has lost all its rows has no folder any more
            rows_ = [(version, batch, kind, b, folder if b in counts else None, counts.get(b, 0)) for b in touched]
        else:
            rows_ = [(version, batch, kind, b, folder, n) for b, n in sorted(counts.items())]
        rows_ = rows_ or [(version, batch, kind, None, None, 0)]
        self.spark.createDataFrame(rows_, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _tasks(self, touched: list[int]) -> int:
        """Into how many tasks a bucket is dealt, by its largest size so far."""
        sizes: dict[int, int] = {}
        for b, _, n in self.state():
            sizes[b] = sizes.get(b, 0) + n
        return max(1, *(-(-sizes.get(b, 0) // self.task_rows) for b in touched)) if touched else max(1, *(-(-n // self.task_rows) for n in sizes.values()), 1)

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Adds rows to their buckets; False if the batch was written before."""
        if self.done(batch):
            return False
        self._write(rows, "append", [], batch)
        return True

    def rewrite(self, rows: DataFrame, touched: list[int], batch: str) -> bool:
        """Puts rows, all of them of the touched buckets, in the place of these; False if the batch was written before."""
        if self.done(batch):
            return False
        self._write(rows, "rewrite", touched, batch)
        return True

    def compact(self, batch: str, least: int = 2) -> list[int]:
        """Rewrites the buckets of at least `least` folders, each as one; gives their numbers."""
        folders: dict[int, int] = {}
        for b, *_ in self.state():
            folders[b] = folders.get(b, 0) + 1
        touched = [b for b, n in sorted(folders.items()) if n >= least]
        if touched and not self.done(batch):
            self.rewrite(self.read(touched), touched, batch)
        return touched
