"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every five-word shingle is hashed once. The hash's top bits choose one of `BINS` bins, and a bin keeps its
smallest hash. An empty bin takes the value of another by optimal densification: it tries bins in an order that
depends on its own number only, and takes the first that is not empty, so equal sets fill alike. `LOW_BITS` bits
of each bin, mixed with the bin's number so that bins filled from one value differ, are packed into a hexadecimal
string. Two unequal bins agree by chance in one of 2^LOW_BITS cases; `likeness` takes that share out again.

All of it happens within a row: hashes are sorted together with one marker per bin that sorts behind every hash
of the bin, and the first entry of each bin is its minimum, or its marker if the bin is empty. No exchange, no
explosion into shingle rows. Only the query's "next document" moves texts, once.

Defined results: a text of fewer than five words is one shingle; a text without words (empty, blank, null) has a
fingerprint of zeros and `words` false, likeness 1 to another such and 0 to any other; repeated rows have a row
each; rows that share an id, or have none (they come first), stand in the order of a hash of their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep, texts
from .merkle import placed

SHINGLE, BINS, LOW_BITS, TRIES = 5, 256, 8, 24
_HALF = 1 << (LOW_BITS - 1)
#: A hash keeps 62 bits: the bin's number above, HASH_BITS below.
HASH_BITS = 54
#: 2^RUN_BITS consecutive ids find their next document together.
RUN_BITS = 8
#: A run of more rows is parted by id and 2^SUB_BITS ways by a hash of the texts, as are the rows without an id, which are one run.
HOT_ROWS, SUB_BITS, NAMELESS = 4096, 12, -(1 << 62)
#: Bytes of text for each task.
TASK_BYTES = 32_000_000
#: Runs whose first ids are broadcast (40 bytes each).
SENT_RUNS = 200_000


def word_hashes(text: str) -> Column:
    return F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(h: str) -> Column:
    """62-bit hashes of the shingles of an array column of word hashes."""
    n = F.size(h)
    keep62 = F.lit((1 << 62) - 1)
    windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]).bitwiseAND(keep62))
    whole = F.array(F.xxhash64(h).bitwiseAND(keep62))
    return F.when(n >= SHINGLE, windows).when(n > 0, whole).otherwise(F.array().cast("array<long>"))


def with_bins(table: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: an array of BINS values of LOW_BITS (at most 8) bits, as signed bytes; null for a text without words."""
    rest = table.columns
    marks = F.array(*[F.lit(((b + 1) << HASH_BITS) - 1) for b in range(BINS)])
    step = table.select("*", word_hashes(text).alias("__words"))
    step = step.select(*rest, F.size("__words").alias("__n"), F.sort_array(F.concat(_shingles("__words"), marks)).alias("__sorted"))
    # the first of each bin: one value a bin, in the order of the bins
    first = F.filter("__sorted", lambda x, i: (i == 0) | (F.shiftright(x, HASH_BITS) != F.shiftright(F.get("__sorted", i - 1), HASH_BITS)))
    step = step.select(*rest, "__n", first.alias("__firsts"))
    empty_mark = F.lit((1 << HASH_BITS) - 1)

    def own(x: Column) -> Column:
        """A bin's hash, null if it holds its marker."""
        low = x.bitwiseAND(empty_mark)
        return F.when(low != empty_mark, low)

    def tried(i: Column) -> list[Column]:
        return [own(F.get("__firsts", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))) for t in range(TRIES)]

    def last(i: Column) -> Column:
        """Of all bins that are not empty, the one that comes first in the bin's own order of bins."""
        order = F.transform("__firsts", lambda x, j: F.when(own(x).isNotNull(), F.struct(F.xxhash64(i, F.lit(TRIES), j).alias("order"), own(x).alias("low"))))
        return F.array_min(F.filter(order, lambda x: x.isNotNull())).getField("low")

    filled = F.transform("__firsts", lambda x, i: (F.xxhash64(F.coalesce(own(x), *tried(i), last(i)), i).bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - _HALF).cast("byte"))
    return step.select(*rest, F.when(F.col("__n") > 0, filled).alias(name))


def packed(bins: str) -> Column:
    """The bins' low bits in hexadecimal, LOW_BITS / 4 digits a bin; zeros for a text without words."""
    digits = LOW_BITS // 4
    own = F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.cast("long") + _HALF), digits, "0")), "")
    return F.coalesce(F.lower(own), F.lit("0" * digits * BINS))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts' shingles from their bins, from 0 to 1."""
    chance = 1 / (1 << LOW_BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    neither = F.col(a).isNull() & F.col(b).isNull()
    return F.when(neither, 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, words (whether there are any), fingerprint of each whole text."""
    made = with_bins(texts(docs), "text", "bins")
    return made.select("doc_id", F.col("bins").isNotNull().alias("words"), packed("bins").alias("fingerprint"))


def in_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text and `_copies`, with the run (`_run`, `_sub`) whose rows find their next one together, dealt out by run.

    A run is a stretch of consecutive ids. One with many rows is parted by id and by a hash of the texts, and its equal rows
    become one with their number, so that a hot id, or a hot row, is dealt to many tasks. The first row of each run also goes,
    marked as `_ghost`, to the end of the run before, the very first to the end of the last: the runs' own order is that of a
    range partitioning of a few numbers a run. Tasks are as many as the texts' bytes ask for.
    """
    spark = docs.sparkSession
    run = F.coalesce(F.shiftright("doc_id", RUN_BITS), F.lit(NAMELESS))
    table = texts(docs).withColumn("_run", run)
    counts = table.groupBy("_run").agg(F.count("*").alias("n")).filter((F.col("n") > HOT_ROWS) | (F.col("_run") == NAMELESS))
    hot = keep(counts.select("_run"), "hot-runs")
    n_hot = hot.count()
    rows = table.select("doc_id", "text", F.xxhash64("text").alias("_h"), "_run", F.lit(0).cast("long").alias("_sub"), F.lit(1).cast("long").alias("_copies"))
    if n_hot:
        sent = F.broadcast(hot) if n_hot <= SENT_RUNS else hot
        own = F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << RUN_BITS) - 1)), F.lit(0)) * (1 << SUB_BITS)
        sub = own + F.shiftright("_h", 64 - SUB_BITS) + (1 << (SUB_BITS - 1))
        many = rows.join(sent, "_run", "left_semi").groupBy("doc_id", "text", "_h", "_run").agg(sub.alias("_sub"), F.count("*").alias("_copies"))
        rows = rows.join(sent, "_run", "left_anti").unionByName(many)
    firsts = rows.groupBy("_run", "_sub").agg(F.min(F.struct("doc_id", "_h")).alias("_least"), F.sum(F.octet_length("text")).alias("_bytes"))
    firsts = placed(firsts.withColumn("tree", F.lit("")), ["_run", "_sub"])
    n, size = firsts.agg(F.count("*"), F.sum("_bytes")).first()
    before = firsts.select(((F.col("at") + 1) % F.col("n")).alias("at"), F.col("_run").alias("_run0"), F.col("_sub").alias("_sub0"))
    firsts = keep(firsts.join(before, "at").select("_run", "_sub", "_least", "_run0", "_sub0"), "runs-before")
    # a few numbers for each run: sent to all tasks while that is small, else joined by run
    sent = F.broadcast(firsts) if n <= SENT_RUNS else firsts
    heads = rows.join(sent, ["_run", "_sub"]).filter(F.struct("doc_id", "_h").eqNullSafe(F.col("_least")))
    heads = heads.groupBy("_run", "_sub").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("_h").alias("_h"), F.first("_run0").alias("_run0"), F.first("_sub0").alias("_sub0"))
    ghosts = heads.select("doc_id", "text", "_h", F.col("_run0").alias("_run"), F.col("_sub0").alias("_sub"), F.lit(1).cast("long").alias("_copies"), F.lit(True).alias("_ghost"))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(max(least, -(-(size or 0) // TASK_BYTES)), "_run", "_sub")


def with_next(rows: DataFrame, columns: list[str], once: bool = False) -> DataFrame:
    """Adds next_<c>: the columns of the row that follows in ascending doc_id, after the last the first; takes the output of
    `in_runs`, by then with more columns. Each of equal rows but the last is followed by its like.

    once: equal rows with an equal next one stay one row, with their number in `times`.
    """
    w = Window.partitionBy("_run", "_sub").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h", "text")
    found = rows.select("*", F.struct(*[F.lead(c).over(w).alias(c) for c in columns]).alias("_next")).filter("not _ghost")
    own = F.struct(*[F.col(c).alias(c) for c in columns])
    last = F.struct(F.col("_next").alias("of"), F.lit(1).cast("long").alias("times"))
    each = F.when(F.col("_copies") > 1, F.array(F.struct(own.alias("of"), (F.col("_copies") - 1).alias("times")), last)).otherwise(F.array(last))
    rest = [c for c in rows.columns if c not in ("_ghost", "_run", "_sub", "_h", "_copies")]
    every = found.select(*rest, F.explode(each).alias("_x")).select(*rest, *[F.col(f"_x.of.{c}").alias(f"next_{c}") for c in columns], F.col("_x.times").alias("times"))
    return every if once else repeated(every)


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as `times` says."""
    return rows.select(*[c for c in rows.columns if c != "times"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_k")).drop("_k")


def op5_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_bins(in_runs(documents(spark, sf_dir)), "text", "bins")
    rows = with_next(own, ["text", "bins"], once=True)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("*", n.cast("long").alias("n_chars"), half.alias("half"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.select("doc_id", "n_chars", "bins", "next_bins", "times", edited.alias("edited"))
    rows = with_bins(rows.select("*", F.sha2("edited", 256).alias("edited_sha256")), "edited", "edited_bins")
    made = rows.select(
        "times", "doc_id", "n_chars", "edited_sha256", packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
    return repeated(made)
