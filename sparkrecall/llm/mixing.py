"""Mixing sources to target weights: hash-threshold histograms, with no sort of the documents.

Every document has a hash of its id. Sizes are summed by source and hash bucket; the first bucket in which a
source's running sum passes its budget is its boundary, and only the documents of that bucket are summed again,
by the next bits of the hash, until one hash value is the boundary. A document is then taken if its hash lies
below its source's threshold: one filter. What the boundary document leaves open is a smaller budget for the
documents behind it that fit, found by the same search; nested thresholds bring a source within a few words.

Defined results: a null text has size 0; a null source is a source of its own, last; repeated rows of an id share
a hash and are taken together; a row without a doc_id hashes its text (equal texts are then taken together); an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, forget, keep

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most that a source or document gives, in times its size.
SHARE, MOST = 1.5, 2
#: A hash has 60 bits; each level of the search tells 15 more apart, so that a source has 32,768 buckets at most at any level.
SHIFTS = (45, 30, 15, 0)
END = 1 << 60
ROUNDS = 4


def hash60() -> F.Column:
    """60 bits of the md5 of a row's id, of its text where it has no id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit(""))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h and text-free: a narrow row per document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), hash60().alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: weights go round the sources by code point; what lies above `most` times a
    source's size is shared anew among the rest, found at once by ordering sources by size over weight."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    goal = F.sum("source_size").over(Window.partitionBy()) * share
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (goal - before) / behind).withColumn("at", F.row_number().over(order))
    open_ = F.col("cap") / F.col("w") > F.col("level")
    by = by.withColumn("first", F.min(F.when(open_, F.struct("at", "level"))).over(Window.partitionBy()))
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("w"))
    return by.select("source", "source_size", target.alias("target"))


def _cut(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, cut, used: the hashes below `cut` are the longest run whose sizes stay within the budget.

    rows: source, size, h; budgets: source, budget. Sources compare by <=>, as null is one. All rows are summed once, by the
    upper bits of their hashes; below that only the rows of each source's boundary bucket are, a table of their own, filtered
    to the boundary reached so far.
    """
    level = rows
    found = budgets.select("source", "budget", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("whole"))
    was = 60
    for shift in SHIFTS:
        if was < 60:
            edge = found.filter("not whole").select(F.col("source").alias("s"), "prefix")
            inside = rows.source.eqNullSafe(edge.s) & (F.shiftright("h", was) == F.col("prefix"))
            level = rows.join(edge, inside).select("source", "size", "h")
            if was == SHIFTS[0]:
                rows = level = keep(level, "mix-boundary")
        sums = level.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        known = found.alias("f").join(sums.alias("s"), F.col("f.source").eqNullSafe(F.col("s.source")) & ~F.col("f.whole"))
        run = F.sum("s.size").over(Window.partitionBy("f.source").orderBy("s.bucket"))
        known = known.select(F.col("f.source").alias("source"), "f.budget", "f.used", "s.bucket", "s.size", run.alias("run"))
        over = F.col("used") + F.col("run") > F.col("budget")
        step = known.groupBy("source").agg(
            F.first("budget").alias("budget"),
            (F.first("used") + F.coalesce(F.max(F.when(~over, F.col("run"))), F.lit(0))).alias("used"),
            F.min(F.when(over, F.col("bucket"))).alias("prefix"),
        )
        rest = found.select("source", "budget", F.col("used").alias("u0"), F.col("prefix").alias("p0"), F.col("whole").alias("w0"))
        step = step.select(F.col("source").alias("s1"), F.col("used").alias("u1"), F.col("prefix").alias("p1"))
        found = rest.join(step, rest.source.eqNullSafe(step.s1), "left").select(
            "source", "budget", F.coalesce("u1", "u0").alias("used"),
            F.coalesce("p1", F.lit(-1)).cast("long").alias("prefix"), F.col("p1").isNull().alias("whole"),
        )
        found = keep(found, "mix-level")
        was = shift
    forget(rows)
    return found.select("source", F.when(F.col("whole"), F.lit(END)).otherwise(F.col("prefix")).alias("cut"), "used")


def thresholds(rows: DataFrame, rounds: int = ROUNDS, **how) -> DataFrame:
    """Per source: source_size, target, copies (whole passes), and per round the gap and cut."""
    goal = keep(targets(rows, **how), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("copies", copies).withColumn("gap0", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("cut0", F.lit(0).cast("long"))
    for k in range(1, rounds + 1):
        open_ = goal.select(F.col("source").alias("s"), F.col(f"gap{k - 1}").alias("gap"), F.col(f"cut{k - 1}").alias("cut"))
        left = rows.join(open_, rows.source.eqNullSafe(open_.s)).filter("size > 0 and h >= cut and size <= gap").select("source", "size", "h")
        found = _cut(left, goal.select("source", F.col(f"gap{k - 1}").alias("budget")))
        found = found.select(F.col("source").alias("s"), F.col("cut").alias(f"cut{k}"), "used")
        goal = goal.join(found, goal.source.eqNullSafe(found.s)).drop("s").withColumn(f"gap{k}", F.col(f"gap{k - 1}") - F.col("used")).drop("used")
        goal = keep(goal, "mix-round")  # a row per source; else each round's plan would hold all rounds before
    return goal


def times(rounds: int = ROUNDS) -> F.Column:
    """How often a row is taken, from the columns of `thresholds`, its size and its hash."""
    parts = [(F.col("h") >= F.col(f"cut{k - 1}")) & (F.col("size") <= F.col(f"gap{k - 1}")) & (F.col("h") < F.col(f"cut{k}")) for k in range(1, rounds + 1)]
    return F.col("copies") + F.when(reduce(lambda a, b: a | b, parts), 1).otherwise(0)


def _with(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found.withColumnRenamed("source", "of"), rows.source.eqNullSafe(F.col("of"))).drop("of")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one narrow row per document."""
    rows = keep(sized(docs), "mix-rows")
    found = thresholds(rows, **how)
    return _with(rows, found).select("doc_id", "source", "size", "source_size", "target", (times() * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; one without words costs nothing and stays once."""
    rows = keep(sized(docs), "mix-rows")
    found = thresholds(rows, **how)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size.alias("size"), hash60().alias("h"))
    n = F.when(F.col("size") > 0, times()).otherwise(1).cast("int")
    taken = _with(own, found).select("row", n.alias("n")).filter("n > 0")
    every = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return every.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS goal FROM src),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS pos,
    (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / CAST(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
first_open AS (SELECT min(pos) AS pos, min_by(level, pos) AS level FROM levels WHERE cap / w > level),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN CAST(l.cap AS DOUBLE) ELSE f.level * l.w END AS target
  FROM levels l CROSS JOIN first_open f),
g0 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goals),
b0 AS (SELECT *, target - copies * source_size AS gap0, CAST(0 AS BIGINT) AS cut0 FROM g0),
""" + "\n".join(f"""
r{k} AS (
  SELECT d.source, d.h, b.gap{k - 1} AS gap, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS run
  FROM docs d JOIN b{k - 1} b ON d.source IS NOT DISTINCT FROM b.source
  WHERE d.size > 0 AND d.h >= b.cut{k - 1} AND d.size <= b.gap{k - 1}),
b{k} AS (
  SELECT b.*, b.gap{k - 1} - coalesce(u.used, 0) AS gap{k}, coalesce(u.cut, {END}) AS cut{k}
  FROM b{k - 1} b LEFT JOIN (SELECT source, max(CASE WHEN run <= gap THEN run END) AS used, min(CASE WHEN run > gap THEN h END) AS cut FROM r{k} GROUP BY source) u
    ON b.source IS NOT DISTINCT FROM u.source),""" for k in range(1, ROUNDS + 1)) + f"""
taken AS (
  SELECT d.doc_id, d.size, b.source_size, b.target,
    CAST(d.size * (b.copies + CASE WHEN {' OR '.join(f'(d.h >= b.cut{k - 1} AND d.size <= b.gap{k - 1} AND d.h < b.cut{k})' for k in range(1, ROUNDS + 1))} THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM docs d JOIN b{ROUNDS} b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, taken FROM taken
"""
