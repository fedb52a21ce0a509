"""Merkle manifest of a dataset by sibling-shift self-joins, in DataFrame functions alone.

Every row is a leaf: the sha256 of its fields. The leaves of a tree (one a language) stand in the order of their ids, and
`FAN` consecutive nodes make a run, whose digests together give the node above. At each level the nodes meet themselves:
the first node of each run (slot zero) computes the indices of its siblings, an equijoin on (tree, index) brings their
digests, and the slot-zero row emits the parent. The trees' roots are the leaves of one last tree.

Going down again, a run meets the run that holds its parent, and so gets the digests beside its way to the root: the proof
of its leaves. Sums, joins and groups are keyed by (tree, index), so that a tree of any size is spread over all tasks; only the
number of levels, one number, comes to the driver. A leaf's index is its place in its task of a range partitioning plus
the sizes of the tasks before, of which there is a row for each tree and task.

Defined results: a null field counts as `-`; rows without an id come first; rows that share an id stand in the order of
their leaves, and equal rows, all with leaves of their own, in any order, which gives the same digests; a null tree key is
a tree of its own, the first; a tree of one leaf has that leaf as its root; an empty table gives no rows; other columns
are ignored. A row without an id is never tampered with in the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, keep

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value so that no two lists of fields read alike: `-` for null, else its UTF-8 bytes' count, a colon, itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields, binary."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def tree_key(value: Column) -> Column:
    """A string for each value, null among them, in the order of the values' UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `at`, each row's index in its tree by the columns of `order`, from 0, and `n`, the tree's rows.

    Equal rows are told apart by their place in the written input, so that even they are dealt to many tasks.
    """
    rows = keep(rows, "merkle-rows").withColumn("_copy", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("tree", *order, "_copy").sortWithinPartitions("tree", *order, "_copy").drop("_copy")
    own = keep(ordered.withColumn("_place", F.monotonically_increasing_id()), "merkle-places").withColumn("_task", F.shiftright("_place", 33))
    tasks = own.groupBy("tree", "_task").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy("tree")
    before = F.sum("_rows").over(every.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = keep(tasks.select("tree", "_task", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(every).alias("n")), "merkle-tasks")
    at = F.col("_place") - F.col("_first") + F.col("_before")
    found = keep(own.join(tasks, ["tree", "_task"]).select(*rows.drop("_copy").columns, at.alias("at"), "n"), "merkle-leaves")
    forget(rows, own, tasks)
    return found


def runs(nodes: DataFrame) -> DataFrame:
    """tree, run, n and the run's digests in order, of all trees with more than one node at this level.

    nodes: tree, at, n (the tree's nodes at this level), digest.
    """
    live = nodes.filter("n > 1")
    last = F.least(F.col("at") + (FAN - 1), F.col("n") - 1)
    first = live.filter(F.col("at") % FAN == 0).select("tree", "n", F.col("at").alias("first"), F.explode(F.sequence("at", last)).alias("at"))
    met = first.join(live.select("tree", "at", "digest"), ["tree", "at"])
    digests = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
    return met.groupBy("tree", (F.col("first") / FAN).cast("long").alias("run"), "n").agg(digests.alias("digests"))


def parents(level: DataFrame) -> DataFrame:
    """The nodes above the runs of a level."""
    digest = F.unhex(F.sha2(F.array_join(F.transform("digests", hexed), ""), 256))
    return level.select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest.alias("digest"))


def forest(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, from the leaves up, and the trees' roots (tree, digest)."""
    nodes = leaves.select("tree", "at", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.filter("n = 1").select("tree", "digest")
    while most > 1:
        levels.append(keep(runs(nodes), "merkle-runs"))
        nodes = parents(levels[-1])
        roots = roots.union(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // FAN)
    return levels, keep(roots, "merkle-roots")


def _step(digests: str, slot: Column) -> Column:
    """The digests before and behind a slot of a run."""
    joined = F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))
    size = 32
    left = F.substring(joined, F.lit(1), (slot * size).cast("int"))
    right = F.substring(joined, ((slot + 1) * size + 1).cast("int"), F.lit(FAN * size))
    return F.struct(left.alias("left"), right.alias("right"))


def with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Adds `path` to leaves: the digests (left, right) beside each node on the way up, from the leaf's own run on.

    tops: tree, path (what follows above the tree's root).
    """
    above = None
    for level in reversed(levels):
        # a tree's last run hangs from its root; every other run from the run that holds its parent
        own = level.filter(F.col("n") <= FAN).select("tree", "run", "digests").join(tops, "tree")
        if above is not None:
            up = above.select("tree", F.col("run").alias("_up"), F.col("digests").alias("_digests"), F.col("path").alias("_path"))
            lower = level.filter(F.col("n") > FAN).select("tree", "run", "digests", F.floor(F.col("run") / FAN).alias("_up")).join(up, ["tree", "_up"])
            own = own.union(lower.select("tree", "run", "digests", F.concat(F.array(_step("_digests", F.col("run") % FAN)), F.col("_path")).alias("path")))
        made = keep(own, "merkle-paths")
        if above is not None:
            forget(above)
        above = made
    alone = leaves.filter("n = 1").join(tops, "tree")
    if above is None:
        return alone
    known = above.select("tree", F.col("run").alias("_run"), "digests", F.col("path").alias("_path"))
    many = leaves.filter("n > 1").withColumn("_run", F.floor(F.col("at") / FAN)).join(known, ["tree", "_run"])
    many = many.withColumn("path", F.concat(F.array(_step("digests", F.col("at") % FAN)), F.col("_path")))
    return alone.unionByName(many.select(alone.columns))


def folded(start: Column, path: str = "path") -> Column:
    """The root, in hexadecimal, that a leaf (binary) and its path lead to."""
    return F.aggregate(path, hexed(start), lambda a, s: F.sha2(F.concat(hexed(s["left"]), a, hexed(s["right"])), 256))


def proof_digest(path: str = "path") -> Column:
    """The sha256 of all siblings on a path, from the leaf's run to the root, each left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)


def manifest(docs: DataFrame, tree: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, more: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: `order`, tree, leaf, at, n, subroot, root (binary), path and the columns `more`."""
    more = more or {}
    own = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order).alias("order"), leaf(*map(F.col, fields)).alias("digest"), *[c.alias(f"more_{k}") for k, c in more.items()])
    leaves = placed(own, ["order", "digest"])
    levels, subroots = forest(leaves)
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"])
    top_levels, roots = forest(tops)
    top = with_paths(tops, top_levels, roots.select("tree", F.array().cast(_PATH).alias("path"))).join(roots.select("tree", F.col("digest").alias("root")), "tree")
    top = keep(top.select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    found = with_paths(leaves, levels, top.select("tree", "path")).join(top.select("tree", "subroot", "root"), "tree")
    return found.select(F.col("order").alias(order), "tree", F.col("digest").alias("leaf"), "at", "n", "subroot", "root", "path", *[F.col(f"more_{k}").alias(k) for k in more])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = leaf(*[F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    made = manifest(docs, more={"other": F.when(picked, tampered)})
    made = made.select("*", folded(F.coalesce("other", "leaf")).alias("folded_root"))
    return made.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof_digest().alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == hexed(F.col("root"))).alias("verified"),
    )


def _text(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR) END"


def _levels(name: str, source: str) -> str:
    """nodes (level, tree, idx, n, digest) of all levels of the trees over `source` (tree, idx, n, digest)."""
    return f"""
{name} AS (
  SELECT 0 AS level, tree, idx, n, digest FROM {source}
  UNION ALL
  SELECT any_value(level) + 1, tree, idx // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, idx // {FAN}),
{name}_sides AS (
  SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.tree = b.tree AND a.idx // {FAN} = b.idx // {FAN} WHERE a.n > 1 GROUP BY a.level, a.tree, a.idx)"""


_CRC = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"

SQL = f"""
WITH RECURSIVE
docs AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, sha256({" || ".join(_text(c) for c in FIELDS)}) AS digest,
    coalesce(xor({_CRC}, 4294967295) % 3 = 0, FALSE) AS picked,
    sha256({" || ".join(_text(c) if c != "text" else _text(f"translate(text, '{UPPER}', '{LOWER}')") for c in FIELDS)}) AS other
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_levels("nodes", "leaves")},
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
tops AS (SELECT '' AS tree, tree AS own, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n, digest FROM subroots),
{_levels("top_nodes", "tops")},
steps AS (
  SELECT 0 AS part, level, tree, idx, l, r FROM nodes_sides
  UNION ALL SELECT 1, level, tree, idx, l, r FROM top_nodes_sides),
walk AS (
  SELECT l.tree, l.idx AS leaf_idx, 0 AS part, 0 AS level, l.tree AS now, l.idx, CASE WHEN picked THEN other ELSE digest END AS folded, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.tree, w.leaf_idx,
    CASE WHEN s.idx IS NULL AND w.part = 0 THEN 1 ELSE w.part END, CASE WHEN s.idx IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN s.idx IS NULL THEN '' ELSE w.now END, CASE WHEN s.idx IS NULL THEN t.idx ELSE w.idx // {FAN} END,
    CASE WHEN s.idx IS NULL THEN w.folded ELSE sha256(s.l || w.folded || s.r) END, CASE WHEN s.idx IS NULL THEN w.proof ELSE w.proof || s.l || s.r END
  FROM walk w LEFT JOIN steps s ON s.part = w.part AND s.level = w.level AND s.tree = w.now AND s.idx = w.idx LEFT JOIN tops t ON t.own = w.tree
  WHERE NOT (w.part = 1 AND s.idx IS NULL)),
ends AS (
  SELECT tree, leaf_idx, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM walk WHERE part = 1 GROUP BY tree, leaf_idx),
root AS (SELECT digest FROM top_nodes WHERE n = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, root.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN ends e ON e.tree = l.tree AND e.leaf_idx = l.idx, root
"""
