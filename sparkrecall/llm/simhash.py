"""SimHash near-dedup: segment popcounts as an embedding, a grid range join under Manhattan distance, exact check.

A 64-bit fingerprint is cut into 32 segments of two bits; the number of ones of each segment is a point in 32
dimensions. Changing one bit moves one coordinate by one, so the Manhattan distance of two points is at most the
Hamming distance of their fingerprints. Points within distance 2 differ in at most two of five blocks of
coordinates, so they share a grid cell in one of the ten choices of three blocks. The join runs on equal cells,
keeps pairs whose Manhattan distance is at most 2, and then those whose fingerprints differ in at most 2 bits.

Counts 0, 1, 2 are kept in unary (00, 01, 11), which packs a point into one long: the Manhattan distance is then
the number of differing bits of two packed points.

Only distinct fingerprints are joined, so exact copies cost one row. Those with a cell of over `CELL_MOST` of them go
through finer grids (six of eight blocks, then fourteen of sixteen), whose cells are smaller by the same argument; only
points that crowd even the finest cells, which differ in at most four coordinates, are linked another exact way:
fingerprints within two bits share a fingerprint that is at most one bit from either, and each fingerprint has 65 such
neighbours, so the rows grow with the cell and not with its square.

Defined results: a text without words (empty, blank, null) has fingerprint zero and links like any other; a null
doc_id has a row, and is a component's id only where no other id is in it (then null); repeated rows have one row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, keep, slices, texts
from .components import connected_components
from .tokens import release

SEED, SHINGLE, BITS = 42, 3, 2
#: Distinct fingerprints of a cell that are joined pair by pair.
CELL_MOST = 64
_HALF = 0x5555555555555555
_BIT_OF_BYTE = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def fingerprint(text: str) -> int:
    """SimHash of a whole text as an unsigned 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return hash_of(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(starts))
    each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """doc_id, fp: the fingerprint of each whole text as a signed long with the same bits; and `key`, where one is given."""
    rows = texts(docs)
    more = [] if key is None else ["key"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1):
                own = np.array([fingerprint(t.as_py()) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), *part.columns[2:]], names=["doc_id", "fp", *more])

    rows = rows if key is None else rows.withColumn("key", key)
    return rows.mapInArrow(make, "doc_id long, fp long" + ", key string" * len(more))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: str = "fp") -> F.Column:
    """Ones of each two-bit segment in unary, packed into a long."""
    low = F.expr(f"({fp} | shiftrightunsigned({fp}, 1)) & {_HALF}L")
    high = F.expr(f"shiftleft(({fp} & shiftrightunsigned({fp}, 1)) & {_HALF}L, 1)")
    return low.bitwiseOR(high)


def _cells(blocks: int) -> list[int]:
    """Masks of the grids that leave out two of `blocks` blocks of segments each."""
    ends = [round(k * 32 / blocks) for k in range(blocks + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(ends, ends[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(masks, blocks - 2)]


def _grid_links(fps: DataFrame, blocks: int, cell_most: int) -> tuple[DataFrame, DataFrame]:
    """(links within cells, the fingerprints that have a cell of more than cell_most)."""
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(_cells(blocks))])).alias("c")
    cells = fps.select("fp", embedding().alias("at")).select("fp", "at", grid).select("fp", "at", "c.grid", "c.cell")
    # a table of its own, so that the join has plain exchanges on either side and a hot cell can be split
    sizes = keep(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell-sizes")
    shared = keep(cells.join(sizes, ["grid", "cell"]), "cells")
    light = shared.filter(F.col("n") <= cell_most)
    x, y = light.select("grid", "cell", F.col("fp").alias("a"), F.col("at").alias("p")), light.select("grid", "cell", F.col("fp").alias("b"), F.col("at").alias("q"))
    near = (F.col("x.grid") == F.col("y.grid")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("a") < F.col("b"))
    near &= (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    pairs = x.alias("x").join(y.alias("y"), near).select("a", "b")
    pairs, crowded = keep(pairs, "near"), keep(shared.filter(F.col("n") > cell_most).select("fp").distinct(), "crowded")
    forget(sizes, shared)
    return pairs, crowded


#: Blocks of segments of the grids, one after the other for what is crowded in the one before.
GRIDS = (5, 8, 16)


def links(fps: DataFrame, cell_most: int = CELL_MOST, grids: tuple[int, ...] = GRIDS) -> DataFrame:
    """(a, b): links among distinct fingerprints that join everything within two bits, directly or by steps of such."""
    out, crowded = None, fps
    for blocks in grids:
        pairs, crowded = _grid_links(crowded, blocks, cell_most)
        out = pairs if out is None else out.union(pairs)
        if crowded.isEmpty():
            return out.distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("near"))
    heads = keep(around.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1"), "neighbours")
    stars = around.join(heads, "near").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return out.union(stars).distinct()


def _classes(own: DataFrame, cell_most: int = CELL_MOST) -> DataFrame:
    """fp, root, component_id, in one row per fingerprint; own: doc_id, fp."""
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct, cell_most)).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    # a table of its own, so that the join has plain exchanges on either side and a hot fingerprint can be split
    return keep(joined.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, cell_most: int = CELL_MOST) -> DataFrame:
    """doc_id, fp, component_id, in one row per document."""
    own = keep(fingerprints(docs), "simhash")
    return own.join(_classes(own, cell_most), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs per component: that of its smallest doc_id, and of different texts with that id one of the component.

    A row without a doc_id stands for its component only where no row of it has one. Rows of one id with unlike texts
    count one by one: each belongs to the component of its own text.
    """
    own = keep(fingerprints(docs, F.md5("text")), "simhash")
    classes = _classes(own.select("doc_id", "fp"))
    # the text tells apart rows of one id that belong to different groups
    heads = own.join(classes, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("root").agg(F.min("doc_id").alias("id"), F.min("key").alias("key"))
    heads = keep(heads.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "key"), "heads")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    kept = rows.join(heads, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
