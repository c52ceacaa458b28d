"""Merkle manifest of a dataset by a nested-struct rollup, with a proof for every row.

Every row is a leaf; the leaves of a tree (one per value of ``tree``) stand in the order of their id, and every
``FAN`` consecutive nodes become the digest of their digests until one is left, the tree's root.  The roots of all
trees, in the order of their keys, become one root in the same way.

1. One pass over the rows makes the leaf and, where a row is to be checked in another state, that state's leaf.
   Only (tree, id, leaf, altered leaf) goes on; texts are never shuffled.
2. The rank of a leaf in its tree comes from a range partitioning: the position in the sorted partition plus the
   rows of its tree in the partitions before, a table of at most partitions + trees rows.
3. The rank's digits to the base ``FAN`` name the nodes above a leaf.  The lowest ``DIGITS`` digits stay in one block of
   ``FAN ** DIGITS`` leaves: rows are grouped by block and digits, then by block and one digit fewer, and so on, one
   shuffle in all, each group's digest standing over the array of the structs it was made from.  A block is a row.
   The blocks' own digests are the leaves of the next rollup, until a tree has one block.
4. On the way down each block is opened level by level: a transform gives every child the digests on its left and
   right, an explode makes it a row.  Paths meet the blocks below in a grouping by block, so proofs take no join.

A group never holds more than ``FAN`` nodes, a row never more than one block, so neither a tree that holds a third of
all rows nor a repeated id grows a task.

Defined results: a null field is written ``-``; a null tree is a tree of its own, the first one; a null id is the first
of its tree; rows with equal ids go by their leaves, and equal rows have equal leaves and places of their own;
a table without rows has no rows.  Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored

BITS = 3
FAN = 1 << BITS  # nodes of a run
DIGITS = 3  # levels of a block: 512 leaves
STEP = "struct<l:string,r:string>"  # digests left and right of a node in its run


def digest(content: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(content.cast("binary"), 256)


def encoded(field: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value; ``-`` if null."""
    value = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, fields)))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``nodes`` (with a column ``tree``) with ``rank``, from 0 in each tree by ``order``, and ``size`` of the tree."""
    placed = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # the id's high bits are the partition, its low ones the row's place in it
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33)), "merkle-placed")
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                                F.sum("rows").over(whole).alias("size")), "merkle-parts")
    return placed.join(small_side(parts), ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop(
        "at", "part", "shift")


def _levels(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return sum((F.when(size > FAN ** k, 1).otherwise(0) for k in range(21)), F.lit(0))


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, rank, levels, h, kids): a row per block of ``nodes`` (tree, rank, levels, h, carried)."""
    def digit(k: int) -> Column:
        return F.shiftright("rank", BITS * k).bitwiseAND(FAN - 1).cast("int").alias(f"d{k}")

    rows = nodes.select("tree", F.shiftright("rank", BITS * DIGITS).alias("block"), "levels", *map(digit, range(DIGITS)),
                        F.col("h"), *carried)
    # the block is the outermost key of every grouping: one exchange serves them all
    rows = rows.repartition("tree", "block")
    inner = carried
    for k in range(DIGITS):
        keys = ["tree", "block", "levels", *(f"d{j}" for j in range(k + 1, DIGITS))]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "h", *inner)))
        rows = rows.groupBy(*keys).agg(kids.alias("kids"))
        run = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        # a tree that is one node already goes up as it is
        rows = rows.withColumn("h", F.when(F.col("levels") > k, digest(run)).otherwise(F.col("kids")[0]["h"]))
        inner = ["kids"]
    return rows.select("tree", F.col("block").alias("rank"), (F.greatest(F.col("levels") - DIGITS, F.lit(0))).alias("levels"),
                       "h", "kids", F.col("levels").alias("own_levels"))


def _step(kid: Column, taken: Column) -> Column:
    """One step of a child's path; none where the tree has no such level."""
    def side(test: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter(F.col("x.kids"), test), lambda s: s["h"]), "")

    step = F.struct(side(lambda s: s["d"] < kid["d"]).alias("l"), side(lambda s: s["d"] > kid["d"]).alias("r"))
    return F.when(taken, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>"))


def _opened(blocks: DataFrame, carried: list[str], path: str) -> DataFrame:
    """(tree, rank, h, carried, path): the nodes that blocks with ``path`` (an array of steps) were made from."""
    kept = [c for c in blocks.columns if c not in ("kids", "rank", "h", path, "own_levels")]
    rows = blocks.withColumn("x", F.struct("kids")).select(*kept, "own_levels", "rank", path, "x")
    for k in reversed(range(DIGITS)):
        above = F.col("own_levels") > k
        rows = rows.select(*kept, "own_levels", "rank", path, F.explode(
            F.transform("x.kids", lambda kid: F.struct(kid.alias("x"), _step(kid, above).alias("step")))).alias("e"))
        rows = rows.select(*kept, "own_levels", (F.col("rank") * FAN + F.col("e.x.d")).alias("rank"),
                           F.concat("e.step", path).alias(path), F.col("e.x").alias("x"))
    return rows.select(*kept, "rank", F.col("x.h").alias("h"), *(F.col(f"x.{c}").alias(c) for c in carried), path)


def _met(blocks: DataFrame, paths: DataFrame, carried: list[str]) -> DataFrame:
    """``blocks`` with what ``paths`` (tree, rank, carried) has for them, in one grouping."""
    names = ["levels", "own_levels", "h", "kids"]
    types = {f.name: f.dataType for f in [*blocks.schema, *paths.schema]}
    both = blocks.select("tree", "rank", *names, *(F.lit(None).cast(types[c]).alias(c) for c in carried)).unionByName(
        paths.select("tree", "rank", *(F.lit(None).cast(types[c]).alias(c) for c in names), *carried))
    return both.groupBy("tree", "rank").agg(*(F.first(c, ignorenulls=True).alias(c) for c in [*names, *carried]))


def _forest(nodes: DataFrame, order: list[str], carried: list[str]) -> list[DataFrame]:
    """Stored block tables of all trees, from the leaves up; the last has one block per tree."""
    placed = ranked(nodes, order).withColumn("levels", _levels(F.col("size"))).drop("size")
    tables, extra = [], carried
    while True:
        tables.append(stored(_blocks(placed, extra), "merkle-blocks"))
        placed, extra = tables[-1].select("tree", "rank", "levels", "h"), []
        if placed.where("rank > 0").isEmpty():
            return tables


def _descended(tables: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves of a forest with their paths; ``top``: (tree, rank, path, …) of each tree's highest block."""
    brought = [c for c in top.columns if c not in ("tree", "rank")]
    for i, table in reversed(list(enumerate(tables))):
        nodes = _opened(_met(table, top, brought), carried if i == 0 else [], "path")
        top = nodes if i == 0 else nodes.select("tree", "rank", *brought)
    return top


def merkle_manifest(rows: DataFrame, fields: list[str], id_col: str = "doc_id", tree: str = "lang",
                    altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id, tree, leaf, other_leaf, subroot, root, path) per row of ``rows``.

    ``path``: array of (l, r), the digests left and right of the row's node in each run up to the root.
    ``other_leaf``: the leaf with the fields ``altered`` where ``when`` holds, null elsewhere.
    """
    columns = [F.col(c) for c in fields]
    changed = [(altered or {}).get(c, F.col(c)) for c in fields]
    other = F.when(F.lit(False) if when is None else when, leaf_of(changed))
    # a null tree sorts before every other, and keys compare by their UTF-8 bytes
    key = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = stored(rows.select(key.alias("tree"), F.col(id_col).alias("id"), leaf_of(columns).alias("h"),
                                other.alias("other")), "merkle-leaves")
    tables = _forest(leaves, ["id", "h"], ["id", "other"])
    subroots = stored(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "h"), "merkle-subroots")
    above = _forest(subroots, ["key"], ["key"])
    empty = F.array().cast(f"array<{STEP}>")
    top = _descended(above, above[-1].select("tree", "rank", F.col("h").alias("root"), empty.alias("path")), ["key"])
    top = top.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("rank"), F.col("h").alias("subroot"), "root",
                     "path")
    out = _descended(tables, top, ["id", "other"])
    return out.select(F.col("id").alias(id_col), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(tree),
                      F.col("h").alias("leaf"), F.col("other").alias("other_leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))
