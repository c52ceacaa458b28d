"""Shared helpers of the training-data operators: table access, registry, lineage cuts, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship

QueryFn = Callable[[SparkSession, str], DataFrame]

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
SMALL_ROWS, SMALL_BYTES = 500_000, 32 * 1024 * 1024

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement where SQL can express it."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is; Spark's readers open the path, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and reread: computed once, lineage cut,
    and no filters or constraints of its old plan carried on."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table stands for the plan, whose shuffle files can go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if _MADE:
        _MADE[-1].append(out)
    return out


# Tables stored on the way to a result, innermost result last.
_MADE: list[list[DataFrame]] = []


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored table of ``make()``; all tables stored on the way to it are deleted."""
    _MADE.append([])
    try:
        out = stored(make(), name)
    finally:
        made = _MADE.pop()
    for table_ in made:
        if table_ is not out:
            discard(table_)
    if _MADE:
        _MADE[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that no plan reads any more."""
    path = df.__dict__.pop("_stored_path", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of ids or the like if it is small by count and size, else none.

    Nothing is kept: ``df`` is a stored table or little more than its scan, which is counted and measured.
    """
    if df.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release_memory() -> None:
    """Gives a worker's freed memory back: workers outlive tasks, and what they hold adds up over the steps of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the package shipped and batches of ``BATCH_ROWS`` rows at most: texts are long."""
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per node.

    ``nodes``: (id); ``edges``: (a, b), undirected, without duplicates that matter.  Returns
    (id, component).  Alternating large-star and small-star rounds on the edge table:
    every round is two shuffles of at most the edges, the hub of a star is a grouping
    key only of thin (id, id) rows combined map-side by ``min``, and lineage is cut by
    storing the table.  Isolated nodes are their own component.
    """
    def state(df: DataFrame) -> tuple:
        """Number and hash of the edges: equal tables have equal states."""
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()
    e = stored(e, "edges")
    now = state(e)
    for _ in range(max_rounds):
        if now[0] == 0:
            break
        # large star: every larger neighbour of u links to the smallest neighbour of u (u included)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour of u, and u, link to the smallest neighbour of u
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        old, e = e, stored(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        discard(old)
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
