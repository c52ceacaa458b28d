"""Session helpers: building a session, shared scratch space, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast only tables whose row count was checked against this bound ...
BROADCAST_ROW_LIMIT = 2_000_000
# ... and whose cached size (Spark's statistics of the materialized table) is below this one.
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "wordloom") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller's session is used as is."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WORDLOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names; set a private one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or "cluster" in sc.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Only reached in local runs (tests, bench): nothing on a cluster relies on it.
    local_dir = tempfile.mkdtemp(prefix="wordloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint dir for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/wordloom-scratch/{name}-{uuid.uuid4().hex[:12]}"


def cached_size_bytes(df: DataFrame) -> int | None:
    """Size in bytes Spark's statistics give for ``df``; exact for a cached, materialized frame."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # sessions without JVM access: the row bound alone applies
        return None


def within_broadcast_bounds(cached: DataFrame, n_rows: int, row_limit: int = BROADCAST_ROW_LIMIT,
                            byte_limit: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Row count (already counted) and materialized size both under the broadcast bounds."""
    if n_rows > row_limit:
        return False
    size = cached_size_bytes(cached)
    return size is None or size <= byte_limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT,
                      byte_limit: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast hint behind an explicit row-count and size check; beyond it Spark plans a shuffle join.

    Only used for tables that are small by construction (lexicons, vocabularies,
    bucket tables).  The counted frame is cached, so the count is not
    recomputed and its size is the measured size of the cached columns; beyond a bound it is released.
    """
    cached = df.cache()
    n = cached.count()
    if within_broadcast_bounds(cached, n, limit, byte_limit):
        return F.broadcast(cached)
    cached.unpersist()
    return df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the workers of a single-machine session, wherever it was started.

    On a cluster the package comes with ``--py-files`` or is installed there, as any other.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local") and "cluster" not in sc.master and sc.applicationId not in _SHIPPED:
        sc.addFile(os.path.dirname(os.path.abspath(__file__)), recursive=True)
        _SHIPPED.add(sc.applicationId)


# Tables whose rows carry long texts: tokenizing them is the CPU-heavy part of most plans.
TEXT_TABLES = frozenset({"documents", "conversations", "pages", "benchmark"})


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin the rows over ``factor`` × default parallelism partitions, only when the scan
    gives fewer partitions than the cluster has cores (e.g. a file with one row group).

    On large inputs the scan already has far more partitions than cores and
    nothing is added; on small ones one cheap shuffle lets every core tokenize.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access keep the scan as it is
        return df
    if current >= target:
        return df
    return df.repartition(target * factor)


def session_key(spark: SparkSession) -> tuple:
    """Key of per-session caches (parsed lexicon, fitted state, checkpointed frames)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = spark.conf.get("spark.app.id", "")
    return (id(spark), app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
