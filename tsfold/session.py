"""Session helpers: building a local session for tests and resolving the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. AQE re-plans joins and coalesces
# shuffle partitions at run time; skew join splits hot partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tsfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove checkpoint files once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and is used as is. Only when it is unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tsfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# folders written by ``stored`` in the ``scratch_released`` blocks that a thread is in
_open = threading.local()

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch_released(spark: SparkSession) -> Iterator[None]:
    """For work whose result is written out before the block ends: the folders that ``stored`` made inside are removed
    then, and shuffle files as soon as the job that wrote them ends, so that a run of many such steps holds the
    intermediate rows of one step only."""
    before, conf = getattr(_open, "paths", None), spark.conf.get(SHUFFLE_CLEANUP, None)
    _open.paths = []
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, before
        spark.conf.unset(SHUFFLE_CLEANUP) if conf is None else spark.conf.set(SHUFFLE_CLEANUP, conf)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this run."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str = "stored", made: list[str] | None = None) -> DataFrame:
    """``df`` computed once and read back from Parquet under the shared checkpoint dir: cut from its lineage as by
    ``checkpoint``, but packed (checkpoint files hold rows as they lie in memory) and read by columns. The folder's path
    is added to ``made``."""
    path = scratch_path(df.sparkSession, name)
    if made is not None:
        made.append(path)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
