"""Session construction, the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on. They are set on the session the caller
# hands in, so a cluster's own sizing (memory, executors) is left alone.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even if the split costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the JVM never compiles methods above 8000 bytes; past that, use split projections
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "casario") -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CASARIO_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # plans here have many small projections: do not look up the call site of each column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="casario-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder, or that of the running job, that no other run uses."""
    return f"{_job_root.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# by thread: a stream's trigger deletes its own tables, not those of work beside it
_job_root: ContextVar[str | None] = ContextVar("job_root", default=None)


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of the work inside lie in one folder, which is deleted at the end.

    Results must be written elsewhere before the end: what is read afterwards would miss its tables.
    """
    root = scratch_path(spark, "job")
    token = _job_root.set(root)
    try:
        yield root
    finally:
        _job_root.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    What follows re-reads files instead of recomputing, also after losing executors, and
    Catalyst knows the true size: a small table is broadcast, a large one is shuffled.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
