"""Session helpers: local session for tests and benches, shared scratch folder, size checks."""

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
from pyspark.sql import functions as F

#: Largest side that is broadcast on request: rows and bytes, whichever is reached first.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

_local_scratch: str | None = None
#: Folders of the enclosing ``scratch`` blocks, the innermost last.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def local_session(cores: str | int = "*", app: str = "millrace", memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings the library expects of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, keep: bool = False) -> str:
    """A fresh folder that every executor can reach.

    Inside a ``scratch`` block it is part of what the block removes; ``keep`` puts it outside of the innermost one.

    The cluster names the shared root in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors are one process, may fall back to a folder of its own.
    """
    global _local_scratch
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        return os.path.join(scopes[-1], uuid.uuid4().hex)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        root = _local_scratch
    return os.path.join(root, uuid.uuid4().hex)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` inside goes when the block ends, except for what it keeps.

    Frames that read it must not be used afterwards.
    """
    folder = scratch_folder(spark)
    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield
    finally:
        _scopes.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle go when the job that wrote them ends, not when the driver's memory happens to be tidied.

    For code in which every frame that is used twice is ``written``.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and read it back; see ``scratch_folder`` for ``keep``."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame) -> bool:
    """True if the frame is proven small enough to send to every executor."""
    probe = df.limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b"),
    ).first()
    return probe["n"] <= BROADCAST_ROWS and (probe["b"] or 0) <= BROADCAST_BYTES


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a CPU-heavy step enough tasks when its input is only a few files.

    An input of at least as many files as there are cores, the normal case on a cluster, is
    returned as it is and does not shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, F.col(key))
