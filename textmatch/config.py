"""Engine settings, the local test session, and the scratch area for written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Tunables of the pipeline; defaults follow the documented parameter table."""

    # corpus preparation
    max_person_id: int | None = None
    title_repeat: int = 3
    title_sep: str = ""
    # term statistics
    max_features: int = 10_000
    min_df: int = 5
    max_df: float = 0.85
    # boosting
    boost_terms: int = 20
    boost_sep: str = ""
    # chunking, in tokens of four characters
    chunk_size: int = 512
    chunk_overlap: int = 50
    # embedding
    dim: int = 1024
    encode_batch: int = 32
    # matching
    top_n: int = 5
    overfetch: int = 3
    # evaluation
    k_values: tuple[int, ...] = (3, 5, 10)
    relevance_threshold: float = 1.0
    thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0)


def local_session(cpus: int = 8, app: str = "textmatch", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the folder named by ``spark.checkpoint.dir``.

    The setting must name storage every executor reaches. Only in a local session (tests,
    the bench) may it be unset: then a folder is made once per application. Any other session
    without it is refused before a job starts. What was written is removed when the program
    ends.
    """
    context = spark.sparkContext
    folder = getattr(context, "_textmatch_scratch", None)
    if folder is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            folder = f"{base.rstrip('/')}/textmatch-{context.applicationId}"
        elif context.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="textmatch-")
        else:
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        context._textmatch_scratch = folder
        atexit.register(_remove, context, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(context, folder: str) -> None:
    """Delete the application's scratch folder; a JVM that has ended already leaves it."""
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        conf = context._jvm.org.apache.hadoop.conf.Configuration()
        path.getFileSystem(conf).delete(path, True)
    except Exception as e:
        print(f"scratch folder {folder} was not removed: {e}", file=sys.stderr)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    Used where a result feeds several later jobs; unlike a cache it outlives executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a table that is written shuffles is removed when it is done. Otherwise it stays on disk until
    the driver happens to collect its garbage, so jobs that follow one another would add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_package(spark: SparkSession | None = None) -> None:
    """Give the Python workers this package, once per application.

    The same as starting with ``--py-files``; harmless where it is installed. Operators
    that run Python in tasks call it.
    """
    context = (spark or SparkSession.active()).sparkContext
    if getattr(context, "_textmatch_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():
        folder = tempfile.mkdtemp(prefix="textmatch-pkg-")
        archive = shutil.make_archive(
            os.path.join(folder, package.name), "zip", package.parent, package.name
        )
        context.addPyFile(archive)
    context._textmatch_shipped = True


# Bytes of an Arrow batch. A task may feed several Python workers, one behind the other.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of at most ``BATCH_BYTES``; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small input before expensive per-row work.

    A scan that already has a few splits per core, as any large input does, is left as it
    is. Call it on a scan, not on a shuffled plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, key)
