"""Session set-up and the one durable cut of lineage used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def build_session(master: str | None = None, cores: int = 8) -> SparkSession:
    """Session for tests, bench and command line; a cluster passes its own instead."""
    builder = (
        SparkSession.builder.appName("matchloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.shuffle.partitions", str(cores))
        )
    return builder.getOrCreate()


def split_hot_keys(spark: SparkSession) -> None:
    """Let adaptive execution cut the join partition of a hot key into several tasks.

    By default Spark keeps such a partition whole when an aggregation on the same key follows, to
    save a shuffle. One document with a third of all variants, or one run with a third of all
    documents, would then be one task. ``build_session`` sets the same; a caller with a session of
    its own calls this once, operators never change settings.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        if "folder" not in _OWN:
            _OWN["folder"] = tempfile.mkdtemp(prefix="matchloom-stages-")
            atexit.register(shutil.rmtree, _OWN["folder"], ignore_errors=True)
        folder = _OWN["folder"]
    return folder.rstrip("/")


def durable(rows: DataFrame) -> DataFrame:
    """Write ``rows`` as a stage table in the shared folder and read them back.

    A lost executor then rereads files instead of recomputing, so values that depend on the
    physical layout (a partition number) stay as they were. The table is deleted when the program ends;
    its size is known to the plans that read it, so small ones are joined without a shuffle.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system; a stopped session leaves it to the folder's owner."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
