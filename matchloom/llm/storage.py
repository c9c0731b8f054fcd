"""Tables between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        if "folder" not in _OWN:
            _OWN["folder"] = tempfile.mkdtemp(prefix="matchloom-tables-")
            atexit.register(shutil.rmtree, _OWN["folder"], ignore_errors=True)
        folder = _OWN["folder"]
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the session's program ends."""
    path = f"{shared_folder(spark)}/matchloom-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system; a stopped session leaves it to the shared folder's owner."""
    with contextlib.suppress(Exception):
        jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def unused_name(rows: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it a name that no column of ``rows`` has in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(rows: DataFrame, *by: str) -> DataFrame:
    """Write ``rows`` once and read them back: lineage ends here, columns stay prunable."""
    spark, schema = rows.sparkSession, rows.schema
    path = new_folder(spark)
    (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def dropped(rows: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing may read it any more."""
    remove(rows.sparkSession, rows.stored_at)
