"""What the operators share: the cluster's shared folder and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Spark's own sizes of an Arrow batch, and ours: texts lie in them, in the JVM and in its Python workers at once.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4MB"),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see.

    Only where the setting is absent (tests on a local master) a folder of this process is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns it read back: a cut of the lineage
    that survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many work tables this process has written and not deleted: a mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes the work tables written since a mark, but for the last one if it is still needed; call it
    when the results that read them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = [_WRITTEN.pop()] if keep_last and len(_WRITTEN) > since else []
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN.extend(kept)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of whole texts stay small, for the rest of the session (Spark reads the settings when a
    query runs, not when it is planned). A size that the user has chosen stays."""
    for key, (default, ours) in _BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
