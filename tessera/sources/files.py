"""Small files that are replaced whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and renames over it in one step: at any time readers find the old file or the
    new one, also after a crash in between."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = fs.Path(path)
    store = target.getFileSystem(conf)
    target, beside = store.makeQualified(target), store.makeQualified(fs.Path(path + ".tmp"))
    out = store.create(beside, True)
    out.write(text.encode())
    out.close()
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, options)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder of spark.checkpoint.dir; only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
