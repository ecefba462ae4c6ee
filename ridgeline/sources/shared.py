"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder. Only a local session that names none gets one in the machine's temporary folder."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ridgeline-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """df written once to the shared folder and read back: it cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df) -> None:
    """Deletes the files of a table made by ``stored``."""
    from ridgeline.sources import files

    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        system, path = files.store(at)
        system.delete_dir(path)
