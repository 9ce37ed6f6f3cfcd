"""Tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; a local folder only where that is unset and all tasks run in this process."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = os.path.join(tempfile.gettempdir(), "tracemill-scratch")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 1.0
_collected = 0.0


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of finished steps: it does so when the driver's references to
    them have been collected, which by itself happens every half hour."""
    global _collected
    if time.monotonic() - _collected > COLLECT_EVERY:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df written once as Parquet and read back: lineage ends here, and a lost executor costs no recomputation.

    row_group, in bytes, keeps what a reader holds at a time small where single values are large.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    collect_garbage(df.sparkSession)  # before the step, when nothing of earlier ones is held any more
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path: another one after any change."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(conf).listStatus(at)
    return hashlib.sha256("".join(sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}\n" for s in found)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files under a result of stored(); nothing may read it afterwards."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession, *names: str) -> None:
    """Deletes stored tables under spark.checkpoint.dir by name, or all that this library has left there; no result that reads them may be used afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent()
    files = top.getFileSystem(conf)
    if files.exists(top):
        for status in files.listStatus(top):
            own = re.fullmatch(r"(.+)-[0-9a-f]{32}", status.getPath().getName())
            if own and (not names or own[1] in names):
                files.delete(status.getPath(), True)
