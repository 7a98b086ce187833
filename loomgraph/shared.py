"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back, so a lost executor
costs a re-read and never a recomputation of the whole job.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _LOCAL).rstrip("/")


#: Rows and bytes of the Arrow batches while a table is written, at most: rows can be whole texts, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 2500, 1 << 21
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


#: Up to which size Spark broadcasts a side of a join that has no hint.
_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def shuffled(spark: SparkSession) -> Iterator[None]:
    """What runs inside shuffles its joins; only sides with a hint are broadcast.

    A broadcast side is collected by the driver and kept there until its garbage is, and a loop of small joins has dozens of them.
    """
    before = {key: spark.conf.get(key, None) for key in _BROADCASTS}
    for key in _BROADCASTS:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/loomgraph/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    before = {key: spark.conf.get(key) for key in (_ROWS, _BYTES)}
    rows = int(before[_ROWS])
    spark.conf.set(_ROWS, str(BATCH_ROWS if rows <= 0 else min(BATCH_ROWS, rows)))
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that save() returned and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/loomgraph/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
