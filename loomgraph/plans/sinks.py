"""Ordered text at any size: tasks write the parts of a document, and the parts in the order of their names are the document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def _fixed(like: DataFrame, lines: Sequence[str]) -> DataFrame:
    return like.sparkSession.createDataFrame([(k, line) for k, line in enumerate(lines)], "_at bigint, line string")


def write_document(bodies: Sequence[tuple[DataFrame, Sequence[str]]], path: str, header: Sequence[str] = (), footer: Sequence[str] = (), parts: int | None = None) -> None:
    """Writes a header, each body (a table with a column line, and the columns to order it by) and a footer as text below path.

    Every body is range-partitioned by its order, so each task sorts and writes one stretch of it, and nothing passes through the driver.
    Header and footer are parts of their own: part files are named 0-..., 1-..., as folders, and read in the order of names they are the
    document. Lines with line breaks stay as they are.
    """
    spark = bodies[0][0].sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = [(_fixed(bodies[0][0], header), ["_at"], 1), *((body, list(order), parts) for body, order in bodies), (_fixed(bodies[0][0], footer), ["_at"], 1)]
    width = len(str(len(pieces)))
    for k, (rows, order, many) in enumerate(pieces):
        dealt = rows.repartitionByRange(many, *(F.col(c) for c in order)).sortWithinPartitions(*order)
        dealt.select("line").write.mode("overwrite").text(f"{path.rstrip('/')}/{k:0{width}d}")


def read_document(spark, path: str) -> list[str]:
    """The lines of a document of a size that a person reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = sorted(s.getPath().toString() for folder in files.listStatus(root) for s in files.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-"))
    return [r["value"] for name in named for r in spark.read.text(name).toLocalIterator()]


def default_cache(spark, root: str) -> str:
    """Where the records of a workspace are kept: below the shared folder, by the path of the workspace."""
    import hashlib

    return f"{shared_dir(spark)}/loomgraph/records/{hashlib.sha256(root.encode()).hexdigest()[:16]}"
