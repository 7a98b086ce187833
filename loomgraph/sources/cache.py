"""Parsed records kept between runs, file by file, as Parquet keyed by path and digest."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..shared import save
from .tree import store
from .workspace import PARSED

_KEY = ["package", "rel_path", "digest"]


def digests(listing: DataFrame) -> DataFrame:
    """(root, package, rel_path, digest): the SHA-256 of each file that is parsed; tasks read the files. What cannot be read has the digest of nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for root, rel in zip(batch["root"], batch["rel_path"], strict=True):
                files, top = store(root)
                try:
                    data = files.read(f"{top}/{rel}")
                except OSError:
                    data = b""
                found.append(hashlib.sha256(data).hexdigest())
            yield batch.assign(digest=found)

    rows = listing.filter(F.col("suffix").isin(*PARSED) & ~F.col("is_dir")).select("root", "package", "rel_path")
    return rows.mapInPandas(run, "root string, package string, rel_path string, digest string")


def _stored(like: DataFrame, path: str) -> DataFrame | None:
    try:
        return like.sparkSession.read.parquet(path)
    except AnalysisException as e:  # nothing has been kept yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def changes(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """(package, rel_path, state): kept, changed, new or gone, of the files now against all that a store has ever had.

    keys and kept: (package, rel_path, digest). A file is kept if the store has it with the same digest, changed if with other ones only.
    """
    now = keys.select(*_KEY).withColumn("_now", F.lit(True))
    then = kept.select(*_KEY).distinct().withColumn("_then", F.lit(True))
    both = now.join(then, _KEY, "full").groupBy("package", "rel_path").agg(
        F.bool_or(F.col("_now") & F.col("_then")).alias("same"), F.bool_or("_now").alias("now"), F.bool_or("_then").alias("then")
    )
    state = F.when(F.col("now").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.col("same"), "kept").otherwise("changed")
    return both.select("package", "rel_path", state.alias("state"))


def cached(listing: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, package: str = "package") -> DataFrame:
    """parse(listing), of which the records of files that have not changed are read from path.

    Records have columns file_path and `package`. Files whose package, path and digest the store does not have are parsed and appended, those
    without records too; one changed file parses one file. What a file had with other digests, and files that are gone, stay in the store and
    are not read. Each append is one write and has an id; of files that two runs have parsed the records of one count. path is a folder that
    all executors share.
    """
    keys = save(digests(listing), "digests")
    kept = _stored(keys, path)
    missing = keys if kept is None else keys.join(kept.select(*_KEY).distinct(), _KEY, "left_anti")
    missing = save(missing, "missing")
    fresh = parse(listing.join(missing.select("root", "package", "rel_path"), ["root", "package", "rel_path"], "left_semi"))
    columns = fresh.columns
    found = fresh.select(F.struct(*columns).alias("record"), F.col(package).alias("_package"), F.col("file_path").alias("_path"))
    marked = missing.join(found, (missing["package"] == found["_package"]) & (missing["rel_path"] == found["_path"]), "left")
    marked.select(*_KEY, "record", F.lit(uuid.uuid4().hex).alias("run")).write.mode("append").parquet(path)
    whole = keys.sparkSession.read.parquet(path).join(keys.select(*_KEY), _KEY, "left_semi")
    first = whole.groupBy(*_KEY).agg(F.min("run").alias("run"))
    return whole.join(first, [*_KEY, "run"], "left_semi").filter("record IS NOT NULL").select("record.*")
