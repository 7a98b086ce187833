"""The corpus pipeline: from raw documents to a mixture.

STAGES are (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame
that run() writes as Parquet in the shared folder and reads back as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import op2_pii, op4_quality, op8_decontamination, op9_jaccard_join, op10_mixing, scratch
from loomgraph.llm.idfilter import anti_join, semi_join


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (f"{name}{k or ''}" for k in range(len(taken) + 1)) if x not in taken)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts are scored as texts without words; repeated rows are scored alike; rows without a doc_id are
    scored too and never learned from.
    """
    return op4_quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _told(docs: DataFrame, row: Column, key: str, best: str) -> DataFrame:
    """(key, rows, best) of the rows in groups of several: how many equal ones there are, and the one of the group that stays."""
    placed = op9_jaccard_join.jaccard_components(docs.select(row.alias("doc_id"), "text")).filter("n_shingles > 0")
    rows = scratch.save(placed.groupBy(F.col("doc_id").alias(key), "component_id").agg(F.count("*").alias("rows")), "rows")
    crowds = rows.groupBy("component_id").agg(F.sum("rows").alias("all")).filter("all > 1").select("component_id")
    grouped = scratch.save(rows.join(crowds, "component_id", "left_semi"), "grouped")
    names = semi_join(docs.select(row.alias(key), "doc_id"), grouped, key).distinct()
    named = scratch.save(grouped.join(names, key), "named")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key).alias("row")))["row"]
    return scratch.save(named.join(named.groupBy("component_id").agg(first.alias(best)), "component_id").select(key, "rows", best), "told")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link, one row stays: that of the smallest doc_id, null the largest.

    Rows are told apart by doc_id and text, so a clean text stays whatever its doc_id is. Of rows that are equal in both
    one stays, the least by its other columns; of different texts with one doc_id in a group, one stays. Documents
    without words are in no group, and all of them stay.
    """
    key, best = _unused(docs, "_row"), "best"
    row = F.xxhash64(F.lit(9), "doc_id", "text")
    keyed = docs.withColumn(key, row)
    with scratch.shuffled(spark):
        told = _told(docs, row, key, best)
    left = anti_join(keyed, scratch.save(told.filter(F.col(key) != F.col(best)).select(key), "gone"), key)
    repeated = scratch.save(told.filter((F.col(key) == F.col(best)) & (F.col("rows") > 1)).select(key), "repeated")
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = semi_join(left, repeated, key).groupBy(key).agg(F.min(F.struct(*own)).alias(best)).select(*(F.col(best)[c].alias(c) for c in docs.columns))
    return anti_join(left, repeated, key).select(*own).unionAll(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, whatever their doc_id is; rows of equal texts go or stay together.

    Null and empty texts contain nothing and stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = _unused(docs, "_said")
    said = F.xxhash64(F.lit(8), "text")
    found = op8_decontamination.contained_items(docs.select(said.alias("doc_id"), "text"), items)
    hit = scratch.save(found.select(F.col("doc_id").alias(key)).distinct(), "hit")
    return anti_join(docs.withColumn(key, said), hit, key).select(*(F.col(f"`{c}`") for c in docs.columns))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, row by row; null texts stay null, and nothing goes."""
    return op2_pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, source_size, target, copies (0: not in the mix) and taken.

    Null and empty texts have size 0 and take nothing; a null source is a source; repeated rows count each.
    """
    own = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    return op10_mixing.mix(docs, keep=own)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("mixture", mixture),
]

#: The stages learn, hash and round; SQL has no twin of that. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
