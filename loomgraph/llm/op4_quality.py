"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every whole text are computed in Arrow batches. On a bounded sample of labelled
rows (MOST_LABELLED, drawn by a hash of the id) boosted trees are grown; every path from a root to
a node becomes a conjunctive rule over the statistics; a lasso logistic regression gives the
rules weights, most of them zero; and the rest are compiled into one Spark column expression.
Only statistics of the text are inputs of a score.

Defined results: null and empty texts have statistics of 0 and are scored like others; labels of
null or unknown documents are not used; repeated rows are scored each; without labels, or with one class
only, every score is the smoothed share of good labels; an empty table gives an empty table; extra columns,
whatever their names, pass through good_documents() and are ignored otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .idfilter import semi_join
from .shingles import text_slices, words

STATISTICS = (
    "log_words", "word_chars", "upper", "digits", "symbols", "shouts", "bars", "stops", "repeats", "distinct", "line_words", "wide", "top",
)
THRESHOLD = 0.7
#: Labelled rows that the model is fitted on, at most about so many; a parameter of fit_quality().
MOST_LABELLED = 20_000
TREES, DEPTH = 16, 3
LASSO = 0.001
HELD_OUT = 2

_CLASSES = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\=+_", b"!?", b"|\t", b".,;:"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 7


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    word, first, end, spans = words(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 8 + _CLASSES[data], minlength=8 * n).reshape(n, 8) if len(data) else np.zeros((n, 8), np.int64)
    solid = np.bincount(np.repeat(np.arange(n), np.diff(spans)), end - first, n) if len(word) else np.zeros(n)
    many = np.diff(spans)
    lines = np.bincount(owner, data == 10, n) + 1 if len(data) else np.ones(n)
    base = np.maximum(solid, 1)
    out[:, 0] = np.log1p(many)
    out[:, 1] = solid / np.maximum(many, 1)
    for k in range(1, 7):
        out[:, 1 + k] = counts[:, k] / base
    out[:, 10] = many / lines
    out[:, 11] = counts[:, 7] / base
    same = np.zeros(len(word), dtype=np.int64)
    same[1:] = word[1:] == word[:-1]
    for i in range(n):
        a, b = spans[i], spans[i + 1]
        if b > a:
            values, times = np.unique(word[a:b], return_counts=True)
            out[i, 8] = same[a + 1 : b].sum() / (b - a)
            out[i, 9] = len(values) / (b - a)
            out[i, 12] = times.max() / (b - a)
    return out


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column("text"))]
        values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], ["row", *STATISTICS])


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row, the columns as one struct, whatever their names, and a column for each of STATISTICS of the row's text.

    Statistics are columns of their own, so that the code compiled for a few hundred conditions on them stays small.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    wide = docs.select(row, F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("row", wide.schema["row"].dataType), *(T.StructField(name, T.DoubleType()) for name in STATISTICS)])
    return wide.mapInArrow(_append, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, upper side?, bound) with its weight."""

    parts: tuple[tuple[int, bool, float], ...]
    weight: float

    def sql(self) -> str:
        return " AND ".join(f"{STATISTICS[k]} {'>' if above else '<='} {bound!r}D" for k, above, bound in self.parts)


@dataclass(frozen=True)
class QualityModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, as an expression over the statistics."""
        terms = [f"if({r.sql()}, {r.weight!r}D, 0D)" for r in self.rules]
        return 1 / (1 + F.exp(-F.expr(" + ".join([f"({self.bias!r}D)", *terms]))))


_IF = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)")


def tree_rules(text: str) -> set[tuple[tuple[int, bool, float], ...]]:
    """The conjunctions of all paths in a printed tree."""
    found, path = set(), []
    for line in text.splitlines():
        if m := _IF.search(line):
            depth = len(line) - len(line.lstrip())
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (int(m[2]), m[3] == ">", float(m[4]))))
            bounds: dict[tuple[int, bool], float] = {}
            for _, (k, above, bound) in path:  # only the tightest bound of each side counts
                old = bounds.get((k, above), bound)
                bounds[k, above] = max(old, bound) if above else min(old, bound)
            found.add(tuple((k, above, b) for (k, above), b in sorted(bounds.items())))
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def _hits(rules: list[tuple[tuple[int, bool, float], ...]]) -> object:
    """(label, hits): which of the rules hold for each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_numpy() for name in STATISTICS]
            held = np.ones((batch.num_rows, len(rules)))
            for j, rule in enumerate(rules):
                for k, above, bound in rule:
                    held[:, j] *= columns[k] > bound if above else columns[k] <= bound
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(rules))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(held.ravel()))], ["label", "hits"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> QualityModel:
    """The model of labelled rows. docs: (doc_id, text); labels: (doc_id, quality). Held-out rows are not read.

    Of the labels, at most `most` ids are drawn by their hash, and statistics are computed for their documents only. Of an id's texts
    the one with the least hash counts, once for each of its labels, so that the sample has 2 * most rows at most.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("double").alias("label")).filter(
        "doc_id is not null AND label in (0, 1)"
    ).filter(~held_out())
    share = min(1.0, most / max(1, known.count()))
    at = F.xxhash64(F.lit(4), "doc_id")
    some = known.filter(F.pmod(at, F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id").distinct().orderBy(at, "doc_id").limit(most)
    drawn = scratch.save(known.join(some, "doc_id", "left_semi").distinct(), "drawn")
    texts = semi_join(docs.select(F.col("doc_id").cast("bigint"), "text"), drawn, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("at"), "text"))["text"].alias("text")
    )
    stats = with_statistics(texts, ["doc_id"]).select("row.doc_id", *STATISTICS)
    sample = scratch.save(
        # in a fixed order, so that reruns fit the same model
        stats.join(drawn, "doc_id").repartition(max(1, min(8, most // 2500)), "doc_id").sortWithinPartitions("doc_id", "label", *STATISTICS).select("label", *STATISTICS),
        "sample",
    )
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    good, bad = seen.get(1.0, 0), seen.get(0.0, 0)
    if not good or not bad:
        return QualityModel(math.log((good + 1) / (bad + 1)), ())
    rows = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=4, maxBins=64).fit(rows)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in trees.trees)))
    if not rules:
        return QualityModel(math.log((good + 1) / (bad + 1)), ())
    hits = scratch.save(sample.mapInArrow(_hits(rules), "label double, hits array<double>"), "rules")
    binary = hits.select("label", array_to_vector("hits").alias("features"))
    lasso = LogisticRegression(
        featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60
    ).fit(binary)
    kept = [Rule(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return QualityModel(float(lasso.intercept), tuple(kept))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_quality(docs, labels)
    stats = with_statistics(docs.select(F.col("doc_id").cast("bigint"), "text"), ["doc_id"]).select("row.doc_id", *STATISTICS)
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    model = fit_quality(docs, labels)
    return with_statistics(docs, docs.columns).filter(model.score() >= THRESHOLD).select("row.*")
