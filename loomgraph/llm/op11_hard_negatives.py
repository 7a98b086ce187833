"""Hard negatives: of each anchor and each of its best positives, the best rows of other labels that score within a window.

A score is the inner product of two vectors of integers. Anchors and candidates meet in tiles, and the
products of a tile are made by Strassen's recursion on int64 matrices: odd sizes are padded with zeros,
and additions and products are exact. Two passes read the candidates, one for each block of anchors, and
shuffle none of them:

1. positives: every task keeps for each anchor a heap of its best rows of the same label;
2. negatives: every task keeps for each anchor and positive a heap of the best rows inside the window.

Heaps merge by taking the best of all: Spark ranks what the tasks have kept, a few rows for each task and
anchor. A block of anchors has a fixed size, and so has what is broadcast, what reaches the driver and
what a task holds; a larger table takes more passes.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of
unequal length count as padded with zeros, and an empty one scores 0 with all. Rows of the anchor's own id
are no positives of it; other repeated rows count each, and repeated anchors are answered each. Scores
that tie go by smaller id. A vector whose length times the scale exceeds 2**28 raises an error, for scores
might pass 64 bits. Other columns are ignored, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Anchors of a block, rows of a side of a tile, and the size below which a product is made directly.
BLOCK, TILE, LEAF = 4096, 1024, 16
LONGEST = 1 << 28
_WORST, _LAST = -(1 << 62), (1 << 63) - 1
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices with seven products of halves for eight, down to sides of `leaf`."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, i, j = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m, k, n) != (2 * h, 2 * i, 2 * j):
        a, b = np.pad(a, ((0, 2 * h - m), (0, 2 * i - k))), np.pad(b, ((0, 2 * i - k), (0, 2 * j - n)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3, p4 = product(a11 + a22, b11 + b22, leaf), product(a21 + a22, b11, leaf), product(a11, b12 - b22, leaf), product(a22, b21 - b11, leaf)
    p5, p6, p7 = product(a11 + a12, b22, leaf), product(a21 - a11, b11 + b12, leaf), product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix, padded with zeros to the longest."""
    ends = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Heaps:
    """For each row the best `size` (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, rows: int, size: int):
        self.score = np.full((rows, size), _WORST, np.int64)
        self.id = np.full((rows, size), _LAST, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> None:
        """Offers scores[k, j] of ids[j] to row rows[k], within least[k] to most[k]; ids ascend. Scores of _WORST or less are none."""
        size, worst, last = self.score.shape[1], self.score[rows, -1], self.id[rows, -1]
        low = worst if least is None else np.maximum(worst, least)
        fits = scores >= low[:, None]
        if most is not None:
            fits &= scores <= most[:, None]
        keen = np.flatnonzero(fits.any(axis=1))
        if not len(keen):
            return
        fits, scores, worst, last = fits[keen], scores[keen], worst[keen], last[keen]
        # a tie with the last of a heap counts for smaller ids only
        fits &= (scores > worst[:, None]) | (ids[None, :] < last[:, None])
        fits &= scores > _WORST
        if scores.shape[1] > size:
            held = np.where(fits, scores, _WORST)
            fits &= scores >= np.partition(held, -size, axis=1)[:, -size][:, None]
        k, j = np.nonzero(fits)
        if not len(k):
            return
        touched, at = np.unique(k, return_inverse=True)
        own = rows[keen[touched]]
        owner = np.concatenate([at, np.repeat(np.arange(len(own)), size)])
        score = np.concatenate([scores[k, j], self.score[own].ravel()])
        of = np.concatenate([ids[j], self.id[own].ravel()])
        order = np.lexsort((of, -score, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], np.arange(len(own)))[owner[order]]
        best = order[place < size]
        self.score[own], self.id[own] = score[best].reshape(-1, size), of[best].reshape(-1, size)


@dataclass(frozen=True)
class _Block:
    """Anchors, sorted by label; of a positive's window the row of its anchor and the scores that fit."""

    id: np.ndarray
    label: np.ndarray
    units: np.ndarray
    row: np.ndarray | None = None
    positive: np.ndarray | None = None
    score: np.ndarray | None = None


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, label, units) of `tile` rows, fewer at the end, in the order of their ids."""
    held: list[pa.RecordBatch] = []

    def ready(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = rows.combine_chunks().to_batches()[0]
        ids, labels = one.column("vec_id").to_numpy(), one.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], labels[order], _matrix(one.column("units"))[order]

    def count() -> int:
        return sum(b.num_rows for b in held)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        while count() >= tile:
            rows = pa.Table.from_batches(held)
            yield ready(rows.slice(0, tile))
            held[:] = [b for b in rows.slice(tile).to_batches() if b.num_rows]
    if held:
        yield ready(pa.Table.from_batches(held))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])  # beyond it one side has zeros
    return product(a[:, :width], np.ascontiguousarray(b[:, :width].T))


def _without_own(scores: np.ndarray, anchors: np.ndarray, ids: np.ndarray) -> None:
    """Takes the rows of an anchor's own id out; ids ascend."""
    first, end = np.searchsorted(ids, anchors, "left"), np.searchsorted(ids, anchors, "right")
    for k in np.flatnonzero(first < end):
        scores[k, first[k] : end[k]] = _WORST


def _positives(block, size: int, tile: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Block = block.value
        heaps = Heaps(len(own.id), size)
        for ids, labels, units in _tiles(batches, tile):
            for label in np.unique(labels):
                lo, hi = np.searchsorted(own.label, label, "left"), np.searchsorted(own.label, label, "right")
                same = labels == label
                for at in range(lo, hi, tile):
                    rows = np.arange(at, min(hi, at + tile))
                    scores = _scores(own.units[rows], units[same])
                    _without_own(scores, own.id[rows], ids[same])
                    heaps.offer(rows, scores, ids[same])
        row, place = np.nonzero(heaps.score > _WORST)
        columns = [pa.array(x, pa.int64()) for x in (row, heaps.score[row, place], heaps.id[row, place])]
        yield pa.RecordBatch.from_arrays(columns, ["row", "score", "id"])

    return run


def _negatives(block, size: int, tile: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Block = block.value
        least, most = -((-low * own.score) // 100), (high * own.score) // 100
        heaps = Heaps(len(own.row), size)
        # windows of one anchor stand together; the k-th of all anchors are offered a tile at once
        first = np.searchsorted(own.row, np.arange(len(own.id) + 1))
        for ids, labels, units in _tiles(batches, tile):
            for at in range(0, len(own.id), tile):
                rows = np.arange(at, min(len(own.id), at + tile))
                scores = _scores(own.units[rows], units)
                scores[own.label[rows][:, None] == labels[None, :]] = _WORST
                for k in range(int(np.diff(first)[rows].max(initial=0))):
                    having = np.flatnonzero(first[rows] + k < first[rows + 1])
                    window = first[rows[having]] + k
                    heaps.offer(window, scores[having], ids, least[window], most[window])
        window, place = np.nonzero(heaps.score > _WORST)
        columns = [window, own.id[own.row[window]], own.positive[window], own.score[window], heaps.score[window, place], heaps.id[window, place]]
        names = ["window", "anchor_id", "positive_id", "positive_score", "score", "id"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return run


def _merged(kept: DataFrame, by: str, size: int) -> DataFrame:
    """The best `size` of what the heaps of all tasks have kept for one row, with their rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= size)


def usable(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, units) of the rows that take part: units are floor(scale * component)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    scaled = F.transform("embedding", lambda x: F.floor(float(scale) * x.cast("double")))
    size = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(float(scale) * x.cast("double"), F.lit(2.0)))
    too_long = F.raise_error(F.lit(f"a vector times {scale} is longer than {LONGEST}"))
    return rows.select("vec_id", "label", F.when(size <= float(LONGEST) ** 2, scaled).otherwise(too_long).cast("array<bigint>").alias("units"))


def _block_of(rows: pa.Table) -> _Block:
    rows = rows.combine_chunks()
    label, ids = rows.column("label").to_numpy(), rows.column("vec_id").to_numpy()
    order = np.lexsort((ids, label))
    return _Block(ids[order], label[order], _matrix(rows.column("units").combine_chunks())[order])


def hard_negatives(
    embeddings: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """RESULT rows: for each anchor, a row whose vec_id anchor_every divides, and each of its first `positives` rows of the same label, the
    first `negatives` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, scale)
    anchors = scratch.save(rows.filter(F.col("vec_id") % anchor_every == 0), "anchors")
    many = -(-anchors.count() // block)
    if not many:
        return spark.createDataFrame([], RESULT)
    dealt = scratch.save(anchors.repartition(many).withColumn("block", F.spark_partition_id()), "blocks")
    folder = f"{scratch.new_folder(spark, 'negatives')}"
    for k in range(many):
        own = _block_of(dealt.filter(F.col("block") == k).drop("block").toArrow())
        if not len(own.id):
            continue
        sent = spark.sparkContext.broadcast(own)
        found = _merged(rows.mapInArrow(_positives(sent, positives, tile), "row bigint, score bigint, id bigint"), "row", positives).toArrow().combine_chunks()
        sent.unpersist()
        row, place = found.column("row").to_numpy(), found.column("rank").to_numpy()
        order = np.lexsort((place, row))
        asked = _Block(own.id, own.label, own.units, row[order], found.column("id").to_numpy()[order], found.column("score").to_numpy()[order])
        sent = spark.sparkContext.broadcast(asked)
        kept = rows.mapInArrow(
            _negatives(sent, negatives, tile, low, high), "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint"
        )
        best = _merged(kept, "window", negatives)
        best.select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(folder)
        sent.unpersist()
    scratch.drop(anchors)
    scratch.drop(dealt)
    return spark.read.schema(RESULT).parquet(folder)
