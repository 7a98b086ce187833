"""Substring deduplication: exact runs of words, and paragraph MinHash banding with exact verification.

A text is taken apart in two ways:

* Runs of RUN words (a parameter), at every word. A run's anchor is the least hash of its SHINGLE-word runs,
  the rightmost of equal ones, so that equal runs have equal anchors wherever they stand.
  Neighbouring runs with the same anchor make a cell.
* Paragraphs: lines of at least PARAGRAPH_WORDS words (a parameter).

Equal cells and paragraphs are found by a pre-aggregated count of their hashes. A cell that no
other document has may still share runs with other cells of its anchor, as at both ends of a
passage; of such cells, once for each distinct cell, the runs themselves are compared by hash.
So every run of RUN words or more that two documents share is found, with its exact ends.

Paragraphs get a MinHash signature of their five-word shingles. tune_bands() takes the most
rows per band with which a paragraph pair of similarity 0.75 collides with probability 0.99
or more; colliding paragraphs are verified by exact Jaccard (0.75 or more) and clustered by
connected components.

Of equal runs and of each cluster the units of the smallest doc_id stay; those of other
documents are removals. Removals that overlap, or between which no word stands, are joined into
spans, so a span holds nothing but text that is shown to repeat.

Defined results: null and empty texts have no units; repeats inside one document, repeated
rows of one doc_id included, are not repeats across documents and stay; an empty table gives
an empty result; extra columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .blocks import class_sets, link_classes
from .idfilter import semi_join
from .shingles import WIDTH, mix, rolling, shingles_of, text_slices, words

PERCENT = 75
RECALL = 0.99
PERMUTATIONS = 32
PARAGRAPH_WORDS = 30
#: Words of the shortest run that counts, and of the runs that its anchor is chosen from, at most.
RUN = 51
SHINGLE = 16
UNITS = "doc_id bigint, unit bigint, anchor bigint, start int, stop int, place int, words int, bands array<bigint>"
RUNS = "doc_id bigint, run bigint, start int, stop int, place int, words int"


def tune_bands(similarity: float = PERCENT / 100, permutations: int = PERMUTATIONS, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): most rows per band that still find a pair of this similarity with this probability."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            best = (bands, rows)
    return best


_BANDS, _ROWS = tune_bands()
_FACTORS = mix(np.arange(1, _BANDS * _ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _layout(data: np.ndarray, offsets: np.ndarray):
    """Words of a slice with the line number and the span, in code points of the slice, of each."""
    word, first, end, spans = words(data, offsets)
    line = np.cumsum(data == 10)[first] if len(first) else first
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    return word, line, chars[first], chars[end], spans, chars[offsets]


def _bounds(start: int, end: int, line: np.ndarray) -> np.ndarray:
    """First words of the lines among the words start to end, and end."""
    own = line[start:end]
    return np.concatenate([[start], start + 1 + np.flatnonzero(own[1:] != own[:-1]), [end]])


def _paragraphs(start: int, end: int, line: np.ndarray, least: int) -> list[tuple[int, int]]:
    if end - start < least:
        return []
    at = _bounds(start, end, line)
    return [(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b - a >= least]


def _unit(prefix: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs start to end, from prefix sums weighted by the words' places."""
    value = (prefix[end] - prefix[start]) * weight[start]
    return mix(value + (end - start).astype(np.uint64))


_UP, _DOWN = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _place_sums(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(word)
    up, down = np.full(n + 1, _UP, np.uint64), np.full(n + 1, _DOWN, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(word * up[:n], out=prefix[1:])
    return prefix, down


def _cells(prefix: np.ndarray, weight: np.ndarray, spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first run, end, anchor) of the cells; run i is the words i to i + size, inside one text."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    short = min(SHINGLE, size)
    if n < size:
        return none, none, none
    at = np.arange(n - short + 1)
    hashes = _unit(prefix, weight, at, at + short)
    # where the least of the next `width` hashes is, by doubling; of equal ones the right one
    width, reach = 1, size - short + 1
    while width < reach:
        step = min(width, reach - width)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    text = np.repeat(np.arange(len(spans) - 1), np.diff(spans))
    run = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    if not len(run):
        return none, none, none
    own = at[run]
    # runs of two texts never share an anchor
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return run[new], run[np.append(new[1:], len(run)) - 1] + 1, hashes[own[new]]


def _units(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.array(batch.column("doc_id").fill_null(0))
        known = np.array(batch.column("doc_id").is_valid())
        for at, end_row, data, offsets in text_slices(batch.column("text")):
            word, line, first, end, spans, zero = _layout(data, offsets)
            if not len(word):
                continue
            prefix, weight = _place_sums(word)
            doc_of = np.repeat(np.arange(end_row - at), np.diff(spans))
            a, b, anchor = _cells(prefix, weight, spans, size)
            b = b + size - 1
            spot = [p for i in range(len(spans) - 1) for p in _paragraphs(int(spans[i]), int(spans[i + 1]), line, least)]
            pa_, pb = (np.array(x, dtype=np.int64) for x in (zip(*spot, strict=True) if spot else ([], [])))
            start, stop = np.concatenate([a, pa_]), np.concatenate([b, pb])
            hashes = np.concatenate([_unit(prefix, weight, a, b), mix(_unit(prefix, weight, pa_, pb) + np.uint64(1))])
            anchors = np.concatenate([anchor.view(np.int64), np.zeros(len(pa_), np.int64)])
            owner = doc_of[start]
            keep = known[at + owner]
            bands = _signatures(word, pa_, pb)
            is_cell = np.arange(len(start)) < len(a)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([np.zeros(len(a), np.int32), np.arange(len(pa_) + 1, dtype=np.int32) * _BANDS])),
                pa.array(bands.ravel().view(np.int64)), mask=pa.array(is_cell),
            )
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at + owner]), pa.array(hashes.view(np.int64)), pa.array(anchors, mask=~is_cell),
                    pa.array((first[start] - zero[owner]).astype(np.int32)), pa.array((end[stop - 1] - zero[owner]).astype(np.int32)),
                    pa.array((start - spans[owner]).astype(np.int32)), pa.array((stop - start).astype(np.int32)), lists,
                ],
                ["doc_id", "unit", "anchor", "start", "stop", "place", "words", "bands"],
            )
            yield out if keep.all() else out.filter(pa.array(keep))


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The runs of the cells that are listed in wanted."""
    for batch in batches:
        ids = np.array(batch.column("doc_id"))
        wanted = batch.column("wanted")
        ends, values = np.asarray(wanted.offsets), wanted.values.to_numpy()
        for at, end_row, data, offsets in text_slices(batch.column("text")):
            word, _, first, end, spans, zero = _layout(data, offsets)
            if not len(word):
                continue
            prefix, weight = _place_sums(word)
            doc_of = np.repeat(np.arange(end_row - at), np.diff(spans))
            a, b, _ = _cells(prefix, weight, spans, size)
            unit = _unit(prefix, weight, a, b + size - 1).view(np.int64)
            listed = np.isin(unit, values[ends[at] : ends[end_row]])
            a, b = a[listed], b[listed]
            many = b - a
            run = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            owner = doc_of[run]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at + owner]), pa.array(_unit(prefix, weight, run, run + size).view(np.int64)),
                    pa.array((first[run] - zero[owner]).astype(np.int32)), pa.array((end[run + size - 1] - zero[owner]).astype(np.int32)),
                    pa.array((run - spans[owner]).astype(np.int32)), pa.array(np.full(len(run), size, np.int32)),
                ],
                ["doc_id", "run", "start", "stop", "place", "words"],
            )


def _signatures(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of band keys for each paragraph."""
    if not len(start):
        return np.zeros((0, _BANDS), np.uint64)
    run = rolling(word)
    edges = np.empty(2 * len(start), dtype=np.int64)
    edges[0::2], edges[1::2] = start, end - WIDTH + 1
    padded = np.append(run, np.uint64(0))  # reduceat needs every edge inside
    out = np.empty((len(start), _BANDS), np.uint64)
    for band in range(_BANDS):
        key = np.full(len(start), np.uint64(band + 1))
        for row in range(_ROWS):
            least = np.minimum.reduceat(padded * _FACTORS[band * _ROWS + row], edges)[0::2]
            key = mix(key * np.uint64(_UP) + least)
        out[:, band] = key
    return out


def _paragraph_sets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    def found(batch):
        for _, _, data, offsets in text_slices(batch.column("text")):
            word, line, _, _, spans, _ = _layout(data, offsets)
            if not len(word):
                continue
            prefix, weight = _place_sums(word)
            run = rolling(word)
            spot = [p for i in range(len(spans) - 1) for p in _paragraphs(int(spans[i]), int(spans[i + 1]), line, least)]
            if spot:
                a, b = (np.array(x, dtype=np.int64) for x in zip(*spot, strict=True))
                for key, (x, y) in zip(mix(_unit(prefix, weight, a, b) + np.uint64(1)).view(np.int64).tolist(), spot, strict=True):
                    yield key, np.unique(shingles_of(word, run, x, y))

    for batch in batches:
        yield from class_sets(found(batch))


def _alike(docs: DataFrame, paragraphs: DataFrame, least: int) -> DataFrame:
    """(unit, component) of the paragraphs that link with others. paragraphs: (unit, doc_id, bands), equal ones too."""
    each = scratch.save(paragraphs.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "paragraphs")
    keys = each.select(F.explode("bands").alias("key"), F.col("unit").alias("class"), F.lit(0).cast("bigint").alias("place"))
    # counted before they are joined, so that a band of any number of paragraphs is split
    many = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = scratch.save(keys.join(many, "key", "left_semi").select("key", "class", "place"), "lists")
    classes = scratch.save(lists.select("class").distinct(), "classes")
    homes = scratch.save(each.join(classes.withColumnRenamed("class", "unit"), "unit", "left_semi").select("doc_id").distinct(), "homes")
    found = semi_join(docs, homes, "doc_id").mapInArrow(partial(_paragraph_sets, least=least), "class bigint, shingles array<bigint>")
    sets = scratch.save(found.join(classes, "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")
    for table in (each, classes, homes):
        scratch.drop(table)
    linked = link_classes(lists, sets, PERCENT)
    scratch.drop(sets)
    return linked.select(F.col("class").alias("unit"), "component")


def repeated_passages(docs: DataFrame, run: int = RUN, paragraph_words: int = PARAGRAPH_WORDS) -> DataFrame:
    """(doc_id, start, stop, words, kept_doc_id): spans to remove, and the smallest document that keeps text of it.

    run: the words of the shortest passage that is found inside other lines. paragraph_words: those of the shortest line
    that is compared as a paragraph, WIDTH at least. Units are hashed again where they are needed: only their counts and
    those that repeat are written.
    """
    if run < 1 or paragraph_words < WIDTH:
        raise ValueError(f"run must be 1 or more and paragraph_words {WIDTH} or more")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    units = docs.mapInArrow(partial(_units, size=run, least=paragraph_words), UNITS)
    paragraphs = scratch.save(units.filter("bands is not null").select("unit", "doc_id", "bands"), "lines")
    alike = _alike(docs, paragraphs, paragraph_words)
    scratch.drop(paragraphs)

    # equal units, by hash; a cluster is a component of paragraphs or a hash alone
    spread = scratch.save(units.groupBy("unit").agg(F.min("anchor").alias("anchor"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "spread")
    clusters = scratch.save(
        spread.join(alike, "unit", "left").filter("lo < hi OR component is not null")
        .select("unit", "lo", "hi", F.coalesce("component", "unit").alias("cluster")),
        "clusters",
    )
    # runs first: they are the last to read the counts of all units
    removed = scratch.save(_shared_runs(docs, spread, run), "shared")
    kept = clusters.groupBy("cluster").agg(F.min("lo").alias("kept_doc_id"), F.max("hi").alias("hi")).filter("kept_doc_id < hi").drop("hi")
    where = scratch.save(clusters.join(kept, "cluster").select("unit", "kept_doc_id"), "where")
    scratch.drop(clusters)
    whole = (
        semi_join(units.select("doc_id", "unit", "start", "stop", "place", "words"), where, "unit").join(where, "unit")
        .filter("doc_id > kept_doc_id").select("doc_id", "start", "stop", "place", "words", "kept_doc_id")
    )
    cut = scratch.save(whole.unionAll(removed), "removed")
    for table in (where, removed):
        scratch.drop(table)
    return _spans(cut)


def _shared_runs(docs: DataFrame, spread: DataFrame, size: int) -> DataFrame:
    """Runs to remove from the first document of a cell: those that another cell of the anchor has in an earlier document.

    The other documents of a cell lose all of it anyway. spread, a saved table, is dropped.
    """
    cells = spread.filter("anchor is not null")
    mixed = scratch.save(
        cells.groupBy("anchor").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most").select("anchor"), "anchors"
    )
    edges = scratch.save(cells.join(mixed, "anchor", "left_semi").select(F.col("lo").alias("doc_id"), "unit"), "edges")
    for table in (spread, mixed):
        scratch.drop(table)
    wanted = edges.groupBy("doc_id").agg(F.collect_list("unit").alias("wanted"))
    texts = semi_join(docs, edges, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "wanted")
    runs = scratch.save(texts.mapInArrow(partial(_runs, size=size), RUNS), "runs")
    scratch.drop(edges)
    first = runs.groupBy("run").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("hi")).filter("kept_doc_id < hi").drop("hi")
    found = scratch.save(
        runs.join(first, "run").filter("doc_id > kept_doc_id").select("doc_id", "start", "stop", "place", "words", "kept_doc_id"), "found"
    )
    scratch.drop(runs)
    return found


def _spans(removed: DataFrame) -> DataFrame:
    """Units to spans: those that overlap or follow at once are joined; words that units share count once."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("stop"), "kept_doc_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        removed.distinct().withColumn("past", F.max(F.expr("place + words")).over(before))
        .withColumn("fresh", F.coalesce(F.col("place") > F.col("past"), F.lit(True)))
        .withColumn("run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the words of a unit that earlier units do not cover
        .withColumn("own", F.expr("greatest(0, place + words - greatest(place, coalesce(past, 0)))"))
    )
    return (
        marked.groupBy("doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("own").cast("bigint").alias("words"), F.min("kept_doc_id").alias("kept_doc_id"))
        .drop("run")
    )


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out; n_chars, where it is a column, follows. Columns may have any name."""
    cut = next(x for x in (f"_cut{k or ''}" for k in range(len(docs.columns) + 1)) if x not in {c.lower() for c in docs.columns})
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cut))
    joined = docs.join(scratch.save(spans, "cuts"), "doc_id", "left")
    parts = F.expr(
        f"transform(sequence(0, size({cut})), i -> substring(text, if(i = 0, 1, {cut}[i - 1].stop + 1), "
        f"if(i = size({cut}), length(text), {cut}[i].start) - if(i = 0, 0, {cut}[i - 1].stop)))"
    )
    out = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(parts, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
