"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of a benchmark contaminates a document when the document has at least 75 of 100 of
the item's distinct five-word shingles. A MinHash of a long document says little about a
short item, so the sketch is on the items' side only: items are partitioned by their number
of shingles, and in each partition the signature keeps the smallest hashes of an item, just
so many that a containment of 75 in 100 must hit one (n - ceil(0.75 n) + 1 at the upper size
of the partition). Every shingle of every document probes the signatures; a hit is a candidate,
and its containment is counted exactly with all shingles of the item.

Items of one to four words have no five-word shingle: such an item is found where a document
has its words in sequence (containment 1). Items without words match nothing.

The items are read in blocks of bounded size, each a pass over the documents, so what is
broadcast never grows with the benchmark. Documents are never shuffled.

Defined results: null and empty texts match nothing; repeated rows give repeated results;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WIDTH, mix, runs_of, rolling, shingles_of, text_slices, words

PERCENT = 75
#: Items of a block hold about so many characters in all; it bounds what is broadcast.
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint, containment double"
_PREFILTER_BITS = 20


class _Items:
    """Signatures and shingles of a block of items, as sorted arrays."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, sizes, sketch, all_values, all_owner, owner = ids, [], [], [], [], []
        self.widths: set[int] = set()
        for at, _, data, offsets in text_slices(pa.array(texts, pa.string())):
            word, _, _, spans = words(data, offsets)
            run = rolling(word)
            for i in range(len(spans) - 1):
                values = np.unique(shingles_of(word, run, spans[i], spans[i + 1]))
                n, many = len(values), int(spans[i + 1] - spans[i])
                sizes.append(n)
                if not n:
                    continue
                self.widths.add(min(many, WIDTH))
                upper = 1 << (n - 1).bit_length()  # the size partition: n is in (upper / 2, upper]
                keep = min(n, upper - -(-PERCENT * upper // 100) + 1)
                sketch.append(values[np.argsort(mix(values), kind="stable")[:keep]])
                owner.append(np.full(keep, at + i))
                all_values.append(values)
                all_owner.append(np.full(n, at + i))
        self.sizes = np.array(sizes, dtype=np.int64)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.sketch, self.owner = self._sorted(join(sketch, np.uint64), join(owner, np.int64))
        self.values, self.value_owner = self._sorted(join(all_values, np.uint64), join(all_owner, np.int64))
        self.hint = np.zeros(1 << _PREFILTER_BITS, dtype=bool)
        self.hint[self._slot(self.sketch)] = True

    @staticmethod
    def _sorted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - _PREFILTER_BITS)).astype(np.int64)

    def hits(self, values: np.ndarray) -> bool:
        """Is any of the values in a signature?"""
        near = values[self.hint[self._slot(values)]]
        if not len(near):
            return False
        at = np.searchsorted(self.sketch, near)
        at[at == len(self.sketch)] = 0
        return bool((self.sketch[at] == near).any())

    def containments(self, values: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items that a document of these shingles contains."""
        values = np.unique(values)
        if not len(values) or not len(self.sketch):
            return
        candidates = np.unique(self.owner[self._members(self.sketch, values)])
        if not len(candidates):
            return
        shared = np.bincount(self.value_owner[self._members(self.values, values)], minlength=len(self.sizes))
        for item in candidates:
            if 100 * shared[item] >= PERCENT * self.sizes[item]:
                yield int(item), int(shared[item])

    @staticmethod
    def _members(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, table)
        at[at == len(values)] = 0
        return values[at] == table


def _search(shared_items) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared_items.value
        widths = sorted(items.widths)
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for at, _, data, offsets in text_slices(batch.column("text")):
                word, _, _, spans = words(data, offsets)
                runs = {w: runs_of(word, w) for w in widths}
                if not any(items.hits(r) for r in runs.values()):
                    continue
                for i in range(len(spans) - 1):
                    own = [r[spans[i] : max(spans[i], spans[i + 1] - w + 1)] for w, r in runs.items()]
                    if any(items.hits(x) for x in own):
                        found += [(at + i, item, n) for item, n in items.containments(np.concatenate(own))]
            rows, which, shared = (np.array(x, dtype=np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
            size = items.sizes[which]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)), pa.array([items.ids[k] for k in which], pa.int64()),
                    pa.array(size), pa.array(shared), pa.array(shared / np.maximum(size, 1)),
                ],
                ["doc_id", "item_id", "item_shingles", "shared", "containment"],
            )

    return run


def contained_items(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """SCHEMA rows: every document that contains an item, with the item and the exact containment."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint"), "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    wide = docs.select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows]))
        part = wide.mapInArrow(_search(block), SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out
