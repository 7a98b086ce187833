"""Phrase collocations: phrases of two to four words whose words occur together more often than they occur apart.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words at spaces and tabs. Each word leads one
window of LONGEST words, padded where the piece ends, and only these windows are counted; Spark's ROLLUP over
(lang, w1, ..., w4) sums them to the counts of all shorter prefixes, which are the counts of all shorter phrases, and at the level of
the language to the number of words. No n-grams of other lengths are made.

A window ends, too, before a run of two or three words that occurs less than `least` times: no phrase that counts goes on there, so
the counts of all phrases that occur `least` times stay exact, and what is shuffled shrinks to the windows that can matter. Such
runs and rare words are told by sums over keys of KEY_BITS bits, first of words and pairs, then of the triples of two frequent
pairs; keys that agree only add up, so nothing frequent is lost. Bitmaps of at most MOST_BITS bits of the frequent ones are
broadcast; where they fill up at large scale, fewer windows are cut short and results are the same.

Null texts are empty; a null lang is `und`; documents without an id, repeated documents and texts of any length count like all others; other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .shingles import mix, text_slices, words

LONGEST = 4
#: Bits of the key of a run of words.
KEY_BITS = 36
#: Bits of a bitmap of frequent runs: 64 for each of them, within these bounds; at most 16 MB.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Parts of a language that rank their phrases on their own before the best of all are ranked.
PARTS = 64
_GAP = np.zeros(256, dtype=bool)
_GAP[[*b" \t.,;:!?\n\v\f\r"]] = True
_CUT = _GAP.copy()
_CUT[[32, 9]] = False
_W = [f"w{k + 1}" for k in range(LONGEST)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
RESULT = "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"


class _Slice:
    """The words of some texts: hash, bytes, number of the language, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        self.data = data
        word, self.first, self.end, spans = words(data, offsets, _GAP)
        self.lang = np.repeat(langs, np.diff(spans))
        n = len(word)
        self.next = np.zeros(n, dtype=bool)
        if n > 1:
            cuts = np.flatnonzero(_CUT[data])
            apart = np.searchsorted(cuts, self.first[1:]) > np.searchsorted(cuts, self.end[:-1])
            self.next[:-1] = ~apart
            self.next[spans[1:-1][(spans[1:-1] > 0) & (spans[1:-1] < n)] - 1] = False
        # keys of the runs of one to three words from each word on; next says which of them lie in a piece
        one = mix(word ^ seeds[self.lang])
        two = mix(one * _STEP + np.append(one[1:], one[:1]))
        three = mix(two * _STEP + np.append(one[2:], one[:2]))
        self.keys = [x >> np.uint64(64 - KEY_BITS) for x in (one, two, three)]

    def texts(self, at: np.ndarray) -> pa.Array:
        """Words, lower-cased, as an Arrow column; -1 gives the empty word."""
        have = at >= 0
        first, size = np.where(have, self.first[at], 0), np.where(have, self.end[at] - self.first[at], 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, list[str]]]:
    """The words of all texts, in slices, and the languages that their numbers mean."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
        codes = langs.indices.to_numpy()
        for at, end, data, offsets in text_slices(batch.column("text")):
            yield _Slice(data, offsets, codes[at:end], seeds), names


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    seen, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _short_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the words, and of the pairs of words inside a piece, of each slice."""
    for part, _ in _slices(batches):
        yield _counted([part.keys[0], part.keys[1][part.next]])


def _triples(sent) -> Callable:
    """(key, n) of the triples of two frequent pairs of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in _slices(batches):
            pair = part.next & _marked(sent.value, part.keys[1])
            yield _counted([part.keys[2][pair & np.append(pair[1:], np.zeros(min(1, len(pair)), bool))]])

    return run


def frequent_bits(counted: DataFrame, least: int) -> np.ndarray:
    """A bitmap, of a power of two of 64-bit words, in which the keys with a sum of `least` or more are marked. counted: (key, n)."""
    found = scratch.save(counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), "frequent")
    size = max(FEWEST_BITS, min(MOST_BITS, 1 << (max(1, 64 * found.count()) - 1).bit_length()))
    bit = F.col("key").bitwiseAND(size - 1)
    packed = found.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), bit.bitwiseAND(63).cast("int").alias("at"))
    rows = packed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).toArrow()  # bounded by MOST_BITS
    out = np.zeros(size // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    scratch.drop(found)
    return out.view(np.uint64)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _windows(short, triples) -> Callable:
    """(lang, w1, ..., w4, n): the windows that words lead, each as often as a slice has it; a word that is rare leads an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names in _slices(batches):
            n = len(part.next)
            if not n:
                continue
            pad = np.zeros(LONGEST, bool)
            pair = np.append(part.next & _marked(short.value, part.keys[1]), pad)
            triple = np.append(_marked(triples.value, part.keys[2]), pad)
            # the words of a slice by number: equal texts, equal numbers
            code = part.texts(np.arange(n)).dictionary_encode().indices.to_numpy().astype(np.int64)
            lead = np.arange(n)
            at = np.full((LONGEST, n), -1)
            goes = _marked(short.value, part.keys[0])
            for k in range(LONGEST):
                at[k, goes] = lead[goes] + k
                goes = goes & pair[lead + k]
                if k:
                    goes &= triple[lead + k - 1]
            key = np.where(at >= 0, code[np.maximum(at, 0)], -1)
            order = np.lexsort((*key[::-1], part.lang))
            sorted_keys = np.vstack([part.lang[order][None], key[:, order]])
            fresh = np.flatnonzero(np.append(True, (sorted_keys[:, 1:] != sorted_keys[:, :-1]).any(axis=0)))
            pick = order[fresh]
            times = np.diff(np.append(fresh, n))
            lang = pa.DictionaryArray.from_arrays(pa.array(part.lang[pick], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, *(part.texts(x) for x in at[:, pick]), pa.array(times, pa.int64())], ["lang", *_W, "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, words, f) of all phrases of one to LONGEST words that occur `least` times, and with no words the number of all words of a language.

    docs: (text, lang). The table is saved; drop it after its last reader.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    send, keyed = spark.sparkContext.broadcast, "key bigint, n bigint"
    short = send(frequent_bits(texts.mapInArrow(_short_runs, keyed), least))
    triples = send(frequent_bits(texts.mapInArrow(_triples(short), keyed), least))
    schema = f"lang string, {', '.join(f'{w} string' for w in _W)}, n bigint"
    windows = texts.mapInArrow(_windows(short, triples), schema).groupBy("lang", *_W).agg(F.sum("n").alias("n"))
    # a null is a word that ROLLUP has summed over, an empty one is padding; what ends in padding is counted as a shorter prefix
    whole = F.lit(True)
    for w in _W:
        whole = whole & (F.coalesce(F.col(w), F.lit("-")) != "")
    summed = windows.rollup("lang", *_W).agg(F.sum("n").alias("f")).filter(F.col("lang").isNotNull() & whole)
    kept = summed.filter((F.col("f") >= least) | F.col("w1").isNull())
    out = scratch.save(kept.select("lang", F.array_compact(F.array(*_W)).alias("words"), "f"), "phrases")
    short.unpersist()
    triples.unpersist()
    return out


def _exact(product: Column) -> Column:
    return product.cast("decimal(38,0)")


def scored(counts: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, words, a, l, r, score) of the phrases of two words or more, each at its lowest-scoring cut; ties go to the shortest first part."""
    phrases = counts.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    parts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    of = lambda part, f: counts.filter("size(words) > 0").select("lang", F.col("words").alias(part), F.col("f").alias(f))
    both = parts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.select("*", (F.lit(scale).cast("decimal(10,0)") * wide("a")).alias("above"), (wide("l") + wide("r")).alias("below"))
    both = both.withColumn("score", F.expr("above div below"))
    best = both.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "a", "b.l", "b.r", "b.score")


def _absorbed(phrases: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The phrases without those inside a longer one that occurs at least percent as often.

    The phrases that are one word longer tell: what is inside a still longer one is inside one of these, which occurs no less often.
    """
    longer = counts.filter("size(words) > 2")
    inside = longer.select("lang", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), "f")
    most = inside.groupBy("lang", "words").agg(F.max("f").alias("most"))
    joined = phrases.join(most, ["lang", "words"], "left")
    within = _exact(F.lit(100).cast("decimal(10,0)") * F.coalesce("most", F.lit(0)).cast("decimal(20,0)")) >= _exact(
        F.lit(percent).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
    )
    return joined.filter(~within).drop("most")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """RESULT rows: the first `top` phrases of each language by score, count and phrase. docs: (text, lang)."""
    counts = phrase_counts(docs, least)
    phrases = _absorbed(scored(counts), counts, percent).select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    best = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    size = counts.filter("size(words) = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
