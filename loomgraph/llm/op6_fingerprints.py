"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (line) is hashed to a wide vector, and a fingerprint is the sum of the vectors
of a text's paragraphs modulo powers of two, lane by lane. So the order of paragraphs does not
matter, and insertion or deletion of paragraphs is addition or subtraction of their vectors.
The vector has two parts:

* SUMS lanes of 32 bits with hashes of the whole paragraph: equal multisets of paragraphs have
  equal lanes, and others differ with probability 1 - 2**-256.
* SIGNS lanes of 32 bits that count, with signs, the hashed word triples of the paragraph: a
  count sketch, whose cosine estimates how much text two documents share.

Likeness is 1 for equal fingerprints and else the cosine of the sign lanes, between 0 and 1.
Everything is built-in functions: word triples are exploded and summed per document, and
neighbours are found by one window over ranges of ids, each range with the first row of the next.

Defined results: null and empty texts are one empty paragraph; documents of one id order by
text; a lone document is its own next one; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SUMS = 8
SIGNS = 64
#: Lanes that share a long while they are summed; a text has fewer than 2**31 triples, so neither can wrap.
_PACKED, _BITS = 2, 32
#: Ranges of ids for each shuffle partition.
RANGES = 4


def _range_starts(docs: DataFrame, key: str) -> list[int]:
    """First ids of the ranges, all of them ids of the table and about equally far apart; the shuffle partitions set their number."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()
    return [0] if row["least"] is None else sorted({row["least"], *row["cuts"]})


def _in_ranges(docs: DataFrame, key: str, starts: list[int]) -> DataFrame:
    """Adds _range, the number of the last start not above the key, by halving steps."""
    n, table = len(starts), F.array(*(F.lit(x).cast("bigint") for x in starts))
    out, step = docs.withColumn("_range", F.lit(0)), 1 << max(0, (n - 1).bit_length() - 1)
    while step and n > 1:
        probe = F.col("_range") + step
        above = (probe < n) & (F.col(key) >= F.element_at(table, F.least(probe + 1, F.lit(n))))
        out = out.withColumn("_range", F.when(above, probe).otherwise(F.col("_range")))
        step //= 2
    return out


def _with_next(rows: DataFrame, first: Column, ranges: int, order: list[str], values: list[str]) -> DataFrame:
    """Adds next_<value> of the next row by _range and order, around the end, and _row, its number in the range.

    first marks the rows that can be a range's first; they are also dealt, as guests, to the range before.
    """
    places = F.when(first, F.array(F.col("_range"), F.pmod(F.col("_range") - 1, F.lit(ranges)))).otherwise(F.array("_range"))
    dealt = rows.select(*rows.columns, F.posexplode_outer(places).alias("_guest", "_place"))
    by = Window.partitionBy("_place").orderBy("_guest", *order)
    kept = [c for c in rows.columns if c != "_row"]
    return dealt.select(
        *kept, "_guest", F.row_number().over(by).alias("_row"), *(F.lead(v).over(by).alias(f"next_{v}") for v in values)
    ).filter("_guest = 0").drop("_guest")


def _sums(text: str) -> Column:
    """The sum lanes of a text, each from 0 to 2**32 - 1."""
    lanes = [
        f"aggregate(split({text}, '\\n'), 0L, (a, p) -> (a + (xxhash64({j}, p) & 4294967295L)) & 4294967295L)" for j in range(SUMS)
    ]
    return F.expr(f"array({', '.join(lanes)})")


def _triples(text: str) -> Column:
    """Hashes of the word triples of all paragraphs; the last words of a paragraph have shorter ones."""
    return F.expr(
        f"flatten(transform(split({text}, '\\n'), p -> transform(array(split(p, ' ')), ws -> "
        "transform(ws, (w, i) -> xxhash64(w, get(ws, i + 1), get(ws, i + 2))))[0]))"
    )


def lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys, sums and signs, the lanes of the fingerprint as numbers; keys must tell the rows apart."""
    # both in a projection of their own: beside explode() the sums would be worked out again for every triple
    units = texts.select(*keys, _sums(text).alias("sums"), _triples(text).alias("_hs")).select(*keys, "sums", F.explode_outer("_hs").alias("_h"))
    # two lanes of 32 bits share a long while they are summed; the low sum carries into the high one, and is told apart first
    units = units.select(
        *keys, "sums", F.expr(f"cast(pmod(_h, {SIGNS // _PACKED}) AS int)").alias("_word"),
        F.expr(f"shiftleft(1L - 2L * (shiftrightunsigned(_h, 20) & 1L), {_BITS} * cast(shiftrightunsigned(_h, 30) & {_PACKED - 1}L AS int))").alias("_unit"),
    )
    packed = [F.sum(F.when(F.col("_word") == k, F.col("_unit")).otherwise(F.lit(0))).alias(f"_p{k}") for k in range(SIGNS // _PACKED)]
    summed = units.groupBy(*keys, "sums").agg(*packed)
    words = ", ".join(f"_p{k}" for k in range(SIGNS // _PACKED))
    # the balanced low lane, and the high one once that is taken off
    low = "cast(cast((p & 4294967295L) - if((p & 4294967295L) >= 2147483648L, 4294967296L, 0L) AS bigint) AS int)"
    high = "cast(shiftright(p, 32) + if((p & 4294967295L) >= 2147483648L, 1L, 0L) AS int)"
    return summed.select(*keys, "sums", F.expr(f"flatten(transform(array({words}), p -> array({low}, {high})))").alias("signs"))


def _hex(sums: str, signs: str) -> str:
    """SQL: a fingerprint, eight digits a lane."""
    each = f"concat({sums}, transform({signs}, s -> cast(s AS bigint) & 4294967295L))"
    return f"lower(array_join(transform({each}, s -> lpad(hex(s), 8, '0')), ''))"


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and fingerprint; keys must tell the rows apart."""
    return lanes(texts, keys, text).select(*keys, F.expr(_hex("sums", "signs")).alias("fingerprint"))


def _cosine(a: str, b: str) -> str:
    """SQL: the cosine of two arrays of sign lanes, from 0 to 1."""

    def dot(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (m, n) -> cast(m AS double) * n), 0D, (t, m) -> t + m)"

    # a one-element array binds the products, which are read more than once
    bound = f"array(struct({dot(a, b)} AS xy, sqrt({dot(a, a)}) * sqrt({dot(b, b)}) AS norm))"
    return f"transform({bound}, d -> if(d.norm = 0, 0D, greatest(0D, least(1D, d.xy / d.norm))))[0]"


def likeness(a: str, b: str) -> Column:
    """Likeness of two columns of fingerprints, between 0 and 1."""

    def signs(x: str) -> str:
        read = f"cast(conv(substring({x}, {8 * SUMS + 1} + 8 * i, 8), 16, 10) AS bigint)"
        return f"transform(transform(sequence(0, {SIGNS - 1}), i -> {read}), s -> s - if(s >= 2147483648L, 4294967296L, 0L))"

    cosine = f"transform(array(struct({signs(a)} AS x, {signs(b)} AS y)), v -> {_cosine('v.x', 'v.y')})[0]"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE {cosine} END")


def _vectors(fingerprint: str, sign: int, other: str) -> str:
    """Lane by lane sum (or difference) of two fingerprints, as SQL."""
    plus = "+" if sign > 0 else "-"
    lanes = (
        f"transform(sequence(0, {SUMS + SIGNS - 1}), i -> lpad(lower(hex(pmod(cast(conv(substring({fingerprint}, 1 + 8 * i, 8), 16, 10) AS bigint) {plus} "
        f"cast(conv(substring({other}, 1 + 8 * i, 8), 16, 10) AS bigint), 4294967296L))), 8, '0'))"
    )
    return f"array_join({lanes}, '')"


def insert(fingerprint: str, other: str) -> Column:
    """The fingerprint of a text after the paragraphs of another one are added to it."""
    return F.expr(_vectors(fingerprint, 1, other))


def delete(fingerprint: str, other: str) -> Column:
    """The fingerprint of a text after the paragraphs of another one are taken out of it."""
    return F.expr(_vectors(fingerprint, -1, other))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    starts = _range_starts(docs, "doc_id")
    n = len(starts)
    table = F.array(*(F.lit(x).cast("bigint") for x in starts))
    # a null id stands with the least one
    placed = _in_ranges(docs.withColumn("_key", F.coalesce("doc_id", F.lit(starts[0]))), "_key", starts)
    first = F.col("_key") == F.element_at(table, F.col("_range") + 1)
    paired = _with_next(placed, first, n, ["_key", "text"], ["text"])
    half = "cast(length(text) DIV 2 AS int)"
    edited = paired.select(
        "_range", "_row", "doc_id", F.length("text").cast("bigint").alias("n_chars"), "text",
        F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))").alias("edited"),
    )
    both = edited.select(
        "_range", "_row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode_outer(F.array("text", "edited")).alias("_which", "_text"),
    )
    marked = lanes(both, ["_range", "_row", "doc_id", "n_chars", "edited_sha256", "_which"], "_text")
    own, other = (F.max(F.when(F.col("_which") == k, F.struct("sums", "signs"))).alias(name) for k, name in ((0, "own"), (1, "other")))
    one = marked.groupBy("_range", "_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"), own, other
    )
    one = scratch.save(one, "fingerprints")
    chained = _with_next(one.withColumnRenamed("_row", "_at"), F.col("_at") == 1, n, ["_at"], ["own"])

    def near(x: str) -> Column:
        return F.expr(f"CASE WHEN own.sums = {x}.sums AND own.signs = {x}.signs THEN 1D ELSE {_cosine('own.signs', f'{x}.signs')} END")

    return chained.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(_hex("own.sums", "own.signs")).alias("fingerprint"),
        F.expr(_hex("other.sums", "other.signs")).alias("edited_fingerprint"), near("other").alias("near_edited"), near("next_own").alias("near_next"),
    )
