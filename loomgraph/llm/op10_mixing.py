"""Mixing sources to target weights by entropy balancing.

The size of a document is its number of words. Sources, in code point order with null last,
get shares of all sizes by weights; a target stops at MOST_COPIES times its source's size and
the excess is shared again among the others. Among all rates of documents whose words add up
to the target, those nearest to 1 in relative entropy are exponentially tilted by the size:
rate = min(MOST_COPIES, exp(lambda * size / mean size)), with one multiplier for each source. The
multipliers are the root of the convex dual's gradient, sum(size * rate) - target, and are found
by Newton steps between bounds; a step is one pass over the table of distinct sizes of each
source, made once, and returns a gradient and a curvature for each source.

Rates become whole copies: a document takes floor(rate), and one more if its key, a fixed hash
in [0, 1) less the rate's fraction, lies below a cut near 0. A histogram of the keys, weighted by
size, gives the highest cut that stays within the target; the bin in which it lies is divided
again, until less than CLOSE of the target is open. What is left then is filled in the same way
by documents no larger than the rest. Nothing depends on partitioning, so reruns agree.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of
its own; repeated rows count each and are numbered among themselves, so some of them may take one copy more
than others, and as many of them in every run; an empty table gives an empty result; extra columns are ignored. Sources
are a mixture's parts: more than MOST_SOURCES raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import scratch
from .idfilter import anti_join, semi_join

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
MOST_SOURCES = 500
#: Keys have 63 bits: 24 of the hash less the fraction, 24 more of the document's hash, 15 of the row's.
KEY_BITS, DOC_BITS, ROW_BITS = 63, 24, 15
#: Bins of a histogram as a power of two; MOST_SOURCES times as many rows reach the driver at most.
BIN_BITS = 10
#: Passes that divide bins, at most.
ROUNDS = 12
#: Share of a target that may be left open.
CLOSE = 0.0005
TOLERANCE = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS) -> dict[str | None, float]:
    """Words to take from each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, rest = list(order), float(sum(sizes.values()))
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > MOST_COPIES * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in left}
            break
        for s in over:
            out[s] = float(MOST_COPIES * sizes[s])
        rest -= sum(out[s] for s in over)
        left = [s for s in left if s not in out]
    return {s: out[s] for s in order}


def _by_source(spark, values: dict[str | None, tuple], schema: str) -> DataFrame:
    """A table of one row per source; MOST_SOURCES bounds it."""
    return F.broadcast(spark.createDataFrame([(s, *v) for s, v in values.items()], f"_source string, {schema}"))


def _with(sized: DataFrame, table: DataFrame) -> DataFrame:
    return sized.join(table, F.col("_part").eqNullSafe(F.col("_source"))).drop("_source")


#: A rate by the multiplier and the scale of its source; the exponent is bounded, so that exp() never overflows.
_LIMIT = math.log(MOST_COPIES)
_RATE = f"if(tilt * size >= {_LIMIT!r}D * scale, {MOST_COPIES}D, exp(tilt * size / scale))"


def balance(sizes: DataFrame, goal: dict[str | None, float], total: dict[str | None, int], rounds: int = 100) -> dict[str | None, tuple[float, float]]:
    """(lambda, scale) by source. sizes: (_part, size, n), how many documents of each size; only sizes above 0.

    Infinite multipliers: all documents at the bound, or none.
    """
    spark = sizes.sparkSession
    means = {r["_part"]: r["mean"] for r in sizes.groupBy("_part").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    done: dict[str | None, tuple[float, float]] = {}
    at: dict[str | None, tuple[float, float, float]] = {}  # the multiplier and the bounds that it is known to lie in
    for s in goal:
        if total[s] == 0 or goal[s] <= 0:
            done[s] = (-math.inf, 1.0)
        elif goal[s] >= MOST_COPIES * total[s]:
            done[s] = (math.inf, 1.0)
        else:
            at[s] = (0.0, -math.inf, math.inf)
    for _ in range(rounds):
        if not at:
            break
        table = _by_source(spark, {s: (x[0], means[s]) for s, x in at.items()}, "tilt double, scale double")
        rated = _with(sizes, table).withColumn("taken", F.expr(f"size * double(n) * {_RATE}"))
        slope = F.expr(f"if(tilt * size >= {_LIMIT!r}D * scale, 0D, taken * size / scale)")
        for r in rated.groupBy("_part").agg(F.sum("taken").alias("taken"), F.sum(slope).alias("slope")).collect():
            s = r["_part"]
            tilt, low, high = at[s]
            gradient = r["taken"] - goal[s]
            if abs(gradient) <= TOLERANCE * goal[s] or high - low <= 1e-15 * max(1.0, abs(tilt)):
                done[s] = (tilt, means[s])
                del at[s]
                continue
            low, high = (low, tilt) if gradient > 0 else (tilt, high)
            step = tilt - gradient / r["slope"] if r["slope"] > 0 else math.nan
            if not low < step < high:  # Newton leaves the bounds, or there is no slope: halve them, or go out twice as far
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * max(1.0, tilt) if gradient < 0 else 2 * min(-1.0, tilt))
            at[s] = (step, low, high)
    return done | {s: (x[0], means[s]) for s, x in at.items()}


_FIXED = "tilt double, scale double"
_OPEN = "cuts array<struct<top: bigint, below: bigint>>, top bigint, low bigint, high bigint"
_TAKEN = "exists(cuts, c -> size <= c.top AND key < c.below)"


def _keyed(sized: DataFrame) -> DataFrame:
    """Adds base, the copies that are certain, and key. sized: with tilt and scale, u in [0, 1), doc and row."""
    least = MOST_COPIES - 1
    rated = sized.withColumn("rate", F.expr(f"if(size = 0, 0D, {_RATE})")).withColumn("base", F.expr(f"least({least}, cast(floor(rate) AS int))"))
    place = F.expr("cast(floor((u - (rate - base) + 1) * 8388607D) AS bigint)")  # 0 to 2^24 - 1
    bits = DOC_BITS + ROW_BITS
    return rated.withColumn("key", F.shiftleft(place, bits) + F.shiftleft("doc", ROW_BITS) + F.col("row")).drop("rate")


def _alone(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.lit(0).cast("bigint"))


def _told_apart(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Adds row: 0, or a hash of a number among the rows that agree in all that the result shows; twice: the saved `known` of such rows.

    Which of them has which number does not matter, and all numbers are given in every run, however the rows are dealt.
    """
    several = semi_join(rows, twice, "known").withColumn("_any", F.monotonically_increasing_id())
    numbers = numbered(several, ["known"], ["_any"], "_nth").withColumn("row", F.pmod(F.xxhash64("known", "_nth"), F.lit(1 << ROW_BITS)))
    return _alone(anti_join(rows, twice, "known")).unionByName(numbers.drop("_any", "_nth"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) and the columns named in keep."""
    spark = docs.sparkSession
    known = F.xxhash64(F.lit(10), "doc_id", "text", "source", *(F.col(f"`{c}`") for c in keep))
    wide = docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").alias("_part"), word_count().alias("size"),
        (F.pmod(known, F.lit(1 << 30)) / float(1 << 30)).alias("u"), F.pmod(F.shiftright(known, 30), F.lit(1 << DOC_BITS)).alias("doc"),
        known.alias("known"), *(F.col(f"`{c}`").alias(f"_kept{k}") for k, c in enumerate(keep)),
    )
    plain = scratch.save(wide.select("doc_id", "_part", "size", "u", "doc", "known"), "sized")
    twice = scratch.save(plain.groupBy("known").count().filter("count > 1").select("known"), "twice")
    some = not twice.isEmpty()
    sized = scratch.save(_told_apart(plain, twice), "sized") if some else _alone(plain)
    if keep:
        wide = _told_apart(wide, twice) if some else _alone(wide)
    sizes = scratch.save(sized.groupBy("_part", "size").agg(F.count("*").alias("n")), "sizes")
    rows = sizes.groupBy("_part").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = {r["_part"]: r["size"] for r in rows}
    goal = targets(total, weights)
    tilts = balance(sizes.filter("size > 0"), goal, total)
    cuts = _cuts(sized, sizes, goal, tilts)
    table = _by_source(
        spark, {s: (*tilts[s], total[s], goal[s], cuts[s]) for s in goal},
        f"{_FIXED}, source_size bigint, target double, cuts array<struct<top: bigint, below: bigint>>",
    )
    copies = F.col("base") + F.expr(f"cast({_TAKEN} AS int)")
    return _keyed(_with(wide if keep else sized, table)).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *(F.col(f"_kept{k}").alias(c) for k, c in enumerate(keep)),
    )


def _cuts(sized: DataFrame, sizes: DataFrame, goal: dict[str | None, float], tilts: dict[str | None, tuple[float, float]]) -> dict[str | None, list[tuple[int, int]]]:
    """By source, (top, below): documents of at most top words whose key is less than below take one more copy."""
    spark = sized.sparkSession
    most = MOST_COPIES - 1
    fixed = _with(sizes, _by_source(spark, tilts, _FIXED)).withColumn("sure", F.expr(f"if(size = 0, 0D, size * double(n) * least({most}, floor({_RATE})))"))
    sure = {r["_part"]: r["sure"] for r in fixed.groupBy("_part").agg(F.sum("sure").alias("sure")).collect()}
    left = {s: goal[s] - sure.get(s, 0.0) for s in goal}
    whole = ((1 << 63) - 1, 0, (1 << KEY_BITS) - 1)
    cuts: dict[str | None, list[tuple[int, int]]] = {s: [] for s in goal}
    # (top, low, high): what is below low is taken, and the cut lies between low and high
    at = {s: whole for s, x in left.items() if x >= max(1.0, CLOSE * goal[s])}
    for _ in range(ROUNDS):
        if not at:
            break
        table = _by_source(spark, {s: (*tilts[s], cuts[s], *x) for s, x in at.items()}, f"{_FIXED}, {_OPEN}")
        near = _keyed(_with(sized, table)).filter(f"size > 0 AND size <= top AND key >= low AND key < high AND NOT {_TAKEN}")
        step = {s: max(1, (x[2] - x[1]) >> BIN_BITS) for s, x in at.items()}
        bins = _with(near, _by_source(spark, {s: (n,) for s, n in step.items()}, "step bigint"))
        heights: dict[str | None, dict[int, int]] = {s: {} for s in at}
        many: dict[tuple[str | None, int], int] = {}
        for r in bins.groupBy("_part", F.expr("(key - low) DIV step").alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            heights[r["_part"]][r["bin"]], many[r["_part"], r["bin"]] = r["size"], r["n"]
        for s in list(at):
            top, low, high = at[s]
            edge, alone = high, False
            for k in sorted(heights[s]):
                if heights[s][k] > left[s]:
                    edge, alone = low + k * step[s], many[s, k] == 1
                    break
                left[s] -= heights[s][k]
            if left[s] < max(1.0, CLOSE * goal[s]) or (edge == high and not heights[s]):
                cuts[s].append((top, edge))
                del at[s]
            elif edge == high or alone or step[s] == 1:
                # the next document is larger than the rest: fill with smaller ones
                cuts[s].append((top, edge))
                at[s] = (int(left[s]), 0, whole[2])
            else:
                at[s] = (top, edge, min(edge + step[s], high))
    for s, (top, low, _) in at.items():
        cuts[s].append((top, low))
    return cuts
