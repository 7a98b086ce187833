"""Semi and anti joins of wide tables by id that shuffle only the wide rows that may match.

A bitmap of bounded size, built from the ids by bitwise OR, is broadcast; rows whose bit is
unset cannot match and never move. The exact join that follows sees the rest only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the bitmap: as many as there are ids, within these bounds; at most 4 million bits an id's eighth fills.
FEWEST, MOST = 1 << 12, 1 << 18


def _marked(wide: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """wide with working columns of names that it does not have, and the condition that a row may match."""
    size = max(FEWEST, min(MOST, 1 << (max(1, ids.count() // 8) - 1).bit_length()))
    taken = {c.lower() for c in wide.columns}
    word, at, bits = (next(x for x in (f"_{name}{k or ''}" for k in range(len(taken) + 1)) if x not in taken) for name in ("word", "bit", "bits"))
    bit = F.pmod(F.xxhash64(F.lit(17), F.col(f"`{key}`")), F.lit(size * 64))
    bitmap = (
        ids.filter(F.col(f"`{key}`").isNotNull())
        .select(F.floor(bit / 64).cast("int").alias(word), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("at"))
        .groupBy(word).agg(F.bit_or(F.expr("shiftleft(one, at)")).alias(bits))
    )
    marked = wide.withColumns({word: F.floor(bit / 64).cast("int"), at: (bit % 64).cast("int")}).join(F.broadcast(bitmap), word, "left")
    return marked, F.expr(f"coalesce(shiftrightunsigned({bits}, {at}) & 1L, 0L) = 1L")


def semi_join(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of wide whose key is in ids, a saved table; null keys never match."""
    own = [F.col(f"`{c}`") for c in wide.columns]
    marked, maybe = _marked(wide, ids, key)
    return marked.filter(maybe).select(*own).join(ids.select(key).distinct(), key, "left_semi").select(*own)


def anti_join(wide: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of wide whose key is not in ids, a saved table; rows with a null key stay."""
    own = [F.col(f"`{c}`") for c in wide.columns]
    marked, maybe = _marked(wide, ids, key)
    clear = marked.filter(~maybe).select(*own)
    rest = marked.filter(maybe).select(*own)
    return clear.unionAll(rest.join(ids.select(key), key, "left_anti").select(*own))
