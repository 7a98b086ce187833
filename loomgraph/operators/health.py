"""Health scores of packages: eleven weighted signals, less ten for a dependency cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cyclic

#: Fixed weights of the signals.
WEIGHTS = {
    "has_description": 8,
    "has_license": 8,
    "has_maintainer": 5,
    "has_maintainer_email": 4,
    "has_version": 5,
    "has_readme": 10,
    "no_self_dependency": 15,
    "no_circular_deps": 10,
    "has_test_dir": 15,
    "test_deps_declared": 10,
    "has_launch_files": 10,
}
CYCLE_DEDUCTION = 10


def score(signals: DataFrame) -> DataFrame:
    """(name, score) from (name, one boolean per signal); a missing signal column is false, no_circular_deps granted at first."""
    have = set(signals.columns)
    total = F.lit(WEIGHTS["no_circular_deps"])
    for name, weight in WEIGHTS.items():
        if name in have and name != "no_circular_deps":
            total = total + F.when(F.col(name), weight).otherwise(0)
    return signals.select("name", F.least(total, F.lit(100)).cast("int").alias("score"))


def deduct_cycles(scores: DataFrame, deps: DataFrame) -> DataFrame:
    """deps: (src, dst) between package names."""
    bad = cyclic(deps).select(F.col("id").alias("name"), F.lit(True).alias("_bad"))
    return scores.join(bad, "name", "left").select(
        "name", F.greatest(F.lit(0), F.col("score") - F.when(F.col("_bad"), CYCLE_DEDUCTION).otherwise(0)).cast("int").alias("score")
    )


def workspace_score(scores: DataFrame) -> DataFrame:
    """The mean, rounded half to even; 0 without packages."""
    return scores.agg(F.coalesce(F.bround(F.avg("score")), F.lit(0)).cast("bigint").alias("score"))
