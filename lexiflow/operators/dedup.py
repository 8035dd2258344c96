"""Ordered distinct of translatable units (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.script import est_tokens, is_translatable

# A2: the source rank becomes the high bits of the order key.
RANK_SHIFT = 62


def select_translatable(units: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """F1 + F2 before anything expensive; a native predicate, so it is pushed down."""
    return units.filter(is_translatable("text", settings.profile))


def dedup_units(units: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A1: one row per ``(scope, text)``, ordered by first appearance.

    ``units`` has ``scope, ord, text, context``.  The survivor's ``ord`` is the
    minimum (``dropDuplicates`` keeps an arbitrary row).  Partial aggregation
    combines repeats map-side, so a text repeated in a third of all rows
    costs one row per task before the shuffle.
    """
    return (select_translatable(units, settings)
            .groupBy("scope", "text")
            .agg(F.min("ord").alias("ord"),
                 F.min("context").alias("context"),
                 F.count(F.lit(1)).alias("occurrences"))
            .withColumn("est", est_tokens("text", settings)))


def union_units(first: DataFrame, second: DataFrame) -> DataFrame:
    """A2: ``first`` then ``second`` as one ordered source (before A1).

    Order key = ``rank << 62 | ord``, for two sources whose ``ord`` is below 2**62.
    """
    def ranked(df, rank):
        return df.withColumn("ord", F.col("ord") + F.lit(rank << RANK_SHIFT))
    return ranked(first, 0).unionByName(ranked(second, 1))
