"""Dictionary apply (J1) and translated-or-original projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def apply_translations(units: DataFrame, translations: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """J1 + F9: every occurrence looks up ``(scope, text)``; no match keeps the original.

    One left equi-join, many-to-one, over a single evaluation of the units
    (a second pass just to route non-candidates around the join costs a
    re-scan or a re-parse, measured slower).  AQE broadcasts the translation
    side when its measured size is small, uses sort-merge otherwise, and
    splits a hot key (a column's most common value, say) on the large side.
    Adds ``text_out`` and ``how`` (null = untouched).
    """
    t = translations.select("scope", "text", "text_en", "how")
    return (units.join(t, ["scope", "text"], "left")
            .withColumn("text_out", F.coalesce(F.col("text_en"), F.col("text")))
            .drop("text_en"))
