"""A border between projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each of which is computed once, whatever uses it later.

    A projection may be merged into the next, and an expression that a lambda there refers to would then be
    evaluated for every element. Rows that come from a generator are a border for that.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_stage")
    return df.select(*keep, one).select(*keep, *[F.col("_stage")[n].alias(n) for n in columns])
