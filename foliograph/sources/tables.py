"""Parquet tables and the rule for rows that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Table ``name`` below ``base``; a lazy scan, so later selects prune its columns."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def present(c: Column) -> Column:
    """True where a string is a value: neither null nor empty."""
    return c.isNotNull() & (c != "")


def latest_rows(df: DataFrame, key: str, columns: list[str], loaded_at: str = "loaded_at") -> DataFrame:
    """One row per ``key``: of all its deliveries the one loaded last, with ``columns``.

    Rows that tie in ``loaded_at`` count as equal. A null ``loaded_at`` sorts before every other. Rows without
    a key can't be reported by any query and are left out. Only ``key`` and ``columns`` travel through the
    shuffle, and each task combines its own rows first.
    """
    when = F.coalesce(F.col(loaded_at).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    row = F.struct(*[F.col(c) for c in columns])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.max_by(row, when).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in columns])
    )
