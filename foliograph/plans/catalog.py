"""All queries outside the training-data subpackage, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.plans import goldens, manifests, pages, references, regions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**references.QUERIES, **pages.QUERIES, **regions.QUERIES, **manifests.QUERIES, **goldens.QUERIES}
SQL: dict[str, str] = {**references.SQL, **pages.SQL, **regions.SQL, **manifests.SQL, **goldens.SQL}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Pages selected around the seeds of every manifest."""
    return pages.r_subgraph(spark, base)
