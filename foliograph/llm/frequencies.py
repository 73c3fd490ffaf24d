"""Problem 1: how often every distinct term occurs, in how many records, and which are too rare or too common.

Method: (field, term, record) triples are range-partitioned by all three and sorted outside memory where
needed; a scan over the runs of equal terms counts occurrences and distinct records. A record is in one
partition only, so a term that half the records have spreads over several partitions, and their counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.sources import present


def term_records(records: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(``field``, ``term``, ``record``, ``n``): each term of each record with its number in the record.

    ``fields`` maps a field's name to 'array' or 'string'. Nulls and empty strings are no terms.
    """
    pieces = []
    for name, kind in fields.items():
        values = F.coalesce(F.col(name), F.array()) if kind == "array" else F.array(F.col(name))
        pieces.append(F.transform(values, _named(name)))
    return (
        records.select(F.col(key).alias("record"), F.explode(F.concat(*pieces)).alias("x"))
        .filter(present(F.col("x.term")))
        .select(F.col("x.field").alias("field"), F.col("x.term").alias("term"), "record")
        .filter(F.col("record").isNotNull())
    )


def _named(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("term"))


_RUNS = "field string, term string, occurrences bigint, records bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms over sorted batches; the last run of a batch may go on in the next."""
    open_run: list | None = None  # field, term, occurrences, records
    last_record = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, term, record = (batch.column(i) for i in range(3))
        same_term = np.zeros(n, dtype=bool)
        same_record = np.zeros(n, dtype=bool)
        if n > 1:
            equal = [pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (field, term, record)]
            same_term[1:] = equal[0] & equal[1]
            same_record[1:] = same_term[1:] & equal[2]
        start = np.flatnonzero(~same_term)
        size = np.diff(np.append(start, n))
        new = np.add.reduceat((~same_record).astype(np.int64), start)
        fields, terms = field.take(pa.array(start)).to_pylist(), term.take(pa.array(start)).to_pylist()
        sizes, news = size.tolist(), new.tolist()
        rows = []
        for k in range(len(start)):
            if open_run and k == 0 and open_run[0] == fields[0] and open_run[1] == terms[0]:
                open_run[2] += sizes[0]
                open_run[3] += news[0] - (record[0].as_py() == last_record)
                continue
            if open_run:
                rows.append(open_run)
            open_run = [fields[k], terms[k], sizes[k], news[k]]
        last_record = record[n - 1].as_py()
        if rows:
            yield _batch(rows)
    if open_run:
        yield _batch([open_run])


def _batch(rows: list[list]) -> pa.RecordBatch:
    f, t, o, r = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(f, pa.string()), pa.array(t, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())],
        names=["field", "term", "occurrences", "records"],
    )


def term_frequencies(
    records: DataFrame,
    key: str,
    fields: dict[str, str],
    partitions: int | None = None,
) -> DataFrame:
    """(``field``, ``term``, ``occurrences``, ``records``) of every distinct term.

    ``records`` has one row per ``key``; terms compare as stored, so case and blanks count. Repeated values of
    a record count as occurrences, but for one record. Null keys, null lists, null and empty values give
    nothing; an empty table gives an empty result. One range shuffle of the triples and one of the partial
    counts, of which there is about one per distinct term.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    triples = term_records(records, key, fields)
    ordered = triples.repartitionByRange(n, "field", "term", "record").sortWithinPartitions("field", "term", "record")
    return (
        ordered.mapInArrow(_scan, _RUNS)
        .groupBy("field", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def mark_terms(
    frequencies: DataFrame, total: DataFrame | int, rare_below: int = 3, common_above: float = 0.2
) -> DataFrame:
    """``frequencies`` with ``mark``: 'rare' below ``rare_below`` records, 'common' above a share of all, else null.

    ``total`` is the number of records, or a frame of one row and column that holds it. A term that is both, as
    in tables of a few records, counts as rare.
    """
    number = F.lit(total) if isinstance(total, int) else total.scalar()
    share = F.col("records") > number * F.lit(common_above)
    return frequencies.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(share, "common"))
