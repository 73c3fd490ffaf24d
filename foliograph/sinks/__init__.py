"""Writers of plans. A plan is a frame that can be looked at first; without ``apply`` nothing is written."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """The site's store, replaced as a whole."""
    records.write.mode("overwrite").format(kind).save(path)


def write_texts(plan: DataFrame, folder: str, file: str = "vault_file", text: str = "text", apply: bool = False) -> int:
    """One file per row with a text, below a folder every executor sees; returns how many there are."""
    rows = plan.filter(F.col(text).isNotNull()).select(F.col(file), F.col(text))
    if not apply:
        return rows.count()

    def put(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                _replace(target, body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    # The plan runs once: the tasks that write also count.
    return rows.mapInArrow(put, "written bigint").agg(F.coalesce(F.sum("written"), F.lit(0)).alias("n")).first()["n"]


def copy_assets(plan: DataFrame, source: str, target: str, apply: bool = False) -> list[str]:
    """Assets in state 'copied' put into ``target``; returns the missing ones, sorted."""
    if apply:
        def put(part) -> None:
            os.makedirs(target, exist_ok=True)
            for row in part:
                shutil.copyfile(os.path.join(source, row["asset"]), os.path.join(target, row["asset"]))

        plan.filter(F.col("state") == "copied").foreachPartition(put)
    return sorted(r["asset"] for r in plan.filter(F.col("state") == "missing").toLocalIterator())


def write_manifest(path: str, manifest: dict) -> None:
    """A manifest file, whole or not at all."""
    _replace(path, json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log table."""
    rows.write.mode("append").parquet(path)


def report_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, one per line."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def _replace(path: str, text: str) -> None:
    folder = os.path.dirname(path) or "."
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)
