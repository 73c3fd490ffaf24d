"""Graphs, caches and manifests as files: folders of pages, JSON documents, seeds."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Where things are and how they are read; an option wins over the environment, that over the default."""

    graph: str = ""
    cache: str = field(default_factory=lambda: os.environ.get("FOLIOGRAPH_CACHE", os.path.expanduser("~/.cache/foliograph")))
    max_pages: int = 25
    max_hops: int = 2
    hub_outdegree: int = 40
    min_score: float = 1.0
    origin_label: str = "page graph"


def _texts(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """(path, content) of text files; paths as they are named, not as an address writes them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select("path", F.decode("content", "utf-8").alias("content"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_pages(spark: SparkSession, graph: str, recursive: bool = True) -> DataFrame:
    """(``graph``, ``title``, ``file``, ``path``, ``content``) of the pages of a graph folder; none if it has no pages.

    ``file`` is the path below ``pages/``; the title is the file's name with its encodings undone.
    """
    folder = f"{graph}/pages"
    if not _exists(spark, folder):
        return spark.createDataFrame([], "graph string, title string, file string, path string, content string")
    file = F.regexp_replace("path", r"\A.*/pages/", "")
    title = F.regexp_replace(file, r"(?i)\.md\z", "")
    for code, char in (("___", "/"), ("%3A", ":"), ("%3F", "?"), ("%22", '"')):
        title = F.replace(title, F.lit(code), F.lit(char))
    return _texts(spark, folder, "*.[mM][dD]", recursive).select(F.lit(graph).alias("graph"), title.alias("title"), file.alias("file"), "path", "content")


def list_pages(spark: SparkSession, graph: str) -> DataFrame:
    """(``file``) of the pages directly in the folder."""
    return read_pages(spark, graph, recursive=False).select("file")


def read_assets(spark: SparkSession, graph: str) -> DataFrame:
    """(``graph``, ``asset``): names of the graph's images; their contents aren't read."""
    folder = f"{graph}/assets"
    if not _exists(spark, folder):
        return spark.createDataFrame([], "graph string, asset string")
    rows = spark.read.format("binaryFile").load(folder).select("path")
    return rows.select(F.lit(graph).alias("graph"), F.element_at(F.split("path", "/"), -1).alias("asset"))


def read_cache(spark: SparkSession, graph: str, folder: str) -> DataFrame:
    """(``graph``, ``name``, ``content``) of the files anchors stand for; images have no content."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "graph string, name string, content string")
    rows = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.when(name.rlike(r"(?i)\.(?:md|yaml)\z"), F.try_validate_utf8(F.col("content").cast("string")))
    return rows.select(F.lit(graph).alias("graph"), name.alias("name"), text.alias("content"))


def read_documents(spark: SparkSession, path: str, key: str = "manifest") -> DataFrame:
    """(``key``, ``json``) of whole JSON files: manifests, patches, page lists."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias(key), F.col("value").alias("json"))


def patch_operations(documents: DataFrame, key: str = "manifest") -> DataFrame:
    """(``key``, ``op_index``, op, title, field, value, entry, rationale) of patch files; what :func:`refused_patches` names gives none."""
    ops = F.try_variant_get(F.try_parse_json("json"), "$.operations", "array<variant>")
    rows = documents.select(key, F.posexplode(ops).alias("op_index", "o"))
    text = lambda name: F.try_variant_get("o", f"$.{name}", "string")
    raw = lambda name: F.to_json(F.try_variant_get("o", f"$.{name}", "variant"))
    title = F.coalesce(text("title"), F.try_variant_get("o", "$.entry.title", "string"))
    return rows.select(
        key, "op_index", text("op").alias("op"), title.alias("title"), text("field").alias("field"), raw("value").alias("value"), raw("entry").alias("entry"), text("rationale").alias("rationale")
    )


def refused_patches(documents: DataFrame, key: str = "manifest") -> DataFrame:
    """(``key``, ``reason``) of patch files that can't be applied at all: no JSON, or operations that are no list."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.operations", "variant"))
    reason = F.when(F.try_parse_json("json").isNull(), "not JSON").when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), "operations must be a list")
    return documents.select(key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def page_list(documents: DataFrame) -> DataFrame:
    """(``ord``, title, file, group, tier) of a list of pages to project; the tier is 'projected' unless given."""
    kind = "array<struct<title:string,file:string,group:string,tier:string>>"
    rows = documents.select(F.posexplode(F.from_json("json", kind)).alias("ord", "p"))
    return rows.select("ord", "p.title", "p.file", F.coalesce("p.group", F.lit("default")).alias("group"), F.coalesce("p.tier", F.lit("projected")).alias("tier"))


def seed_list(spark: SparkSession, graph: str, text: str) -> DataFrame:
    """(``graph``, ``title``, ``seed_order``) of titles between semicolons."""
    rows = [(graph, t.strip(), k) for k, t in enumerate(text.split(";")) if t.strip()]
    return spark.createDataFrame(rows, "graph string, title string, seed_order int")
