"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultmart.sources.schemas import TABLES

#: Columns of the manifest in CSV.
MANIFEST = ("source_document_id", "import_run_id", "root_url", "url", "document_type", "parser_profile", "content_hash", "archive_path", "archive_sha256", "archive_status", "archive_reason", "parse_status", "fetched_at")


def load_layer(spark: SparkSession, root: str, names: list[str] | None = None, views: bool = True) -> dict[str, DataFrame]:
    """The tables of a layer by name, read with their schemas; temporary views too unless ``views`` is false."""
    out = {}
    for name in names or TABLES:
        out[name] = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def empty_layer(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def write_layer(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Where that setting is absent, a local master takes a temporary folder; on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each entry of ``profiles`` in a JSON file, with its place."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("profiles").alias("ordinal", "profile")).select("ordinal", "profile.*")


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as text; blank cells are null."""
    df = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in MANIFEST)).csv(path)
    return df.select([F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns])


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A corpus of documents: Parquet with url and body, or files whose paths are their URLs where ``pattern`` names them."""
    if pattern is None:
        return spark.read.parquet(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def write_manifest(df: DataFrame, root: str) -> None:
    """JSON lines with the metadata, and CSV without it."""
    df.write.json(f"{root}/json")
    df.select([F.col(c).cast("string") for c in MANIFEST if c in df.columns]).write.option("header", True).csv(f"{root}/csv")


def write_catalog(df: DataFrame, root: str) -> None:
    df.write.json(f"{root}/json")
    flat = [F.to_json(c).alias(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in df.dtypes]
    df.select(flat).write.option("header", True).csv(f"{root}/csv")


def json_report(**parts: DataFrame) -> DataFrame:
    """One row of JSON with the rows of small reports under their names."""
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).select(F.lit(None).alias("_"))
    for name, df in parts.items():
        out = out.crossJoin(df.agg(F.collect_list(F.struct(*df.columns)).alias(name)))  # one row each
    return out.drop("_").select(F.to_json(F.struct(*parts)).alias("report"))


def seed_rows(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Given rows of a table, for instance of a registry."""
    return spark.createDataFrame(rows, TABLES[name])
