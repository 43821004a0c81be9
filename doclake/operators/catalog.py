"""File and collection catalogs, from object paths pdfs/{hash}_{name}/{name} or pdfs/{hash}_{name}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def parse_path(path: Column) -> tuple[Column, Column]:
    """(file_hash, file_name); a folder without an underscore has the hash `unknown`."""
    parts = F.split(path, "/")
    folder = F.get(parts, F.lit(1))
    rest = F.element_at(F.split(folder, "_", 2), -1)
    file_hash = F.when(F.contains(folder, F.lit("_")), F.get(F.split(folder, "_", 2), F.lit(0))).otherwise(UNKNOWN)
    return file_hash, F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise(rest)


def parsed(objects: DataFrame, prefix: str = "pdfs/") -> DataFrame:
    file_hash, name = parse_path(F.col("path"))
    return objects.where(F.col("path").startswith(prefix)).withColumn("file_hash", file_hash).withColumn("file_name", name)


def uploaded_files(objects: DataFrame) -> DataFrame:
    """One row a hash: the object with the least path. A hash of many objects is reduced before it is shuffled."""
    found = parsed(objects)
    others = [c for c in found.columns if c not in ("file_hash", "path")]
    first = found.groupBy("file_hash").agg(F.min_by(F.struct("path", *others), "path").alias("o"))
    return first.select("file_hash", "o.*")


def collection_files(points: DataFrame, files: DataFrame) -> DataFrame:
    """Collection and file for each file that has points there; points without a file are left out."""
    return points.select("collection", "file_hash").distinct().join(files, "file_hash")


def collection_files_or_unknown(points: DataFrame, files: DataFrame) -> DataFrame:
    """The same, with a made-up name where the file is not found."""
    found = points.select("collection", "file_hash").distinct().join(files.select("file_hash", "file_name"), "file_hash", "left")
    return found.withColumn("file_name", F.coalesce("file_name", F.concat(F.lit("unknown_"), F.substring("file_hash", 1, 8))))


def index_coverage(**have: DataFrame) -> DataFrame:
    """file_hash and has_<name> for each given table with a file_hash: one union and one aggregation."""
    rows = None
    for name, df in have.items():
        own = df.select("file_hash").distinct().select("file_hash", *((F.lit(name == n)).alias(f"has_{n}") for n in have))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("file_hash").agg(*(F.max(f"has_{n}").alias(f"has_{n}") for n in have))


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
