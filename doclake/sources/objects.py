"""Objects (files) as tables: prefixes, parse results, images. store.py lists and reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalog

# File endings.
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
ACCEPTED = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")


def with_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(F.col("path").startswith(prefix))


def stat(objects: DataFrame) -> DataFrame:
    return objects.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def exists(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    there = objects.select("path").distinct().withColumn("there", F.lit(True))
    return wanted.select("path").distinct().join(there, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("exists"))


def parse_results(rows: DataFrame, text: str = "value") -> DataFrame:
    """content_list as an array of JSON strings, empty if the path is missing or the JSON is broken."""
    found = F.get_json_object(F.col(text), "$.results.result.results.content_list")
    return rows.withColumn("content_list", F.coalesce(F.from_json(found, "array<string>"), F.array().cast("array<string>"))).drop(text)


def hash_of_result(path: Column, folder: str = "results") -> Column:
    """The hash in the key {folder}/{hash}_... of a parse result; empty if it is no such key."""
    return F.regexp_extract(path, f"^{folder}/([^_/]*)_", 1)


def result_of_hash(objects: DataFrame, hashes: DataFrame, folder: str = "results") -> DataFrame:
    """file_hash and the first object {folder}/{hash}_... of it; hashes without one are left out."""
    own = objects.withColumn("file_hash", hash_of_result(F.col("path"), folder)).where("file_hash <> ''")
    return own.join(hashes.select("file_hash").distinct(), "file_hash", "left_semi").groupBy("file_hash").agg(F.min("path").alias("path"))


def file_of_hash(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """file_hash and the first object whose name begins with pdfs/{hash}, whatever follows; 32 hexadecimal digits."""
    own = objects.withColumn("file_hash", F.regexp_extract("path", "^pdfs/([0-9a-f]{32})", 1)).where("file_hash <> ''")
    return own.join(hashes.select("file_hash").distinct(), "file_hash", "left_semi").groupBy("file_hash").agg(F.min("path").alias("path"), F.min_by("length", "path").alias("length"))


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def images_base64(objects: DataFrame) -> DataFrame:
    """name and base64 of every picture."""
    return objects.where(ending(F.col("path")).isin(*IMAGES)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.base64("content").alias("image_base64"))


def route(path: Column) -> Column:
    end = ending(path)
    return F.when(end == ".pdf", "document").when(end.isin(*ACCEPTED), "image").otherwise("rejected")


def uploaded(objects: DataFrame) -> DataFrame:
    return catalog.uploaded_files(objects)
