"""Uploads: validation, keys, deduplication and what is stored of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(uploads: DataFrame) -> DataFrame:
    """uploads with status ok or rejected and the reason: no_name, not_pdf, path_in_name, empty (the first that holds)."""
    name = F.coalesce("filename", F.lit(""))
    reason = F.when(name == "", "no_name").when(~F.lower(name).endswith(".pdf"), "not_pdf").when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "path_in_name").when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty")
    return uploads.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))


def with_hash(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("file_hash", F.md5("content"))


def with_keys(uploads: DataFrame, results: str = "results") -> DataFrame:
    folder = F.concat("file_hash", F.lit("_"), "filename")
    return uploads.withColumn("pdf_key", F.concat(F.lit("pdfs/"), folder, F.lit("/"), "filename")).withColumn("result_key", F.concat(F.lit(f"{results}/"), folder, F.lit("/result.json")))


def dedupe(uploads: DataFrame, stored: DataFrame | None = None, arrival: str = "arrival") -> DataFrame:
    """status success for the first upload of a hash that isn't stored yet, already_processed for all others; arrivals differ.

    The first arrival of a hash is found by an aggregate, which combines before it is shuffled, however many copies there are.
    """
    firsts = uploads.groupBy("file_hash").agg(F.min(arrival).alias("first_arrival"))
    out = uploads.join(firsts, uploads["file_hash"].eqNullSafe(firsts["file_hash"])).drop(firsts["file_hash"])
    out = out.withColumn("first", F.col(arrival) == F.col("first_arrival")).drop("first_arrival")
    if stored is None:
        there = F.lit(False)
    else:
        out = out.join(stored.select("file_hash").distinct().withColumn("there", F.lit(True)), "file_hash", "left")
        there = F.coalesce("there", F.lit(False))
    out = out.withColumn("status", F.when(F.col("first") & ~there, "success").otherwise("already_processed"))
    return out.drop("first", "there")


def stamp(results: DataFrame, at: Column | None = None) -> DataFrame:
    """results with metadata: file_hash, original_filename and processed_at as ISO text."""
    when = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return results.withColumn("metadata", F.struct("file_hash", F.col("filename").alias("original_filename"), when.alias("processed_at")))


def explode_images(results: DataFrame, column: str = "images_base64") -> DataFrame:
    """An object images/{key} a decoded image; what isn't base64 is left out."""
    rows = results.select("file_hash", F.explode(F.from_json(column, "map<string,string>")).alias("name", "encoded"))
    rows = rows.withColumn("content", F.try_to_binary("encoded", F.lit("base64")))
    return rows.where("content is not null").select("file_hash", F.concat(F.lit("images/"), "name").alias("path"), "content")


def summary(uploads: DataFrame, records: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Per upload: status, keys, how many embeddings its file has and whether its graph is there."""
    n = records.groupBy("file_hash").agg(F.count("*").alias("embeddings_computed"))
    graphs = graph_nodes.select("file_hash").distinct().withColumn("g", F.lit(True))
    new = F.col("status") == "success"
    out = uploads.join(n, "file_hash", "left").join(graphs, "file_hash", "left")
    computed = F.when(new, F.coalesce("embeddings_computed", F.lit(0))).otherwise(0)
    return out.withColumn("embeddings_computed", computed.cast("long")).withColumn("graph_created", new & F.coalesce("g", F.lit(False))).drop("g")


def object_name(key: Column) -> Column:
    """The key percent-encoded, its slashes kept."""
    encoded = F.array_join(F.transform(F.split(key, "/"), F.url_encode), "/")
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
