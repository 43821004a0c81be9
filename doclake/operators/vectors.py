"""Vector collections as tables, and search over them.

A collection is a row of `collections` and the points that name it. Scores are computed in double and rounded to six
places before they are ranked; equal scores go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search

DISTANCES = ("COSINE", "DOT", "EUCLID")


# Definition and change.


def create_collections(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with status created or already_exists; an unknown distance means COSINE."""
    distance = F.upper("distance")
    known = F.when(distance.isin(*DISTANCES), distance).otherwise("COSINE")
    there = existing.select("name").distinct().withColumn("there", F.lit(True))
    return wanted.join(there, "name", "left").select("name", "vector_size", known.alias("distance"), F.when(F.col("there"), "already_exists").otherwise("created").alias("status"))


def delete_collections(existing: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, names with status deleted or not_found)."""
    names = names.select("name").distinct()
    there = existing.select("name").distinct().withColumn("there", F.lit(True))
    status = names.join(there, "name", "left").select("name", F.when(F.col("there"), "deleted").otherwise("not_found").alias("status"))
    return existing.join(names, "name", "left_anti"), status


def list_collections(collections: DataFrame, points: DataFrame) -> DataFrame:
    counts = points.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("points_count"))
    return collections.join(counts, "name", "left").select("name", F.coalesce("points_count", F.lit(0)).alias("points_count"))


def upsert_points(points: DataFrame, changes: DataFrame, key: str = "point_id") -> DataFrame:
    """Replace or insert by id; of changes to one id the one with the highest `batch` holds."""
    columns = points.columns
    both = points.withColumn("batch", F.lit(-1).cast("long")).unionByName(changes.select(*columns, F.col("batch").cast("long").alias("batch")))
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return both.withColumn("rank", F.row_number().over(newest)).where("rank = 1").select(*columns)


def point_key(*parts: str) -> Column:
    """A point's id from what it is made of, so that a second run gives the same."""
    return F.sha2(F.concat_ws("/", *(F.col(p).cast("string") for p in parts)), 256)


def save_embeddings(records: DataFrame, vectors: DataFrame, keys: list[str], collection: str, size: int) -> DataFrame:
    """Points from records and their vectors; a vector of another size is an error."""
    checked = F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(F.lit(f"vector size is not {size}")).cast("array<float>"))
    rows = records.join(vectors, keys).withColumn("collection", F.lit(collection)).withColumn("vector", checked)
    return rows.withColumn("point_id", point_key("collection", *keys))


def points_by_id(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_semi")


def delete_points(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_anti")


def update_payload(points: DataFrame, updates: DataFrame, fields: list[str], key: str = "point_id") -> DataFrame:
    """Fields that an update names and that aren't null replace the point's."""
    new = updates.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    joined = points.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in points.columns))


def vector_sizes(points: DataFrame) -> DataFrame:
    """Per collection the one size its vectors have, null if they differ."""
    least, most = F.min(F.size("vector")), F.max(F.size("vector"))
    return points.groupBy("collection").agg(F.when(least == most, least.cast("long")).alias("vector_size"))


def scroll(points: DataFrame, after=None, limit: int = 100, key: str = "point_id") -> DataFrame:
    """One page of payloads, by key; the next begins after its last."""
    page = points.drop("vector")
    if after is not None:
        page = page.where(F.col(key) > F.lit(after))
    return page.orderBy(key).limit(limit)


# Search.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def score(distance: str, a: Column, b: Column) -> Column:
    """Null for a zero vector under COSINE, and for vectors of different sizes."""
    if distance == "EUCLID":
        found = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    elif distance == "DOT":
        found = dot(a, b)
    else:
        found = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.round(found, search.PLACES)


def knn(points: DataFrame, query: list[float], limit: int = 10, distance: str = "COSINE", where: Column | None = None) -> DataFrame:
    """The best `limit` points for one vector; a filter applies before the ranking."""
    found = points if where is None else points.where(where)
    vector = F.array(*(F.lit(float(x)) for x in query))
    return found.withColumn("score", score(distance, F.col("vector"), vector)).orderBy(search.best_first(distance), "point_id").limit(limit)


def knn_blocks(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "COSINE") -> DataFrame:
    """The best points for each of many queries (query_id, query): query_id, point_id, score, rank. See search.py; all vectors have one size."""
    return search.knn(points, queries, limit, distance)


def knn_per_file(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "COSINE") -> DataFrame:
    """Each query against the points of its own file (query_hash) only: blocks of a file's points meet blocks of its queries."""
    asked = queries.select("query_id", "query", F.col("query_hash").alias("file_hash"))
    return search.knn_per_key(points.select("file_hash", "point_id", "vector"), asked, "file_hash", limit, distance)


def parse_vector(literal: Column, size: int) -> tuple[Column, Column]:
    """(vector, status) of comma-separated numbers: ok, bad_number or bad_size; the vector is null unless ok."""
    numbers = F.transform(F.split(literal, ","), lambda x: F.trim(x).try_cast("double"))
    status = F.when(F.exists(numbers, lambda x: x.isNull()), "bad_number").when(F.size(numbers) != size, "bad_size").otherwise("ok")
    return F.when(status == "ok", numbers), status


def indexed_flags(files: DataFrame, points: DataFrame) -> DataFrame:
    """file_hash and whether any point has it."""
    there = points.select("file_hash").distinct().withColumn("there", F.lit(True))
    return files.select("file_hash").distinct().join(there, "file_hash", "left").select("file_hash", F.coalesce("there", F.lit(False)).alias("indexed"))
