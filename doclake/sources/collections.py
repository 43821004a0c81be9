"""Collections that are stored: a catalog, and points by collection and bucket. A change writes the buckets that it touches, and no others.

Layout below a root: catalog/ (name, vector_size, distance), points/collection=<name>/bucket=<n>/. A change finds its buckets from the ids that it
names, reads these buckets (partition pruning by the join with the change), and puts their new content in their place. Buckets that
a change leaves empty, and the buckets of deleted collections, are removed. One writer at a time; what a change will write is written
apart first, so a change that fails before the last step leaves all as it was, and can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import vectors

#: Buckets of a collection: a parameter of the store, the same for all of its changes.
BUCKETS = 256
CATALOG = "name string, vector_size long, distance string"


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """name, vector_size, distance of every collection."""
    if not shared.exists(spark, f"{root}/catalog"):
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).parquet(f"{root}/catalog")


def create(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Add collections to the catalog; wanted with status created or already_exists."""
    found = shared.written(vectors.create_collections(catalog(spark, root), wanted), "created")
    found.where("status = 'created'").select("name", "vector_size", "distance").dropDuplicates(["name"]).write.mode("append").parquet(f"{root}/catalog")
    return found


def drop(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """Remove collections and their points; names with status deleted or not_found."""
    left, status = vectors.delete_collections(catalog(spark, root), names)
    left, status = shared.written(left, "left"), shared.written(status, "status")
    left.write.mode("overwrite").parquet(f"{root}/catalog")
    for row in status.where("status = 'deleted'").select("name").toLocalIterator():
        shared.delete(spark, f"{root}/points/collection={_escaped(row.name)}")
    return status


def _escaped(name: str) -> str:
    """As Spark writes a value into a folder's name."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or c < " " or c == "\x7f" else c for c in name)


def points(spark: SparkSession, root: str, columns: DataFrame) -> DataFrame:
    """All points, with the columns of another table of points."""
    schema = columns.schema if "bucket" in columns.columns else columns.select("*", F.lit(0).alias("bucket")).schema
    if not shared.exists(spark, f"{root}/points"):
        return spark.createDataFrame([], schema)
    # Names like numbers stay text, since the schema is given.
    return spark.read.schema(schema).parquet(f"{root}/points").select(*schema.names)


def _touched(spark: SparkSession, root: str, changes: DataFrame, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the buckets of the changes, what is stored in these)."""
    touched = changes.select("collection", "bucket").distinct()
    stored = points(spark, root, like)
    return touched, stored.join(F.broadcast(touched), ["collection", "bucket"], "left_semi").select(*stored.columns)


def _replace(spark: SparkSession, root: str, touched: DataFrame, content: DataFrame) -> None:
    """The content of the touched buckets, in place of what is there."""
    content = shared.written(content, "changed")
    salt = F.pmod(F.xxhash64("point_id", F.lit(1)), F.lit(4))
    content.repartition("collection", "bucket", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "bucket").parquet(f"{root}/points")
    # At most the touched buckets, one delete each.
    for row in touched.join(content.select("collection", "bucket").distinct(), ["collection", "bucket"], "left_anti").toLocalIterator():
        shared.delete(spark, f"{root}/points/collection={_escaped(row.collection)}/bucket={row.bucket}")


def upsert(root: str, changes: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace or insert by collection and point_id; of changes to one id the one with the highest `batch` holds."""
    spark = changes.sparkSession
    columns = [c for c in changes.columns if c != "batch"]
    newest = changes.groupBy("collection", "point_id").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("x.*")
    newest = shared.written(newest.withColumn("bucket", bucket("point_id", buckets)), "newest")
    touched, old = _touched(spark, root, newest, newest)
    kept = old.join(newest.select("collection", "point_id"), ["collection", "point_id"], "left_anti")
    _replace(spark, root, touched, kept.select(*newest.columns).unionByName(newest))


def delete(root: str, ids: DataFrame, like: DataFrame, buckets: int = BUCKETS) -> None:
    """Remove the points that ids (collection, point_id) name. like: a table with the points' columns."""
    spark = ids.sparkSession
    gone = shared.written(ids.select("collection", "point_id").distinct().withColumn("bucket", bucket("point_id", buckets)), "gone")
    touched, old = _touched(spark, root, gone, like)
    _replace(spark, root, touched, old.join(gone.select("collection", "point_id"), ["collection", "point_id"], "left_anti").select(*old.columns))


def update_payload(root: str, updates: DataFrame, fields: list[str], like: DataFrame, buckets: int = BUCKETS) -> None:
    """Fields that an update (collection, point_id, fields) names and that aren't null replace the point's; ids that aren't there are left out."""
    spark = updates.sparkSession
    own = shared.written(updates.select("collection", "point_id", *fields).withColumn("bucket", bucket("point_id", buckets)), "updates")
    touched, old = _touched(spark, root, own, like)
    new = own.select("collection", "point_id", *(F.col(f).alias(f"new_{f}") for f in fields))
    joined = old.join(new, ["collection", "point_id"], "left")
    _replace(spark, root, touched, joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns)))
