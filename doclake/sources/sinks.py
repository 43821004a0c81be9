"""Sinks: objects, records as JSON, results, graphs; and purging.

A batch is written once, under its name, however often its write is run.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

BUCKETS = 64


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _committed(spark: SparkSession, path: str, batch: str, write) -> bool:
    """Let write(folder) write apart, then put the folder in its place at once; False if this batch is there already.

    A write that was killed leaves a folder that readers don't see. Run again, the batch is written whole; run twice, once.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError("a batch's name is letters, digits, _ and -")
    target = f"{path}/batch={batch}"
    if shared.exists(spark, target):
        return False
    apart = f"{path}/_apart-{uuid.uuid4().hex}"
    write(apart)
    if not shared.move(spark, apart, target):
        shared.delete(spark, apart)  # another run of this batch was first
        return False
    return True


def write_objects(objects: DataFrame, path: str, buckets: int = BUCKETS, batch: str = "0") -> bool:
    """Contents by path, in a bounded number of folders."""
    dealt = objects.withColumn("bucket", bucket("path", buckets)).repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(97)))
    return _committed(objects.sparkSession, path, batch, lambda to: dealt.write.partitionBy("bucket").parquet(to))


def _dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """A bucket's rows are in a few tasks, so that it gets a few files, and no task gets a whole bucket of a hot key."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(7))
    return rows.withColumn("bucket", bucket(key, buckets)).repartition("bucket", salt)


def record_key() -> Column:
    """embeddings/{hash}/element_{i}.json, with _caption or _footnote for those parts."""
    suffix = F.when(F.col("part") == "main", "").otherwise(F.concat(F.lit("_"), F.col("part")))
    return F.concat(F.lit("embeddings/"), "file_hash", F.lit("/element_"), F.col("element_index").cast("string"), suffix, F.lit(".json"))


def write_records(records: DataFrame, path: str, buckets: int = BUCKETS, batch: str = "0") -> bool:
    dealt = _dealt(records.withColumn("key", record_key()), "file_hash", buckets)
    return _committed(records.sparkSession, path, batch, lambda to: dealt.write.partitionBy("bucket").json(to))


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS, batch: str = "0") -> bool:
    return _committed(results.sparkSession, path, batch, lambda to: _dealt(results, "file_hash", buckets).write.partitionBy("bucket").json(to))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, doc: str = "doc_id", buckets: int = BUCKETS, batch: str = "0") -> bool:
    """Nodes, then edges; a run between the two goes on with the edges."""
    return any([_committed(df.sparkSession, f"{path}/{name}", batch, lambda to: _dealt(df, doc, buckets).write.partitionBy("bucket").parquet(to)) for name, df in (("nodes", nodes), ("edges", edges))])  # noqa: B023


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}").drop("bucket", "batch") for name in ("nodes", "edges"))


def purge(objects: DataFrame, gone: DataFrame) -> DataFrame:
    """The objects that stay."""
    return objects.join(gone.select("path").distinct(), "path", "left_anti")


# Points by ranges of their key, for scrolling.


def write_ranges(points: DataFrame, path: str, key: str = "point_id", files: int | None = None) -> None:
    """points in files of one range of keys each, and the ranges as a table."""
    spark = points.sparkSession
    dealt = points.repartitionByRange(*([files] if files else []), key).sortWithinPartitions(key)
    dealt.write.parquet(f"{path}/points")
    read = spark.read.schema(points.schema).parquet(f"{path}/points")
    ranges = read.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n"))
    ranges.write.parquet(f"{path}/ranges")


def scroll(spark: SparkSession, path: str, like: DataFrame, after=None, limit: int = 100, key: str = "point_id") -> DataFrame:
    """One page of payloads, by key, from the files that hold it; the next page begins after its last. like: a table with the points' columns."""
    ranges = spark.read.parquet(f"{path}/ranges").orderBy("least", "most")
    if after is not None:
        ranges = ranges.where(F.col("most") > F.lit(after))
    columns = [c for c in like.columns if c != "vector"]
    schema = like.select(*columns).schema
    # The first file may hold less than a page behind `after`; all of the others' rows are.
    files: list[str] = []
    have = 0
    for row in ranges.toLocalIterator():
        files.append(row.file)
        if len(files) > 1 or after is None or row.least > after:
            have += row.n
        else:
            own = spark.read.schema(schema).parquet(row.file).where(F.col(key) > F.lit(after))
            have += own.limit(limit).count()
        if have >= limit:
            break
    if not files:
        return spark.createDataFrame([], schema)
    page = spark.read.schema(schema).parquet(*files)
    return (page if after is None else page.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
