"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A null id is treated as this one, the largest.
NO_ID = 2**63 - 1

_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of our own only where a local session names none (tests)."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="doclake-")
    return _own_root


#: With it, Spark removes an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Executions in here leave no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and frees the shuffles before it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these. Only when all that was read from them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string) of a table whose other columns may have any names."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def given_id(col="doc_id"):
    """Back from NO_ID to null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != NO_ID, col)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of value over all rows before, in the given order, without one task seeing all rows.

    Rows are dealt out by range and kept with their partition's number; each row's sum is that of the
    earlier partitions (one row a partition) and that within its own.
    """
    width = shuffle_width(df.sparkSession)
    part, base = fresh(df, "part"), fresh(df, "base")
    dealt = stored(df.repartitionByRange(width, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(F.sum(value).alias(base))
    totals = totals.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long").alias(base))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # totals has one row a partition, so its size does not grow with the rows.
    joined = dealt.join(F.broadcast(totals), part)
    return joined.withColumn(out, (F.col(base) + F.coalesce(F.sum(value).over(own), F.lit(0))).cast("long")).drop(part, base)


#: A key of fewer rows is never heavy.
HEAVY = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right, whose keys are unique and whose column `rows` counts a key's rows in left (or is more).

    A key is heavy if it has more than a sixteenth of a partition's share of the counted rows, so there are at most 16 a partition of
    them, however large the input: these are broadcast, and their rows stay where they are. left should be cheap to read twice.
    """
    keys = [key] if isinstance(key, str) else key
    right = right if hasattr(right, "_stored_at") else stored(right, "counted")
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = max(HEAVY, total // (16 * shuffle_width(left.sparkSession)))
    heavy = right.where(F.col(rows) > limit)
    if heavy.isEmpty():
        return left.join(right.drop(rows), key, how)
    light = left.join(F.broadcast(heavy.select(*keys)), key, "left_anti").join(right.where(F.col(rows) <= limit).drop(rows), key, how)
    return left.join(F.broadcast(heavy.drop(rows)), key).unionByName(light)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))
