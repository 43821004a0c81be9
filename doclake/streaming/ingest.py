"""Incremental ingestion: files that arrive in a folder are validated, keyed, deduplicated and stored, each once.

Which hashes were stored is keyed state, in a store on disk (RocksDB): a batch looks its own hashes up, and never reads what was stored before,
so its cost doesn't grow with the history. State and offsets are committed with the batch; a batch that is run again after a failure sees
the state from before it, and writes its own folder again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ingest
from ..schemas import OBJECT

#: Groups of hashes whose states are looked up together; more than a cluster has cores.
GROUPS = 4096
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else every partition's store reserves megabytes of disk, however small it is.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
STORED = ("file_hash", "filename", "pdf_key", "result_key", "size", "content")


def arrivals(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """A stream of files: filename, content."""
    reader = spark.readStream.format("binaryFile").schema(OBJECT).option("recursiveFileLookup", "true")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    rows = reader.load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("modificationTime").alias("arrived"))


def accepted(rows: DataFrame) -> DataFrame:
    """Valid uploads with their keys; no state is needed for that."""
    good = ingest.with_keys(ingest.with_hash(ingest.validate(rows).where("status = 'ok'").drop("status", "reason")))
    return good.select("file_hash", "filename", "pdf_key", "result_key", F.octet_length("content").cast("long").alias("size"), "content", "arrived")


def process(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What the batch operators make of one table: accepted files that aren't stored, the first arrival of each hash."""
    fresh = ingest.dedupe(accepted(batch).withColumn("arrival", F.struct("arrived", "filename")), stored)
    return fresh.where("status = 'success'").select(*STORED)


def _first_of_task(rows: DataFrame) -> DataFrame:
    """Of the copies that one task has only those leave it that arrived before all that left: a file that comes very often is a few rows."""
    at = [rows.columns.index(c) for c in ("file_hash", "arrived", "filename")]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        first: dict = {}
        for batch in batches:
            keep = []
            for k, (own, *arrival) in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                if own not in first or arrival < first[own]:
                    first[own] = arrival
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(cut, rows.schema)


class FirstArrivals(StatefulProcessor):
    """Gives the first row of each hash that no earlier batch had; state: the hashes of the group."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "file_hash string", "filename string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        first = pd.concat(list(rows)).sort_values(["arrived", "filename"], kind="stable").drop_duplicates("file_hash")
        first = first[[not self.seen.containsKey((h,)) for h in first["file_hash"]]]
        for h, name in zip(first["file_hash"], first["filename"]):
            self.seen.updateValue((h,), (name,))
        yield first[self.columns]

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_files(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The stream of files to store, each hash once. rows: a stream of filename, content, arrived."""
    own = _first_of_task(accepted(rows))
    grouped = own.withColumn("group", F.pmod(F.xxhash64("file_hash"), F.lit(groups)).cast("int")).groupBy("group")
    return grouped.transformWithStateInPandas(FirstArrivals(list(STORED)), own.select(*STORED).schema, "append", "None")


def run(rows: DataFrame, files: str, checkpoint: str, groups: int = GROUPS) -> StreamingQuery:
    """Process all that is there and stop. rows: a stream of filename, content, arrived. A batch writes its own folder, files/batch=n."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{files}/batch={number}")

    with _settings(rows.sparkSession, STORE):
        return new_files(rows, groups).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
