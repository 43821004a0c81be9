"""Queries that write and read again: streaming ingestion and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..operators import elements, graph
from ..sources import sinks
from ..streaming import ingest as stream
from . import fixtures as fx
from .fixtures import table, with_
from .retrieval import _EDGES, _NODES

QUERIES = {}
SQL = {
    "incremental_ingest": "select distinct md5(text) as file_hash, strlen(text)::bigint as size from documents where doc_id % 11 <> 0 and text <> ''",
    "scroll_ranges": with_("points") + "select point_id, collection, file_hash, element_index from points where point_id > 99 order by point_id limit 100",
    "write_objects": with_("uploads") + "select 'pdfs/' || arrival || '_' || filename as path, md5(content) as file_hash from uploads",
    "write_results": with_("lines") + "select file_hash, count(*) as n_lines from lines group by file_hash",
    "write_graph": with_("elements", then=f"{_NODES}, {_EDGES}") + "select doc_id, rel, src, dst from edges",
    "write_records": with_("records") + "select file_hash, element_index, part, element_type, content, 'embeddings/' || file_hash || '/element_' || element_index || case part when 'main' then '' else '_' || part end || '.json' as key from kept",
}

folder = shared.folder


def _query(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@_query("incremental_ingest")
def _(spark, sf):
    """Documents arrive as a stream of uploads, an eighth of the files at a time."""
    own = folder(spark)
    docs = f"{own}/arrived"
    table(spark, sf, "documents").select("doc_id", "text").write.parquet(docs)
    # About eight batches, however many files there are.
    per_batch = -(-len(spark.read.parquet(docs).inputFiles()) // 8)
    rows = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", per_batch).parquet(docs).where("text is not null")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".pdf"))
    stream.run(rows.select(name.alias("filename"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("arrived")), f"{own}/files", f"{own}/state").awaitTermination()
    return spark.read.parquet(f"{own}/files").select("file_hash", "size")


@_query("write_objects")
def _(spark, sf):
    """Written twice, as by a run that was repeated: once."""
    own = folder(spark)
    for _ in range(2):
        sinks.write_objects(fx.uploads(spark, sf).select(F.concat(F.lit("pdfs/"), F.col("arrival").cast("string"), F.lit("_"), "filename").alias("path"), "content"), own)
    return spark.read.parquet(own).select("path", F.md5("content").alias("file_hash"))


@_query("write_results")
def _(spark, sf):
    own = folder(spark)
    sinks.write_results(fx.lines(spark, sf).groupBy("file_hash").agg(F.count("*").alias("n_lines")), own)
    return spark.read.schema("file_hash string, n_lines long, bucket int").json(own).select("file_hash", "n_lines")


@_query("write_graph")
def _(spark, sf):
    own = folder(spark)
    nodes = graph.regions_full(fx.elements(spark, sf))
    sinks.write_graph(nodes, graph.order_edges(nodes).unionByName(graph.parent_edges(nodes)), own)
    return sinks.read_graph(spark, own)[1].select("doc_id", "rel", "src", "dst")


@_query("write_records")
def _(spark, sf):
    own = folder(spark)
    sinks.write_records(elements.explode_records(fx.elements(spark, sf), fx.images(spark, sf)).select("file_hash", "element_index", "part", "element_type", "content"), own)
    return spark.read.schema("file_hash string, element_index long, part string, element_type string, content string, key string, bucket int").json(own).drop("bucket", "batch")


@_query("scroll_ranges")
def _(spark, sf):
    """The page of scroll_points from points that are laid out by ranges of ids."""
    own, points = folder(spark), fx.points(spark, sf)
    sinks.write_ranges(points, own, files=16)
    return sinks.scroll(spark, own, points, after=99, limit=100).select("point_id", "collection", "file_hash", "element_index")
