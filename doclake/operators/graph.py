"""The document graph: nodes and edges as tables.

Nodes have a document, a dense node_id in reading order and a label; the document itself is node -1. ORDER edges
chain the nodes; PARENT edges hang content under the last header before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared

ROOT = -1
CONTENT = ("text", "table", "image")


def _numbered(rows: DataFrame, doc: str, *order: str) -> DataFrame:
    return rows.withColumn("node_id", (F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).cast("long"))


def regions_plain(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One node an element. What has a text level is a header, even if discarded; other discarded elements have none."""
    kept = elements.where(F.col("text_level").isNotNull() | ~F.col("type").eqNullSafe("discarded"))
    label = F.when(F.col("text_level").isNotNull(), "header").otherwise(F.coalesce("type", F.lit("unknown")))
    text = F.concat(F.lit("key: "), F.col(doc).cast("string"), F.lit("/element_"), F.col("element_index").cast("string"), F.lit(".json"))
    return _numbered(kept, doc, "element_index").select(doc, "node_id", label.alias("label"), text.alias("text"), "element_index")


def _side(prefix: str, side: str) -> Column:
    text = F.array_join(F.coalesce(F.col(f"{prefix}_{side}"), F.array().cast("array<string>")), " ")
    return F.when((F.col("type") == prefix) & (text != ""), text)


def regions_full(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One to three nodes an element, with texts: main, caption, footnote."""
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    main = (
        F.when((kind == "text") & (F.col("text_level") == 1), text)
        .when(kind == "text", F.when(F.btrim(text) != "", text))
        .when(kind == "image", F.coalesce("img_path", F.lit("")))
        .when(kind == "table", F.concat(F.lit("Table: "), F.coalesce("img_path", F.lit("")), F.lit(" | "), F.substring(F.coalesce("table_body", F.lit("")), 1, 200)))
        .when(kind == "equation", text)
        .otherwise(F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(": "), text))
    )
    label = F.when((kind == "text") & (F.col("text_level") == 1), "title").otherwise(F.coalesce(kind, F.lit("unknown")))
    node = lambda seq, label, text: F.struct(F.lit(seq).alias("seq"), label.alias("label"), text.alias("text"))
    sides = [node(k, F.concat(kind, F.lit(f"_{s}")), F.coalesce(_side("image", s), _side("table", s))) for k, s in ((1, "caption"), (2, "footnote"))]
    nodes = F.array(node(0, label, main), *sides)
    rows = elements.where(~kind.eqNullSafe("discarded")).select(doc, "element_index", F.explode(F.filter(nodes, lambda n: n["text"].isNotNull())).alias("n"))
    return _numbered(rows.select(doc, "element_index", "n.*"), doc, "element_index", "seq").select(doc, "node_id", "label", "text", "element_index")


def order_edges(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """-1 to 0, 0 to 1, and so on."""
    before = F.lag("node_id").over(Window.partitionBy(doc).orderBy("node_id"))
    return nodes.select(doc, F.lit("ORDER").alias("rel"), F.coalesce(before, F.lit(ROOT)).cast("long").alias("src"), F.col("node_id").alias("dst"))


def parent_edges(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Content hangs under the last node before it that isn't content, all else under the document."""
    earlier = Window.partitionBy(doc).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    content = F.col("label").isin(*CONTENT)
    header = F.last(F.when(~content, F.col("node_id")), ignorenulls=True).over(earlier)
    return nodes.select(doc, F.lit("PARENT").alias("rel"), F.when(content, F.coalesce(header, F.lit(ROOT))).otherwise(ROOT).cast("long").alias("src"), F.col("node_id").alias("dst"))


def parent_edges_by_level(nodes: DataFrame, doc: str = "doc_id", level: str = "level", levels: int = 6) -> DataFrame:
    """The same with headers of levels 1 to `levels` (null: content): under the nearest earlier header of a smaller level."""
    earlier = Window.partitionBy(doc).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col("node_id")), ignorenulls=True).over(earlier) for k in range(1, levels + 1)]
    seen = nodes.select(doc, "node_id", level, *(x.alias(f"last_{k}") for k, x in enumerate(last, 1)))
    nearest = F.greatest(*(F.when(F.coalesce(F.col(level), F.lit(levels + 1)) > k, F.col(f"last_{k}")) for k in range(1, levels + 1)), F.lit(ROOT))
    return seen.select(doc, F.lit("PARENT").alias("rel"), nearest.cast("long").alias("src"), F.col("node_id").alias("dst"))


def _nested(stack: list[tuple], size: float | None, tolerance: float) -> None:
    """Close the open headers (node, key) that a header of this key closes."""
    while size is not None and stack and not size > stack[-1][1] + tolerance:
        stack.pop()


def parent_edges_by_key(nodes: DataFrame, doc: str = "doc_id", key: str = "key", tolerance: float = 1.0) -> DataFrame:
    """The stack rule: a header (key not null) nests under the last open one whose key is smaller by more than the tolerance, and
    closes those that aren't; content (key null) hangs under the last open header.

    With a tolerance that isn't the nearest header with a smaller key, since what was closed stays closed. Nodes are cut into slices in their
    order, whatever a document's length. What a slice does to the headers that are open before it is a small summary: the least key that it
    compares with them, which says how many stay, and the headers that it leaves open. Summaries, one a slice, are put together in order;
    then each slice is walked with the headers that are open where it begins. On open headers keys grow by more than the tolerance.
    """
    spark, kind = nodes.sparkSession, nodes.schema[doc].dataType.simpleString()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(doc, F.col("node_id").cast("long").alias("node_id"), F.col(key).cast("double").alias("key_"))
    dealt = shared.written(rows.repartitionByRange(width, doc, "node_id").withColumn("slice", F.spark_partition_id()), "slices")
    slices = dealt.select("slice", doc, "node_id", "key_").repartition(width, "slice").sortWithinPartitions("slice", doc, "node_id")

    def summaries(batches):
        last, first, own, stack, least = None, None, None, [], None

        def out() -> pa.RecordBatch:
            values = [[last], [first], [own], [least], [[n for n, _ in stack]], [[k for _, k in stack]]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["slice", "first", "last", "least", "open_nodes", "open_keys"])

        types = None
        for batch in batches:
            types = types or [pa.int32(), batch.column(1).type, batch.column(1).type, pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            for at, own_doc, node, size in zip(*(c.to_pylist() for c in batch.columns)):
                if at != last:
                    if last is not None:
                        yield out()
                    last, first, own, stack, least = at, own_doc, own_doc, [], None
                elif own_doc != own:
                    own, stack, least = own_doc, [], None
                if size is not None:
                    _nested(stack, size, tolerance)
                    if not stack:
                        least = size if least is None else min(least, size)
                    stack.append((node, size))
        if last is not None:
            yield out()

    # One row a slice, which holds the headers that are open at its end.
    found = slices.mapInArrow(summaries, f"slice int, first {kind}, last {kind}, least double, open_nodes array<long>, open_keys array<double>").collect()
    begin, own, stack = {}, None, []
    for r in sorted(found, key=lambda r: r.slice):
        if r.first != own:
            stack = []
        begin[r.slice] = list(stack)
        left = [x for x in stack if r.least is None or r.least > x[1] + tolerance] if r.first == r.last else []
        own, stack = r.last, left + list(zip(r.open_nodes, r.open_keys))
    known = spark.sparkContext.broadcast(begin)

    def walk(batches):
        last, own, stack = None, None, []
        for batch in batches:
            out = []
            for at, own_doc, node, size in zip(*(c.to_pylist() for c in batch.columns)):
                if at != last:
                    last, own, stack = at, own_doc, list(known.value[at])
                elif own_doc != own:
                    own, stack = own_doc, []
                _nested(stack, size, tolerance)
                out.append(stack[-1][0] if stack else ROOT)
                if size is not None:
                    stack.append((node, size))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.int64()), batch.column(2)], names=[doc, "src", "dst"])

    return slices.mapInArrow(walk, f"{doc} {kind}, src long, dst long").select(doc, F.lit("PARENT").alias("rel"), "src", "dst")


def add_documents(nodes: DataFrame, edges: DataFrame, new: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the regions of documents that aren't there yet, their document nodes and both kinds of edges."""
    fresh = new.join(nodes.select(doc).distinct(), doc, "left_anti").select(doc, "node_id", "label", "text")
    roots = fresh.select(doc).distinct().select(doc, F.lit(ROOT).cast("long").alias("node_id"), F.lit("Document").alias("label"), F.col(doc).cast("string").alias("text"))
    return nodes.unionByName(fresh).unionByName(roots), edges.unionByName(order_edges(fresh, doc)).unionByName(parent_edges(fresh, doc))


def documents_exist(nodes: DataFrame, wanted: DataFrame, doc: str = "doc_id") -> DataFrame:
    there = nodes.select(doc).distinct().withColumn("there", F.lit(True))
    return wanted.select(doc).distinct().join(there, doc, "left").select(doc, F.coalesce("there", F.lit(False)).alias("exists"))


def delete_documents(nodes: DataFrame, edges: DataFrame, gone: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Every node carries its document, so nothing is traversed."""
    gone = gone.select(doc).distinct()
    return nodes.join(gone, doc, "left_anti"), edges.join(gone, doc, "left_anti")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = nodes.groupBy(F.lit("node").alias("what"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return counted.unionByName(edges.groupBy(F.lit("edge").alias("what"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))


def order_path(edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each node that ORDER edges reach from its document, and in how many steps. A node has one ORDER edge to it.

    Pointer jumping: what a node points at is replaced by what that points at, and steps are added, so a chain of n nodes takes log2(n) rounds.
    What hangs on a missing node, or on a circle, isn't reached.
    """
    spark = edges.sparkSession
    hops = shared.written(edges.where("rel = 'ORDER'").select(doc, F.col("dst").alias("node_id"), F.col("src").alias("up"), F.lit(1).cast("long").alias("depth")), "hops")
    for _ in range(max(1, hops.count()).bit_length()):
        going = hops.where(F.col("up") != ROOT)
        if going.isEmpty():
            break
        further = hops.select(doc, F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        jumped = going.join(further, [doc, "up"]).select(doc, "node_id", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        before, hops = hops, shared.written(hops.where(F.col("up") == ROOT).unionByName(jumped), "hops")
        shared.delete(spark, before.inputFiles()[0].rpartition("/")[0])
    return hops.where(F.col("up") == ROOT).select(doc, "node_id", "depth")


def section_members(nodes: DataFrame, edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per header or document node: how many nodes hang under it, and the first and last of them."""
    under = edges.where("rel = 'PARENT'").groupBy(doc, "src").agg(F.count("*").alias("members"), F.min("dst").alias("first_member"), F.max("dst").alias("last_member"))
    names = nodes.select(doc, F.col("node_id").alias("src"), "label")
    return under.join(names, [doc, "src"], "left").select(doc, "src", F.coalesce("label", F.lit("Document")).alias("label"), "members", "first_member", "last_member")
