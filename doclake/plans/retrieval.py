"""Queries of embeddings, vector collections, search, graphs and questions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import shared
from ..functions import cache, embed, generate
from ..operators import elements, graph, qa, search, vectors
from ..sources import collections, objects, store
from . import fixtures as fx
from .fixtures import table, with_

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _records(spark, sf):
    return elements.explode_records(fx.elements(spark, sf), fx.images(spark, sf))


# Embeddings.


def _buckets(source: str, keys: str) -> str:
    """SQL: normalised token counts by bucket, of (keys, text)."""
    return f"""select {keys}, bucket, n / sqrt(sum(n * n) over (partition by {keys})) as weight from (
      select {keys}, bucket, count(*)::double as n from (select {keys}, ('0x' || substring(md5(token), 1, 8))::bigint % 64 as bucket
        from (select {keys}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from {source})) group by all)"""


@query("embed_text", f"select doc_id, bucket, round(weight::float::double, 4) as weight from ({_buckets('documents', 'doc_id')})")
def _(spark, sf):
    embedded = table(spark, sf, "documents").select("doc_id", embed.embed_text(F.col("text")).alias("vector"))
    rows = embedded.select("doc_id", F.posexplode("vector").alias("bucket", "w")).where("w <> 0")
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 4).alias("weight"))


@query("embed_cached", f"select doc_id, bucket, round(weight::float::double, 4) as weight from ({_buckets('documents', 'doc_id')})")
def _(spark, sf):
    """A client embeds half of the documents' texts; the second run asks it for those alone that are new."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "text"), shared.folder(spark, "vectors")
    cache.fill(docs.where("doc_id % 2 = 0"), "text", cache.hashing_client(), folder)
    embedded = cache.embed(docs, "text", cache.hashing_client(), folder)
    rows = embedded.select("doc_id", F.posexplode("vector").alias("bucket", "w")).where("w <> 0")
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 4).alias("weight"))


@query(
    "embed_image",
    """select doc_id, bucket, round((n / sqrt(sum(n * n) over (partition by doc_id)))::float::double, 4) as weight from (
      select doc_id, bucket, count(*)::double as n from (select doc_id, ('0x' || substring(md5(pair), 1, 8))::bigint % 64 as bucket
        from (select doc_id, unnest(regexp_extract_all(lower(hex(encode(text))), '..')) as pair from documents)) group by all)""",
)
def _(spark, sf):
    """The bytes of every document stand for its picture."""
    embedded = table(spark, sf, "documents").select("doc_id", embed.embed_image(F.col("text").cast("binary")).alias("vector"))
    rows = embedded.select("doc_id", F.posexplode("vector").alias("bucket", "w")).where("w <> 0")
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 4).alias("weight"))


@query(
    "embed_messages",
    f"""with b as ({_buckets("conversations", "conv_id, turn")}), sizes as (select conv_id, count(distinct turn) as n from b group by conv_id)
      select conv_id, bucket, round(sum(weight::float::double) / any_value(n), 4) as weight from b join sizes using (conv_id) group by conv_id, bucket""",
)
def _(spark, sf):
    parts = table(spark, sf, "conversations").select("conv_id", embed.embed_text(F.col("text")).alias("vector"))
    rows = embed.embed_messages(parts, "conv_id").select("conv_id", F.posexplode("embedding").alias("bucket", "w")).where("w <> 0")
    return rows.select("conv_id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 4).alias("weight"))


# Collections.


def _collections(spark, sf):
    return fx.points(spark, sf).select(F.col("collection").alias("name")).distinct()


def _wanted(spark, sf):
    labels = table(spark, sf, "embeddings").select("label").distinct()
    name = F.when(F.col("label") == 0, "a").when(F.col("label") == 1, "b").otherwise(F.concat(F.lit("c"), F.col("label").cast("string")))
    distance = F.when(F.col("label") % 4 == 0, "dot").when(F.col("label") % 4 == 1, "EUCLID").when(F.col("label") % 4 == 2, "MANHATTAN").otherwise("COSINE")
    return labels.select(name.alias("name"), F.lit(64).cast("long").alias("vector_size"), distance.alias("distance"))


_WANTED = """wanted as (select distinct case label when 0 then 'a' when 1 then 'b' else 'c' || label end as name, 64::bigint as vector_size,
  case label % 4 when 0 then 'DOT' when 1 then 'EUCLID' when 2 then 'COSINE' else 'COSINE' end as distance from embeddings)"""


@query("create_collection", with_("points", then=_WANTED) + "select name, vector_size, distance, case when name in (select collection from points) then 'already_exists' else 'created' end as status from wanted")
def _(spark, sf):
    return vectors.create_collections(_collections(spark, sf), _wanted(spark, sf))


@query("delete_collection", with_("points", then=_WANTED) + "select name, case when name in (select collection from points) then 'deleted' else 'not_found' end as status from wanted")
def _(spark, sf):
    return vectors.delete_collections(_collections(spark, sf), _wanted(spark, sf))[1]


@query(
    "list_collections",
    with_("points", then=_WANTED) + """select name, coalesce(n, 0)::bigint as points_count from (select name from wanted union select collection from points)
      left join (select collection as name, count(*) as n from points group by collection) using (name)""",
)
def _(spark, sf):
    every = _wanted(spark, sf).select("name").union(_collections(spark, sf)).distinct()
    return vectors.list_collections(every, fx.points(spark, sf))


_CHANGES = """changes as (select point_id, element_index + 1000 as element_index, 1 as batch from points where point_id % 3 = 0
  union all select point_id, element_index + 2000, 2 from points where point_id % 6 = 0 union all select point_id + 1000000, element_index, 1 from points where point_id % 5 = 0)"""


@query(
    "upsert_points",
    with_("points", then=_CHANGES) + """select point_id, arg_max(element_index, batch) as element_index from
      (select point_id, element_index, -1 as batch from points union all select * from changes) group by point_id""",
)
def _(spark, sf):
    points, p, e = fx.points(spark, sf).select("point_id", "element_index"), F.col("point_id"), F.col("element_index")
    first = points.where("point_id % 3 = 0").select(p, (e + 1000).alias("element_index"), F.lit(1).alias("batch"))
    second = points.where("point_id % 6 = 0").select(p, (e + 2000).alias("element_index"), F.lit(2).alias("batch"))
    new = points.where("point_id % 5 = 0").select((p + 1000000).alias("point_id"), e, F.lit(1).alias("batch"))
    return vectors.upsert_points(points, first.union(second).union(new))


@query("save_embeddings", with_("points") + "select point_id as element_index, sha256('lake/' || file_hash || '/' || point_id) as point_id, 'lake' as collection, len(vector)::bigint as vector_size from points")
def _(spark, sf):
    points = fx.points(spark, sf)
    records = points.select("file_hash", "element_index")
    saved = vectors.save_embeddings(records, points.select("file_hash", "element_index", "vector"), ["file_hash", "element_index"], "lake", 64)
    return saved.select("element_index", "point_id", "collection", F.size("vector").cast("long").alias("vector_size"))


@query("count_points", with_("points") + "select collection, count(*) as points_count from points group by collection")
def _(spark, sf):
    return fx.points(spark, sf).groupBy("collection").agg(F.count("*").alias("points_count"))


_IDS = "select point_id from points where file_hash = '3'"


def _ids(spark, sf):
    return fx.points(spark, sf).where("file_hash = '3'").select("point_id")


@query("get_point", with_("points") + f"select point_id, collection, file_hash from points where point_id in ({_IDS})")
def _(spark, sf):
    return vectors.points_by_id(fx.points(spark, sf), _ids(spark, sf)).select("point_id", "collection", "file_hash")


@query("delete_points", with_("points") + f"select point_id, collection, file_hash from points where point_id not in ({_IDS})")
def _(spark, sf):
    return vectors.delete_points(fx.points(spark, sf), _ids(spark, sf)).select("point_id", "collection", "file_hash")


@query(
    "update_payload",
    with_("points") + "select point_id, case when point_id % 3 = 0 then 'new' else file_hash end as file_hash, case when point_id % 6 = 0 then -1 else element_index end as element_index from points",
)
def _(spark, sf):
    points = fx.points(spark, sf).select("point_id", "file_hash", "element_index")
    updates = points.where("point_id % 3 = 0").select("point_id", F.lit("new").alias("file_hash"), F.when(F.col("point_id") % 6 == 0, -1).cast("long").alias("element_index"))
    return vectors.update_payload(points, updates, ["file_hash", "element_index"])


@query("infer_vector_size", with_("points") + "select collection, case when min(len(vector)) = max(len(vector)) then min(len(vector)) end::bigint as vector_size from points group by collection")
def _(spark, sf):
    return vectors.vector_sizes(fx.points(spark, sf))


@query("scroll_points", with_("points") + "select point_id, collection, file_hash, element_index from points where point_id > 99 order by point_id limit 100")
def _(spark, sf):
    return vectors.scroll(fx.points(spark, sf), after=99, limit=100).select("point_id", "collection", "file_hash", "element_index")


# The same as changes of a stored collection, of which only the touched buckets are written.


def _kept(spark, sf):
    """All points in a new store, in the collections a and b; its root, and the points."""
    root, points = shared.folder(spark, "collections"), fx.points(spark, sf)
    collections.create(spark, root, _collections(spark, sf).select("name", F.lit(64).cast("long").alias("vector_size"), F.lit("COSINE").alias("distance")))
    collections.upsert(root, points.withColumn("batch", F.lit(0)), buckets=16)
    return root, points


_STORED_WANTED = with_("points", then=_WANTED)


@query("stored_create", _STORED_WANTED + "select name, vector_size, distance from wanted where name not in (select collection from points) union all select distinct collection, 64, 'COSINE' from points")
def _(spark, sf):
    """What the catalog holds after collections were asked for, some of which are there."""
    root, _ = _kept(spark, sf)
    collections.create(spark, root, _wanted(spark, sf))
    return collections.catalog(spark, root)


@query("stored_drop", _STORED_WANTED + """select name, coalesce(n, 0)::bigint as points_count from (select collection as name from points union select name from wanted)
  left join (select collection as name, count(*) as n from points group by collection) using (name) where name not in ('a', 'c2')""")
def _(spark, sf):
    """The collections and points that are left after two collections were dropped, and one that isn't there."""
    root, points = _kept(spark, sf)
    collections.create(spark, root, _wanted(spark, sf))
    collections.drop(spark, root, points.limit(1).select(F.explode(F.array(F.lit("a"), F.lit("c2"), F.lit("nowhere"))).alias("name")))
    return vectors.list_collections(collections.catalog(spark, root), collections.points(spark, root, points))


@query(
    "stored_upsert",
    with_("points") + """select collection, point_id, case when point_id % 50 = 0 then element_index + 2000 else element_index end as element_index from points
      union all select collection, point_id + 1000000, element_index from points where point_id % 100 = 1""",
)
def _(spark, sf):
    root, points = _kept(spark, sf)
    changed = lambda n, batch: points.where("point_id % 50 = 0").withColumn("element_index", F.col("element_index") + n).withColumn("batch", F.lit(batch))
    new = points.where("point_id % 100 = 1").withColumn("point_id", F.col("point_id") + 1000000).withColumn("batch", F.lit(1))
    collections.upsert(root, changed(2000, 2).unionByName(changed(1000, 1)).unionByName(new), buckets=16)
    return collections.points(spark, root, points).select("collection", "point_id", "element_index")


@query("stored_delete", with_("points") + f"select collection, point_id from points where point_id not in ({_IDS}) and point_id % 64 <> 7")
def _(spark, sf):
    root, points = _kept(spark, sf)
    collections.delete(root, points.where("file_hash = '3' or point_id % 64 = 7"), points, buckets=16)
    return collections.points(spark, root, points).select("collection", "point_id")


@query(
    "stored_payload",
    with_("points") + "select collection, point_id, case when point_id % 3 = 0 then 'new' else file_hash end as file_hash, case when point_id % 6 = 0 then -1 else element_index end as element_index from points",
)
def _(spark, sf):
    root, points = _kept(spark, sf)
    updates = points.where("point_id % 3 = 0").select("collection", "point_id", F.lit("new").alias("file_hash"), F.when(F.col("point_id") % 6 == 0, -1).cast("long").alias("element_index"))
    nowhere = points.where("point_id % 9 = 0").select("collection", (F.col("point_id") + 5000000).alias("point_id"), F.lit("none").alias("file_hash"), F.lit(None).cast("long").alias("element_index"))
    collections.update_payload(root, updates.unionByName(nowhere), ["file_hash", "element_index"], points, buckets=16)
    return collections.points(spark, root, points).select("collection", "point_id", "file_hash", "element_index")


# Search: every point whose id divides by 20 asks all points.

_SCORES = {
    "COSINE": "list_sum(list_transform(range(1, 65), lambda i: p.vector[i]::double * q.vector[i]::double)) / (sqrt(list_sum(list_transform(p.vector, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.vector, lambda x: x::double * x::double))))",
    "DOT": "list_sum(list_transform(range(1, 65), lambda i: p.vector[i]::double * q.vector[i]::double))",
    "EUCLID": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (p.vector[i]::double - q.vector[i]::double) ** 2)))",
}


def _knn_sql(distance: str = "COSINE", limit: int = 10, on: str = "true", ask: str = "point_id % 20 = 0") -> str:
    way = "asc" if distance == "EUCLID" else "desc"
    return with_("points") + f"""select query_id, point_id, score, rank from (select *, row_number() over (partition by query_id order by score {way}, point_id) as rank from (
      select q.point_id as query_id, p.point_id, round({_SCORES[distance]}, 6) as score from points p join (select * from points where {ask}) q on {on})) where rank <= {limit}"""


def _knn(name: str, distance: str) -> None:
    @query(name, _knn_sql(distance))
    def _(spark, sf):
        points = fx.points(spark, sf)
        return vectors.knn_blocks(points, fx.queries_of(points), 10, distance).select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


_knn("knn_cosine", "COSINE")
_knn("knn_dot", "DOT")
_knn("knn_euclid", "EUCLID")


@query("knn_filtered", _knn_sql(on="p.collection = 'a'"))
def _(spark, sf):
    points = fx.points(spark, sf)
    found = vectors.knn_blocks(points.where("collection = 'a'"), fx.queries_of(points), 10)
    return found.select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


def _inverted(spark, sf):
    """An inverted file of about as many cells as a cell has points."""
    points = fx.points(spark, sf)
    return points, search.build(points, cells=max(1, math.isqrt(points.count())))


@query("knn_inverted")
def _(spark, sf):
    """Approximate: as many cells are probed as a sample of queries needs for a recall of 0.95."""
    points, index = _inverted(spark, sf)
    found = search.search(index, fx.queries_of(points), 10, probes=search.probes_for(index, points, 10))
    return found.select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


@query("knn_inverted_exact", _knn_sql())
def _(spark, sf):
    """Exact: after two cells, all those whose radius leaves room for a better point."""
    points, index = _inverted(spark, sf)
    return search.search(index, fx.queries_of(points), 10, probes=2, exact=True).select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


# One vector, that of the point 20, asks all points: the best are taken where they are.


def _top_sql(where: str) -> str:
    return with_("points") + f"""select point_id, file_hash, score from (select p.point_id, p.file_hash, round({_SCORES['COSINE']}, 6) as score
      from points p join (select * from points where point_id = 20) q on true where {where}) order by score desc, point_id limit 10"""


def _top(spark, sf, where=None):
    points = fx.points(spark, sf)
    asked = [float(x) for x in points.where("point_id = 20").first().vector]
    return vectors.knn(points, asked, 10, where=where).select("point_id", "file_hash", "score")


@query("knn_top", _top_sql("true"))
def _(spark, sf):
    return _top(spark, sf)


@query("knn_top_filtered", _top_sql("p.collection = 'b' and p.file_hash <> '3'"))
def _(spark, sf):
    return _top(spark, sf, (F.col("collection") == "b") & (F.col("file_hash") != "3"))


@query("knn_batch", _knn_sql(limit=25))
def _(spark, sf):
    points = fx.points(spark, sf)
    return vectors.knn_blocks(points, fx.queries_of(points), 25).select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


@query("knn_batch_per_file", _knn_sql(on="p.file_hash = q.file_hash"))
def _(spark, sf):
    points = fx.points(spark, sf)
    found = vectors.knn_per_file(points, fx.queries_of(points), 10)
    return found.select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))


_LITERALS = """literals as (select point_id, case point_id % 3 when 0 then '1, 2,x,4' when 1 then '1,2,3' else point_id || ',2.5, -1,0' end as literal from points)"""


def _literals(spark, sf):
    p = F.col("point_id")
    text = F.when(p % 3 == 0, "1, 2,x,4").when(p % 3 == 1, "1,2,3").otherwise(F.concat(p.cast("string"), F.lit(",2.5, -1,0")))
    return fx.points(spark, sf).select("point_id", text.alias("literal"))


@query(
    "parse_vector_literal",
    with_("points", then=_LITERALS) + "select point_id, case point_id % 3 when 0 then 'bad_number' when 1 then 'bad_size' else 'ok' end as status, case when point_id % 3 = 2 then point_id + 1.5::double end as total from literals",
)
def _(spark, sf):
    vector, status = vectors.parse_vector(F.col("literal"), 4)
    return _literals(spark, sf).select("point_id", status.alias("status"), F.aggregate(vector, F.lit(0.0), lambda s, x: s + x).alias("total"))


def _whole_literal(spark, sf):
    asked = fx.points(spark, sf).where("point_id = 20").first().vector
    return ",".join(repr(float(x)) for x in asked)


_LITERAL_SQL = with_("points") + f"""select p.point_id, round({_SCORES['DOT']}, 6) as score, p.file_hash from points p join (select * from points where point_id = 20) q on true
  order by score desc, p.point_id limit 5"""


def _literal_search(spark, sf):
    """The literal of one stored vector, all of its numbers, against all points."""
    vector, _ = vectors.parse_vector(F.lit(_whole_literal(spark, sf)), 64)
    found = fx.points(spark, sf).withColumn("score", vectors.score("DOT", F.col("vector"), vector))
    return found.orderBy(F.desc("score"), "point_id").limit(5).select("point_id", "score", "file_hash")


query("vector_search_literal", _LITERAL_SQL)(_literal_search)
query("vector_search_whole_literal", _LITERAL_SQL)(_literal_search)


@query("is_indexed", with_("points", "lines") + "select distinct file_hash, file_hash in (select file_hash from points) as indexed from (select (doc_id % 20)::varchar as file_hash from lines union all select file_hash from lines)")
def _(spark, sf):
    lines = fx.lines(spark, sf)
    files = lines.select((F.col("doc_id") % 20).cast("string").alias("file_hash")).unionByName(lines.select("file_hash"))
    return vectors.indexed_flags(files, fx.points(spark, sf))


# Graphs.

_NODES = """nodes as (select doc_id, row_number() over (partition by doc_id order by element_index, seq) - 1 as node_id, label, text, element_index from (
  select doc_id, element_index, 0 as seq, case when type = 'text' and text_level = 1 then 'title' else type end as label,
    case when type = 'text' and text_level = 1 then text when type = 'text' then case when trim(text) <> '' then text end when type = 'image' then img_path
      when type = 'table' then 'Table: ' || img_path || ' | ' || substring(table_body, 1, 200) when type = 'equation' then text else type || ': ' || text end as text from elements where type <> 'discarded'
  union all select doc_id, element_index, 1, type || '_caption', case type when 'image' then image_caption else table_caption end from elements where type in ('image', 'table') and case type when 'image' then image_caption else table_caption end <> ''
  union all select doc_id, element_index, 2, type || '_footnote', case type when 'image' then image_footnote else table_footnote end from elements where type in ('image', 'table') and case type when 'image' then image_footnote else table_footnote end <> '')
  where text is not null)"""
_EDGES = """edges as (select doc_id, 'ORDER' as rel, node_id - 1 as src, node_id as dst from nodes union all
  select doc_id, 'PARENT', case when label in ('text', 'table', 'image') then coalesce(max(case when label not in ('text', 'table', 'image') then node_id end)
    over (partition by doc_id order by node_id rows between unbounded preceding and 1 preceding), -1) else -1 end, node_id from nodes)"""


def _nodes(spark, sf):
    return graph.regions_full(fx.elements(spark, sf))


def _edges(nodes):
    return graph.order_edges(nodes).unionByName(graph.parent_edges(nodes))


@query(
    "graph_regions_ref",
    with_("elements") + """select doc_id, row_number() over (partition by doc_id order by element_index) - 1 as node_id, case when text_level is not null then 'header' else type end as label,
      'key: ' || doc_id || '/element_' || element_index || '.json' as text from elements where text_level is not null or type <> 'discarded'""",
)
def _(spark, sf):
    return graph.regions_plain(fx.elements(spark, sf)).select("doc_id", "node_id", "label", "text")


@query("parent_edges_tolerant")
def _(spark, sf):
    """Headers are elements with a level or a page's first; their key is where they stand on the page."""
    nodes = fx.elements(spark, sf).where("type <> 'discarded'").select("doc_id", F.col("element_index").alias("node_id"), F.when(F.col("text_level").isNotNull(), F.col("element_index") * 7 % 10).alias("key"))
    return graph.parent_edges_by_key(nodes)


@query("graph_regions_full", with_("elements", then=_NODES) + "select doc_id, node_id, label, text, element_index from nodes")
def _(spark, sf):
    return _nodes(spark, sf)


@query("order_edges", with_("elements", then=f"{_NODES}, {_EDGES}") + "select * from edges where rel = 'ORDER'")
def _(spark, sf):
    return graph.order_edges(_nodes(spark, sf))


@query("parent_edges", with_("elements", then=f"{_NODES}, {_EDGES}") + "select * from edges where rel = 'PARENT'")
def _(spark, sf):
    return graph.parent_edges(_nodes(spark, sf))


_LEVELS = "levels as (select *, case when k % 3 = 0 then k % 6 + 1 end as level from (select doc_id, element_index as node_id, (doc_id * 5 + element_index * 7) % 11 as k from lines))"


@query(
    "parent_edges_by_level",
    with_("lines", then=_LEVELS) + """select n.doc_id, 'PARENT' as rel, coalesce(max(h.node_id), -1) as src, n.node_id as dst from levels n
      left join levels h on h.doc_id = n.doc_id and h.node_id < n.node_id and h.level < coalesce(n.level, 7) group by n.doc_id, n.node_id""",
)
def _(spark, sf):
    k = (F.col("doc_id") * 5 + F.col("element_index") * 7) % 11
    nodes = fx.lines(spark, sf).select("doc_id", F.col("element_index").alias("node_id"), F.when(k % 3 == 0, k % 6 + 1).cast("int").alias("level"))
    return graph.parent_edges_by_level(nodes)


def _stored(spark, sf):
    nodes = _nodes(spark, sf)
    old = nodes.where("doc_id % 4 = 0").drop("element_index")
    none = old.limit(0)
    return graph.add_documents(none, _edges(old).limit(0), old), nodes


_ALL = "all_nodes as (select doc_id, node_id, label, text from nodes union all select distinct doc_id, -1, 'Document', doc_id::varchar from nodes)"


@query("graph_add_documents", with_("elements", then=f"{_NODES}, {_ALL}") + "select doc_id, node_id, label, text from all_nodes")
def _(spark, sf):
    (nodes, edges), new = _stored(spark, sf)
    return graph.add_documents(nodes, edges, new)[0]


@query("graph_doc_exists", with_("elements", then=_NODES) + "select distinct doc_id, doc_id % 4 = 0 and doc_id in (select doc_id from nodes) as exists from elements")
def _(spark, sf):
    (nodes, _), _ = _stored(spark, sf)
    return graph.documents_exist(nodes, fx.elements(spark, sf))


@query("graph_delete_documents", with_("elements", then=f"{_NODES}, {_EDGES}") + "select doc_id, rel, src, dst from edges where doc_id % 4 = 0 and doc_id % 8 <> 0")
def _(spark, sf):
    (nodes, edges), new = _stored(spark, sf)
    return graph.delete_documents(nodes, edges, new.where("doc_id % 8 = 0"))[1]


@query(
    "graph_status",
    with_("elements", then=f"{_NODES}, {_EDGES}, {_ALL}") + "select 'node' as what, label as name, count(*) as n from all_nodes group by label union all select 'edge', rel, count(*) from edges group by rel",
)
def _(spark, sf):
    nodes = _nodes(spark, sf)
    none = nodes.drop("element_index").limit(0)
    return graph.status(*graph.add_documents(none, _edges(none).limit(0), nodes))


@query("order_path", with_("elements", then=_NODES) + "select doc_id, node_id, node_id + 1 as depth from nodes")
def _(spark, sf):
    return graph.order_path(graph.order_edges(_nodes(spark, sf)))


@query("order_path_after_removal", with_("elements", then=_NODES) + "select doc_id, node_id, row_number() over (partition by doc_id order by node_id) as depth from nodes where node_id % 5 <> 2")
def _(spark, sf):
    """Every fifth node was taken out, so depths aren't numbers of nodes."""
    return graph.order_path(graph.order_edges(_nodes(spark, sf).where("node_id % 5 <> 2")))


@query(
    "section_members",
    with_("elements", then=f"{_NODES}, {_EDGES}") + """select e.doc_id, e.src, coalesce(n.label, 'Document') as label, count(*) as members, min(dst) as first_member, max(dst) as last_member
      from edges e left join nodes n on n.doc_id = e.doc_id and n.node_id = e.src where rel = 'PARENT' group by e.doc_id, e.src, n.label""",
)
def _(spark, sf):
    nodes = _nodes(spark, sf)
    return graph.section_members(nodes, graph.parent_edges(nodes))


# Questions.

_ANSWERS = f"""point_buckets as ({_buckets("(select doc_id, element_index, seq, content as text from kept)", "doc_id, element_index, seq")}),
question_buckets as ({_buckets("(select question_id, doc_id, question as text from questions)", "question_id, doc_id")}),
tokened as (select distinct doc_id, element_index, seq from point_buckets), asked as (select distinct question_id, doc_id from question_buckets),
point_norms as (select doc_id, element_index, seq, sqrt(sum(weight::float::double * weight::float::double)) as pn from point_buckets group by all),
question_norms as (select question_id, sqrt(sum(weight::float::double * weight::float::double)) as qn from question_buckets group by all),
scores as (select a.question_id, t.doc_id, t.element_index, t.seq, round(coalesce(s, 0) / (pn * qn), 6) as score from asked a join tokened t using (doc_id)
  join point_norms using (doc_id, element_index, seq) join question_norms n on n.question_id = a.question_id
  left join (select question_id, doc_id, element_index, seq, sum(p.weight::float::double * q.weight::float::double) as s from point_buckets p join question_buckets q using (doc_id, bucket) group by all) x
    on x.question_id = a.question_id and x.doc_id = t.doc_id and x.element_index = t.element_index and x.seq = t.seq),
found as (select s.*, k.element_type, k.content, k.img_path, k.page_idx, row_number() over (partition by question_id order by score desc, s.element_index, s.seq) as rank
  from scores s join kept k using (doc_id, element_index, seq)),
answers as (select * from found where rank <= 5)"""


def _payloads(rows):
    seq = F.when(F.col("part") == "main", 0).when(F.col("part") == "caption", 1).otherwise(2).cast("long")
    return rows.select(F.col("doc_id").cast("string").alias("file_hash"), "element_index", seq.alias("seq"), F.col("content").alias("text"), "element_type", "img_path", "page_idx", "bbox")


def _embedded(payloads):
    return payloads.withColumn("vector", embed.embed_text(F.col("text")))


def _points(rows):
    return _embedded(_payloads(rows))


def _answers(spark, sf):
    """(questions, points, answers, pictures). Every document is embedded, and asked for its own first line; a question is about one document,
    not about its copies. Pictures and records are written once: vectors, payloads and contents come from there."""
    asked = fx.questions(spark, sf).withColumn("file_hash", F.col("doc_id").cast("string"))
    pictures = shared.written(fx.images(spark, sf), "pictures")
    points = _embedded(shared.written(_payloads(elements.explode_records(fx.elements(spark, sf), pictures)), "records"))
    return asked, points, qa.answers(asked, points, 5), pictures.withColumn("content", F.col("img_path").cast("binary"))


_INDEXED_SQL = """select question_id, case when indexed then 'success' else 'error' end as status, indexed, case when indexed then n else 0 end::bigint as n_points
  from (select question_id, doc_id % 3 < 2 and coalesce(n, 0) > 0 as indexed, n from questions left join (select doc_id, count(*) as n from kept group by doc_id) using (doc_id))"""


def _index_missing(spark, sf):
    """A third of the files has points, a third has parse results only, and is indexed and saved when it is asked, a third has nothing.
    Pictures are written once, since every pass over records asks for them."""
    asked = fx.questions(spark, sf).withColumn("file_hash", F.col("doc_id").cast("string"))
    there = fx.elements(spark, sf).withColumn("file_hash", F.col("doc_id").cast("string"))
    pictures, save = shared.written(fx.images(spark, sf), "pictures"), shared.folder(spark, "points")
    points = _points(elements.explode_records(there.where("doc_id % 3 = 0"), pictures))
    status, _ = qa.index_missing(asked, points, there.where("doc_id % 3 = 1"), pictures, save=save)
    counted = qa.saved_points(points, save).groupBy("file_hash").agg(F.count("*").alias("n_points"))
    return status.join(counted, "file_hash", "left").select("question_id", "status", "indexed", F.coalesce("n_points", F.lit(0)).alias("n_points"))


query("ask_indexes_missing", with_("questions", "records") + _INDEXED_SQL)(_index_missing)


@query(
    "ask_from_store",
    with_("stored_files")
    + """select number as question_id, md5(content) as file_hash, case when n > 0 then 'success' else 'error' end as status, n > 0 as indexed, n as n_points
      from (select number, content, case when number % 3 > 0 then len(list_filter(string_split(content, chr(10)), lambda x: x <> '')) else 0 end::bigint as n from stored_files)""",
)
def _(spark, sf):
    """Every file is asked. A third has nothing, a third has points; the parse results of a third are objects, and are indexed and saved.
    Files of equal contents are files of their own: their key is the digest and their number."""
    lists = F.to_json(F.transform(F.split("content", "\n"), lambda x, i: F.struct(F.lit("text").alias("type"), x.alias("text"), i.alias("page_idx"))))
    value = F.concat(F.lit('{"results": {"result": {"results": {"content_list": '), lists, F.lit("}}}}"))
    key = F.concat_ws("-", fx.md5(F.col("content")), F.col("number").cast("string"))
    files = fx.stored_files(spark, sf).select("number", key.alias("file_hash"), F.get(F.split("content", "\n"), F.lit(0)).alias("question"), value.alias("value"))
    files = shared.written(files, "files")
    root, save = shared.folder(spark, "objects"), shared.folder(spark, "points")
    path = F.concat(F.lit("results/"), "file_hash", F.lit("_"), F.col("number").cast("string"), F.lit(".txt/result.json"))
    store.put(files.where("number % 3 = 2").select(path.alias("path"), F.col("value").cast("binary").alias("content")), root)
    none = fx.images(spark, sf).limit(0)
    known = elements.explode_elements(objects.parse_results(files.where("number % 3 = 1").select("file_hash", "value")))
    points = _points(elements.explode_records(known, none).withColumn("doc_id", F.col("file_hash")))
    asked = files.select(F.col("number").alias("question_id"), "question", "file_hash")
    status, _ = qa.index_from_store(asked, points, root, none, save=save)
    counted = qa.saved_points(points, save).groupBy("file_hash").agg(F.count("*").alias("n_points"))
    digest = F.substring_index("file_hash", "-", 1).alias("file_hash")
    return status.join(counted, "file_hash", "left").select("question_id", digest, "status", "indexed", F.coalesce("n_points", F.lit(0)).alias("n_points"))


def _index_flags(spark, sf):
    return _index_missing(spark, sf).drop("n_points")


_FLAGS_SQL = with_("questions", "records") + f"select question_id, status, indexed from ({_INDEXED_SQL})"
query("ask_index_missing", _FLAGS_SQL)(_index_flags)
query("ask_all_index_missing", _FLAGS_SQL)(_index_flags)


_FOUND_SQL = "select question_id, element_index, element_type, content as text, score, rank, page_idx from answers"


def _found(found):
    return found.select("question_id", "element_index", "element_type", "text", "score", F.col("rank").cast("long").alias("rank"), "page_idx")


@query("ask_answers", with_("questions", "records", then=_ANSWERS) + _FOUND_SQL)
def _(spark, sf):
    return _found(_answers(spark, sf)[2])


_PICTURES_SQL = "select question_id, rank, case when element_type in ('image', 'table') and img_path in (select img_path from images) then base64(encode(img_path)) end as image_base64 from answers"


def _pictures(found, pictures):
    return qa.attach_images(found, pictures).select("question_id", F.col("rank").cast("long").alias("rank"), "image_base64")


@query("attach_images", with_("questions", "records", then=_ANSWERS) + _PICTURES_SQL)
def _(spark, sf):
    return _pictures(*_answers(spark, sf)[2:])


_CONTEXT_SQL = "select question_id, string_agg(content, chr(10) || chr(10) order by rank) as context, count(*) as n_answers from answers group by question_id"


def _contexts(found):
    return qa.contexts(found).select("question_id", "context", "n_answers")


@query("build_context", with_("questions", "records", then=_ANSWERS) + _CONTEXT_SQL)
def _(spark, sf):
    return _contexts(_answers(spark, sf)[2])


_PROMPT_SQL = f""", parts as (
      select question_id, 0 as k, 'text' as type, '{qa.SYSTEM}' as text, null as url from answers group by question_id
      union all select question_id, rank, 'image_url', null, 'data:image/jpeg;base64,' || base64(encode(img_path)) from answers where element_type in ('image', 'table') and img_path in (select img_path from images)
      union all select question_id, 100, 'text', string_agg(content, chr(10) || chr(10) order by rank), null from answers group by question_id
      union all select q.question_id, 101, 'text', 'Question: ' || question || ' Answer from the context (texts and images) alone.', null from questions q where question_id in (select question_id from answers))
      select question_id, row_number() over (partition by question_id order by k) - 1 as part, type, text, url from parts"""


def _prompts(found, pictures):
    rows = qa.prompts(qa.attach_images(found, pictures)).select("question_id", F.posexplode("messages").alias("part", "m"))
    return rows.select("question_id", F.col("part").cast("long").alias("part"), "m.type", "m.text", "m.url")


@query("build_prompt", with_("questions", "records", then=_ANSWERS) + _PROMPT_SQL)
def _(spark, sf):
    return _prompts(*_answers(spark, sf)[2:])


@query("llm_answer", with_("questions", "records", then=_ANSWERS) + f"select question_id, string_split(context, chr(10))[1] as answer, null::varchar as error from ({_CONTEXT_SQL})")
def _(spark, sf):
    found = qa.attach_images(*_answers(spark, sf)[2:])
    return generate.llm_answer(qa.prompts(found), "question_id")


@query(
    "ask_document",
    with_("questions", "records", then=_ANSWERS)
    + f"""select question_id, question, context, coalesce(n_answers, 0) as n_answers, string_split(context, chr(10))[1] as answer, null::varchar as error
      from questions left join ({_CONTEXT_SQL}) using (question_id)""",
)
def _(spark, sf):
    asked, _, found, pictures = _answers(spark, sf)
    return qa.asked(asked, qa.attach_images(found, pictures))


# The names under which these were registered while the others asked a part of the documents.

query("ask_all_answers", SQL["ask_answers"])(QUERIES["ask_answers"])
query("attach_all_images", SQL["attach_images"])(QUERIES["attach_images"])
query("build_all_contexts", SQL["build_context"])(QUERIES["build_context"])
query("build_all_prompts", SQL["build_prompt"])(QUERIES["build_prompt"])
