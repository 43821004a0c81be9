"""Queries of sources, ingestion, catalogs and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..operators import catalog, ingest
from ..sources import html, objects, sinks, store
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


def _put(spark, sf):
    """The files, put into a new store; its root."""
    root = shared.folder(spark, "objects")
    store.put(fx.stored_files(spark, sf), root)
    return root


@query("list_objects_prefix", with_("stored_files") + "select path, strlen(content)::bigint as length from stored_files where starts_with(path, 'pdfs/0')")
def _(spark, sf):
    """Only the folder that begins with the prefix is listed."""
    return objects.with_prefix(store.listing(spark, _put(spark, sf)), "pdfs/0").select("path", "length")


@query("object_stat", with_("objects") + "select path, split_part(path, '/', -1) as file_name, length from objects")
def _(spark, sf):
    return objects.stat(fx.objects(spark, sf)).select("path", "file_name", "length")


@query("object_exists", with_("objects") + "select path, path in (select path from objects) as exists from (select distinct 'pdfs/' || md5(text) as path from documents where text is not null)")
def _(spark, sf):
    wanted = table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("pdfs/"), fx.md5(F.col("text"))).alias("path"))
    return objects.exists(wanted, fx.objects(spark, sf))


@query("read_objects", with_("stored_files") + "select path, split_part(path, '/', -1) as file_name, strlen(content)::bigint as length, md5(content) as file_hash from stored_files where number % 3 = 0")
def _(spark, sf):
    """A third of the keys are wanted, and some that aren't there; nothing is listed."""
    wanted = fx.stored_files(spark, sf).where("number % 3 = 0").select("path")
    nowhere = table(spark, sf, "documents").select(F.concat(F.lit("pdfs/none/"), F.col("doc_id").cast("string")).alias("path"))
    found = objects.stat(store.contents(wanted.unionByName(nowhere), _put(spark, sf)))
    return found.select("path", "file_name", "length", F.md5("content").alias("file_hash"))


def _results(spark, sf):
    """A parse result for each document: its lines as a JSON list of objects, with entries that are none."""
    lists = F.to_json(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("text").alias("type"), x.alias("text"), i.alias("page_idx"))))
    wrapped = F.concat(F.lit('{"results": {"result": {"results": {"content_list": [7, "x", null, '), F.substr(lists, F.lit(2)), F.lit("}}}}"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", fx.md5(F.col("text")).alias("file_hash"), F.when(F.col("doc_id") % 10 == 0, '{"results": {}}').when(F.col("doc_id") % 11 == 0, "{broken").otherwise(wrapped).alias("value"))


@query(
    "parse_result_scan",
    "select doc_id, case when doc_id % 10 = 0 or doc_id % 11 = 0 then 0 else len(string_split(text, chr(10))) + 3 end::bigint as n_entries from documents where text is not null",
)
def _(spark, sf):
    return objects.parse_results(_results(spark, sf)).select("doc_id", F.size("content_list").cast("long").alias("n_entries"))


@query(
    "explode_elements",
    with_("lines") + "select doc_id, element_index + 3 as element_index, 'text' as type, line as text, element_index as page_idx from lines where doc_id % 10 <> 0 and doc_id % 11 <> 0",
)
def _(spark, sf):
    from ..operators import elements

    return elements.explode_elements(objects.parse_results(_results(spark, sf))).select("doc_id", "element_index", "type", "text", F.col("page_idx").cast("long").alias("page_idx"))


@query(
    "result_for_hash",
    with_("objects") + "select file_hash, min(path) as path from (select path, regexp_extract(path, '^results/([^_/]*)_', 1) as file_hash from objects) where file_hash <> '' group by file_hash",
)
def _(spark, sf):
    return objects.result_of_hash(fx.objects(spark, sf), fx.lines(spark, sf).select("file_hash"))


@query(
    "get_file_by_hash",
    with_("objects") + "select file_hash, min(path) as path, arg_min(length, path) as length from (select path, length, regexp_extract(path, '^pdfs/([0-9a-f]{32})', 1) as file_hash from objects) where file_hash <> '' group by file_hash",
)
def _(spark, sf):
    return objects.file_of_hash(fx.objects(spark, sf), fx.lines(spark, sf).select("file_hash"))


@query("dir_images_base64", "select 'd' || doc_id || '.PNG' as name, base64(encode(text)) as image_base64 from documents where doc_id % 2 = 0")
def _(spark, sf):
    pictures = table(spark, sf, "documents").select(F.concat(F.lit("images/d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".PNG").otherwise(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return objects.images_base64(pictures)


@query(
    "html_to_elements",
    """with blocks as (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)(<h[1-6]>.*?</h[1-6]>|<p>.*?</p>)', 1) as b from pages),
    each as (select page_id, (generate_subscripts(b, 1) - 1)::bigint as element_index, unnest(b) as block from blocks)
    select page_id, element_index, 'text' as type, trim(regexp_replace(block, '<[^>]*>', ' ', 'g')) as text,
      case when regexp_matches(block, '^<h[1-6]>') then substring(block, 3, 1)::bigint else 0 end as text_level from each""",
)
def _(spark, sf):
    return html.elements(table(spark, sf, "pages")).withColumn("text_level", F.coalesce("text_level", F.lit(0)).cast("long"))


@query(
    "route_by_extension",
    with_("uploads") + "select filename, case when lower(filename) like '%.pdf' then 'document' else 'rejected' end as route from uploads",
)
def _(spark, sf):
    return fx.uploads(spark, sf).select("filename", objects.route(F.col("filename")).alias("route"))


@query(
    "page_range_slice",
    with_("elements") + """select doc_id, element_index, page_idx from (select *, max(page_idx) over (partition by doc_id) as last,
      count(*) filter (page_idx between 1 and 2) over (partition by doc_id) as n from elements) where n = 0 or page_idx between 1 and 2""",
)
def _(spark, sf):
    return html.slice_pages(fx.elements(spark, sf), 1, 2).select("doc_id", "element_index", "page_idx")


@query(
    "validate_upload",
    with_("uploads") + """select arrival, filename, reason, case when reason is null then 'ok' else 'rejected' end as status from (select *,
      case when filename = '' then 'no_name' when lower(filename) not like '%.pdf' then 'not_pdf' when contains(filename, '/') then 'path_in_name' when content = '' then 'empty' end as reason from uploads)""",
)
def _(spark, sf):
    return ingest.validate(fx.uploads(spark, sf)).select("arrival", "filename", "reason", "status")


_OK = "ok as (select arrival, filename, content, md5(content) as file_hash from uploads where lower(filename) like '%.pdf' and not contains(filename, '/') and content <> '')"


def _accepted(spark, sf):
    return ingest.with_hash(ingest.validate(fx.uploads(spark, sf)).where("status = 'ok'").drop("status", "reason"))


@query("content_hash", with_("uploads", then=_OK) + "select arrival, file_hash from ok")
def _(spark, sf):
    return _accepted(spark, sf).select("arrival", "file_hash")


_STATUS = """deduped as (select *, case when row_number() over (partition by file_hash order by arrival) = 1
  and file_hash not in (select md5(text) from documents where doc_id % 9 = 0 and text is not null) then 'success' else 'already_processed' end as status from ok)"""


def _deduped(spark, sf):
    stored = table(spark, sf, "documents").where("doc_id % 9 = 0 and text is not null").select(fx.md5(F.col("text")).alias("file_hash"))
    return ingest.dedupe(_accepted(spark, sf), stored)


@query("dedupe_uploads", with_("uploads", then=f"{_OK}, {_STATUS}") + "select arrival, file_hash, status from deduped")
def _(spark, sf):
    return _deduped(spark, sf).select("arrival", "file_hash", "status")


@query(
    "derive_keys",
    with_("uploads", then=_OK) + "select arrival, 'pdfs/' || file_hash || '_' || filename || '/' || filename as pdf_key, 'results/' || file_hash || '_' || filename || '/result.json' as result_key from ok",
)
def _(spark, sf):
    return ingest.with_keys(_accepted(spark, sf)).select("arrival", "pdf_key", "result_key")


@query("stamp_result_metadata", with_("uploads", then=_OK) + "select arrival, file_hash, filename as original_filename, '2024-01-02T03:04:05.000000' as processed_at from ok")
def _(spark, sf):
    at = F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return ingest.stamp(_accepted(spark, sf), at).select("arrival", "metadata.*")


@query(
    "explode_images",
    "select md5(text) as file_hash, 'images/' || doc_id || '.jpg' as path, sha256(text) as content_sha256, strlen(text)::bigint as length from documents where text is not null and doc_id % 4 <> 0",
)
def _(spark, sf):
    encoded = F.when(F.col("doc_id") % 4 == 0, "!not base64!").otherwise(F.regexp_replace(F.base64(F.col("text").cast("binary")), "\r\n", ""))
    results = table(spark, sf, "documents").where("text is not null").select(
        fx.md5(F.col("text")).alias("file_hash"), F.to_json(F.create_map(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")), encoded)).alias("images_base64")
    )
    return ingest.explode_images(results).select("file_hash", "path", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("length"))


@query(
    "upload_summary",
    with_("uploads", "records", then=f"{_OK}, {_STATUS}") + """select arrival, d.file_hash, status, case when status = 'success' then coalesce(n, 0) else 0 end::bigint as embeddings_computed,
      status = 'success' and g.file_hash is not null as graph_created from deduped d
      left join (select file_hash, count(*) as n from kept group by file_hash) r on r.file_hash = d.file_hash
      left join (select distinct file_hash from elements where type <> 'discarded') g on g.file_hash = d.file_hash""",
)
def _(spark, sf):
    from ..operators import elements

    own = fx.elements(spark, sf)
    records = elements.explode_records(own, fx.images(spark, sf))
    nodes = own.where("type <> 'discarded'")
    return ingest.summary(_deduped(spark, sf), records, nodes).select("arrival", "file_hash", "status", "embeddings_computed", "graph_created")


@query("normalize_object_name", with_("objects") + "select path, array_to_string(list_transform(string_split(path, '/'), lambda x: url_encode(x)), '/') as object_name from objects")
def _(spark, sf):
    return fx.objects(spark, sf).select("path", ingest.object_name(F.col("path")).alias("object_name"))


# Catalogs.

_PARSED = """parsed as (select *, case when contains(folder, '_') then split_part(folder, '_', 1) else 'unknown' end as file_hash,
  case when len(string_split(path, '/')) > 2 then split_part(path, '/', -1) when contains(folder, '_') then substring(folder, strpos(folder, '_') + 1) else folder end as file_name
  from (select *, split_part(path, '/', 2) as folder from objects where starts_with(path, 'pdfs/')))"""
_FILES = "files as (select file_hash, min(path) as path, arg_min(file_name, path) as file_name, arg_min(length, path) as length from parsed group by file_hash)"


@query("parse_object_path", with_("objects", then=_PARSED) + "select path, file_hash, file_name from parsed")
def _(spark, sf):
    return catalog.parsed(fx.objects(spark, sf)).select("path", "file_hash", "file_name")


def _files(spark, sf):
    return catalog.uploaded_files(fx.objects(spark, sf).select("path", "length"))


@query("uploaded_files", with_("objects", then=f"{_PARSED}, {_FILES}") + "select file_hash, path, file_name, length from files")
def _(spark, sf):
    return _files(spark, sf).select("file_hash", "path", "file_name", "length")


def _document_points(spark, sf):
    """Points of the documents' lines, and of files that nobody uploaded."""
    h = F.when(F.col("element_index") % 5 == 4, fx.md5(F.col("line"))).otherwise(F.col("file_hash"))
    return fx.lines(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("collection"), h.alias("file_hash"))


_DOCUMENT_POINTS = "document_points as (select case when doc_id % 2 = 0 then 'a' else 'b' end as collection, case when element_index % 5 = 4 then md5(line) else file_hash end as file_hash from lines)"


@query(
    "collection_files",
    with_("lines", "objects", then=f"{_PARSED}, {_FILES}, {_DOCUMENT_POINTS}") + "select distinct p.collection, p.file_hash, f.file_name from document_points p join files f using (file_hash)",
)
def _(spark, sf):
    return catalog.collection_files(_document_points(spark, sf), _files(spark, sf)).select("collection", "file_hash", "file_name")


@query(
    "unknown_file_fallback",
    with_("lines", "objects", then=f"{_PARSED}, {_FILES}, {_DOCUMENT_POINTS}") + "select distinct p.collection, p.file_hash, coalesce(f.file_name, 'unknown_' || substring(p.file_hash, 1, 8)) as file_name from document_points p left join files f using (file_hash)",
)
def _(spark, sf):
    return catalog.collection_files_or_unknown(_document_points(spark, sf), _files(spark, sf)).select("collection", "file_hash", "file_name")


@query(
    "index_coverage",
    with_("lines", "objects", "elements", then=f"{_PARSED}, {_FILES}, {_DOCUMENT_POINTS}, "
    "results as (select distinct regexp_extract(path, '^results/([^_/]*)_', 1) as file_hash from objects where path like 'results/%'), graphs as (select distinct file_hash from elements where type = 'image'), "
    "everything as (select file_hash from files union select file_hash from results union select file_hash from document_points union select file_hash from graphs)")
    + "select file_hash, file_hash in (select file_hash from files) as has_pdf, file_hash in (select file_hash from results) as has_result, file_hash in (select file_hash from document_points) as has_points, file_hash in (select file_hash from graphs) as has_graph from everything",
)
def _(spark, sf):
    results = objects.result_of_hash(fx.objects(spark, sf), fx.lines(spark, sf).select("file_hash"))
    return catalog.index_coverage(pdf=_files(spark, sf), result=results, points=_document_points(spark, sf), graph=fx.elements(spark, sf).where("type = 'image'"))


# Sinks.


@query(
    "write_embeddings_json",
    with_("records") + "select doc_id, 'embeddings/' || file_hash || '/element_' || element_index || case part when 'main' then '' else '_' || part end || '.json' as key, content from kept",
)
def _(spark, sf):
    from ..operators import elements

    return elements.explode_records(fx.elements(spark, sf), fx.images(spark, sf)).select("doc_id", sinks.record_key().alias("key"), "content")


@query("purge_objects", with_("objects") + "select path, length from objects where path not in (select path from objects where doc_id % 3 = 0)")
def _(spark, sf):
    own = fx.objects(spark, sf)
    return sinks.purge(own, own.where("doc_id % 3 = 0")).select("path", "length")
