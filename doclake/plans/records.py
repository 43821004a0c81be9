"""Queries of elements, records and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements, overlay
from . import fixtures as fx
from .fixtures import with_

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


@query("drop_discarded", with_("elements") + "select doc_id, element_index, type from elements where type <> 'discarded'")
def _(spark, sf):
    return elements.drop_discarded(fx.elements(spark, sf)).select("doc_id", "element_index", "type")


def _kinds(name: str, types: list[str]) -> None:
    listed = ", ".join(f"'{t}'" for t in types)

    @query(name, with_("records") + f"select doc_id, element_index, element_type, content from kept where element_type in ({listed})")
    def _(spark, sf):
        return _records(spark, sf).where(F.col("element_type").isin(types)).select("doc_id", "element_index", "element_type", "content")


_kinds("text_records", ["text", "title"])
_kinds("image_records", ["image"])
_kinds("caption_records", ["image_caption", "table_caption"])
_kinds("footnote_records", ["image_footnote", "table_footnote"])
_kinds("table_records", ["table"])
_kinds("equation_records", ["equation"])
_kinds("unknown_records", ["list"])


@query("explode_records", with_("records") + "select doc_id, file_hash, element_index, part, element_type, content from kept")
def _(spark, sf):
    return _records(spark, sf).select("doc_id", "file_hash", "element_index", "part", "element_type", "content")


@query(
    "record_metadata",
    with_("records") + """select doc_id, element_index, element_type, file_hash, case when placed then coalesce(img_path, '') end as img_path,
      case when placed then top::double else -1 end as box_top, case when placed then page_idx else -1 end as page_idx
      from (select *, element_type = 'image' or element_type like '%\\_caption' escape '\\' or element_type like '%\\_footnote' escape '\\' as placed from kept)""",
)
def _(spark, sf):
    p = elements.record_metadata(_records(spark, sf))
    return p.select("doc_id", "payload.element_index", "payload.element_type", "payload.file_hash", "payload.img_path", F.coalesce(F.get("payload.bbox", F.lit(1)), F.lit(-1.0)).alias("box_top"), F.coalesce("payload.page_idx", F.lit(-1)).cast("long").alias("page_idx"))


@query("record_counts", with_("records") + "select file_hash, element_type, count(*) as n_records from kept group by all")
def _(spark, sf):
    return elements.record_counts(_records(spark, sf), "file_hash")


@query(
    "index_by_hash",
    with_("records") + """, wanted as (select distinct file_hash from lines union select md5(file_hash) from lines),
      r as (select distinct file_hash from lines where doc_id % 3 <> 0), e as (select distinct file_hash from elements where doc_id % 3 <> 0 and type <> 'discarded'),
      n as (select file_hash, count(*) as n from kept where doc_id % 3 <> 0 group by file_hash)
      select w.file_hash, case when r.file_hash is null then 'no_result' when e.file_hash is null then 'no_elements' when n is null then 'no_records' else 'indexed' end as status,
      coalesce(n, 0)::bigint as n_records, r.file_hash is not null and e.file_hash is not null and n is not null as indexed
      from wanted w left join r using (file_hash) left join e using (file_hash) left join n using (file_hash)""",
)
def _(spark, sf):
    lines = fx.lines(spark, sf)
    wanted = lines.select("file_hash").unionByName(lines.select(fx.md5(F.col("file_hash")).alias("file_hash")))
    have = "doc_id % 3 <> 0"
    return elements.index_status(wanted, lines.where(have), fx.elements(spark, sf).where(have).where("type <> 'discarded'"), _records(spark, sf).where(have))


# Overlays.

_TYPE = "case when type = 'text' and text_level = 1 then 'title' else type end"


@query(
    "overlay_page_filter",
    with_("elements") + "select doc_id, element_index as global_index, row_number() over (partition by doc_id order by element_index) - 1 as element_index from elements where page_idx = 1",
)
def _(spark, sf):
    return overlay.page_filter(fx.elements(spark, sf), 1).select("doc_id", "global_index", "element_index")


@query("overlay_valid_bbox", with_("elements") + "select doc_id, element_index from elements where element_index % 4 <> 1")
def _(spark, sf):
    box = F.when(F.col("element_index") % 4 == 1, F.slice("bbox", 1, 3)).otherwise(F.col("bbox"))
    return overlay.valid_boxes(fx.elements(spark, sf).withColumn("bbox", box)).select("doc_id", "element_index")


_COLOR = "case {} " + " ".join(f"when '{k}' then '{v}'" for k, v in overlay.COLORS.items()) + f" else '{overlay.DEFAULT_COLOR}' end"


@query("overlay_type_color", with_("elements") + f"select doc_id, element_index, region_type, {_COLOR.format('region_type')} as color from (select *, {_TYPE} as region_type from elements)")
def _(spark, sf):
    kind = overlay.region_type()
    return fx.elements(spark, sf).select("doc_id", "element_index", kind.alias("region_type"), overlay.color_of(kind).alias("color"))


def _cut(text: str, n: int = 100) -> str:
    return f"case when length({text}) > {n} then substring({text}, 1, {n}) || '...' else {text} end"


def _side(prefix: str, side: str, sign: str) -> str:
    c = f"{prefix}_{side}"
    return f"select doc_id, element_index, {1 if side == 'caption' else 2} as seq, '{c}' as region_type, {_cut(c)} as label, '{sign}{side.capitalize()}: ' || {_cut(c)} as text_preview from elements where {c} is not null"


def _main_preview(prefix: str) -> str:
    sign = overlay.SIGNS[prefix]
    parts = f"concat_ws(' | ', case when {prefix}_caption <> '' then '{sign}Caption: ' || substring({prefix}_caption, 1, 50) end, case when {prefix}_footnote <> '' then '{overlay.FOOTNOTE_SIGN}Footnote: ' || substring({prefix}_footnote, 1, 50) end)"
    return f"case when {parts} <> '' then {parts} else '{sign}{prefix.capitalize()} #' || element_index end"


_REGIONS = f"""regions as (
  select doc_id, element_index, 0 as seq, region_type, region_type || '_' || element_index as label,
    case region_type when 'text' then {_cut("text")} when 'title' then '{overlay.SIGNS["title"]}' || {_cut("text")} when 'equation' then '{overlay.SIGNS["equation"]}' || {_cut("text")}
      when 'discarded' then '{overlay.SIGNS["discarded"]}' || {_cut("text")} when 'image' then {_main_preview("image")} when 'table' then {_main_preview("table")} end as text_preview
  from (select *, {_TYPE} as region_type from elements)
  union all {_side("image", "caption", overlay.SIGNS["image_caption"])} union all {_side("image", "footnote", overlay.FOOTNOTE_SIGN)}
  union all {_side("table", "caption", overlay.SIGNS["table_caption"])} union all {_side("table", "footnote", overlay.FOOTNOTE_SIGN)})"""


def _regions(spark, sf):
    return overlay.regions(overlay.valid_boxes(fx.elements(spark, sf)))


@query("overlay_label", with_("elements", then=_REGIONS) + "select doc_id, element_index, region_type, label from regions")
def _(spark, sf):
    return _regions(spark, sf).select("doc_id", "element_index", "region_type", "label")


@query("overlay_preview", with_("elements", then=_REGIONS) + "select doc_id, element_index, region_type, text_preview from regions")
def _(spark, sf):
    return _regions(spark, sf).select("doc_id", "element_index", "region_type", "text_preview")


@query("overlay_explode", with_("elements", then=_REGIONS) + f"select doc_id, element_index, seq::bigint as seq, region_type, {_COLOR.format('region_type')} as color, region_type = 'title' as is_title from regions")
def _(spark, sf):
    return _regions(spark, sf).select("doc_id", "element_index", "seq", "region_type", "color", "is_title")


@query("overlay_totals", with_("elements", then=_REGIONS) + "select r.doc_id, e.page_idx, count(*) as total_elements from regions r join elements e using (doc_id, element_index) group by all")
def _(spark, sf):
    return overlay.totals(_regions(spark, sf), "doc_id", "page_idx")


@query(
    "scale_bbox",
    with_("elements") + """select doc_id, element_index, trunc(50.0 / 1000 * 612)::bigint * 2 as x0, trunc(top::double / 1000 * 792)::bigint * 2 as y0,
      trunc(950.0 / 1000 * 612)::bigint * 2 as x1, trunc((top + 90)::double / 1000 * 792)::bigint * 2 as y1 from elements""",
)
def _(spark, sf):
    box = overlay.scale_box(F.col("bbox"), F.lit(612), F.lit(792))
    return fx.elements(spark, sf).withColumn("b", box).select("doc_id", "element_index", *(F.get("b", F.lit(k)).cast("long").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(
    "parse_bbox_spec",
    with_("elements") + """select doc_id, element_index, k::bigint as k, 'c' || k as label, '#0000FF' as color, (top + k)::double as y0 from elements, range(2) t(k)
      where element_index % 7 <> 0""",
)
def _(spark, sf):
    top = F.get("bbox", F.lit(1)).cast("long")
    one = lambda k: F.concat(F.lit('{"bbox": [1, '), (top + k).cast("string"), F.lit(f', 3, 4], "color": "#0000FF", "label": "c{k}"}}'))
    spec = F.when(F.col("element_index") % 7 == 0, "[{oops").otherwise(F.concat(F.lit("["), one(0), F.lit(', 5, {"bbox": [1, 2], "label": "short"}, '), one(1), F.lit("]")))
    rows = fx.elements(spark, sf).select("doc_id", "element_index", F.posexplode(overlay.parse_boxes(spec)).alias("k", "b"))
    return rows.select("doc_id", "element_index", F.col("k").cast("long").alias("k"), "b.label", "b.color", F.get("b.bbox", F.lit(1)).alias("y0"))


@query("bbox_size", with_("elements") + "select doc_id, element_index, 900::double as width, 90::double as height from elements")
def _(spark, sf):
    width, height = overlay.box_size(F.col("bbox"))
    return fx.elements(spark, sf).select("doc_id", "element_index", width.alias("width"), height.alias("height"))
