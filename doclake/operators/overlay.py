"""Region overlays: the boxes of a page with colors, labels and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BOX_SPEC

# The color of each kind of region.
COLORS = {
    "title": "#9b59b6",
    "text": "#3498db",
    "image": "#27ae60",
    "image_caption": "#2ecc71",
    "image_footnote": "#1abc9c",
    "table": "#e67e22",
    "table_caption": "#f39c12",
    "table_footnote": "#d35400",
    "equation": "#e74c3c",
    "discarded": "#95a5a6",
}
DEFAULT_COLOR = "#333333"


def page_filter(elements: DataFrame, page: int | None = None, doc: str = "doc_id") -> DataFrame:
    """Elements of one page, or of all; element_index counts what is left, global_index is the original."""
    if page is not None:
        elements = elements.where(F.coalesce("page_idx", F.lit(0)) == page)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("element_index")) - 1
    return elements.withColumn("global_index", F.col("element_index")).withColumn("element_index", place.cast("long"))


def valid_boxes(elements: DataFrame) -> DataFrame:
    return elements.where(F.size(F.coalesce("bbox", F.array().cast("array<double>"))) == 4)


def region_type() -> Column:
    return F.when((F.col("type") == "text") & (F.col("text_level") == 1), "title").otherwise(F.coalesce("type", F.lit("unknown")))


def color_of(kind: Column) -> Column:
    pairs = [F.lit(x) for item in COLORS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(DEFAULT_COLOR))


def short(text: Column, length: int, dots: str = "...") -> Column:
    """The text, cut with dots if it is longer."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(dots))).otherwise(text)


def _list_text(prefix: str, side: str) -> Column:
    return F.array_join(F.coalesce(F.col(f"{prefix}_{side}"), F.array().cast("array<string>")), " ")


# The signs before previews.
FOOTNOTE_SIGN = "📝 "
SIGNS = {"title": "📑 Title: ", "equation": "∫ Equation: ", "discarded": "🗑️ Discarded: ", "image": "🖼️ ", "table": "📊 ", "image_caption": "📷 ", "table_caption": "📋 "}


def _described(prefix: str) -> Column:
    """Caption and footnote of an image or a table, or its number."""
    part = lambda sign, side: F.when(_list_text(prefix, side) != "", F.concat(F.lit(f"{sign}{side.capitalize()}: "), F.substring(_list_text(prefix, side), 1, 50)))
    both = F.concat_ws(" | ", part(SIGNS[prefix], "caption"), part(FOOTNOTE_SIGN, "footnote"))
    return F.when(both != "", both).otherwise(F.concat(F.lit(f"{SIGNS[prefix]}{prefix.capitalize()} #"), F.col("element_index").cast("string")))


def preview() -> Column:
    """A line about the region; null for kinds that have none."""
    kind, text = region_type(), short(F.coalesce("text", F.lit("")), 100)
    out = F.when(kind == "text", text).when(kind == "image", _described("image")).when(kind == "table", _described("table"))
    for name in ("title", "equation", "discarded"):
        out = out.when(kind == name, F.concat(F.lit(SIGNS[name]), text))
    return out


def regions(elements: DataFrame) -> DataFrame:
    """One row a region: main, and an image's or table's caption and footnote with the same box. Discarded ones are shown."""
    kind, number = region_type(), F.col("element_index").cast("string")
    row = lambda seq, kind, label, preview: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("region_type"), label.alias("label"), preview.alias("text_preview"))
    main = row(0, kind, F.concat(kind, F.lit("_"), number), preview())
    sides = []
    for seq, side in ((1, "caption"), (2, "footnote")):
        for prefix in ("image", "table"):
            text = short(_list_text(prefix, side), 100)
            sign = FOOTNOTE_SIGN if side == "footnote" else SIGNS[f"{prefix}_caption"]
            own = row(seq, F.lit(f"{prefix}_{side}"), text, F.concat(F.lit(f"{sign}{side.capitalize()}: "), text))
            sides.append(F.when((F.col("type") == prefix) & (F.size(f"{prefix}_{side}") > 0), own))
    rows = elements.withColumn("r", F.explode(F.filter(F.array(main, *sides), lambda r: r.isNotNull())))
    rows = rows.select(*(c for c in elements.columns if c not in ("seq", "region_type", "label", "text_preview")), "r.*")
    return rows.withColumn("color", color_of(F.col("region_type"))).withColumn("is_title", F.col("region_type") == "title")


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("total_elements"))


def scale_box(bbox: Column, width: Column, height: Column, zoom: int = 2) -> Column:
    """From 0..1000 to the page's size, then to pixels; cut to whole numbers each time."""
    on_page = F.transform(bbox, lambda x, i: (x / 1000 * F.when(i % 2 == 0, width).otherwise(height)).cast("int"))
    return F.transform(on_page, lambda x: (x * zoom).cast("int"))


def parse_boxes(spec: Column) -> Column:
    """array<struct<bbox,color,label>> of a JSON list; nothing if it isn't valid, and entries without four numbers are left out."""
    entries = F.from_json(spec, "array<string>")
    parsed = F.transform(F.filter(entries, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, BOX_SPEC))
    return F.coalesce(F.filter(parsed, lambda b: F.size(b["bbox"]) == 4), F.array().cast("array<struct<bbox:array<double>,color:string,label:string>>"))


def box_size(bbox: Column) -> tuple[Column, Column]:
    return F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0)), F.get(bbox, F.lit(3)) - F.get(bbox, F.lit(1))
