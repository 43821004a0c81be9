"""Elements of pages to embeddable records: one scan, one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ELEMENT

KNOWN = ("text", "image", "table", "equation")


def explode_elements(results: DataFrame, list_col: str = "content_list") -> DataFrame:
    """A row an entry of an array of JSON strings that is an object; element_index is its place, and `raw` the entry."""
    others = [c for c in results.columns if c != list_col]
    rows = results.select(*others, F.posexplode(list_col).alias("element_index", "raw"))
    rows = rows.where(F.ltrim("raw").startswith("{")).withColumn("e", F.from_json("raw", ELEMENT))
    return rows.select(*others, F.col("element_index").cast("long").alias("element_index"), "raw", "e.*")


def drop_discarded(elements: DataFrame) -> DataFrame:
    """A missing type is not discarded; indexes keep their gaps."""
    return elements.where(~F.col("type").eqNullSafe("discarded"))


def _filled(text: Column, prefix: str | Column) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(text != "", F.concat(prefix, text))


def _joined(parts: str) -> Column:
    return F.array_join(F.coalesce(F.col(parts), F.array().cast("array<string>")), " ")


def text_content() -> Column:
    level = F.col("text_level")
    prefix = F.when(level == 1, "Title: ").when(level.isNotNull(), F.concat(F.lit("Text (level "), level, F.lit("): "))).otherwise("Text: ")
    return _filled(F.col("text"), prefix)


def table_content() -> Column:
    return F.concat(F.lit("Table: "), F.coalesce(_filled(F.col("table_body"), " | Body: "), F.lit("")))


def main_content() -> Column:
    """What the element itself says; null if there is nothing to embed."""
    kind = F.col("type")
    return (
        F.when(kind == "text", text_content())
        .when(kind == "image", F.concat(F.lit("Image: "), F.coalesce("img_path", F.lit(""))))
        .when(kind == "table", table_content())
        .when(kind == "equation", _filled(F.col("latex"), "Equation: "))
        .otherwise(F.col("raw"))
    )


def side_content(side: str) -> Column:
    """The caption or footnote of an image or a table."""
    label = side.capitalize()
    return F.when(F.col("type") == "image", _filled(_joined(f"image_{side}"), f"Image {label}: ")).when(F.col("type") == "table", _filled(_joined(f"table_{side}"), f"Table {label}: "))


def record_type() -> Column:
    return F.when((F.col("type") == "text") & (F.col("text_level") == 1), "title").otherwise(F.coalesce("type", F.lit("unknown")))


def explode_records(elements: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One to three records an element: part main, caption or footnote. An image that isn't in `images` has none at all.

    Order within an element: an image's main, caption, footnote; a table's caption, footnote, main (seq).
    """
    live = drop_discarded(elements)
    if images is not None:
        # Images alone are looked up: rows without a path would all meet in one task.
        # Not made distinct, which a semi join doesn't need: below an aggregate Spark could not split the elements of a frequent path.
        stored = images.select(F.col("img_path").alias("stored_path"))
        shown = live.where("type = 'image'").join(stored, F.col("img_path") == F.col("stored_path"), "left_semi")
        live = live.where(~F.col("type").eqNullSafe("image")).unionByName(shown)
    kind = record_type()
    late = F.when(F.col("type") == "table", 3).otherwise(0)
    record = lambda part, seq, kind, content: F.struct(F.lit(part).alias("part"), seq.cast("long").alias("seq"), kind.alias("element_type"), content.alias("content"))
    parts = F.array(
        record("main", late, kind, main_content()),
        record("caption", F.lit(1), F.concat(kind, F.lit("_caption")), side_content("caption")),
        record("footnote", F.lit(2), F.concat(kind, F.lit("_footnote")), side_content("footnote")),
    )
    rows = live.withColumn("r", F.explode(F.filter(parts, lambda r: r["content"].isNotNull())))
    return rows.select(*(c for c in elements.columns if c not in ("part", "seq", "element_type", "content")), "r.*")


def record_metadata(records: DataFrame) -> DataFrame:
    """The payload of a record: where images, captions and footnotes also carry path, box and page."""
    placed = (F.col("element_type") == "image") | F.col("element_type").endswith("_caption") | F.col("element_type").endswith("_footnote")
    payload = F.struct(
        "element_index",
        "element_type",
        "file_hash",
        F.when(placed, F.coalesce("img_path", F.lit(""))).alias("img_path"),
        F.when(placed, F.coalesce("bbox", F.array().cast("array<double>"))).alias("bbox"),
        F.when(placed, F.coalesce("page_idx", F.lit(0))).alias("page_idx"),
    )
    return records.withColumn("payload", payload)


def record_counts(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys, "element_type").agg(F.count("*").alias("n_records"))


def index_status(wanted: DataFrame, results: DataFrame, elements: DataFrame, records: DataFrame) -> DataFrame:
    """Per wanted file_hash: whether a result, elements and records are there, and how many records."""
    has = lambda df, name: df.select("file_hash").distinct().withColumn(name, F.lit(True))
    n = records.groupBy("file_hash").agg(F.count("*").alias("n_records"))
    out = wanted.select("file_hash").distinct().join(has(results, "r"), "file_hash", "left").join(has(elements, "e"), "file_hash", "left").join(n, "file_hash", "left")
    n = F.coalesce("n_records", F.lit(0))
    status = F.when(F.col("r").isNull(), "no_result").when(F.col("e").isNull(), "no_elements").when(n == 0, "no_records").otherwise("indexed")
    return out.select("file_hash", status.alias("status"), n.alias("n_records"), (status == "indexed").alias("indexed"))
