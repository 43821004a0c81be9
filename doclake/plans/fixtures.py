"""Inputs of the registered queries, derived from the given tables by rules that both engines evaluate.

Each has a DataFrame builder and a CTE; with_(names) gives the WITH clause of a query's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", md5(F.col("text")).alias("file_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "file_hash", F.col("pos").cast("long").alias("element_index"), "line")


def elements(spark: SparkSession, sf: str) -> DataFrame:
    i, doc, line = F.col("element_index"), F.col("doc_id"), F.col("line")
    k = (doc * 7 + i) % 12
    kind = F.when(k == 2, "image").when(k == 3, "table").when(k == 4, "equation").when(k == 5, "discarded").when(k == 6, "list").otherwise("text")
    blank = (doc + i) % 17 == 0
    text = F.when(k.isin(2, 3), None).when(blank, "").otherwise(line)
    head, tail = F.array(F.substring(line, 1, 40)), F.array(F.substring(line, 41, 40))
    top = ((i % 10) * 100).cast("double")
    return lines(spark, sf).select(
        "doc_id",
        "file_hash",
        "element_index",
        kind.alias("type"),
        text.alias("text"),
        F.when(k == 0, 1).when(k == 1, 2).alias("text_level"),
        F.when(k == 4, text).alias("latex"),
        F.when(k.isin(2, 3), F.concat(F.lit("images/"), md5(line), F.lit(".jpg"))).alias("img_path"),
        F.when(k == 2, head).alias("image_caption"),
        F.when((k == 2) & (doc % 2 == 0), tail).alias("image_footnote"),
        F.when((k == 3) & (doc % 3 == 0), head).alias("table_caption"),
        F.when((k == 3) & (doc % 2 == 1), tail).alias("table_footnote"),
        F.when(k == 3, F.concat(F.lit("<table>"), line, F.lit("</table>"))).alias("table_body"),
        F.array(F.lit(50.0), top, F.lit(950.0), top + 90).alias("bbox"),
        F.floor(i / 10).cast("long").alias("page_idx"),
        F.concat(F.lit('{"type": "list", "text": "'), line, F.lit('"}')).alias("raw"),
    )


def images_of(elements_: DataFrame) -> DataFrame:
    """Images that were stored."""
    return elements_.where("type = 'image' and element_index % 5 <> 0").select("img_path").distinct()


def images(spark: SparkSession, sf: str) -> DataFrame:
    return images_of(elements(spark, sf))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    h, n = md5(F.col("text")), F.concat(F.lit("d "), F.col("doc_id"), F.lit(".pdf"))
    short = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf"))
    keys = F.array(
        F.concat(F.lit("pdfs/"), h, F.lit("_"), n, F.lit("/"), n),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("pdfs/"), h, F.lit("_"), short)),
        F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("pdfs/"), h)),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("results/"), h, F.lit("_"), n, F.lit("/result.json"))),
    )
    return docs.select("doc_id", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("path"), F.col("n_chars").alias("length"))


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of 64 documents each, in 16 folders: number, path, content."""
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 64).alias("number"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    path = F.concat(F.lit("pdfs/"), F.lower(F.hex(F.col("number") % 16)), F.lit("/"), F.col("number").cast("string"), F.lit(".txt"))
    return docs.groupBy("number").agg(F.array_join(texts, "\n").alias("content")).select("number", path.alias("path"), "content")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    docs, d = table(spark, sf, "documents"), F.col("doc_id")
    name = lambda a, b: F.concat(F.lit(a), d, F.lit(b))
    filename = F.when(d % 13 == 0, name("a/d", ".pdf")).when(d % 11 == 0, name("d", ".txt")).when(d % 5 == 0, name("d", ".PDF")).otherwise(name("d", ".pdf"))
    return docs.select(d.alias("arrival"), filename.alias("filename"), F.when(d % 17 == 0, "").otherwise(F.coalesce("text", F.lit(""))).cast("binary").alias("content"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("collection"),
        F.col("vec_id").alias("point_id"),
        F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("file_hash"),
        F.col("vec_id").alias("element_index"),
    )


def queries_of(points_: DataFrame) -> DataFrame:
    """Every point whose id divides by 20 asks."""
    return points_.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), F.col("vector").alias("query"), F.col("file_hash").alias("query_hash"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with a text asks its own file, with its first line."""
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("question_id"), F.substring_index("text", "\n", 1).alias("question"), "doc_id", md5(F.col("text")).alias("file_hash"))


CTES = {
    "lines": """lines as (select doc_id, md5(text) as file_hash,
      (generate_subscripts(string_split(text, chr(10)), 1) - 1)::bigint as element_index, unnest(string_split(text, chr(10))) as line
      from documents where text is not null)""",
    "elements": """elements as (
      select doc_id, file_hash, element_index, line,
        case k when 2 then 'image' when 3 then 'table' when 4 then 'equation' when 5 then 'discarded' when 6 then 'list' else 'text' end as type,
        case when k in (2, 3) then null when b = 0 then '' else line end as text,
        case k when 0 then 1 when 1 then 2 end as text_level,
        case when k = 4 then case when b = 0 then '' else line end end as latex,
        case when k in (2, 3) then 'images/' || md5(line) || '.jpg' end as img_path,
        case when k = 2 then substring(line, 1, 40) end as image_caption,
        case when k = 2 and doc_id % 2 = 0 then substring(line, 41, 40) end as image_footnote,
        case when k = 3 and doc_id % 3 = 0 then substring(line, 1, 40) end as table_caption,
        case when k = 3 and doc_id % 2 = 1 then substring(line, 41, 40) end as table_footnote,
        case when k = 3 then '<table>' || line || '</table>' end as table_body,
        (element_index % 10) * 100 as top, element_index // 10 as page_idx,
        '{"type": "list", "text": "' || line || '"}' as raw
      from (select *, (doc_id * 7 + element_index) % 12 as k, (doc_id + element_index) % 17 as b from lines))""",
    "images": "images as (select distinct img_path from elements where type = 'image' and element_index % 5 <> 0)",
    "objects": """objects as (select doc_id, path, n_chars as length from (
      select doc_id, n_chars, 'pdfs/' || md5(text) || '_d ' || doc_id || '.pdf/d ' || doc_id || '.pdf' as path from documents where text is not null
      union all select doc_id, n_chars, 'pdfs/' || md5(text) || '_d' || doc_id || '.pdf' from documents where text is not null and doc_id % 7 = 0
      union all select doc_id, n_chars, 'pdfs/' || md5(text) from documents where text is not null and doc_id % 50 = 0
      union all select doc_id, n_chars, 'results/' || md5(text) || '_d ' || doc_id || '.pdf/result.json' from documents where text is not null and doc_id % 3 <> 0))""",
    "stored_files": """stored_files as (select number, 'pdfs/' || substring('0123456789abcdef', number % 16 + 1, 1) || '/' || number || '.txt' as path, content from (
      select doc_id // 64 as number, string_agg(coalesce(text, ''), chr(10) order by doc_id, coalesce(text, '')) as content from documents group by doc_id // 64))""",
    "uploads": """uploads as (select doc_id as arrival,
      case when doc_id % 13 = 0 then 'a/d' || doc_id || '.pdf' when doc_id % 11 = 0 then 'd' || doc_id || '.txt'
           when doc_id % 5 = 0 then 'd' || doc_id || '.PDF' else 'd' || doc_id || '.pdf' end as filename,
      case when doc_id % 17 = 0 then '' else coalesce(text, '') end as content from documents)""",
    "points": """points as (select case when vec_id % 2 = 0 then 'a' else 'b' end as collection, vec_id as point_id, embedding as vector,
      label::varchar as file_hash, vec_id as element_index from embeddings)""",
    "questions": """questions as (select doc_id as question_id, string_split(text, chr(10))[1] as question, doc_id, md5(text) as file_hash
      from documents where text is not null)""",
    "records": """records as (
      select doc_id, file_hash, element_index, 'main' as part, 0 as seq,
        case when type = 'text' and text_level = 1 then 'title' else type end as element_type,
        case type when 'text' then case when text <> '' then case when text_level = 1 then 'Title: ' when text_level is not null then 'Text (level ' || text_level || '): ' else 'Text: ' end || text end
                  when 'image' then 'Image: ' || img_path when 'table' then 'Table: ' || case when table_body <> '' then ' | Body: ' || table_body else '' end
                  when 'equation' then case when latex <> '' then 'Equation: ' || latex end when 'list' then raw end as content, img_path, page_idx, type, top
      from elements
      union all select doc_id, file_hash, element_index, 'caption', 1, type || '_caption',
        case type when 'image' then case when image_caption <> '' then 'Image Caption: ' || image_caption end when 'table' then case when table_caption <> '' then 'Table Caption: ' || table_caption end end, img_path, page_idx, type, top
      from elements
      union all select doc_id, file_hash, element_index, 'footnote', 2, type || '_footnote',
        case type when 'image' then case when image_footnote <> '' then 'Image Footnote: ' || image_footnote end when 'table' then case when table_footnote <> '' then 'Table Footnote: ' || table_footnote end end, img_path, page_idx, type, top
      from elements),
    kept as (select r.* from records r where content is not null and (type <> 'image' or img_path in (select img_path from images)))""",
}
_NEEDS = {"elements": ("lines",), "images": ("elements",), "records": ("images",)}


def with_(*names: str, then: str = "") -> str:
    """The WITH clause for these inputs and what they need, and further CTEs after them."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join([CTES[n] for n in order] + ([then] if then else [])) + "\n"
