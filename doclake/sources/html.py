"""Pages of HTML to elements, in built-in functions; and a table function for other parsers to plug into."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = r"(?s)(<h[1-6]>.*?</h[1-6]>|<p>.*?</p>)"


def article(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings (with their level) and paragraphs of each page's article, in order: element_index, type, text, text_level."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(article(F.col(html_col)), F.lit(BLOCK), F.lit(1))).alias("pos", "block"))
    level = F.regexp_extract("block", "^<h([1-6])>", 1)
    text = F.trim(F.regexp_replace("block", "<[^>]*>", " "))
    return rows.select(id_col, F.col("pos").cast("long").alias("element_index"), F.lit("text").alias("type"), text.alias("text"), F.when(level != "", level.cast("int")).alias("text_level"))


def parser(parse=None):
    """A table function of content to elements; `parse` gives (type, text, level) for a document's text."""

    def default(content: str) -> Iterator[tuple[str, str, int | None]]:
        found = re.search(r"(?s)<article>(.*?)</article>", content or "")
        for block in re.findall(BLOCK, found[1] if found else ""):
            level = re.match("<h([1-6])>", block)
            yield "text", re.sub("<[^>]*>", " ", block).strip(" "), int(level[1]) if level else None

    own = parse or default

    class Parse:
        def eval(self, content: str):
            for k, (kind, text, level) in enumerate(own(content)):
                yield k, kind, text, level

    return F.udtf(Parse, returnType="element_index int, type string, text string, text_level int")


def slice_pages(elements: DataFrame, start: int, end: int | None = None, doc: str = "doc_id") -> DataFrame:
    """Pages start to end of each document, both included; if a document has none of them, all its pages."""
    whole = Window.partitionBy(doc)
    last = F.max("page_idx").over(whole)
    inside = (F.col("page_idx") >= start) & (F.col("page_idx") <= (last if end is None else F.least(F.lit(end), last)))
    rows = elements.withColumn("inside", inside).withColumn("any_inside", F.max("inside").over(whole))
    return rows.where("inside or not any_inside").drop("inside", "any_inside")
