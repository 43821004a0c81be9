"""Schemas of the tables that operators take and give, as DDL."""

#: What a layout parser says of one element of a page; every key may be absent.
ELEMENT = (
    "type string, text string, text_level int, latex string, img_path string, image_caption array<string>, "
    "image_footnote array<string>, table_caption array<string>, table_footnote array<string>, table_body string, "
    "bbox array<double>, page_idx int"
)
OBJECT = "path string, modificationTime timestamp, length bigint, content binary"
BOX_SPEC = "bbox array<double>, color string, label string"
