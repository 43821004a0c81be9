"""Token counts of sections and fields by offset attribution.

A whole text is encoded once. Its tokens' character spans follow from the bytes that each id stands for, which are the text's bytes
one after another. They are joined to the sections' spans: both are sorted, so the join of a text is one merge. A token that
crosses a boundary goes, by the rule given, to the section in which it starts ("start", the default), to that of its last
character ("end"), or to the one with most of its characters, the earlier of equals ("most"). Every token belongs to exactly one
section, so the sections' counts add up to the text's.

Sections are lines with the line end that closes them (`lines`), or from one heading to the next (`headings`); they tile the text. Any
other disjoint and complete spans can be given instead. Fields are columns that are read as one text, with a separator that
belongs to the field before it.

Null or empty text: one empty section without tokens. Null fields are empty ones. Null ids stay null; repeated rows are counted each;
ids that many rows share don't matter, nothing is grouped. Very long texts are encoded whole, in memory of some 40 bytes a
character. An empty table gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, encoder, vocabulary

RULES = ("start", "end", "most")


class Spans:
    """Character spans of a text's tokens, from its ids."""

    def __init__(self, base: Encoder):
        self.base = base
        #: Bytes of each id, where ids are the text's bytes one after another.
        self.sizes = np.array([len(base.tokenizer.id_to_token(k) or "") for k in range(base.tokenizer.get_vocab_size())], np.int64) if base.blanks else None

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.sizes is None or self.base.special(text):
            offsets = np.array(self.base.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return offsets[:, 0], offsets[:, 1]
        ends = np.cumsum(self.sizes[np.frombuffer(self.base.encode(text), "<u4")])
        starts = np.concatenate([[0], ends[:-1]])
        if len(text) == ends[-1]:  # every character is a byte
            return starts, ends
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


def lines(text: str) -> np.ndarray:
    """Where each line starts, and the length at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], starts[starts < len(codes)], [len(codes)]]) if len(codes) else np.array([0, 0])


def headings(text: str) -> np.ndarray:
    """Where each section starts: at lines that begin with #, and at the start of the text."""
    starts = [k for k in lines(text)[1:-1].tolist() if text[k] == "#"]
    return np.array([0, *starts, len(text)], np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross a boundary. bounds: where sections start, and where the last ends."""
    n = len(bounds) - 1
    inner = bounds[1:-1]
    first = np.searchsorted(inner, starts, "right")
    last = np.searchsorted(inner, np.maximum(ends - 1, starts), "right")
    owner = first if rule == "start" else last.copy()
    if rule == "most":
        for k in np.flatnonzero(first != last).tolist():
            parts = [min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(parts))
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


_OUT = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _counted(rows: DataFrame, bounds_of: Callable[[list[str]], tuple[str, np.ndarray]], path: str | None, rule: str) -> DataFrame:
    """rows: doc_id and the columns of a text, which bounds_of makes one, with its sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary("byte_bpe_50k.json")

    def count(batches) -> Iterator[pa.RecordBatch]:
        spans = Spans(encoder(path))
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                text, bounds = bounds_of([t or "" for t in texts])
                tokens, crossing = attribute(*spans.of(text), bounds, rule)
                n = len(bounds) - 1
                for c, values in zip(columns, ([doc] * n, range(n), bounds[:-1].tolist(), bounds[1:].tolist(), tokens.tolist(), crossing.tolist())):
                    c.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, _OUT)


def count_sections(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, sections: Callable[[str], np.ndarray] = lines, rule: str = "start") -> DataFrame:
    """A row a section: doc_id, section (from 0), its characters [start, end), n_tokens, n_crossing."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _counted(rows, lambda texts: (texts[0], sections(texts[0])), path, rule)


def count_fields(docs: DataFrame, fields: list[str], id_col="doc_id", path: str | None = None, separator: str = "\n", rule: str = "start") -> DataFrame:
    """A row a field of each row, read as one text: doc_id, field, its characters [start, end), n_tokens, n_crossing."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *(docs[f].cast("string").alias(f"text{k}") for k, f in enumerate(fields)))

    def joined(texts: list[str]) -> tuple[str, np.ndarray]:
        parts = [*(t + separator for t in texts[:-1]), texts[-1]]
        return "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    found = _counted(rows, joined, path, rule)
    return found.withColumn("field", F.get(F.array(*map(F.lit, fields)), F.col("section"))).select("doc_id", "field", "start", "end", "n_tokens", "n_crossing")
