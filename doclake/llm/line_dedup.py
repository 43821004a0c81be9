"""Line dedup by two Bloom filters.

A line's key is the line without white space at either end and with A-Z in lower case. A key of at least min_chars code
points that is found in two documents or more keeps its lines only in the document of the smallest id. A first pass
fills the filters of once-seen and twice-seen hashes, of a size that follows from the number of lines; only lines that the
second filter suspects are shuffled, as 128-bit digests, to confirm the repeat and to choose the first document. (Where the
filter is too large to broadcast, digests meet their slice of it first.) Texts move once, to meet their own drop list.

Null or empty text: one empty line, kept. Null id: the largest id. Rows that share an id are one document to the choice
of the first, and each is written. A line within one document only is never dropped, however often it is there. Very long texts are split
whole, and their keys met once each. An empty table gives an empty table; a clashing column name gets underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BROADCAST, Repeats, repeated, slices_for
from .common import NO_ID, as_bytes, fresh, join_counted, narrow, stored

#: White space that is stripped: space and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line's key, None for keys too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars))}


def first_documents(docs: DataFrame, min_chars: int = MIN_CHARS, slices: int | None = None, most: int = BROADCAST) -> DataFrame:
    """(doc_id, keys): the digests that each document loses, from a table of doc_id and text."""
    if slices is None:
        lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
        slices = slices_for(docs.agg(F.sum(lines)).first()[0] or 0)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        keys = [k[:8] for t in as_bytes(batch.column(0)) for k in _keys(t, min_chars)]
        return np.frombuffer(b"".join(keys), "<u8")

    known = repeated(docs.select("text"), hashes, slices, most)
    filters = docs.sparkSession.sparkContext.broadcast(known) if isinstance(known, Repeats) else None

    def lines(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                own = list(_keys(t, min_chars))
                ids += [i] * len(own)
                keys += own
            h = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
            found = (filters.value.suspects(h).nonzero()[0] if filters else np.arange(len(h))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(h[found].view(np.int64)), pa.array([keys[j] for j in found], pa.binary()), pa.array([ids[j] for j in found], pa.int64())], names=["hash", "key", "doc_id"])

    rows = docs.mapInArrow(lines, "hash long, key binary, doc_id long")
    found = stored((rows if filters else known.only(rows)).drop("hash"), "suspected-lines")
    # Smallest and largest id combine before the shuffle, so a line of very many documents is a few rows.
    confirmed = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    confirmed = confirmed.where("first < last").select("key", "first", "rows")
    lost = join_counted(found, confirmed, "key", "rows").where("doc_id <> first").select("doc_id", "key")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _kept_lines(text: bytes | None, drop: set[bytes], min_chars: int) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not drop:
        return len(lines), 0, text or b""
    keep = [line for line in lines if line_key(line, min_chars) not in drop]
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars: int = MIN_CHARS, slices: int | None = None, most: int = BROADCAST) -> DataFrame:
    """docs with the kept text in its text column, and n_lines, n_dropped (long) after the given columns.

    A clashing column name gets underscores.
    """
    lost = first_documents(narrow(docs, id_col, text_col), min_chars, slices, most)
    drops, key, n_lines, n_dropped = (fresh(docs, x) for x in ("drops", "drop_id", "n_lines", "n_dropped"))
    lost = lost.select(F.col("doc_id").alias(key), F.col("keys").alias(drops))
    # Drop lists are far smaller than texts: they are the built side, and the texts aren't sorted.
    joined = docs.join(lost.hint("shuffle_hash"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == F.col(key), "left").drop(key)
    at, names = docs.columns.index(text_col), docs.columns

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = batch.column(len(names)).to_pylist()
            rows = [_kept_lines(t, set(d or ()), min_chars) for t, d in zip(as_bytes(batch.column(at)), drop)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
            columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, n_lines, n_dropped])

    schema = docs.select("*", F.lit(0).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_dropped)).schema
    return joined.mapInArrow(cut, schema)
