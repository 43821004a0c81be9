"""A content-addressed store of token ids.

Each text's ids are cut into chunks by a rolling hash, so equal passages give equal chunks wherever they stand. A chunk's
address is the digest of its bytes; a chunk is written once. A document's recipe lists its chunks' addresses, and the
Merkle root over them; the manifest has the Merkle root of each recipe file, over its documents' roots. Reading puts the
documents together again, and fails on a chunk, document or file that does not have its address or root.

Files, all Parquet, under one folder:
  chunks/    a row for each address: address binary(16), ids: zstd of little-endian unsigned 16 or 32-bit integers, after a
             byte that is the width
  recipes/   in ascending doc_id over its files: doc_id, start (ids of all documents before), n_tokens, addresses, root
  manifest/  a row for each recipe file: file, first and last doc_id, documents, root

Null and empty texts: the end id alone. Null id: the largest. Rows that share an id are kept apart, in the order of
their roots; so are repeated rows. Very long texts have chunks like others, of at most MOST ids each. An empty table gives an
empty store. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, NO_ID, cleaned_up, discard, given_id, join_counted, narrow, prefix_sums, scratch_root, shuffle_width, stored
from .tokens import encoder, vocabulary

END_ID = 2
#: Chunks have AVERAGE ids more than LEAST on the whole, and MOST at most; a cut depends on WINDOW ids before it. Powers of two.
LEAST, AVERAGE, MOST, WINDOW = 256, 2048, 16384, 16
_MULTIPLIER = 0x9E3779B97F4A7C15


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last WINDOW ids has its low bits zero."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    # The hash of WINDOW ids from those of its halves.
    rolling, have = ids.astype(np.uint64), 1
    while have < WINDOW:
        rolling = rolling[:-have] * np.uint64(pow(_MULTIPLIER, have, 1 << 64)) + rolling[have:]
        have *= 2
    marks = np.flatnonzero((rolling * np.uint64(_MULTIPLIER) >> np.uint64(32)) & np.uint64(AVERAGE - 1) == 0) + WINDOW
    out, last = [], 0
    for end in [*marks.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16, person=b"chunk").digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves, paired level by level; an odd one goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[k : k + 2]), digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"\2", digest_size=16).digest()


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + _zstd()[0].compress(ids.astype(f"<u{width}").tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(packed[1:]), f"<u{packed[0]}").astype("<u4")


_ENCODED = "doc_id long, root binary, n_tokens long, addresses array<binary>, chunks array<binary>"


def chunked(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Per document: its ids' number, and its chunks with their addresses."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("root", pa.binary()), ("n_tokens", pa.int64()), ("addresses", pa.list_(pa.binary())), ("chunks", pa.list_(pa.binary()))])

    def encode(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(tokenizer.encode(text.as_py()) + end, "<u4")
                ends = cuts(ids)
                parts = [ids[a:b] for a, b in zip([0, *ends], ends)]
                addresses = [address(p.tobytes()) for p in parts]
                rows.append((doc.as_py(), merkle(addresses), len(ids), addresses, [pack_ids(p) for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.mapInArrow(encode, _ENCODED)


def _first_of_each(chunks: DataFrame) -> DataFrame:
    """Of the rows (address, place, ids) the one of each address that has the least place. Places differ."""
    least = chunks.groupBy("address").agg(F.min("place").alias("least"), F.count("*").alias("rows"))
    return join_counted(chunks, least, "address", "rows").where(F.col("place") == F.col("least")).select("address", "ids")


def write_store(docs: DataFrame, folder: str, id_col="doc_id", text_col="text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encode all texts and write the store's files."""
    spark = docs.sparkSession
    path = path or vocabulary("word_bpe_49k.json")
    encoded = chunked(narrow(docs, id_col, text_col), path, end_id).withColumn("row", F.monotonically_increasing_id())
    encoded = stored(encoded, "encoded")  # from here on a row's number stays
    chunks = encoded.select("row", F.posexplode(F.arrays_zip("addresses", "chunks")).alias("k", "c"))
    chunks = chunks.select(F.col("c.addresses").alias("address"), F.struct("row", "k").alias("place"), F.col("c.chunks").alias("ids"))
    with cleaned_up(spark):
        _first_of_each(chunks).write.option("compression", "none").parquet(f"{folder}/chunks")
    summed = prefix_sums(encoded.select("doc_id", "root", "row", "n_tokens", "addresses"), ["doc_id", "root", "row"], "n_tokens", "start")
    recipes = summed.select("doc_id", "start", "n_tokens", "addresses", "root").repartitionByRange(shuffle_width(spark), "start").sortWithinPartitions("start")
    with cleaned_up(spark):
        recipes.write.parquet(f"{folder}/recipes")
    discard(encoded)
    manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """A row for each recipe file, with the Merkle root over its documents' roots."""

    def roots(batches) -> Iterator[pa.RecordBatch]:
        files: dict[str, list] = {}
        for batch in batches:
            for name, doc, start, root in zip(*(c.to_pylist() for c in batch.columns)):
                files.setdefault(name, []).append((start, doc, root))
        for name, rows in sorted(files.items()):
            rows.sort()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_doc": rows[0][1], "last_doc": rows[-1][1], "documents": len(rows), "root": merkle([r[2] for r in rows])}], schema=out)

    out = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("documents", pa.int64()), ("root", pa.binary())])
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = recipes.select(name.alias("file"), "doc_id", "start", "root")
    return rows.repartition("file").mapInArrow(roots, "file string, first_doc long, last_doc long, documents long, root binary")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the manifest that the recipe files no longer agree with; none if all is well."""
    now = manifest(spark.read.parquet(f"{folder}/recipes"))
    return now.exceptAll(spark.read.parquet(f"{folder}/manifest"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each place of a chunk, its ids beside it, sorted by start and k; a document's rows are in one partition.

    A chunk that very many documents want is written out several times, and its places are dealt over those.
    """
    recipes, chunks = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/chunks")
    wanted = recipes.select("start", "doc_id", "n_tokens", "root", F.size("addresses").alias("n"), F.posexplode("addresses").alias("k", "address"))
    many = wanted.groupBy("address").count().where(F.col("count") > HEAVY).select("address", F.ceil(F.col("count") / HEAVY).cast("int").alias("salts"))
    many = stored(many, "wanted-often")
    if many.isEmpty():
        found = wanted.join(chunks, "address", "left")
    else:
        wanted = wanted.join(many, "address", "left").withColumn("salt", F.pmod(F.xxhash64("start"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        chunks = chunks.join(many, "address", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        found = wanted.join(chunks, ["address", "salt"], "left")
    return found.select("start", "k", "n", "doc_id", "n_tokens", "root", "address", "ids").repartition("start").sortWithinPartitions("start", "k")


def _documents(batches, last: pa.DataType, value) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, value of the ids), from the rows of _parts, each chunk and document verified."""
    addresses: list[bytes] = []
    found: list[bytes] = []
    names = ["doc_id", "start", "n_tokens", "ids"]
    for batch in batches:
        out = []
        for start, k, n, doc, n_tokens, root, own, ids in zip(*(c.to_pylist() for c in batch.columns)):
            raw = b"" if ids is None else unpack_ids(ids).tobytes()
            if k != len(addresses) or address(raw) != own:
                raise ValueError(f"document {doc} does not agree with its recipe")
            addresses.append(own)
            found.append(raw)
            if len(found) == n:
                if merkle(addresses) != root or sum(map(len, found)) != 4 * n_tokens:
                    raise ValueError(f"document {doc} does not agree with its recipe")
                out.append((doc, start, n_tokens, value(b"".join(found))))
                addresses, found = [], []
        kinds = (pa.int64(), pa.int64(), pa.int64(), last)
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files alone, each chunk and document verified."""
    return _parts(spark, folder).mapInArrow(lambda b: _documents(b, pa.binary(), bytes), "doc_id long, start long, n_tokens long, ids binary")


def store_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/token-store-{uuid.uuid4().hex}"


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): what read_store gives, with the checksum of the ids in their place."""
    found = _parts(spark, folder).mapInArrow(lambda b: _documents(b, pa.int64(), zlib.crc32), "doc_id long, start long, n_tokens long, ids long")
    return found.select(given_id().alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))


__all__ = ["NO_ID", "chunked", "cuts", "read_digests", "read_store", "store_folder", "verify_manifest", "write_store"]
