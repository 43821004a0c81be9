"""Near-duplicates by SimHash, found through segment popcounts.

A text's fingerprint has 64 bits by the majority over the hashes of its three-word shingles. Two texts are linked at three or fewer
differing bits; a component is all that links reach.

Search: a fingerprint is embedded as the number of set bits in each of 32 segments of two bits. The Manhattan distance of
two such vectors is at most the Hamming distance, so linked fingerprints are at most 3 apart. The 32 coordinates lie in
six groups; at most three groups can differ, so any linked pair agrees on three whole groups: these are the cells of the
grid, 20 for each fingerprint. Within a cell the Manhattan bound is tested first and the Hamming distance after it, and
the cell gives only a star for each of its own components, not its pairs. A cell of more than CELL fingerprints is cut by
the same argument over the fingerprints' bits, those that are still open, in six groups: 20 inner cells, which fix half of the open
bits each. That is repeated while a cell is too large; with 11 open bits or fewer none can be.

A bit that exactly half of the hashes have set is 0; a shingle that is there twice counts twice. Only distinct fingerprints take part; copies
join their component at the end, and of ids that tie for the smallest there is one component. Null, empty or blank texts have
fingerprint zero, like any other. Null id: the largest, null in results. Repeated rows get the same component. Very long texts are
hashed whole, at 16 bytes and a bit row a shingle. An empty table gives an empty table; other columns, whatever their names, pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, as_bytes, discard, fresh, given_id, join_counted, mix, narrow, stored

SHINGLE, SEED, DISTANCE = 3, 42, 3
GROUPS = 6
#: Larger cells are cut once more.
CELL = 2048
_EVEN = 0x5555555555555555


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [words]
    else:
        shingles = zip(*(words[k:] for k in range(SHINGLE)))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in shingles], ">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of a table of doc_id and text."""

    def hash_texts(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.mapInArrow(hash_texts, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """The segments' counts, each written as 00, 01 or 11: so the Manhattan distance is the number of differing bits."""
    low = F.lit(_EVEN)
    one, two = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return one.bitwiseOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(places: list[int], groups: int = GROUPS) -> list[list[int]]:
    """For each choice of half of the groups into which places are dealt: its places."""
    at = [places[len(places) * k // groups : len(places) * (k + 1) // groups] for k in range(groups)]
    return [[p for g in chosen for p in at[g]] for chosen in combinations(range(groups), groups - DISTANCE)]


#: Per cell the bits of its segments.
_CELLS = [sum(3 << 2 * s for s in own) for own in _choices(list(range(32)))]


def _cells(points: DataFrame) -> DataFrame:
    """(cell, key, fp, code, open): every fingerprint in its 20 cells; open: the bits on which the cell's members may differ."""
    keys = F.array(*(F.struct(F.lit(k).cast("long").alias("cell"), F.col("code").bitwiseAND(F.lit(_signed(mask))).alias("key")) for k, mask in enumerate(_CELLS)))
    # Equal counts still leave bits open, so all are.
    return points.select("fp", "code", F.explode(keys).alias("c")).select("c.cell", "c.key", "fp", "code", F.lit(-1).cast("long").alias("open"))


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Cells within cells: a linked pair also agrees on three of six groups of the open bits."""
    for batch in batches:
        cell, key, fp, code, open_ = (c.to_numpy().view(np.uint64) for c in batch.columns)
        for mask in np.unique(open_).tolist():
            own = open_ == mask
            for k, places in enumerate(_choices([b for b in range(64) if mask >> b & 1])):
                fixed = sum(1 << b for b in places)
                inner = mix(cell[own] * np.uint64(20) + np.uint64(k + 20))
                keys = mix(key[own] ^ mix(fp[own] & np.uint64(fixed)))
                left = np.full(len(inner), mask & ~fixed, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (inner, keys, fp[own], code[own], left)], names=batch.schema.names)


def _stars(codes: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """For the members of one cell: (fingerprint, least of those it is connected with here)."""
    label = np.arange(len(prints))
    for i in range(1, len(prints)):
        near = np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= DISTANCE)
        near = near[np.bitwise_count(prints[near] ^ prints[i]) <= DISTANCE]
        if len(near):
            roots = np.unique(label[near])
            label[i] = roots[0]
            if len(roots) > 1:
                label[: i][np.isin(label[:i], roots)] = roots[0]
    for i in np.flatnonzero(label != np.arange(len(label))).tolist():
        yield i, int(label[i])


def _links(batches) -> Iterator[pa.RecordBatch]:
    """Stars of every cell, from rows (cell, key, code, fp) that are sorted."""
    held: list[np.ndarray] = []

    def of(cell, key, code, fp) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero((cell[1:] != cell[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cell)]])
        prints, codes = fp.view(np.uint64), code.view(np.uint64)
        pair = starts[ends - starts == 2]
        pair = pair[np.bitwise_count(codes[pair] ^ codes[pair + 1]) <= DISTANCE]
        pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= DISTANCE]
        a, b = [fp[pair + 1]], [fp[pair]]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            found = list(_stars(codes[s:e], prints[s:e]))
            a.append(fp[s + np.array([x for x, _ in found], np.int64)])
            b.append(fp[s + np.array([x for _, x in found], np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
        # The last cell may go on in the next batch.
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield from of(*(r[:cut] for r in rows))
    if held:
        yield from of(*held)


_DEALT = "cell long, key long, fp long, code long, open long"


def bounded(points: DataFrame, cell: int = CELL) -> DataFrame:
    """The cells of points (fp, code), cut until each has `cell` members at most, or so few open bits that it can't have more than 2048."""
    dealt, done = _cells(points), None
    while True:
        counts = dealt.where(F.bit_count("open") > 11).groupBy("cell", "key").agg(F.count("*").alias("rows"))
        crowded = stored(counts.where(F.col("rows") > cell), "crowded-cells")
        if crowded.isEmpty():
            return dealt if done is None else done.unionByName(dealt)
        # Rows of a crowded cell stay where they are: join_counted's heavy keys.
        large = stored(join_counted(dealt, crowded, ["cell", "key"], "rows").select("cell", "key", "fp", "code", "open"), "crowded-rows")
        rest = dealt.join(crowded, ["cell", "key"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        dealt = large.mapInArrow(_cut, _DEALT)


def links(points: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b) of fingerprints: stars that connect whatever is linked. points: distinct fp."""
    dealt = bounded(points.select("fp", unary(F.col("fp")).alias("code")), cell)
    ordered = dealt.select("cell", "key", "code", "fp").repartition("cell", "key").sortWithinPartitions("cell", "key", "fp")
    return stored(ordered.mapInArrow(_links, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach. Labels spread along edges, then jump to their label's label.

    A node of very many edges, or a label of very many nodes, is not shuffled: join_counted.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("root"), F.count("*").alias("edges")).withColumnRenamed("a", "node"), "labels")
    while True:
        beside = label.select(F.col("node").alias("b"), "root", "edges")
        near = join_counted(both, beside, "b", "edges").groupBy("a").agg(F.min("root").alias("near"))
        spread = label.join(near.withColumnRenamed("a", "node"), "node").select("node", "edges", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        spread = stored(spread, "spread")
        many = spread.groupBy("root").agg(F.count("*").alias("rows"))
        # up is a label of the round before: never larger than the node it labels.
        above = many.join(label.select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
        after = stored(join_counted(spread, above, "root", "rows").select("node", "edges", "was", F.least("root", "up").alias("root")), "labels")
        discard(label, spread)
        label = after
        if after.where("root <> was").isEmpty():
            discard(both)
            return label.select("node", "root")


def _least(found: DataFrame, cell: int) -> DataFrame:
    """(fp, least, rows) of a table of fp and place: the least place in the fingerprint's component, and the fingerprint's rows."""
    points = stored(found.groupBy("fp").agg(F.min("place").alias("first"), F.count("*").alias("rows")), "points")
    roots = components(links(points.select("fp"), cell)).select(F.col("node").alias("fp"), "root")
    placed = stored(points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    discard(points)
    least = placed.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("prints"))
    return join_counted(placed, least, "root", "prints").select("fp", "least", "rows")


def classes(docs: DataFrame, id_col="doc_id", text_col="text", cell: int = CELL) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    found = stored(fingerprints(narrow(docs, id_col, text_col)), "fingerprints")
    by_fp = _least(found.select("fp", F.col("doc_id").alias("place")), cell).withColumnRenamed("least", "component_id")
    return join_counted(found, by_fp, "fp", "rows").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(docs, id_col, text_col, cell)
    return found.select(given_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), given_id("component_id").alias("component_id"))


def _with_fingerprints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with each row's fingerprint."""
    names, at = docs.columns, docs.columns.index(text_col)

    def add(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in as_bytes(batch.column(at).cast(pa.string()))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, name])

    return docs.mapInArrow(add, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text", cell: int = CELL) -> DataFrame:
    """docs without the rows that aren't the first of their component, by id, then by the hash of the text.

    Rows of one id and one text are repeats of a document and stay together. Rows without an id are documents of their own: of a
    component that has no id one row stays.
    """
    fp, place, least, rows = (fresh(docs, name) for name in ("print_fp", "print_place", "print_least", "print_rows"))
    own = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    text = docs[text_col].cast("string")
    tag = F.when(own == NO_ID, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    # Written once: a row's place must not change between the two times that it is read.
    found = docs.select("*", F.struct(own.alias("id"), F.xxhash64(text).alias("hash"), tag.alias("row")).alias(place))
    found = stored(_with_fingerprints(found, text_col, fp), "fingerprints")
    by_fp = _least(found.select(F.col(fp).alias("fp"), F.col(place).alias("place")), cell).toDF(fp, least, rows)
    return join_counted(found, by_fp, fp, rows).where(F.col(place) == F.col(least)).select(*docs.columns)
