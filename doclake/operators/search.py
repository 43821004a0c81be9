"""Vector search of many queries: blocks that meet by key, per file, and inverted files.

Vectors are packed into blocks of one key (a file, a cell). Blocks of points and of queries meet by an equi-join on the key; a key with
many blocks is cut into groups on both sides, so that a task gets a bounded number of pairs of blocks, however many rows a key has. A pair
of blocks is one matrix product, of which `limit` rows a query leave.

An inverted file lays all points out by cell, that of the nearest of some centroids, which are fitted on a bounded sample. A query probes the
cells nearest to it. That is the approximate search. The exact one then goes on: by the best scores that it has, and by each cell's radius
and the triangle inequality, a cell that can't hold a better point is left out, and all others are searched.

Scores are rounded to six places before they are ranked; equal scores go by id. A score with a zero vector is null under COSINE, and ranks
last.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared

PLACES = 6
#: Rows of a block; blocks of a side that meet in one task.
BLOCK, TOGETHER = 2048, 8
#: Points a cell on the whole; bytes of centroids that may be broadcast; probed cells; rows of the sample a cell; rounds of fitting.
PER_CELL, CENTROID_BYTES, PROBES, SAMPLE, ROUNDS = 4096, 64 << 20, 8, 64, 4


#: Bytes of vectors of a batch that a task gives away; found rows of one.
OUT, ROWS_OUT = 8 << 20, 1 << 16


def best_first(distance: str) -> Column:
    return F.asc_nulls_last("score") if distance == "EUCLID" else F.desc_nulls_last("score")


def ranked(scored: DataFrame, limit: int, distance: str, by: str = "query_id", ids: str = "point_id") -> DataFrame:
    """The best rows of each query. Spark cuts each task's rows to `limit` a query before it shuffles them."""
    best = Window.partitionBy(by).orderBy(best_first(distance), ids)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def scores(p: np.ndarray, q: np.ndarray, distance: str) -> np.ndarray:
    """Rounded scores, a row a query; NaN where there is none."""
    if distance == "EUCLID":
        # From differences, as norms would lose the digits of near points; some points at a time.
        step = max(1, 2_000_000 // q.size)
        found = np.concatenate([np.sqrt(((q[:, None] - p[None, k : k + step]) ** 2).sum(2)) for k in range(0, len(p), step)], axis=1)
    else:
        found = q @ p.T
        if distance == "COSINE":
            with np.errstate(invalid="ignore", divide="ignore"):
                found = found / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1))
    return np.round(found, PLACES)


def _starts(keys: pa.Array, block: int) -> np.ndarray:
    """Where blocks begin in sorted keys: at each new key, and after each `block` rows of one."""
    new = np.append(True, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
    runs = np.flatnonzero(new)
    parts = -(-np.diff(np.append(runs, len(keys))) // block)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(runs, parts) + block * within


def blocks(rows: DataFrame, key: str, ids: str, vector: str, prefix: str = "", chunk: Column | None = None, path: str | None = None) -> DataFrame:
    """<key>, <prefix>ids and <prefix>data: rows of one key packed by up to BLOCK, written once. Null vectors and keys are left out.

    Rows are dealt by range of key and id, which splits a key of very many rows; or by key and chunk, where chunk is given and numbers
    parts of a key that are of about a block.
    """
    # Floats are widened where they are packed.
    values = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    own = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(ids).cast("long").alias("id_"), values.alias("vector_"), *([] if chunk is None else [chunk.cast("long").alias("chunk_")]))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if chunk is None:
        dealt = own.repartitionByRange(width, key, "id_").sortWithinPartitions(key, "id_")
    else:
        dealt = own.repartition(width, key, "chunk_").sortWithinPartitions(key, "chunk_", "id_").drop("chunk_")
    kind = own.schema[key].dataType

    def pack(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last block goes on in the next batch, as far as its key does.
            held = batch if held is None else pa.concat_batches([held, batch])
            starts = _starts(held.column(0), BLOCK)
            if len(starts) > 1:
                yield packed(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield packed(held, _starts(held.column(0), BLOCK))

    def packed(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """A row a block: all of a batch's small blocks at once."""
        lists, ends = rows.column(2), np.append(starts, rows.num_rows).astype(np.int32)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(((offsets - offsets[0])[ends] * 8).astype(np.int32)), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(pa.array(ends), rows.column(1)), data], names=[key, f"{prefix}ids", f"{prefix}data"])

    return shared.written(dealt.mapInArrow(pack, f"{key} {kind.simpleString()}, {prefix}ids array<long>, {prefix}data binary"), "blocks", path)


def pairs(points: DataFrame, queries: DataFrame, key: str, together: int = TOGETHER) -> DataFrame:
    """Each block of points (ids, data) beside each block of queries (qids, qdata) of its key. A key's blocks are dealt into groups of about
    `together` on both sides, p_ and q_, and groups meet: an equi-join without a key of more than some together ** 2 pairs."""
    groups = lambda n: F.ceil(F.col(n) / together).cast("int")
    sizes = points.groupBy(key).agg(F.count("*").alias("n_")).join(queries.groupBy(key).agg(F.count("*").alias("m_")), key)
    sizes = sizes.select(key, groups("n_").alias("of_points"), groups("m_").alias("of_queries"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda ids, n: F.pmod(F.xxhash64(F.get(ids, F.lit(0))), F.col(n)).cast("int")
    left = points.join(sizes, key).withColumn("p_", part("ids", "of_points")).withColumn("q_", every("of_queries"))
    right = queries.join(sizes, key).withColumn("q_", part("qids", "of_queries")).withColumn("p_", every("of_points"))
    return left.select(key, "p_", "q_", "ids", "data").join(right.select(key, "p_", "q_", "qids", "qdata"), [key, "p_", "q_"])


def meet(points: DataFrame, queries: DataFrame, key: str, limit: int, distance: str) -> DataFrame:
    """query_id, point_id, score: the best points for each query in each pair of blocks of one key."""

    def best(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            """What many pairs of blocks gave is one batch."""
            qids, ids, values = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(ids), pa.array(values, mask=np.isnan(values))], names=["query_id", "point_id", "score"])

        for batch in batches:
            for ids, data, qids, qdata in zip(_arrays(batch.column(0)), batch.column(1).to_pylist(), _arrays(batch.column(2)), batch.column(3).to_pylist()):
                p, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(qdata).reshape(len(qids), -1)
                found = scores(p, q, distance)
                order = np.lexsort((np.broadcast_to(ids, found.shape), found if distance == "EUCLID" else -found), axis=1)[:, :limit]
                rows = np.repeat(np.arange(len(qids)), order.shape[1])
                held.append((qids[rows], ids[order.ravel()], found[rows, order.ravel()]))
                n += len(rows)
                if n >= ROWS_OUT:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return pairs(points, queries, key).select("ids", "data", "qids", "qdata").mapInArrow(best, "query_id long, point_id long, score double")


def knn_per_key(points: DataFrame, queries: DataFrame, key: str, limit: int = 10, distance: str = "COSINE", chunk: Column | None = None) -> DataFrame:
    """Each query against the points of its own key: query_id, point_id, score, rank. points: key, point_id, vector; queries: key, query_id, query."""
    own = blocks(points, key, "point_id", "vector", chunk=chunk)
    asked = blocks(queries, key, "query_id", "query", "q")
    return ranked(meet(own, asked, key, limit, distance), limit, distance)


# Inverted files.


class Index(NamedTuple):
    """Centroids (in the space of `placed`), each cell's radius, the largest norm under DOT, and the blocks of all points by cell."""

    distance: str
    centroids: np.ndarray
    radii: np.ndarray
    norm: float
    blocks: DataFrame


def placed(x: np.ndarray, distance: str, norm: float = 0.0, query: bool = False) -> np.ndarray:
    """Vectors where nearer in the plain distance means better: scaled to length 1 under COSINE; under DOT with a further coordinate that
    gives points the same length, and queries zero."""
    if distance == "COSINE":
        length = np.linalg.norm(x, axis=1)
        return x / np.where(length > 0, length, 1.0)[:, None]
    if distance == "DOT":
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(1)))
        return np.concatenate([x, more[:, None]], axis=1)
    return x


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return values[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(lists), -1)


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def cells_for(n: int, size: int) -> int:
    """Cells for n points of so many numbers: their centroids may be broadcast."""
    return max(1, min(n // PER_CELL, CENTROID_BYTES // (8 * (size + 1))))


def _steps(k: int) -> int:
    """Rows at a time, so that their distances to k centroids take 16 MB."""
    return max(1, (2 << 20) // max(1, k))


def fit(points: DataFrame, cells: int, distance: str, norm: float, n: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by rounds of k-means over a sample of `sample` points a cell at most, by hash of the id from all of the points.

    Tasks give sums a cell and coordinate, which combine before the shuffle; centroids alone come to the driver (CENTROID_BYTES). A cell that
    no point of the sample chose keeps its centroid.
    """
    part = max(1, -(-n // (sample * cells)))
    chosen = shared.written(points.where(F.pmod(F.xxhash64("point_id", F.lit(7)), F.lit(part)) == 0).select("point_id", F.col("vector").cast("array<double>").alias("vector")), "sample")
    first = chosen.orderBy(F.xxhash64("point_id"), "point_id").limit(cells).select("vector").toArrow()["vector"].combine_chunks()
    centroids = placed(_matrix(first), distance, norm)
    for _ in range(rounds):
        now = points.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches) -> Iterator[pa.RecordBatch]:
            c = now.value  # noqa: B023
            total, number = np.zeros(c.shape), np.zeros(len(c))
            for batch in batches:
                x = placed(_matrix(batch.column(0)), distance, norm)
                for k in range(0, len(x), _steps(len(c))):
                    own = x[k : k + _steps(len(c))]
                    at = _distances(own, c).argmin(1)
                    np.add.at(total, at, own)
                    np.add.at(number, at, 1)
            for cell in np.flatnonzero(number).tolist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c.shape[1] + 1, cell)), pa.array(np.arange(c.shape[1] + 1)), pa.array(np.append(total[cell], number[cell]))], names=["cell", "pos", "x"])

        found = chosen.select("vector").mapInArrow(sums, "cell long, pos long, x double").groupBy("cell", "pos").agg(F.sum("x").alias("x")).toArrow()
        table = np.zeros((len(centroids), centroids.shape[1] + 1))
        table[found["cell"].to_numpy(), found["pos"].to_numpy()] = found["x"].to_numpy()
        seen = table[:, -1] > 0
        centroids = np.where(seen[:, None], table[:, :-1] / np.maximum(1, table[:, -1])[:, None], centroids)
        now.unpersist()
    return centroids


def build(points: DataFrame, distance: str = "COSINE", cells: int | None = None, folder: str | None = None, **options) -> Index:
    """An inverted file of all points (point_id, vector), written to a folder; vectors have one size, and null ones are left out."""
    spark = points.sparkSession
    folder = folder or shared.folder(spark, "index")
    points = points.where("vector is not null").select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<double>").alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, size, norm = points.agg(F.count("*"), F.max(F.size("vector")), F.sqrt(F.max(length))).first()
    norm = (norm or 0.0) * (1 + 1e-12)
    cells = min(n, cells_for(n, size or 1) if cells is None else cells)
    centroids = fit(points, cells, distance, norm, n, **options) if n else np.zeros((0, 1))
    known = spark.sparkContext.broadcast(centroids)

    def assign(batches) -> Iterator[pa.RecordBatch]:
        c = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = placed(_matrix(batch.column(1)), distance, norm)
            cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for k in range(0, len(x), _steps(len(c))):
                d = _distances(x[k : k + _steps(len(c))], c)
                cell[k : k + len(d)] = d.argmin(1)
                far[k : k + len(d)] = d.min(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), pa.array(far)], names=["cell", "point_id", "vector", "far"])

    assigned = shared.written(points.mapInArrow(assign, "cell long, point_id long, vector array<double>, far double"), "assigned")
    blocks(assigned, "cell", "point_id", "vector", path=f"{folder}/blocks")
    # One row a cell; a cell without points has no radius.
    radii = np.full(len(centroids), -1.0)
    far = assigned.groupBy("cell").agg(F.max("far").alias("radius")).toArrow()
    radii[far["cell"].to_numpy()] = far["radius"].to_numpy()
    lists = pa.ListArray.from_arrays(np.arange(len(centroids) + 1, dtype=np.int32) * centroids.shape[1], centroids.ravel())
    table = pa.table({"cell": np.arange(len(centroids)), "centroid": lists, "radius": radii})
    spark.createDataFrame(table).select("*", F.lit(distance).alias("distance"), F.lit(norm).alias("norm")).write.parquet(f"{folder}/cells")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    """An index that was built before."""
    table = spark.read.parquet(f"{folder}/cells").orderBy("cell").toArrow()
    stored = spark.read.schema("cell long, ids array<long>, data binary").parquet(f"{folder}/blocks")
    if not table.num_rows:
        return Index("COSINE", np.zeros((0, 1)), np.zeros(0), 0.0, stored)
    return Index(table["distance"][0].as_py(), _matrix(table["centroid"].combine_chunks()), table["radius"].to_numpy(), table["norm"][0].as_py(), stored)


def _probing(queries: DataFrame, index: Index, choose, columns: list[str]) -> DataFrame:
    """cell, query_id, query for each cell that choose(distances, rows) marks."""
    known = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii))
    distance, norm = index.distance, index.norm

    def probe(batches) -> Iterator[pa.RecordBatch]:
        centroids, radii = known.value
        for batch in batches:
            for k in range(0, batch.num_rows, _steps(len(centroids))):
                part = batch.slice(k, _steps(len(centroids)))
                q = _matrix(part.column(1))
                d = _distances(placed(q, distance, norm, query=True), centroids)
                rows, cells = np.nonzero(choose(d, radii, q, [c.to_numpy(zero_copy_only=False) for c in part.columns[2:]]))
                for a in range(0, len(rows), step := max(1, OUT // (8 * q.shape[1]))):  # a query's vector stands beside each of its cells
                    row = pa.array(rows[a : a + step])
                    yield pa.RecordBatch.from_arrays([pa.array(cells[a : a + step]), part.column(0).take(row), part.column(1).take(row)], names=["cell", "query_id", "query"])

    rows = queries.where("query is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"), *columns)
    return rows.mapInArrow(probe, "cell long, query_id long, query array<double>")


def _nearest(probes: int):
    def choose(d: np.ndarray, radii: np.ndarray, q: np.ndarray, more: list) -> np.ndarray:
        d = np.where(radii >= 0, d, np.inf)  # empty cells
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
        return out & np.isfinite(d)

    return choose


#: Scores are rounded, and distances are computed from norms: bounds are wider by so much.
SLACK = 1e-5


def _promising(probes: int, distance: str, norm: float):
    """Cells that were not probed and may hold a point as good as the worst of the best so far."""
    nearest = _nearest(probes)

    def choose(d: np.ndarray, radii: np.ndarray, q: np.ndarray, more: list) -> np.ndarray:
        worst = more[0].astype(np.float64)[:, None]  # NaN: fewer than the limit
        least = np.maximum(0.0, d - radii)
        if distance == "EUCLID":
            may = least <= worst + SLACK * (1 + np.abs(worst)) + 1e-6 * (norm + np.linalg.norm(q, axis=1)[:, None])
        elif distance == "DOT":
            most = ((q**2).sum(1)[:, None] + norm**2 - least**2) / 2
            may = most >= worst - SLACK * (1 + np.abs(worst) + norm**2 + (q**2).sum(1)[:, None])
        else:
            may = 1 - least**2 / 2 >= worst - SLACK
        return (may | np.isnan(worst)) & (radii >= 0) & ~nearest(d, radii, q, more)

    return choose


def search(index: Index, queries: DataFrame, limit: int = 10, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """query_id, point_id, score, rank for queries (query_id, query): from the nearest `probes` cells, and, for the exact result, from all
    further cells that may change it."""
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], "query_id long, point_id long, score double, rank int")
    ask = lambda asked: meet(index.blocks, blocks(asked, "cell", "query_id", "query", "q"), "cell", limit, index.distance)
    found = ask(_probing(queries, index, _nearest(probes), []))
    if exact and probes < len(index.centroids):
        found = shared.written(ranked(found, limit, index.distance).drop("rank"), "probed")
        # The worst of a full list without nulls; a shorter one has no bound.
        worst = (F.max if index.distance == "EUCLID" else F.min)("score")
        bound = found.groupBy("query_id").agg(F.when(F.count("score") >= limit, worst).alias("worst"))
        more = _probing(queries.join(bound, "query_id", "left"), index, _promising(probes, index.distance, index.norm), ["worst"])
        found = found.unionByName(ask(more))
    return ranked(found, limit, index.distance)


#: Queries of the sample that tunes, and the share of the true neighbours that it is tuned for.
TUNED_BY, RECALL = 256, 0.95


def probes_for(index: Index, points: DataFrame, limit: int = 10, recall: float = RECALL, queries: int = TUNED_BY) -> int:
    """Cells to probe so that `recall` of the exact neighbours are found, measured on so many points (by hash of the id) as queries."""
    own = points.where("vector is not null").select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = shared.written(own.orderBy(F.xxhash64("point_id", F.lit(11)), "point_id").limit(queries).select(F.col("point_id").alias("query_id"), F.col("vector").alias("query")), "asked")
    found = search(index, asked, limit, exact=True).where("score is not null").select("query_id", "point_id")
    # At most queries * limit rows.
    table = found.join(own, "point_id").join(asked, "query_id").select("vector", "query").toArrow()
    if not table.num_rows:
        return 1
    vectors, q = (_matrix(table[c].combine_chunks()) for c in ("vector", "query"))
    home = _distances(placed(vectors, index.distance, index.norm), index.centroids).argmin(1)
    d = np.where(index.radii >= 0, _distances(placed(q, index.distance, index.norm, query=True), index.centroids), np.inf)
    place = (d < d[np.arange(len(d)), home][:, None]).sum(1)
    return int(np.quantile(place, recall, method="higher")) + 1


def knn(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "COSINE") -> DataFrame:
    """The exact best points for each of many queries: query_id, point_id, score, rank. Points for a cell or two need no index: they are
    blocks of one key."""
    n = points.count()
    if n < 2 * PER_CELL:
        return knn_per_key(points.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), "cell", limit, distance)
    return search(build(points, distance), queries, limit, exact=True)
