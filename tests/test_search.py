"""Search by blocks and by inverted files against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclake.functions import embed
from doclake.operators import qa, search, vectors


def brute(points, queries, limit, distance, keys=None):
    """{query id: [(point id, score)]} best first; points and queries: {id: vector}; keys: {id: key} of both."""
    out = {}
    for i, q in queries.items():
        rows = []
        for j, p in points.items():
            if keys is not None and keys[0][j] != keys[1][i]:
                continue
            n = np.linalg.norm(p) * np.linalg.norm(q)
            s = np.linalg.norm(p - q) if distance == "EUCLID" else p @ q if distance == "DOT" else (p @ q) / n if n else None
            rows.append((s is None, 0 if s is None else round(s, 6) if distance == "EUCLID" else -round(s, 6), j))
        out[i] = [(j, None if none else abs(s) if distance == "EUCLID" else -s) for none, s, j in sorted(rows)[:limit]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.point_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [x[0] for x in a[k]] == [x[0] for x in b[k]], (k, a[k], b[k])
        assert all((x[1] is None and y[1] is None) or abs(x[1] - y[1]) < 2e-6 for x, y in zip(a[k], b[k]))


@pytest.fixture(scope="module")
def clustered():
    """Points in groups, many equal ones, zero vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25, 8))[rng.integers(0, 25, 900)] + 0.2 * rng.normal(size=(900, 8))
    x[100:400] = x[100]  # a third are one vector
    x[5] = x[300] = 0
    return x


def frames(spark, x, asked):
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "point_id long, vector array<double>").repartition(5)
    return points, points.where(F.col("point_id").isin(asked)).selectExpr("point_id as query_id", "vector as query")


@pytest.mark.parametrize("distance", vectors.DISTANCES)
def test_exact_search(spark, clustered, distance, monkeypatch):
    """By one block, by many small ones, and by an inverted file whose cells are left out by their radius: the same."""
    monkeypatch.setattr(search, "BLOCK", 64)
    asked = [0, 5, 77, 150, 777]
    points, queries = frames(spark, clustered, asked)
    want = brute(dict(enumerate(clustered)), {k: clustered[k] for k in asked}, 7, distance)
    same(found(vectors.knn_blocks(points, queries, 7, distance)), want)
    index = search.build(points, distance, cells=30)
    assert index.blocks.count() > 30
    same(found(search.search(index, queries, 7, probes=2, exact=True)), want)
    # All cells probed is exact too.
    same(found(search.search(index, queries, 7, probes=30)), want)


def test_cells_are_left_out(spark, clustered):
    """The exact search doesn't read cells that can't change the result."""
    points, queries = frames(spark, clustered, [0, 77])
    index = search.build(points, "EUCLID", cells=30)
    first = search.ranked(search.meet(index.blocks, search.blocks(search._probing(queries, index, search._nearest(2), []), "cell", "query_id", "query", "q"), "cell", 5, "EUCLID"), 5, "EUCLID")
    bound = first.groupBy("query_id").agg(F.max("score").alias("worst"))
    more = search._probing(queries.join(bound, "query_id"), index, search._promising(2, "EUCLID", index.norm), ["worst"])
    assert 0 < more.count() + 4 < 2 * int((index.radii >= 0).sum()) * 0.7


def test_recall_is_tuned(spark, clustered):
    """At least 0.9 of the true neighbours, in data with groups and in data without any, with fewer cells than all in the former."""
    rng = np.random.default_rng(9)
    for x, most in ((clustered, 0.6), (rng.normal(size=(1500, 16)), 1.0)):
        asked = list(range(0, len(x), 20))
        points, queries = frames(spark, x, asked)
        index = search.build(points, "COSINE", cells=30)
        probes = search.probes_for(index, points, 10)
        assert probes <= most * 30
        got = found(search.search(index, queries, 10, probes=probes))
        want = brute(dict(enumerate(x)), {k: x[k] for k in asked}, 10, "COSINE")
        # Points as good as the last true neighbour are neighbours: there are many equal ones.
        good = sum(sum(s is not None and (want[k][-1][1] is None or s >= want[k][-1][1] - 2e-6) for _, s in got.get(k, [])) for k in asked)
        assert good / sum(sum(s is not None for _, s in w) for w in want.values()) >= 0.9


def test_registered_recall(spark, sf):
    """The registered approximate query against the exact one."""
    from doclake.plans import registry

    exact, near = ({(r.query_id, r.point_id) for r in registry.queries()[name](spark, sf).collect()} for name in ("knn_cosine", "knn_inverted"))
    assert len(exact & near) / len(exact) >= 0.9


def test_index_is_kept(spark, clustered, tmp_path):
    points, queries = frames(spark, clustered, [3, 4])
    built = search.build(points, "DOT", cells=10, folder=f"{tmp_path}/index")
    again = search.opened(spark, f"{tmp_path}/index")
    assert again.distance == "DOT" and np.array_equal(again.centroids, built.centroids) and np.array_equal(again.radii, built.radii)
    same(found(search.search(again, queries, 5, exact=True)), found(search.search(built, queries, 5, exact=True)))
    # Each block is of one cell, and every point is in one.
    assert sorted(i for r in again.blocks.collect() for i in r.ids) == list(range(900))


def test_nothing_to_search(spark, clustered):
    points, queries = frames(spark, clustered, [3])
    none = points.limit(0)
    assert vectors.knn_blocks(none, queries).collect() == [] and vectors.knn_blocks(points, queries.limit(0)).collect() == []
    assert search.search(search.build(none), queries, exact=True).collect() == []


def test_search_per_file_with_a_hot_file(spark, monkeypatch):
    """A file with a third of the points and queries is cut into groups, and none of them holds more than a small share of its pairs of blocks."""
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1800, 4))
    files = {k: "hot" if k % 3 == 0 else f"f{k % 7}" for k in range(1800)}
    points = spark.createDataFrame([(files[k], k, x[k].tolist()) for k in range(1800)], "file_hash string, point_id long, vector array<double>").repartition(6)
    asked = [k for k in range(1800) if k % 2 == 0]
    queries = points.where("point_id % 2 = 0").selectExpr("point_id as query_id", "vector as query", "file_hash as query_hash")
    want = brute(dict(enumerate(x)), {k: x[k] for k in asked}, 3, "COSINE", (files, files))
    same(found(vectors.knn_per_file(points, queries, 3)), want)
    # Where the blocks meet, groups of a file hold about as many pairs as those of others: each pair of blocks is in one task, once.
    own, other = search.blocks(points, "file_hash", "point_id", "vector"), search.blocks(queries.withColumnRenamed("query_hash", "file_hash"), "file_hash", "query_id", "query", "q")
    count = lambda df: {r.file_hash: r["count"] for r in df.groupBy("file_hash").count().collect()}
    n, m = count(own), count(other)
    groups = search.pairs(own, other, "file_hash", together=2).groupBy("file_hash", "p_", "q_").count().collect()
    assert sum(r["count"] for r in groups) == sum(n[f] * m[f] for f in n) and n["hot"] * m["hot"] > 500
    sizes = [r["count"] for r in groups if r.file_hash == "hot"]
    assert len(sizes) > 100 and max(sizes) <= 6 * np.mean(sizes) and max(sizes) < 0.05 * sum(sizes)


def test_answers_of_one_hot_file(spark):
    """A file of very many points and questions: each question gets its best rows with their payload."""
    rows = [("hot" if k % 3 else f"f{k % 5}", k, k % 3, f"word{k % 50} word{k % 7} text", "text", k) for k in range(600)]
    points = spark.createDataFrame(rows, "file_hash string, element_index long, seq long, text string, element_type string, page_idx long").withColumn("vector", embed.embed_text(F.col("text")))
    questions = spark.createDataFrame([(k, f"word{k % 50} word{k % 7}", "hot" if k % 2 else "f1") for k in range(80)] + [(99, "...", "hot"), (98, "word1", "nowhere")], "question_id long, question string, file_hash string")
    got = qa.answers(questions, points, 4)
    assert {"question_id", "question", "file_hash", "element_index", "seq", "text", "element_type", "page_idx", "score", "rank"} == set(got.columns)
    vec = {r.element_index: (r.file_hash, np.array(r.vector, float)) for r in points.collect()}
    asked = {r.question_id: (r.file_hash, np.array(r.v, float)) for r in questions.select("question_id", "file_hash", embed.embed_text(F.col("question")).alias("v")).where("v is not null").collect()}
    out = {}
    for r in got.collect():
        out.setdefault(r.question_id, []).append((r["rank"], r.element_index * 4 + r.seq, r.score, r.text))
    assert set(out) == set(range(80))
    for k, (f, q) in asked.items():
        best = sorted((-round(v @ q / np.linalg.norm(v) / np.linalg.norm(q), 6), i * 4 + i % 3) for i, (g, v) in vec.items() if g == f)[:4]
        assert [(n, -s) for s, n in best] == [(n, s) for _, n, s, _ in sorted(out.get(k, []))]
        assert all(t == f"word{n // 4 % 50} word{n // 4 % 7} text" for _, n, _, t in out.get(k, []))


def test_a_task_gives_few_vectors_at_a_time(spark, monkeypatch):
    """Queries beside all their cells would be as large as both together."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(400)]
    points = spark.createDataFrame(rows, "point_id long, vector array<double>")
    asked = points.select(F.col("point_id").alias("query_id"), F.col("vector").alias("query"))
    index = search.build(points, cells=20)
    want = found(search.search(index, asked, 3, probes=2, exact=True))
    monkeypatch.setattr(search, "OUT", 8 * 16 * 50)
    sizes = search._probing(asked.coalesce(1), index, search._nearest(20), [])
    assert sizes.count() == 400 * int((index.radii >= 0).sum())
    assert found(search.search(index, asked, 3, probes=2, exact=True)) == want


def test_each_question_is_embedded_once(spark):
    """The range by which questions are dealt is sampled from what is embedded, and not embedded again."""
    asked = spark.createDataFrame([(k, f"word{k % 50}", f"f{k % 9}") for k in range(300)], "question_id long, question string, file_hash string")
    points = asked.select("file_hash", F.col("question_id").alias("element_index"), F.lit(0).cast("long").alias("seq"), F.col("question").alias("text"), F.lit("text").alias("element_type"), embed.embed_text(F.col("question")).alias("vector"))
    n = spark.sparkContext.accumulator(0)

    def counted(text):
        @F.udf("string")
        def same_text(t):
            n.add(1)
            return t

        return embed.embed_text(same_text.asNondeterministic()(text))

    assert qa.answers(asked, points, 2, embedder=counted).where("rank = 1").count() == 300
    assert n.value == 300


def test_blocks_of_many_batches(spark):
    """A block goes on from one batch to the next, and a key of many rows is cut; null keys and vectors are in none."""
    rng = np.random.default_rng(9)
    rows = [("long", k, rng.normal(size=3).tolist()) for k in range(5000)] + [(f"f{k // 3:04}", 5000 + k, rng.normal(size=3).tolist()) for k in range(600)]
    points = spark.createDataFrame([*rows, (None, 9000, [1.0, 2.0, 3.0]), ("f0001", 9001, None)], "file_hash string, point_id long, vector array<float>")
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
        made = search.blocks(points, "file_hash", "point_id", "vector", chunk=F.lit(0)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert sorted(len(r.ids) for r in made if r.file_hash == "long") == [904, 2048, 2048]
    assert sorted(len(r.ids) for r in made if r.file_hash != "long") == [3] * 200
    want = {k: (f, np.array(v, np.float32).astype(float)) for f, k, v in rows}
    got = {i: (r.file_hash, v) for r in made for i, v in zip(r.ids, np.frombuffer(r.data).reshape(len(r.ids), -1))}
    assert set(got) == set(want) and all(got[i][0] == f and (got[i][1] == v).all() for i, (f, v) in want.items())
