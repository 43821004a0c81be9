"""Stored collections: a change writes what it touches."""

from pyspark.sql import functions as F

from doclake.sources import collections

SCHEMA = "collection string, point_id long, value string, batch int"


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def held(spark, root, like):
    return {(r.collection, r.point_id): r.value for r in collections.points(spark, str(root), like).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k, f"v{k}", 0) for k in range(400)], SCHEMA)
    root, like = str(tmp_path), rows.drop("batch")
    collections.upsert(root, rows, buckets=32)
    want = {("a" if k % 3 else "b", k): f"v{k}" for k in range(400)}
    assert held(spark, tmp_path, like) == want
    before = files(tmp_path)
    # One percent: of two changes to an id the later one holds.
    changes = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, "new", 2), ("b", 3, "three", 1), ("a", 1000, "more", 1), ("c =/%", 5, "odd name", 1)], SCHEMA)
    collections.upsert(root, changes, buckets=32)
    want |= {("a", 1): "new", ("b", 3): "three", ("a", 1000): "more", ("c =/%", 5): "odd name"}
    assert held(spark, tmp_path, like) == want
    after = files(tmp_path)
    folders = lambda names: {n.rsplit("/", 1)[0] for n in names}
    changed = folders(n for n, _ in set(before.items()) ^ set(after.items()))
    assert len(changed) <= 4 < len(folders(before))
    # Deletes, down to empty buckets; an id that isn't there; a collection that isn't.
    collections.delete(root, spark.createDataFrame([(c, i) for c, i in want if i % 8 == 1] + [("a", 7777), ("none", 1), ("c =/%", 5)], "collection string, point_id long"), like, buckets=32)
    want = {k: v for k, v in want.items() if k[1] % 8 != 1 and k[0] != "c =/%"}
    assert held(spark, tmp_path, like) == want and not list(tmp_path.glob("points/*/bucket=*/part-*.tmp"))
    collections.update_payload(root, spark.createDataFrame([("a", 2, "two"), ("a", 4, None), ("a", 9999, "none")], "collection string, point_id long, value string"), ["value"], like, buckets=32)
    assert held(spark, tmp_path, like) == want | {("a", 2): "two"}


def test_catalog(spark, tmp_path):
    wanted = spark.createDataFrame([("a", 4, "dot"), ("b", 4, "odd"), ("c =/%", 4, "EUCLID")], "name string, vector_size long, distance string")
    status = lambda df: {r.name: r.status for r in df.collect()}
    assert status(collections.create(spark, str(tmp_path), wanted.where("name <> 'b'"))) == {"a": "created", "c =/%": "created"}
    assert status(collections.create(spark, str(tmp_path), wanted)) == {"a": "already_exists", "b": "created", "c =/%": "already_exists"}
    assert {(r.name, r.distance) for r in collections.catalog(spark, str(tmp_path)).collect()} == {("a", "DOT"), ("b", "COSINE"), ("c =/%", "EUCLID")}
    points = spark.createDataFrame([(c, k, "v", 0) for c in ("a", "c =/%") for k in range(20)], SCHEMA)
    collections.upsert(str(tmp_path), points, buckets=4)
    assert status(collections.drop(spark, str(tmp_path), spark.createDataFrame([("c =/%",), ("x",)], "name string"))) == {"c =/%": "deleted", "x": "not_found"}
    assert {r.name for r in collections.catalog(spark, str(tmp_path)).collect()} == {"a", "b"}
    assert {c for c, _ in held(spark, tmp_path, points.drop("batch"))} == {"a"}


def test_pruned(spark, tmp_path):
    """A change reads its buckets only."""
    rows = spark.createDataFrame([("a", k, "v", 0) for k in range(200)], SCHEMA)
    collections.upsert(str(tmp_path), rows, buckets=16)
    one = rows.where("point_id = 3").drop("batch").withColumn("bucket", collections.bucket("point_id", 16))
    _, old = collections._touched(spark, str(tmp_path), one, one)
    assert "dynamicpruning" in old._jdf.queryExecution().executedPlan().toString() and 0 < old.count() < 40
    assert old.where(F.col("point_id") == 3).count() == 1
