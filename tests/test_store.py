"""The object store: what is listed, read and put."""

import pytest
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from doclake.sources import objects, store


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = [(f"{top}/{k % 4}/{k}.txt", b"x" * k) for top in ("pdfs", "pdfs2", "results") for k in range(20)] + [("top.txt", b"t"), ("a b/ü*.txt", "é".encode()), ("empty", None)]
    assert store.put(spark.createDataFrame(rows, "path string, content binary").repartition(4), root) == 63
    return root


def test_listing(spark, root):
    got = {r.path: r.length for r in store.listing(spark, root).collect()}
    assert len(got) == 63 and got["pdfs/3/19.txt"] == 19 and got["a b/ü*.txt"] == 2 and got["empty"] == 0
    assert all(r.modified is not None for r in store.listing(spark, f"file://{root}").where("path = 'top.txt'").collect())


@pytest.mark.parametrize("prefix,n", [("pdfs/", 20), ("pdfs", 40), ("pdfs/1", 5), ("pdfs/1/1", 3), ("top", 1), ("none", 0), ("pdfs/3/19.txt", 1), ("pdfs/3/19.txt/x", 0)])
def test_only_matching_folders_are_listed(spark, root, prefix, n):
    found = objects.with_prefix(store.listing(spark, root), prefix)
    assert {r.path for r in found.collect()} == {r.path for r in store.listing(spark, root).collect() if r.path.startswith(prefix)} and found.count() == n
    reader = store.ObjectReader(root)
    assert list(reader.pushFilters([StringStartsWith(("path",), prefix), StringEndsWith(("path",), "x")])) == [StringEndsWith(("path",), "x")]
    listed, whole = [], reader._children
    reader._children = lambda folder: (listed.append(folder), whole(folder))[1]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == n
    # Folders above the prefix's own are not listed, nor those beside it.
    assert all(f == prefix.rpartition("/")[0] or f.startswith(prefix) or f"{f}/".startswith(prefix) for f in listed), listed


def test_exact_keys_are_looked_up(spark, root):
    reader = store.ObjectReader(root)
    assert list(reader.pushFilters([In(("path",), ("pdfs/3/19.txt", "none", "top.txt")), StringStartsWith(("path",), "pdfs/")])) == []
    reader._children = None  # nothing is listed
    assert [r["path"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["pdfs/3/19.txt"]
    again = store.ObjectReader(root)
    assert list(again.pushFilters([EqualTo(("path",), "top.txt"), EqualTo(("path",), "empty")])) == [] and again.keys == []
    assert [r.path for r in store.listing(spark, root).where("path in ('top.txt', 'none') and length > 0").collect()] == ["top.txt"]
    plan = store.listing(spark, root).where("path like 'pdfs/1%'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan and "Filter isnotnull" not in plan, plan


def test_many_folders_are_dealt_out(spark, root, monkeypatch):
    """Beyond some folders the rest is listed by the tasks, with all below."""
    monkeypatch.setattr(store, "FOLDERS", 3)
    reader = store.ObjectReader(root)
    parts = reader.partitions()
    assert any(f.deep for p in parts for f in p.folders)
    assert len({r["path"] for p in parts for b in reader.read(p) for r in b.to_pylist()}) == 63


def test_contents(spark, root, monkeypatch):
    wanted = spark.createDataFrame([("pdfs/3/19.txt",), ("pdfs/3/19.txt",), ("none",), ("pdfs",), (None,), ("empty",), ("a b/ü*.txt",)], "path string")
    got = {r.path: (r.length, bytes(r.content)) for r in store.contents(wanted, root).collect()}
    assert got == {"pdfs/3/19.txt": (19, b"x" * 19), "empty": (0, b""), "a b/ü*.txt": (2, "é".encode())}


def test_folders_of_an_object_each_are_not_a_partition_each(tmp_path):
    for k in range(3 * store.FOLDERS):
        (tmp_path / "results" / str(k)).mkdir(parents=True)
        (tmp_path / "results" / str(k) / "result.json").write_bytes(b"{}")
    reader = store.ObjectReader(str(tmp_path))
    list(reader.pushFilters([StringStartsWith(("path",), "results/")]))
    parts = reader.partitions()
    found = [[r["path"] for b in reader.read(p) for r in b.to_pylist()] for p in parts]
    assert len(parts) == store.FOLDERS and max(map(len, found)) <= 4
    assert sorted(k for part in found for k in part) == sorted(f"results/{k}/result.json" for k in range(3 * store.FOLDERS))


def test_contents_are_read_by_many_tasks(spark, tmp_path):
    """Keys are small whatever their objects are: Spark would put them together into one task."""
    keys = [f"{k}.txt" for k in range(64)]
    store.put(spark.createDataFrame([(k, b"x" * 1000) for k in keys], "path string, content binary"), str(tmp_path))
    found = store.contents(spark.createDataFrame([(k,) for k in keys * 2], "path string"), str(tmp_path))
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 64 and len([n for n in sizes if n]) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_contents_are_not_joined(spark, tmp_path, monkeypatch):
    """Contents pass for as small as their keys, so a join of them would broadcast all files by way of the driver."""
    import json

    from doclake import shared
    from doclake.operators import elements, qa
    from pyspark.sql import functions as F

    value = json.dumps({"results": {"result": {"results": {"content_list": [{"type": "text", "text": "one"}]}}}})
    store.put(spark.createDataFrame([(f"results/h{k}_{k}.txt/result.json", value.encode()) for k in range(5)], "path string, content binary"), f"{tmp_path}/store")
    images = spark.createDataFrame([], "img_path string")
    known = elements.explode_elements(objects.parse_results(spark.createDataFrame([("h0", value)], "file_hash string, value string")))
    points = elements.explode_records(known, images).select("file_hash", "element_index", "seq", F.col("content").alias("text"), "element_type", F.array(F.lit(1.0).cast("float")).alias("vector"))
    asked = spark.createDataFrame([(k, "one", f"h{k}") for k in (0, 1, 2, 9)], "question_id long, question string, file_hash string")
    plans, whole = {}, shared.written
    monkeypatch.setattr(shared, "written", lambda df, name, path=None: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), whole(df, name, path))[1])
    status, found = qa.index_from_store(asked, points, f"{tmp_path}/store", images)
    above, _, below = plans["elements"].partition("MapInArrow")
    assert below and "Join" not in above and "MapInArrow" not in plans["indexed"], plans
    assert {r.question_id: r.status for r in status.collect()} == {0: "success", 1: "success", 2: "success", 9: "error"}
    assert sorted((r.file_hash, r.text) for r in found.collect()) == [("h0", "Text: one"), ("h1", "Text: one"), ("h2", "Text: one")]


def test_put_again(spark, root, tmp_path):
    rows = spark.createDataFrame([("a/b", b"one"), ("a/c", b"two")], "path string, content binary")
    for _ in range(2):
        assert store.put(rows, str(tmp_path)) == 2
    (tmp_path / "a" / ".half.123").write_bytes(b"not whole")
    assert sorted((r.path, r.length) for r in store.listing(spark, str(tmp_path)).collect()) == [("a/b", 3), ("a/c", 3)]
    assert store.put(rows.limit(0), str(tmp_path)) == 0


def test_files_are_indexed_from_the_store_once(spark, tmp_path):
    """Results are read for missing files alone, and what is indexed is there when the store isn't."""
    import json

    from doclake.functions import embed
    from doclake.operators import elements, qa

    def result(texts):
        return json.dumps({"results": {"result": {"results": {"content_list": [{"type": "text", "text": t} for t in texts]}}}}).encode()

    root, save = f"{tmp_path}/store", f"{tmp_path}/saved"
    put = [("results/h1_a.pdf/result.json", result(["one", "two"])), ("results/h2_b.pdf/result.json", b"{broken"), ("results/h3_c.pdf/result.json", result([""])), ("results/h4_d.pdf/result.json", result(["not asked"]))]
    store.put(spark.createDataFrame(put, "path string, content binary"), root)
    images = spark.createDataFrame([], "img_path string")
    none = elements.explode_elements(objects.parse_results(spark.createDataFrame([], "file_hash string, value string")))
    from pyspark.sql import functions as F

    records = elements.explode_records(none, images)
    points = records.select("file_hash", "element_index", F.lit(0).cast("long").alias("seq"), F.col("content").alias("text"), "element_type", embed.embed_text(F.col("content")).alias("vector"))
    asked = spark.createDataFrame([(k, "two", f"h{k}") for k in (1, 2, 3, 9)], "question_id long, question string, file_hash string")
    status, found = qa.index_from_store(asked, points, root, images, save=save)
    assert {r.question_id: r.status for r in status.collect()} == {1: "success", 2: "error", 3: "error", 9: "error"}
    assert [(r.text, r.file_hash) for r in qa.answers(asked, found, 1).collect()] == [("Text: two", "h1")]
    saved = qa.saved_points(points, save)
    again, _ = qa.index_from_store(asked.where("question_id = 1"), saved, f"{tmp_path}/gone", images, save=save)
    assert [r.status for r in again.collect()] == ["success"] and saved.count() == 2
