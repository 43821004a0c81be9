"""Sinks whose write is killed and run again, and pages of points by ranges."""

import pytest

from doclake import shared
from doclake.sources import sinks


def written(spark, path):
    return sorted((r.file_hash, r.n) for r in spark.read.schema("file_hash string, n long, bucket int").json(path).collect())


def test_a_write_that_is_killed_and_run_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"h{k % 9}", k) for k in range(100)], "file_hash string, n long")
    want = sorted((r.file_hash, r.n) for r in rows.collect())
    path, move = str(tmp_path / "out"), shared.move

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(shared, "move", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_results(rows, path, buckets=4)
    assert not list((tmp_path / "out").glob("batch=*"))
    monkeypatch.setattr(shared, "move", move)
    assert sinks.write_results(rows, path, buckets=4) and written(spark, path) == want
    assert not sinks.write_results(rows, path, buckets=4) and written(spark, path) == want
    assert sinks.write_results(rows.limit(5), path, buckets=4, batch="b-1") and len(written(spark, path)) == 105
    with pytest.raises(ValueError):
        sinks.write_results(rows, path, batch="../x")


def test_two_runs_of_a_batch_at_once(spark, tmp_path):
    """The one that is later to put its folder in place leaves the first one's."""
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("h", 1)], "file_hash string, n long")

    def slow(to):
        rows.write.json(to)
        assert sinks._committed(spark, path, "0", lambda other: rows.write.json(other))

    assert not sinks._committed(spark, path, "0", slow)
    assert written(spark, path) == [("h", 1)] and not list((tmp_path / "out").glob("_apart*"))


def test_graph_goes_on_where_it_stopped(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "doc_id long, node_id long, label string")
    edges = spark.createDataFrame([(1, "ORDER", -1, 0)], "doc_id long, rel string, src long, dst long")
    path = str(tmp_path / "g")
    sinks._committed(spark, f"{path}/nodes", "0", lambda to: nodes.withColumn("bucket", nodes.doc_id.cast("int")).write.partitionBy("bucket").parquet(to))
    assert sinks.write_graph(nodes, edges, path) and not sinks.write_graph(nodes, edges, path)
    got = sinks.read_graph(spark, path)
    assert got[0].count() == 2 and got[1].count() == 1 and got[0].columns == nodes.columns


def test_pages_of_ranges(spark, tmp_path):
    """Pages follow one another without a gap, and read the files that hold them."""
    points = spark.range(0, 3000, 3).selectExpr("id as point_id", "concat('p', id) as payload", "array(cast(id as float)) as vector").repartition(5)
    sinks.write_ranges(points, str(tmp_path / "p"), files=10)
    seen, after, reads = [], None, []
    while True:
        page = sinks.scroll(spark, str(tmp_path / "p"), points, after, 64)
        rows = page.collect()
        if not rows:
            break
        assert page.columns == ["point_id", "payload"]
        reads.append(len(page.inputFiles()))
        seen += [r.point_id for r in rows]
        after = seen[-1]
    assert seen == list(range(0, 3000, 3)) and max(reads) <= 2 and sum(reads) < 2 * len(reads)
    assert sinks.scroll(spark, str(tmp_path / "p"), points, 10**9).collect() == []
