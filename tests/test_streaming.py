"""Ingestion with keyed state: equals the batch, survives failures, and doesn't read the history."""

import pytest

from doclake.streaming import ingest as stream

SCHEMA = "filename string, content binary, arrived long"


def batches(spark, path, rows, size):
    """Rows as files of `size`, in order."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def stored(spark, path):
    return sorted((r.file_hash, r.filename, r.pdf_key, r.result_key, r.size, bytes(r.content)) for r in spark.read.parquet(path).collect())


ROWS = [(f"d{k}.pdf" if k % 7 else f"d{k}.txt", b"hot" if k % 3 == 0 else b"text %d" % (k % 40), k) for k in range(200)]


def test_stream_equals_batch_with_hot_and_repeated_files(spark, tmp_path):
    batches(spark, f"{tmp_path}/in", ROWS, 40)
    stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=8).awaitTermination()
    # Within a batch the first arrival; batches come in the order of files.
    want, known = [], set()
    for k in range(0, 200, 40):
        own = {}
        for name, content, at in ROWS[k : k + 40]:
            if name.endswith(".pdf") and content not in known:
                own.setdefault(content, (at, name))
        known |= set(own)
        want += [(c, own[c][1]) for c in own]
    got = stored(spark, f"{tmp_path}/files")
    assert sorted((r[5], r[1]) for r in got) == sorted(want)
    batch = stream.process(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(r.file_hash for r in batch.collect()) == [r[0] for r in got]
    # More of the same stores nothing; something new is stored.
    batches(spark, f"{tmp_path}/in", [*ROWS[:30], ("new.pdf", b"new", 1000)], 31)
    stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=8).awaitTermination()
    assert [r[1] for r in stored(spark, f"{tmp_path}/files") if r not in got] == ["new.pdf"]


def test_failed_batch_runs_again(spark, tmp_path, monkeypatch):
    """The second batch fails after it wrote; run again, each hash is there once."""
    batches(spark, f"{tmp_path}/in", ROWS[:80], 40)
    whole = stream.new_files

    def broken(rows, groups):
        found = whole(rows, groups)
        calls = []

        class Writer:
            def foreachBatch(self, f):  # noqa: N802
                def fail(batch, number):
                    f(batch, number)
                    calls.append(number)
                    if number == 1:
                        raise RuntimeError("lost")

                return found.writeStream.foreachBatch(fail)

        return type("Stream", (), {"writeStream": Writer()})()

    monkeypatch.setattr(stream, "new_files", broken)
    with pytest.raises(Exception, match="lost"):
        stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=4).awaitTermination()
    monkeypatch.setattr(stream, "new_files", whole)
    stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=4).awaitTermination()
    got = stored(spark, f"{tmp_path}/files")
    assert len(got) == len({r[0] for r in got}) == len({c for n, c, _ in ROWS[:80] if n.endswith(".pdf")})


def test_history_is_not_read(spark, tmp_path):
    """What was stored may be moved away between runs: state alone knows it."""
    batches(spark, f"{tmp_path}/in", ROWS[:40], 40)
    stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=4).awaitTermination()
    (tmp_path / "files").rename(tmp_path / "moved")
    batches(spark, f"{tmp_path}/in", [*ROWS[:40], ("x.pdf", b"x", 99)], 41)
    query = stream.run(source(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state", groups=4)
    query.awaitTermination()
    assert [r[1] for r in stored(spark, f"{tmp_path}/files")] == ["x.pdf"]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_a_task_gives_copies_away_once(spark):
    rows = spark.createDataFrame([("b", 3, "x"), ("a", 2, "x"), ("a", 5, "x"), ("b", 1, "x"), ("a", 2, "w")], "file_hash string, arrived long, filename string").coalesce(1)
    got = [tuple(r) for r in stream._first_of_task(rows).collect()]
    assert got == [("b", 3, "x"), ("a", 2, "x"), ("b", 1, "x"), ("a", 2, "w")]
