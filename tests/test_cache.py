"""Embeddings that are kept."""

import pytest
from pyspark.sql import functions as F

from doclake.functions import cache, embed


def counting(path, fail=None):
    """A client that notes what it is asked, one file a call."""

    def make():
        import uuid

        def client(texts):
            if fail is not None and any(t in fail for t in texts):
                raise RuntimeError("no service")
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return client

    return make


def asked(path):
    return sorted(t for p in path.iterdir() for t in p.read_text().split("\n"))


def test_each_text_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(k, f"text {k % 7}" if k % 3 else "hot") for k in range(60)] + [(60, None)], "id long, text string").repartition(4)
    got = {r.id: r.vector for r in cache.embed(rows, "text", counting(tmp_path / "calls"), f"{tmp_path}/vectors").collect()}
    assert len(got) == 61 and got[60] is None and got[1] == [6.0, 1.0] and got[3] == [3.0, 1.0]
    assert asked(tmp_path / "calls") == ["hot", *(f"text {k}" for k in range(7))]
    # Again, with a client that can't be asked.
    again = cache.embed(rows, "text", counting(tmp_path / "calls", {"hot", *(f"text {k}" for k in range(7))}), f"{tmp_path}/vectors")
    assert {r.id: r.vector for r in again.collect()} == got
    # Another model has other vectors; a new text is all that the first one is asked for.
    assert cache.fill(rows, "text", counting(tmp_path / "calls"), f"{tmp_path}/vectors", model="other") == 8
    assert cache.fill(rows.withColumn("text", F.concat("text", F.lit("!"))).unionByName(rows).where("id in (1, 3)"), "text", counting(tmp_path / "calls"), f"{tmp_path}/vectors") == 2


def test_a_failed_run_goes_on(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(f"t{k}",) for k in range(100)], "text string")
    with pytest.raises(Exception, match="no service"):
        cache.fill(rows, "text", counting(tmp_path / "calls", {"t42"}), f"{tmp_path}/vectors", part=10)
    kept = cache.stored(spark, f"{tmp_path}/vectors").count()
    left = cache.fill(rows, "text", counting(tmp_path / "calls"), f"{tmp_path}/vectors", part=10)
    assert kept + left == 100 and cache.stored(spark, f"{tmp_path}/vectors").select("address").distinct().count() == 100


def test_client_of_the_default(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    client = embed.client_udf(cache.hashing_client())
    for r in docs.select(embed.embed_text(F.col("text")).alias("a"), client("text").alias("b")).collect():
        assert r.a is None or max(abs(x - y) for x, y in zip(r.a, r.b)) < 1e-6
