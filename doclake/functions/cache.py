"""Embeddings that are kept: a client gets each different text once, and never again.

The cache is a table of vectors by content address, the digest of the model's name and the text, in folders by the first digits of the
address. Texts whose address isn't there go to the client, in parts that are committed one by one: what a run embedded before it
failed is there for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from .embed import client_udf

#: Different texts that are embedded before the next commit.
PART = 1_000_000
SCHEMA = "address string, vector array<float>, folder string"


def address(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model + "\0"), text).cast("binary"), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """address, vector, folder of all that was embedded."""
    if not shared.exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def fill(texts: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], folder: str, model: str = "default", part: int = PART, batch: int = 64) -> int:
    """Embed what isn't stored yet; how many texts that were. Null texts have no vector. Copies combine before the shuffle."""
    spark = texts.sparkSession
    own = texts.where(F.col(text).isNotNull()).select(address(F.col(text), model).alias("address"), F.col(text).alias("text")).groupBy("address").agg(F.first("text").alias("text"))
    missing = shared.written(own.join(stored(spark, folder).select("address"), "address", "left_anti"), "missing")
    n = missing.count()
    parts = -(-n // part)
    embed = client_udf(make, batch)
    for k in range(parts):
        now = missing if parts == 1 else missing.where(F.pmod(F.xxhash64("address"), F.lit(parts)) == k)
        vectors = now.select("address", embed(F.col("text")).alias("vector"), F.substring("address", 1, 1).alias("folder"))
        vectors.write.mode("append").partitionBy("folder").parquet(folder)
    return n


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], folder: str, model: str = "default", out: str = "vector", **options) -> DataFrame:
    """rows with their vectors: from the cache, after it was filled with what it lacked."""
    fill(rows, text, make, folder, model, **options)
    vectors = stored(rows.sparkSession, folder).select(F.col("address").alias("address_"), F.col("vector").alias(out))
    return rows.join(vectors, address(F.col(text), model) == F.col("address_"), "left").drop("address_")


def hashing_client(dimensions: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """embed.embed_text as a client: feature hashing, zeros where there is no token."""

    def make():
        import hashlib
        import re
        from functools import lru_cache

        import numpy as np

        bucket = lru_cache(1 << 16)(lambda token: int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions)
        # Letters that are small already, and those that lower() makes of others, as the column function has them.
        tokens = re.compile("[a-z0-9]+")

        def client(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                n = np.bincount([bucket(x) for x in tokens.findall(t.lower())] or [0], minlength=dimensions).astype(float)
                n = n * bool(tokens.search(t.lower()))
                out.append((n / (np.sqrt((n * n).sum()) or 1.0)).tolist())
            return out

        return client

    return make
