"""Embeddings as columns: a default by feature hashing, and pluggable clients."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


#: Different tokens whose buckets a task remembers.
KNOWN = 1 << 18


#: Bytes of UTF-8 that are no part of a token [a-z0-9]+ become spaces.
WORDS = bytes(k if chr(k) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for k in range(256))


class Buckets(dict):
    """The bucket of each token that was asked for, of up to KNOWN tokens."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        own = self[token] = int(hashlib.md5(token).hexdigest()[:8], 16) % self.dimensions
        return own


def embed_text(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Feature hashing: counts of [a-z0-9]+ in the lower-cased text by bucket, scaled to length 1; null where there is no token."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Buckets(dimensions)
        for texts in batches:
            found = [t.translate(WORDS).split() if t else () for t in texts.cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            buckets = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            # Counts of all rows of a batch at once: a row's buckets are its own range of numbers.
            n = np.bincount(np.repeat(np.arange(len(found)) * dimensions, sizes) + buckets, minlength=len(found) * dimensions).reshape(-1, dimensions)
            some = sizes > 0
            n = n[some]
            values = (n / np.sqrt((n * n).sum(1))[:, None]).astype(np.float32)
            offsets = np.append(0, np.cumsum(some * dimensions)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~some))

    # A filter on the vector would otherwise be pushed below, and compute it a second time.
    return embed.asNondeterministic()(F.lower(text))


def embed_image(content: Column, dimensions: int = DIMENSIONS) -> Column:
    """The default for images: feature hashing of the bytes as embed_text would do it with their hexadecimal pairs, which are counted first."""
    own = np.array([int(hashlib.md5(b"%02x" % k).hexdigest()[:8], 16) % dimensions for k in range(256)])

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out = []
            for data in s:
                n = np.bincount(own, np.bincount(np.frombuffer(data, np.uint8), minlength=256), dimensions) if data else None
                out.append(None if n is None else (n / np.sqrt((n * n).sum())).astype(np.float32))
            yield pd.Series(out, index=s.index)

    return embed(content)


def image_url(content: Column, kind: str = "jpeg") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(content))


def client_udf(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
    """A vectorised function around a client; make() runs once a task, and the client gets up to `batch` texts a call."""

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in series:
            texts, out = s.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                out += [[float(x) for x in v] for v in client(texts[k : k + batch])]
            yield pd.Series(out, index=s.index)

    return embed


def embed_messages(parts: DataFrame, message: str = "message_id", vector: str = "vector") -> DataFrame:
    """One vector a message: the mean of its parts' vectors."""
    places = parts.select(message, F.posexplode(vector).alias("pos", "x")).groupBy(message, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return places.groupBy(message).agg(whole.alias("embedding"))
