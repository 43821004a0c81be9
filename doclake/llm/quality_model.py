"""Quality classifier: a factorisation machine.

Inputs of a text: its words, stripped of what is no letter or digit, in lower case and hashed to BUCKETS; the words as they stand, hashed
to as many others; and measures of its structure. Every pair of inputs interacts through vectors of FACTORS numbers.
The sum over pairs is taken as half of (sum of v x) squared less the sum of (v x) squared, so scoring takes time in
proportion to a text's inputs. It is fitted by adaptive gradient steps on at most SAMPLE labelled texts, in the order of the
hash of their id, and no more when ENTRIES inputs have come to the driver (256 MB; some 50 MB as a rule). A text is fitted with the inputs
with which it is scored, all of them. Every row is scored where it is.

Null or empty texts have the structure of an empty text and are scored. Without any labelled row the score is 0.5. Rows whose
label is null are not learned from; of several labels of one id the largest counts, of several texts the one with the least digest.
Equal hashes go by id, so two fits agree.
Repeated rows have one score. Whole texts are read, very long ones too. A clashing column name gets underscores. An empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh

#: The fit takes so many labelled texts at most, and no more when these have so many inputs.
SAMPLE, ENTRIES = 8000, 1 << 25
BUCKETS, FACTORS = 1 << 15, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.08, 1e-5, 11
MEASURES = 14
SIZE = 2 * BUCKETS + MEASURES
_STRIP = bytes(range(48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))
_SYMBOLS = b"#*$%&|<>"


def measures(text: bytes, words: list[bytes]) -> np.ndarray:
    n, size = len(words), max(1, len(text))
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars: codes[list(chars)].sum() / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    several = max(1, n)
    threes = set(zip(words, words[1:], words[2:]))
    return np.array(
        [
            1.0 if n else 0.0,
            np.log1p(n) / 8,
            min(3.0, size / several / 8),
            2 * codes[65:91].sum() / size,
            5 * codes[48:58].sum() / size,
            5 * share(_SYMBOLS),
            5 * share(b"!?"),
            5 * share(b".,;:"),
            codes[128:].sum() / size,
            len(set(words)) / several,
            len(threes) / max(1, n - 2),
            len(set(lines)) / max(1, len(lines)),
            np.log1p(len(lines)) / 5,
            min(2.0, n / max(1, len(lines)) / 100),
        ],
        np.float32,
    )


def inputs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's inputs: where, and how much; at most SIZE, however long it is. Each kind of words has length 1."""
    text = text or b""
    words = text.split()
    at, x = [], []
    mask = BUCKETS - 1
    for k, own in enumerate(([w.strip(_STRIP).lower() for w in words], words)):
        if own:
            found, counts = np.unique(np.fromiter(map(zlib.crc32, own), np.int64, len(own)) & mask, return_counts=True)
            at.append(found + k * BUCKETS)
            x.append(counts / np.sqrt((counts * counts).sum()))
    at.append(np.arange(2 * BUCKETS, SIZE))
    x.append(measures(text, words))
    return np.concatenate(at).astype(np.int32), np.concatenate(x).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        """bias + sum w x + half of (sum of v x) squared less the sum of (v x) squared."""
        vx = self.vectors[at] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.weights[at] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Adaptive gradient steps on the logistic loss; labels 0 and 1 weigh the same in sum."""
    rng = np.random.default_rng(seed)
    model = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    if not rows:
        model.vectors[:] = 0
        return model
    ones = sum(y for _, _, y in rows)
    weight = {1: len(rows) / max(1, 2 * ones), 0: len(rows) / max(1, 2 * (len(rows) - ones))}
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            own = [rows[k] for k in order[start : start + BATCH]]
            lengths = [len(a) for a, _, _ in own]
            edges = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at, x = np.concatenate([a for a, _, _ in own]), np.concatenate([b for _, b, _ in own])
            vx = model.vectors[at] * x[:, None]
            s = np.add.reduceat(vx, edges)
            margin = model.bias + np.add.reduceat(model.weights[at] * x, edges) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), edges))
            y = np.array([y for _, _, y in own])
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * np.array([weight[k] for k in y.tolist()]) / len(own)
            each = np.repeat(g, lengths).astype(np.float32)
            where, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, each * x, len(where)).astype(np.float32) + DECAY * model.weights[where]
            part = (each * x)[:, None] * (np.repeat(s, lengths, axis=0) - vx)
            gv = np.stack([np.bincount(back, part[:, f], len(where)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * model.vectors[where]
            seen_w[where] += gw * gw
            seen_v[where] += gv * gv
            model.weights[where] -= RATE * gw / np.sqrt(seen_w[where])
            model.vectors[where] -= RATE * gv / np.sqrt(seen_v[where])
            seen_b += float(g.sum()) ** 2
            model.bias -= RATE * float(g.sum()) / seen_b**0.5
    return model


def labelled(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y, at, x, place): the inputs of at most `sample` texts of labels that are in docs, and the order in which they are taken.

    Labels are taken by the hash of their id; of texts that share an id the one with the least digest. labels above 0 are 1."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), (labels[label_col] > 0).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # `sample` ids of two numbers.
    own = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.sha2("text", 256)).alias("text"))

    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs(t) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())],
                names=["doc_id", "y", "at", "x"],
            )

    return own.mapInArrow(of, "doc_id long, y int, at binary, x binary").withColumn("place", F.xxhash64("doc_id"))


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE, epochs: int = EPOCHS, entries: int = ENTRIES) -> Machine:
    """Fit on labelled() rows: whole texts in their order, until these have `entries` inputs."""
    rows, have = [], 0
    for r in labelled(docs, labels, id_col, text_col, label_col, sample).orderBy("place", "doc_id").select("y", "at", "x").toLocalIterator():
        at = np.frombuffer(bytes(r.at), np.int32)
        have += len(at)
        if have > entries:
            break
        rows.append((at, np.frombuffer(bytes(r.x), np.float32), r.y))
    return fit(rows, epochs)


def score(docs: DataFrame, model: Machine, text_col="text", out="score") -> DataFrame:
    """docs with the probability that the label is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at, out = docs.columns, docs.columns.index(text_col), fresh(docs, out)

    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(*inputs(t)) for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, out])

    return docs.mapInArrow(of, docs.select("*", F.lit(0.0).alias(out)).schema)
