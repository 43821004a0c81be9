"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A run of three letters binds the first vector
permuted twice, the second permuted once and the third: their product. A document bundles (adds) the vectors of
all its runs, a language those of its documents, and a document is compared with each language by cosine.

Texts are lower-cased; what is no letter counts as one blank, which is a letter of its own, and each text stands between two.
Null, or no letter: language `und`, score 0. Learning leaves out rows whose language is null. With nothing learned, all
are `und`. Equal cosines go to the language that sorts first. Whole texts are read, very long ones too: what they need besides
themselves is a row for each of their distinct runs. Repeated rows count each in learning, and get the same prediction. A clashing
column name gets underscores. An empty table learns nothing, and gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

DIMENSIONS = 1024
SEED = 7
UNKNOWN = "und"
#: Languages that may be learned; more labels than that are no languages. So prototypes take at most 64 MB.
MOST_LANGUAGES = 8000
#: Sums that a task holds before it gives them away.
HELD = 256
#: Documents less like any language are rejected by the filter. A text that shares no run with a prototype has a cosine of
#: standard deviation 1 / sqrt(DIMENSIONS); this is four of them.
MIN_SCORE = 4 / DIMENSIONS**0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, 32 for all that is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


@lru_cache(4096)
def letter(code: int, dimensions: int, seed: int = SEED) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


def runs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of three letters of a text, packed, and how often each is there; nothing if it has no letter."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return none
    return np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:], return_counts=True)


def bound(packed: np.ndarray, dimensions: int) -> np.ndarray:
    """A row for each packed run: its letters' vectors, permuted by place and multiplied."""
    out = np.ones((len(packed), dimensions), np.int8)
    for place, shift in ((2, 42), (1, 21), (0, 0)):
        codes, back = np.unique((packed >> np.uint64(shift)) & np.uint64((1 << 21) - 1), return_inverse=True)
        out *= np.stack([np.roll(letter(int(c), dimensions), place) for c in codes])[back]
    return out


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> Iterator[np.ndarray | None]:
    """Each text's vector; None for texts without a letter. Runs that a group of texts share are bound once."""
    for at in range(0, len(texts), 64):
        found = [runs(t) for t in texts[at : at + 64]]
        distinct = np.unique(np.concatenate([r for r, _ in found]))
        vectors = bound(distinct, dimensions).astype(np.float32) if len(distinct) else None
        for packed, counts in found:
            yield counts.astype(np.float32) @ vectors[np.searchsorted(distinct, packed)] if len(packed) else None


def fold_profiles(docs: DataFrame, fold, text_col="text", lang_col="lang", dimensions: int = DIMENSIONS) -> dict[tuple[str, int], np.ndarray]:
    """The sum of the vectors of each language's documents in each fold (a column of docs), from all rows of docs."""

    def add(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def given() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "fold", "vector"])

        for batch in batches:
            for lang, own, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bundles(batch.column(2).to_pylist(), dimensions)):
                if vector is not None:
                    sums[lang, own] = sums.get((lang, own), 0) + vector.astype(np.float64)
                    if len(sums) > HELD:
                        yield given()
                        sums.clear()
        if sums:
            yield given()

    known = docs.select(docs[lang_col].cast("string").alias("lang"), fold.cast("int").alias("fold"), docs[text_col].cast("string").alias("text")).where("lang is not null")
    parts = known.mapInArrow(add, "lang string, fold int, vector array<double>")
    summed = parts.select("lang", "fold", F.posexplode("vector")).groupBy("lang", "fold", "pos").agg(F.sum("col").alias("x"))
    rows = summed.groupBy("lang", "fold").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select("lang", "fold", "v.x")
    found: dict[tuple[str, int], np.ndarray] = {}
    for lang, own, x in rows.toLocalIterator():
        found[lang, own] = np.array(x)
        if len({k[0] for k in found}) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return found


def profiles(docs: DataFrame, text_col="text", lang_col="lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Each language's prototype, from all rows of docs. As many vectors as languages come to the driver."""
    return {lang: v for (lang, _), v in fold_profiles(docs, F.lit(0), text_col, lang_col, dimensions).items()}


def without_own(sums: dict[tuple[str, int], np.ndarray], folds: int) -> list[dict[str, np.ndarray]]:
    """For each fold the prototypes that the other folds make."""
    return [{lang: sum(v for (x, f), v in sums.items() if x == lang and f != own) for lang in {x for x, f in sums if f != own}} for own in range(folds)]


def predict(docs: DataFrame, learned: dict[str, np.ndarray] | list[dict[str, np.ndarray]], text_col="text", pred="lang_pred", score="score", dimensions: int = DIMENSIONS, fold: str | None = None) -> DataFrame:
    """docs with the predicted language and its cosine, at least 0. fold: the column that tells which prototypes of a list to take."""
    every = learned if isinstance(learned, list) else [learned]
    langs = [sorted(x) for x in every]
    matrices = [np.stack([x[k] / (np.linalg.norm(x[k]) or 1) for k in own]).astype(np.float32) if own else None for x, own in zip(every, langs)]
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrices))
    names, at = docs.columns, docs.columns.index(text_col)
    pred = fresh(docs, pred)
    score = fresh(docs.withColumn(pred, F.lit("")), score)
    which = names.index(fold) if fold else None

    def compare(batches) -> Iterator[pa.RecordBatch]:
        langs, matrices = shared.value
        for batch in batches:
            best, scores = [], []
            own = batch.column(which).to_pylist() if which is not None else [0] * batch.num_rows
            for k, vector in zip(own, bundles(batch.column(at).to_pylist(), dimensions)):
                if vector is None or matrices[k] is None:
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = matrices[k] @ (vector / (np.linalg.norm(vector) or 1))
                best.append(langs[k][int(cosines.argmax())])
                scores.append(float(min(1, max(0, cosines.max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*names, pred, score])

    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(compare, schema)


def fold_of(id_col, folds: int):
    """crc32 of the id as text, modulo folds; a null id is the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def in_fold(id_col, folds: int, fold: int):
    """Whether the id falls in this fold."""
    return fold_of(id_col, folds) == fold
