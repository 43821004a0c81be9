"""An audit of how filters interact: what each removes, alone, in any order, and its share of all that is removed.

A document's failures are a pattern of five bits. Patterns are counted by part where the rows are, which gives every coalition's
removals: a coalition of filters removes the documents that fail any of them. All else follows from these 32 numbers, for all
documents, those labelled good and those labelled toxic:

* a step of an order removes what the filters up to it remove together, less what those before it do;
* the Shapley values solve the constrained least squares: coalitions' removals fitted by sums over their filters, weighted by the
  Shapley kernel, the values adding up to the removals of all five. Its normal equations, with the constraint, are solved in
  rationals, so nothing is rounded; a value is given times the number of orders, which is whole.

Conditions: A under 200 words; B distinct words under half of the words; C more than 3 % of the code points are A-Z; D any of
`#$%&*|`; E the text is that of a document with a smaller id, in whatever part. Words are maximal `[^\\x20\\x09-\\x0D]+`.

Null text: empty. Null part: the empty string, with that part's own. Null id: the largest; of rows that share an id none is the
other's earlier copy. Repeated rows are counted each. A document whose id has several labels is good (or toxic) if any of them says so;
rows without an id have no labels. Very long texts are split whole. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, as_bytes

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_COPY = 1 << FILTERS.index("E")

# The limits of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def pattern(text: bytes, points: int) -> int:
    """The bits of the conditions A to D that a text of so many code points fails."""
    words = text.split()
    out = int(len(words) < LEAST_WORDS)
    out |= int(100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    out |= int(100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITALS_PERCENT * points) << 2
    return out | int(len(text.translate(None, SIGNS)) < len(text)) << 3


def patterns(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """part, bits, n, good, toxic: documents by part and pattern, at most 32 rows a part."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].cast("string").alias("text"))

    def judge(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(2))]
            points = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            bits = pa.array([pattern(t, n) for t, n in zip(texts, points)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, bits], names=["doc_id", "part", "digest", "bits"])

    # Rows that repeat become one, so that an id of very many rows does not stay in one task of the join.
    judged = rows.mapInArrow(judge, "doc_id long, part string, digest binary, bits int").groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    said = said.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = judged.join(said, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    # A text's copies fail A to D alike. Per text and kind of document: how many, and the smallest id with its rows; what a text has
    # is a few rows, however many copies there are.
    kinds = known.groupBy("digest", "bits", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = kinds.withColumn("firsts", F.when(first, F.col("least.n")).otherwise(F.lit(0)))
    copies = F.struct((F.col("bits").bitwiseOR(F.lit(_COPY))).alias("bits"), (F.col("n") - F.col("firsts")).alias("n"))
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("bits", F.col("firsts").alias("n")), copies)).alias("x")).select("part", "good", "toxic", "x.bits", "x.n")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    return both.where("n > 0").groupBy("part", "bits").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def removals(counts: dict[int, int]) -> list[int]:
    """Per coalition of filters (as bits): the documents that fail any of them."""
    return [sum(n for bits, n in counts.items() if bits & s) for s in range(_ALL + 1)]


def _solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a regular system, its right side last in each row."""
    n = len(rows)
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [r[-1] for r in rows]


def shapley(v: list[int], players: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of the game v (by coalition, v[0] = 0), as the constrained least squares under the Shapley kernel."""
    every = (1 << players) - 1
    # Unknowns: the values, and the constraint's multiplier.
    rows = [[Fraction(0)] * (players + 2) for _ in range(players + 1)]
    for s in range(1, every):
        size = s.bit_count()
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        members = [i for i in range(players) if s >> i & 1]
        for i in members:
            for j in members:
                rows[i][j] += weight
            rows[i][-1] += weight * v[s]
    for i in range(players):
        rows[i][players] = rows[players][i] = Fraction(1)
    rows[players][-1] = Fraction(v[every])
    return _solved(rows)[:players]


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _orders(part: str, counts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    v, good, toxic = (removals({bits: n[k] for bits, n in counts.items()}) for k in range(3))
    total = sum(n[0] for n in counts.values())
    shares = [x * factorial(len(FILTERS)) for x in shapley(v)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders is whole")
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = v[after] - v[before]
            yield (part, "".join(FILTERS[k] for k in order), step, total - v[after], removed, v[1 << f] - removed, v[_ALL] - v[_ALL & ~(1 << f)], good[after] - good[before], toxic[after] - toxic[before], int(shares[f]))
            before = after


def audit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    # A part has at most 32 patterns.
    found = patterns(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts"))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])

    def report(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _orders(part, {x["bits"]: (x["n"], x["good"], x["toxic"]) for x in counts})
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return found.mapInArrow(report, _REPORT)
