"""Best-fit packing by linear grouping.

Texts become token ids; those longer than a sequence are cut into full pieces, the first of which takes the rest. From
here only a histogram of lengths (at most `size` numbers) is needed for the plan: large lengths are sorted and dealt into groups of
equal cardinality, each rounded up to its longest; few sizes have few configurations, and for the
largest size that is left the fullest one is taken as often as the groups allow; the real pieces then take the places of their group; small pieces
fill what is left by best fit, longest first. The plan is a list of runs (a pattern of real lengths, how many sequences have
it). The k-th piece of a length finds its place in it by k alone, so pieces are numbered where they are.

Null or empty text: the end id alone. A null id is kept as null and sorted as the largest. Repeated rows are packed each.
Ties between equal lengths go by their place in the table. Very long texts are many pieces, all but the first full. An empty table
gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_id, narrow, stored
from .tokens import encoder, vocabulary

SIZE = 2048
END_ID = 0
#: Groups of large lengths, and the part of a sequence from which a length is large.
GROUPS, LARGE = 96, 3
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokenizer.encode(text) + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(encode, _PIECES)


class _Bins:
    """Runs of sequences with equal patterns, found by the room that is left."""

    def __init__(self, size: int):
        self.size = size
        self.rooms: list[int] = []
        self.by_room: dict[int, list[list]] = {}

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        room = self.size - sum(pattern)
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append([pattern, count])

    def tightest(self, length: int) -> list | None:
        """Takes out the run with the least room that is enough."""
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(k)
        return run


def _fullest(sizes: list[int], left: list[int], size: int) -> list[int]:
    """How often to take each rounded size: the largest that is left, and with it what comes nearest to size."""
    order = sorted((g for g in range(len(sizes)) if left[g]), key=lambda g: -sizes[g])
    best: dict[int, tuple[int, ...]] = {sizes[order[0]]: (order[0],)}
    for g in order:
        s, have = sizes[g], left[g] - (g == order[0])
        for total, chosen in list(best.items()):
            for times in range(1, min(have, (size - total) // s) + 1):
                best.setdefault(total + times * s, (*chosen, *[g] * times))
    take = [0] * len(sizes)
    for g in best[max(best)]:
        take[g] += 1
    return take


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """[(pattern of lengths, number of sequences)] for so many pieces of each length."""
    bins, least = _Bins(size), size // LARGE
    large = [[n, c] for n, c in sorted(histogram.items(), reverse=True) if least <= n < size]
    if full := histogram.get(size):
        bins.add((size,), full)
    # Linear grouping: equal shares of the sorted large pieces, each rounded up to its longest.
    share = max(1, -(-sum(c for _, c in large) // groups))
    members: list[list[list[int]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                members.append([])
                room = share
            took = min(c, room)
            members[-1].append([n, took])
            c, room = c - took, room - took
    sizes = [m[0][0] for m in members]
    left = [sum(c for _, c in m) for m in members]
    while any(left):
        take = _fullest(sizes, left, size)
        times = min(have // t for have, t in zip(left, take) if t)
        slots = [g for g, t in enumerate(take) for _ in range(t)]
        left = [have - t * times for have, t in zip(left, take)]
        while times:  # real lengths take the places; a run ends where one of its groups changes length
            need: dict[int, int] = defaultdict(int)
            pattern = []
            for g in slots:
                k = 0
                used = need.copy()
                while used[(g, k)] >= members[g][k][1]:
                    k += 1
                need[(g, k)] += 1
                pattern.append(members[g][k][0])
            run = min(times, *(members[g][k][1] // m for (g, k), m in need.items()))
            run = max(run, 1)
            for (g, k), m in need.items():
                members[g][k][1] -= m * run
            for g in {*slots}:
                members[g] = [x for x in members[g] if x[1]]
            bins.add(tuple(pattern), run)
            times -= run
    # Best fit of the small ones, longest first.
    for n, c in sorted(((n, c) for n, c in histogram.items() if n < least), reverse=True):
        while c:
            if (run := bins.tightest(n)) is None:
                per = size // n
                if whole := c // per:
                    bins.add((n,) * per, whole)
                    c -= whole * per
                if c:
                    bins.add((n,) * c, 1)
                break
            pattern, count = run
            per = min((size - sum(pattern)) // n, c)
            times = min(count, c // per)
            bins.add((*pattern, *[n] * per), times)
            if count > times:
                bins.add(pattern, count - times)
            c -= per * times
    return [(tuple(p), c) for runs in bins.by_room.values() for p, c in runs]


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first k, first sequence, offset): the k-th piece of the length goes to sequence + (k - first)."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, count in runs:
        offset = 0
        for n in pattern:
            out[n].append((used[n], sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


#: Pieces of one length are numbered in parts of about so many.
PART = 1000


def numbered(found: DataFrame, histogram: dict[int, int], part: int = PART) -> DataFrame:
    """Add k: the place of a piece among those of its length, from 0. A length is numbered in parts, so no task has all of a common one.

    found: pieces with a column row, which differs.
    """
    sizes = [max(1, -(-histogram.get(n, 0) // part)) for n in range(max(histogram, default=0) + 1)]
    share = F.get(F.array(*map(F.lit, sizes)), F.col("length").cast("int")) if max(sizes) > 1 else F.lit(1)
    salted = found.withColumn("part", F.pmod(F.xxhash64("row"), share).cast("int"))
    own = Window.partitionBy("length", "part").orderBy("row")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "part").count()
    counts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # A row a length and part: both sides are dealt by these.
    return salted.withColumn("k", F.row_number().over(own) - 1).join(counts, ["length", "part"]).withColumn("k", (F.col("k") + F.col("base")).cast("long")).drop("part", "base", "row")


def pack(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, size: int = SIZE, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or vocabulary("byte_bpe_50k.json")
    found = stored(pieces(narrow(docs, id_col, text_col), path, size, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most `size` rows.
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().toLocalIterator()}
    runs = plan(histogram, size, groups)
    # Each run but for a few uses up a length in a group, or a small length: that bounds what is broadcast.
    assert len(runs) <= 4 * (size + groups)
    where = places(runs)
    shared = docs.sparkSession.sparkContext.broadcast(where)

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("k")).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n).tolist():
                own, rows = n == length, shared.value[length]
                row = rows[np.searchsorted(rows[:, 0], k[own], "right") - 1]
                sequence[own], offset[own] = row[:, 1] + k[own] - row[:, 0], row[:, 2]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = numbered(found, histogram).mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
    return out.withColumn("doc_id", given_id())
