"""Which 64-bit hashes occur twice or more in a table: two Bloom filters, built where the rows are.

The filters are cut into slices of 2**SLICE_BITS bits, as many as the number of hashes asks for. A hash belongs to one slice and has
three bits in it. Each task notes the bits of its hashes (once) and of those it met twice, as a bitmap where they are
many; per slice these are merged one after another: a bit already in "once" that comes again goes to "twice". Merging needs
two slices in memory however many tasks there are. A filter of at most BROADCAST slices is broadcast (Repeats); a larger one
stays a table of slices, and hashes are dealt out by slice to meet theirs (Sliced). A filter too small for its corpus only
suspects more; it never misses a repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned_up, mix, shuffle_width, stored

SLICE_BITS = 21
_MASK = np.uint64((1 << SLICE_BITS) - 1)
_PAYLOAD = "slice int, once binary, twice binary"
_ARROW = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
#: Bits of a filter for each hash; slices that may be broadcast: 64 MiB.
BITS, BROADCAST = 8, 256
#: A task gives its bits away after so many hashes, so that its memory is bounded.
FLUSH = 1_000_000


def slices_for(hashes: int) -> int:
    """Slices that so many hashes need."""
    return max(1, -(-hashes * BITS >> SLICE_BITS))


def _slices(h: np.ndarray, slices: int) -> np.ndarray:
    return (mix(h) >> np.uint64(40)).astype(np.int64) % slices


def _bits(h: np.ndarray) -> np.ndarray:
    """The three bits of each hash, one row a bit."""
    return np.stack([(h >> np.uint64(SLICE_BITS * k)) & _MASK for k in range(3)]).astype(np.uint32)


def _pack(bits: np.ndarray) -> bytes:
    """Places of bits, or the bitmap where that is no longer."""
    places = np.unique(bits)
    if 4 * len(places) < 1 << (SLICE_BITS - 3):
        return places.astype("<u4").tobytes()
    out = np.zeros(1 << SLICE_BITS, bool)
    out[places] = True
    return np.packbits(out).tobytes()


def _places(packed: bytes) -> np.ndarray:
    if len(packed) < 1 << (SLICE_BITS - 3):
        return np.frombuffer(packed, "<u4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))


def notes(hashes: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    """Per slice: the bits of all hashes, and those of the hashes that occur twice among them."""
    h, n = np.unique(hashes, return_counts=True)
    at = _slices(h, slices)
    order = np.argsort(at, kind="stable")
    h, n, at = h[order], n[order], at[order]
    edges = np.searchsorted(at, np.arange(slices + 1))
    rows = []
    for s in range(slices):
        lo, hi = edges[s], edges[s + 1]
        if hi > lo:
            own, many = h[lo:hi], n[lo:hi] > 1
            rows.append((s, _pack(_bits(own)), _pack(_bits(own[many]))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen filter of each slice, from notes sorted by slice."""
    last, ones, twos = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(twos).tobytes()], pa.binary())], names=["slice", "twice"])

    for batch in batches:
        for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if s != last:
                if last is not None:
                    yield done()
                last, ones, twos = s, np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
            once = _places(once)
            twos[once[ones[once]]] = True
            twos[_places(twice)] = True
            ones[once] = True
    if last is not None:
        yield done()


def _marked(bits: np.ndarray, base: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row in _bits(h):
        at = base + row.astype(np.int64)
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


class Repeats:
    """The twice-seen filter, as tasks use it."""

    def __init__(self, slices: int, parts: dict[int, bytes]):
        self.slices = slices
        bits = np.zeros((slices, 1 << (SLICE_BITS - 3)), np.uint8)
        for s, b in parts.items():
            bits[s] = np.frombuffer(b, np.uint8)
        self.bits = bits.ravel()

    def suspects(self, h: np.ndarray) -> np.ndarray:
        """True for every hash that was met twice, and for few others."""
        return _marked(self.bits, _slices(h, self.slices) << SLICE_BITS, h)


class Sliced:
    """The same as a table, for filters that are too large to broadcast."""

    def __init__(self, slices: int, parts: DataFrame):
        self.slices, self.parts = slices, parts

    def only(self, rows: DataFrame) -> DataFrame:
        """The rows whose column `hash` (long, the first one) was met twice, and few others."""
        slices, schema = self.slices, rows.schema
        names = rows.columns

        def deal(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _slices(batch.column(0).to_numpy().view(np.uint64), slices).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["slice", *names])

        def test(batches) -> Iterator[pa.RecordBatch]:
            own, bits = None, None
            for batch in batches:
                slice_, filters = batch.column(0).to_numpy(), batch.column(len(names) + 1)
                edges = np.concatenate([[0], np.flatnonzero(slice_[1:] != slice_[:-1]) + 1, [len(slice_)]])
                keep = np.zeros(len(slice_), bool)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if a == b:
                        continue
                    if slice_[a] != own:  # a slice's filter comes first
                        own, bits = slice_[a], np.frombuffer(filters[a].as_py(), np.uint8)
                        a += 1
                    keep[a:b] = _marked(bits, 0, batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64))
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(kept.columns[1:-1], names=names)

        dealt = rows.mapInArrow(deal, f"slice int, {', '.join(f'{x.name} {x.dataType.simpleString()}' for x in schema)}").withColumn("twice", F.lit(None).cast("binary"))
        first = self.parts.select("slice", *(F.lit(0).cast("long").alias(n) if n == names[0] else F.lit(None).cast(schema[n].dataType).alias(n) for n in names), "twice")
        both = first.unionByName(dealt).repartition("slice").sortWithinPartitions("slice", F.col("twice").isNull())
        return both.mapInArrow(test, schema)


def repeated(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], slices: int, most: int = BROADCAST) -> Repeats | Sliced:
    """The hashes that hashes_of gives for the batches of df twice or more."""

    def note(batches):
        held, n = [], 0
        for batch in batches:
            h = hashes_of(batch)
            held.append(h)
            n += len(h)
            if n >= FLUSH:
                yield from notes(np.concatenate(held), slices)
                held, n = [], 0
        if n:
            yield from notes(np.concatenate(held), slices)

    width = min(slices, max(8, shuffle_width(df.sparkSession)))
    merged = df.mapInArrow(note, _PAYLOAD).repartition(width, "slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, twice binary")
    if slices > most:
        return Sliced(slices, stored(merged, "twice-seen"))
    # At most `most` rows of 256 KiB.
    with cleaned_up(df.sparkSession):
        return Repeats(slices, {r[0]: bytes(r[1]) for r in merged.collect()})
