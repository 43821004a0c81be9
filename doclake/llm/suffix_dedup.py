"""Removal of repeated byte strings by a distributed difference-cover suffix array.

Every byte that a string of LENGTH bytes covers goes, if that string also starts earlier (smaller id, or same text and earlier
start). Strings are judged on the input, as UTF-8 bytes, and never cross texts.

1. Phrases. A window is a string of LENGTH bytes. Its anchor is the GRAM bytes in it whose hash is least, so equal windows have
   their anchor at the same place. Successive windows with one anchor form a phrase. Two Bloom filters over the anchors'
   hashes, of a size that follows from the input, leave the phrases whose anchor is met twice; other windows cannot repeat. What is
   left of a text are stretches of successive phrases. Of equal stretches the first stands for all.
2. Suffix array. The suffixes of a stretch start at its anchors, and a symbol reaches from one anchor to the next. Symbols are
   ordered by their anchor first, so suffixes with the same GRAM bytes ahead are neighbours. Positions whose number mod 3
   is 1 or 2 are the difference cover's sample: their triples of symbols are sorted and named, then triples of names, each three times
   as long as before, until every name is alone or stands for suffixes that are equal to their end. The rest is merged by
   the rule that any two positions meet in the sample after 0, 1 or 2 steps: three orders, over residues (1, 2) by name,
   (0, 1) by symbol and the next name, (0, 2) by two symbols and the name after them.
3. Adjacent prefixes. In each order a run of neighbours with the same anchor is compared by a prefix, which is all bytes of the
   phrase's windows: those that are equal form a class, and all but its earliest repeat as a whole. Where a run holds
   several classes, their windows may still be shared in part, where a repeat begins or ends; the windows of such a run's
   earliest phrases are compared one by one. Phrases that are in no run repeat nothing.

The order does not decide the result: pieces of a class that lie in several runs are put together by the hash of their prefix over all
phrases, so the same bytes go whatever the names are, and a pair of unequal phrases with one hash would count as equal.

Sorts are over distinct keys with their counts, in ranges that are drawn from the keys, and names come back by join_counted; a class is
reduced to its least position before it is shuffled. So no key's rows meet in one task, however many they are. Hashes of
64 bits stand for bytes where rows that the order has brought together are compared.

Null text: empty. Null id: the largest, null in results. Rows that share an id are in the order of their texts; equal rows are
one text, and each is written. Texts shorter than LENGTH stay. Very long texts are read in pieces of CHUNK bytes. An empty table
gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BROADCAST, Repeats, repeated, slices_for
from .common import as_bytes, discard, given_id, join_counted, mix, narrow, prefix_sums, shuffle_width, stored

LENGTH, GRAM = 100, 40
#: Windows that are looked at together.
CHUNK = 1 << 17
#: Rows of a range of names, where there are few; texts that are looked at together.
RANGE, TEXTS = 20_000, 2000
#: Anchors of fewer suffixes are never dealt by name.
MANY = 100
#: Anchors of more phrases are dealt out by window.
CROWDED = 4096
_WORD = 8
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1) for k in range(1, 16)]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    n = len(data) - _WORD + 1
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (n, _WORD), (1, 1))).view("<u8").ravel()


def _hash_at(words: np.ndarray, length: int, n: int) -> np.ndarray:
    """A hash of the `length` bytes from each of n places on; words: of _words()."""
    places = [*range(0, length - _WORD, _WORD), length - _WORD]
    h = np.full(n, length, np.uint64)
    for k, p in enumerate(places):
        h += words[p : p + n]
        h *= _STEP[k % len(_STEP)]
        h ^= h >> np.uint64(32)
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive numbers."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def phrases_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, end of windows, anchor, hash of the anchor) for each phrase of the texts that lie one after another in data.

    Places count from the start of data.
    """
    total, width = len(data) - length + 1, length - gram + 1
    starts, anchors, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for base in range(0, max(0, total), CHUNK):
        part = data[base : min(total, base + CHUNK) + length - 1]
        n = len(part) - gram + 1
        h = _hash_at(_words(part), gram, n)
        # The upper half of the hash, and the place: so equal ones go to the first.
        at = (_least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        starts.append(new + base)
        anchors.append(at[new] + base)
        hashes.append(h[at[new]])
    start, anchor, h = np.concatenate(starts), np.concatenate(anchors), np.concatenate(hashes)
    first = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]  # a phrase may go on in the next chunk
    start, anchor, h = start[first], anchor[first], h[first]
    # Windows lie within one text: runs are cut where a text's windows begin and end.
    text = np.flatnonzero(np.diff(offsets) >= length)
    begin, end = offsets[text], offsets[text + 1] - length + 1
    cuts = np.unique(np.concatenate([start, begin, end]))
    stop = np.concatenate([cuts[1:], [max(total, 0)]])[: len(cuts)]
    own = np.searchsorted(begin, cuts, "right") - 1
    inside = (own >= 0) & (cuts < end[own]) if len(text) else np.zeros(len(cuts), bool)
    cuts, stop, own = cuts[inside], stop[inside], own[inside]
    run = np.searchsorted(start, cuts, "right") - 1
    return text[own], cuts, stop, anchor[run], h[run]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_STRETCH = "doc_id long, start long, digest binary, sizes binary, offsets binary, data binary"
_STRETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("digest", pa.binary()), ("sizes", pa.binary()), ("offsets", pa.binary()), ("data", pa.binary())])


def _stretches(docs: list[int], column: pa.Array, suspect: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], length: int, gram: int) -> Iterator[tuple]:
    """suspect: which phrases may repeat, by their anchors' hashes, texts and numbers in the text."""
    data, offsets = _buffer(column)
    text, start, stop, anchor, h = phrases_of(data, offsets, length, gram)
    marked = np.flatnonzero(suspect(h, text, np.arange(len(text)) - np.searchsorted(text, text)))
    if not len(marked):
        return
    edges = np.flatnonzero((np.diff(marked) > 1) | (text[marked[1:]] != text[marked[:-1]])) + 1
    size, offset, raw = (stop - start).astype("<u2"), (anchor - start).astype("<u2"), data.tobytes()
    for a, b in zip(marked[np.concatenate([[0], edges])].tolist(), (marked[np.concatenate([edges - 1, [len(marked) - 1]])] + 1).tolist()):
        t = int(text[a])
        own = raw[start[a] : stop[b - 1] + length - 1]
        yield docs[t], int(start[a] - offsets[t]), hashlib.blake2b(own, digest_size=16).digest(), size[a:b].tobytes(), offset[a:b].tobytes(), own


class Stretch:
    """A row of stretches, with the symbols of its phrases."""

    def __init__(self, sizes: bytes, offsets: bytes, data: bytes, length: int, gram: int):
        self.offsets, self.data, self.length = np.frombuffer(offsets, "<u2").astype(np.int64), data, length
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64))])
        self.gram, self._ends = gram, [*(self.at[:-1] + self.offsets).tolist(), len(data)]

    def anchor(self, k: int) -> int:
        """A hash of a phrase's anchor."""
        return xxhash.xxh3_64_intdigest(self.data[self._ends[k] : self._ends[k] + self.gram])

    def symbols(self) -> list[int]:
        """From one anchor to the next; the upper half is the anchor's."""
        digest, ends, gram, data, high, low = xxhash.xxh3_64_intdigest, self._ends, self.gram, self.data, 0xFFFFFFFF00000000, 0xFFFFFFFF
        return [digest(data[a : a + gram]) & high | digest(data[a:b]) & low for a, b in zip(ends, ends[1:])]

    def prefixes(self) -> list[int]:
        """A hash of all bytes of each phrase's windows."""
        digest, at, more = xxhash.xxh3_64_intdigest, self.at.tolist(), self.length - 1
        return [digest(self.data[a : b + more], seed=o) for a, b, o in zip(at, at[1:], self.offsets.tolist())]


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _arrow(columns: dict[str, np.ndarray | list | pa.Array], **kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds.get(k)) for k, v in columns.items()], names=list(columns))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _of(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names]


def _numbers(column: pa.Array, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of binaries holds, one row after another, and each one's row."""
    values = column.to_pylist()
    counts = np.array([len(v) // np.dtype(kind).itemsize for v in values], np.int64)
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), counts)


def _steps(owner: np.ndarray) -> np.ndarray:
    """The number of each entry within its owner."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner)


def _shifted(values: np.ndarray, owner: np.ndarray, by: int) -> np.ndarray:
    """values `by` places on, 0 where the owner ends."""
    out = np.zeros_like(values)
    if by < len(values):
        same = np.flatnonzero(owner[:-by] == owner[by:])
        out[same] = values[same + by]
    return out


def _together(batches, name: str) -> Iterator[pa.Table]:
    """Rows sorted by a column, put together so that rows of one value are in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        values = batch.column(name).to_numpy()
        if values[-1] == held[0].column(name)[0].as_py():
            continue  # still one value
        table = pa.Table.from_batches(held)
        values = table.column(name).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))  # the last one may go on
        yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_NUMBERED = "stretch long, doc_id long, start long, sizes binary, offsets binary, data binary"


def _number(batches) -> Iterator[pa.RecordBatch]:
    """Stretches in the order of (doc_id, start), less those flagged as copies: each is numbered by the phrases before it.

    So stretch + k is the position of its phrase k, and positions are in the order of the texts.
    """
    at, flagged = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        doc, start, kind = _of(batch, "doc_id", "start", "kind")
        keep = kind == 1
        for k in np.flatnonzero(~keep).tolist():
            flagged = int(doc[k]), int(start[k])
            if k + 1 < len(doc):
                keep[k + 1] = False
                flagged = None
        if len(doc) and keep[0] and flagged == (int(doc[0]), int(start[0])):
            keep[0], flagged = False, None
        kept = batch.filter(pa.array(keep))
        if kept.num_rows:
            sizes = np.array([len(x) // 2 for x in kept.column("sizes").to_pylist()], np.int64)
            numbers = at + np.cumsum(sizes) - sizes
            at = int(numbers[-1] + sizes[-1])
            yield _arrow({"stretch": numbers, **{c: kept.column(c) for c in ("doc_id", "start", "sizes", "offsets", "data")}})


_HASHED = "stretch long, symbols binary, prefixes binary"


def _hashed(batches, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols, prefixes = [], []
        for own in _rows(batch, "sizes", "offsets", "data"):
            stretch = Stretch(*own, length, gram)
            symbols.append(_signed(stretch.symbols()).tobytes())
            prefixes.append(_signed(stretch.prefixes()).tobytes())
        yield _arrow({"stretch": batch.column("stretch"), "symbols": pa.array(symbols, pa.binary()), "prefixes": pa.array(prefixes, pa.binary())})


_TRIPLE = "a long, b long, c long, stretch long, k int"


def _first_triples(batches) -> Iterator[pa.RecordBatch]:
    """Of the sample's positions: three symbols. k: the number within the stretch's sample."""
    for batch in batches:
        symbol, owner = _numbers(batch.column("symbols"))
        step = _steps(owner)
        take = np.flatnonzero(step % 3)
        b, c = _shifted(symbol, owner, 1), _shifted(symbol, owner, 2)
        k = 2 * (step[take] // 3) + step[take] % 3 - 1
        yield _arrow({"a": symbol[take], "b": b[take], "c": c[take], "stretch": _of(batch, "stretch")[0][owner[take]], "k": k.astype(np.int32)})


def _next_triples(batches, steps: int) -> Iterator[pa.RecordBatch]:
    """Of the names that aren't settled: with those `steps` and twice as many further on in the stretch's sample."""
    for batch in batches:
        name, owner = _numbers(batch.column("names"))
        live, _ = _numbers(batch.column("live"), "u1")
        take = np.flatnonzero(live)
        b, c = _shifted(name, owner, steps), _shifted(name, owner, 2 * steps)
        yield _arrow({"a": name[take], "b": b[take], "c": c[take], "stretch": _of(batch, "stretch")[0][owner[take]], "k": _steps(owner)[take].astype(np.int32)})


def _ranked(triples: DataFrame) -> DataFrame:
    """(a, b, c, rows, part, place, before): distinct triples in ranges of their order, and how many rows are before each among
    those of its a (place), and in its range."""

    def place(batches) -> Iterator[pa.RecordBatch]:
        part, last, before, passed = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a, rows = _of(batch, "a", "rows")
            new = np.concatenate([[a[0] != last], a[1:] != a[:-1]])
            total = np.cumsum(rows) - rows
            base = np.maximum.accumulate(np.where(new, total, -before if last is not None else 0))
            if not new[0]:
                base[: int(np.argmax(new)) if new.any() else len(new)] = -before
            at = total - base
            last, before = int(a[-1]), int(at[-1] + rows[-1])
            yield _arrow({**{n: batch.column(n) for n in ("a", "b", "c", "rows")}, "part": np.full(len(a), part, np.int32), "place": at, "before": passed + total})
            passed += int(total[-1] + rows[-1])

    # Later rounds have few rows, and need few ranges.
    width = max(1, min(shuffle_width(triples.sparkSession), triples.count() // RANGE))
    counted = triples.groupBy("a", "b", "c").agg(F.count("*").alias("rows"))
    ordered = counted.repartitionByRange(width, "a", "b", "c").sortWithinPartitions("a", "b", "c")
    return stored(ordered.mapInArrow(place, "a long, b long, c long, rows long, part int, place long, before long"), "ranked")


def _carried(ranked: DataFrame) -> DataFrame:
    """`place` counted on where the rows of an a go on from one range to the next. A row a range comes to the driver."""
    ends = F.broadcast(ranked.groupBy("part").agg(F.min("a").alias("low"), F.max("a").alias("high")))
    tails = ranked.join(ends, "part").where("a = high").groupBy("part", "low", "high").agg(F.sum("rows").alias("tail"))
    carry, last, held = [], None, 0
    for part, low, high, tail in sorted(tuple(r) for r in tails.collect()):
        if low != last:
            held = 0
        if held:
            carry.append((part, low, held))
        held = held + tail if low == high and low == last else tail
        last = high
    if not carry:
        return ranked
    more = ranked.sparkSession.createDataFrame(carry, "part int, low long, held long")
    return ranked.join(F.broadcast(more), "part", "left").withColumn("place", F.col("place") + F.when(F.col("a") == F.col("low"), F.col("held")).otherwise(0)).drop("low", "held")


_NAMES = "stretch long, names binary, live binary"


def _named(triples: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A row a stretch: the names of its sample, and which of them aren't settled. before: those that the triples refine.

    A name is the number of rows that are smaller, so finer names lie between those of before. It is settled if it is alone, or
    if its suffixes end within the triple and so are equal.
    """
    triples = stored(triples, "triples")
    ranked = _ranked(triples)
    if before is None:
        name = F.shiftleft(F.col("part").cast("long"), 40) + F.col("before") + 1
        found = ranked.withColumn("name", name)
    else:
        found = _carried(ranked).withColumn("name", F.col("a") + F.col("place"))
    found = found.select("a", "b", "c", "name", "rows", ((F.col("rows") > 1) & (F.col("c") != 0)).cast("int").alias("live"))
    found._stored_at = ranked._stored_at  # little is computed on top of what is stored
    rows = join_counted(triples, found, ["a", "b", "c"], "rows").select("stretch", "k", "name", "live", *(F.lit(None).cast("binary").alias(n) for n in ("names", "lives")))
    if before is not None:
        old = before.select("stretch", F.lit(-1).alias("k"), F.lit(0).cast("long").alias("name"), F.lit(0).alias("live"), "names", F.col("live").alias("lives"))
        rows = rows.unionByName(old)

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, "stretch"):
            stretch, k, name, live = _of(table, "stretch", "k", "name", "live")
            new, known = k >= 0, np.flatnonzero(k < 0)
            own = np.unique(stretch)
            if len(known):
                old = table.take(pa.array(known))
                names, owner = (x.copy() for x in _numbers(old.column("names").combine_chunks()))
                lives = np.zeros(len(names), np.uint8)
                base = np.searchsorted(owner, np.arange(len(own)))
                at = base[np.searchsorted(own, stretch[new])] + k[new]
                names[at], lives[at] = name[new], live[new]
            else:
                names, lives, owner = name, live.astype(np.uint8), np.searchsorted(own, stretch)
            edges = [*np.searchsorted(owner, np.arange(len(own))).tolist(), len(owner)]
            packed = [(names[a:b].astype("<i8").tobytes(), lives[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield _arrow({"stretch": own, "names": pa.array([x for x, _ in packed], pa.binary()), "live": pa.array([x for _, x in packed], pa.binary())})

    dealt = rows.repartition("stretch").sortWithinPartitions("stretch", "k")
    out = stored(dealt.mapInArrow(pack, _NAMES), "sample")
    discard(triples, ranked)
    return out


def _sample(hashed: DataFrame) -> DataFrame:
    """The names of all samples, refined until all are settled; stretches without a name to refine are put aside."""
    live = F.col("live").contains(F.lit(b"\1"))
    rounds = [_named(hashed.mapInArrow(_first_triples, _TRIPLE))]
    steps = 2  # of three successive positions two are in the sample
    while not (left := rounds[-1].where(live)).isEmpty():
        rounds.append(_named(left.mapInArrow(lambda b, n=steps: _next_triples(b, n), _TRIPLE), left))
        steps *= 3
    out = stored(reduce(DataFrame.unionByName, [r.where(~live) for r in rounds]), "all-names")
    discard(*rounds)
    return out


def _heavy(hashed: DataFrame) -> np.ndarray:
    """Anchors of so many suffixes that their orders are dealt by name: 16 for a partition at most."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, rows = np.unique(_numbers(batch.column("symbols"))[0] >> 32, return_counts=True)
            yield _arrow({"anchor": anchors, "rows": rows})

    counted = hashed.mapInArrow(count, "anchor long, rows long").groupBy("anchor").agg(F.sum("rows").alias("rows"))
    counted = stored(counted.where(F.col("rows") > 1), "anchors")
    least = max(MANY, (counted.agg(F.sum("rows")).first()[0] or 0) // (16 * shuffle_width(hashed.sparkSession)))
    found = np.sort(np.array([r[0] for r in counted.where(F.col("rows") > least).select("anchor").collect()], np.int64))
    discard(counted)
    return found


def _bounds(names: DataFrame) -> np.ndarray:
    """Limits of even ranges of names, one for each partition: from those names whose hash falls in a share, some 200 a range."""
    width = shuffle_width(names.sparkSession)
    share = np.uint64(max(1, (names.agg(F.sum(F.length("names"))).first()[0] or 0) // (8 * 200 * width)))

    def pick(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_numbers(batch.column("names"))[0])
            yield _arrow({"name": found[mix(found.view(np.uint64)) % share == 0]})

    found = np.sort(np.array([r[0] for r in names.select("names").mapInArrow(pick, "name long").distinct().collect()], np.int64))
    return np.unique(found[np.arange(1, width) * len(found) // width]) if len(found) else found


#: kind: 2 * order, and 1 for anchors that are dealt by name.
_ORDER = "kind int, part int, a long, b long, c long, prefix long, position long"


def _first_here(owner: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Phrases whose windows are new within their stretch."""
    order = np.lexsort((np.arange(len(prefix)), prefix, owner))
    new = np.ones(len(order), bool)
    new[1:] = (prefix[order][1:] != prefix[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _orders(batches, heavy: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of the three orders, from stretches with their symbols, prefixes and names; part: a range of the order's keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, owner = _numbers(batch.column("symbols"))
        prefix, _ = _numbers(batch.column("prefixes"))
        name, of = _numbers(batch.column("names").fill_null(b""))
        step = _steps(owner)
        here = np.zeros(len(symbol), np.int64)
        base = np.searchsorted(owner, np.arange(batch.num_rows))
        k = _steps(of)
        here[base[of] + 3 * (k // 2) + 1 + k % 2] = name
        position = _of(batch, "stretch")[0][owner] + step
        live = _first_here(owner, prefix)
        zero = np.zeros(len(symbol), np.int64)
        one, two, next_symbol = _shifted(here, owner, 1), _shifted(here, owner, 2), _shifted(symbol, owner, 1)
        wide = np.isin(symbol >> 32, heavy)
        share = ((symbol >> 33) + (1 << 30)) * width >> 31
        residue = step % 3
        for order, without, key in ((0, 0, (here, symbol, zero)), (1, 2, (symbol, one, zero)), (2, 1, (symbol, next_symbol, two))):
            take = np.flatnonzero(live & (residue != without))
            by_name = np.searchsorted(bounds, (here, one, two)[order][take], "right")
            part = np.where(wide[take], by_name, share[take]) if order else by_name
            columns = dict(zip("abc", (x[take] for x in key)))
            head = {"kind": (2 * order + wide[take]).astype(np.int32), "part": part.astype(np.int32)}
            yield _arrow({**head, **columns, "prefix": prefix[take], "position": position[take]})


def _positions(batches) -> Iterator[pa.RecordBatch]:
    """(prefix, position, stretch) of the phrases that are in the orders."""
    for batch in batches:
        prefix, owner = _numbers(batch.column("prefixes"))
        take = np.flatnonzero(_first_here(owner, prefix))
        stretch = _of(batch, "stretch")[0][owner[take]]
        yield _arrow({"prefix": prefix[take], "position": stretch + _steps(owner)[take], "stretch": stretch})


def _classes(batches) -> Iterator[pa.RecordBatch]:
    """(prefix, least, rows, several) of each class in each run of neighbours with the same anchor.

    several: the run has other classes too. That is held of a run's piece at either end of a batch's rows of one kind, since a run of the
    first order may go on in the next range of names, and of anchors that are dealt by name.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, a, b, prefix, least, rows = _of(batch, "kind", "a", "b", "prefix", "least", "rows")
        order = kind >> 1
        anchor = np.where(order == 0, b, a) >> 32
        run = np.cumsum(np.concatenate([[0], (order[1:] != order[:-1]) | (anchor[1:] != anchor[:-1])]))
        by = np.lexsort((prefix, run))
        first = np.flatnonzero(np.concatenate([[True], (run[by][1:] != run[by][:-1]) | (prefix[by][1:] != prefix[by][:-1])]))
        own = run[by][first]
        change = kind[1:] != kind[:-1]
        ends = run[np.concatenate([[True], change]) | np.concatenate([change, [True]])]
        several = (np.bincount(own)[own] > 1) | np.isin(own, ends) | (kind[by][first] & 1 > 0)
        yield _arrow({"prefix": prefix[by][first], "least": np.minimum.reduceat(least[by], first), "rows": np.add.reduceat(rows[by], first), "several": several.astype(np.int32)})


def _compared(hashed: DataFrame, names: DataFrame) -> DataFrame:
    """(stretch, flags): of the phrases that repeat 2 * k + 1, of those whose windows are to be compared 2 * k."""
    width = shuffle_width(hashed.sparkSession)
    joined = hashed.join(names.select("stretch", "names").hint("shuffle_hash"), "stretch", "left")
    heavy, bounds = _heavy(hashed), _bounds(names)
    orders = joined.mapInArrow(lambda b: _orders(b, heavy, bounds, width), _ORDER)
    # Suffixes that are equal to their end are one row, with the least of their positions.
    orders = orders.groupBy("kind", "part", "a", "b", "c", "prefix").agg(F.min("position").alias("least"), F.count("*").alias("rows"))
    dealt = orders.repartitionById(width, F.col("part")).sortWithinPartitions("kind", "a", "b", "c")
    classes = dealt.mapInArrow(_classes, "prefix long, least long, rows long, several int")
    classes = classes.groupBy("prefix").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"), F.max("several").alias("several"))
    # A phrase is in two of the orders.
    classes = stored(classes.where("rows > 2 or several > 0"), "classes")
    own = stored(hashed.mapInArrow(_positions, "prefix long, position long, stretch long"), "positions")
    found = join_counted(own, classes, "prefix", "rows").withColumn("later", (F.col("position") != F.col("least")).cast("long"))
    found = found.where("later > 0 or several > 0").select("stretch", (2 * (F.col("position") - F.col("stretch")) + F.col("later")).alias("flag"))
    out = stored(found.groupBy("stretch").agg(F.collect_list("flag").alias("flags")), "flags")
    discard(classes, own)
    return out


_PART = "kind int, anchor long, position long, doc_id long, start long, size long, data binary"
_PART_ARROW = pa.schema([("kind", pa.int32()), ("anchor", pa.int64()), ("position", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def _parts(batches, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of each stretch: runs of windows that are repeats (kind 0), and the phrases whose windows are to be compared, by anchor (kind 1)."""
    for batch in batches:
        out = []
        for first, doc, start, sizes, offsets, data, flags in _rows(batch, "stretch", "doc_id", "start", "sizes", "offsets", "data", "flags"):
            stretch = Stretch(sizes, offsets, data, length, gram)
            marks = {f >> 1: f & 1 for f in flags or ()}
            at, seen, run = stretch.at.tolist(), set(), None
            for k, prefix in enumerate(stretch.prefixes()):
                again = marks.get(k) or prefix in seen
                seen.add(prefix)  # of equal phrases of a stretch the first alone is in the orders
                if again:
                    run = k if run is None else run
                    continue
                if run is not None:
                    out.append((0, 0, 0, doc, start + at[run], at[k] - at[run], None))
                    run = None
                if k in marks:
                    a, b, anchor = at[k], at[k + 1], stretch.anchor(k)
                    out.append((1, anchor - (1 << 64) if anchor >> 63 else anchor, first + k, doc, start + a, b - a, data[a : b + length - 1]))
            if run is not None:
                out.append((0, 0, 0, doc, start + at[run], at[-1] - at[run], None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PART_ARROW.types)], schema=_PART_ARROW)


def _windows(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of every window of the given phrases."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    h = _hash_at(_words(joined), length, len(joined) - length + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base = np.concatenate([[0], np.cumsum(sizes + length - 1)[:-1]])
    return row, starts[row] + step, h[base[row] + step]


def _later_windows(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Windows that also start earlier, from phrases sorted by anchor; as runs (doc_id, start, size)."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, doc, start, size = (table.column(k).to_numpy() for k in ("anchor", "doc_id", "start", "size"))
        data = table.column("data").combine_chunks()
        edges = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        if not several.any():
            return
        doc, start, size, data = doc[several], start[several], size[several], data.filter(pa.array(several))
        row, place, h = _windows(doc, start, size, data, length)
        by = np.lexsort((place, doc[row], h))
        later = np.sort(by[1:][h[by][1:] == h[by][:-1]])
        if not len(later):
            return
        row, place = row[later], place[later]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
        yield _arrow({"doc_id": doc[row[new]], "start": place[new], "size": np.diff(np.concatenate([new, [len(row)]]))})

    for table in _together(batches, "anchor"):
        yield from of(table)


def _dealt_windows(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many phrases: a row for each window, of which a phrase has no two that are equal."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size, position = _of(batch, "doc_id", "start", "size", "position")
            row, place, h = _windows(doc, start, size, batch.column("data"), length)
            yield _arrow({"window": h.view(np.int64), "position": position[row], "doc_id": doc[row], "start": place})

    rows = stored(parts.select("position", "doc_id", "start", "size", "data").mapInArrow(each, "window long, position long, doc_id long, start long"), "windows")
    least = rows.groupBy("window").agg(F.min("position").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    later = join_counted(rows, least, "window", "rows").where(F.col("position") != F.col("least"))
    return later.select("doc_id", "start", F.lit(1).cast("long").alias("size"))


def _suspected(docs: DataFrame, length: int, gram: int, slices: int | None, most: int) -> DataFrame:
    """The stretches of phrases whose anchors are met twice."""
    if slices is None:
        # Of random bytes every (length - gram + 2) / 2-th is an anchor.
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slices = slices_for(2 * size // (length - gram + 2))

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([phrases_of(*_buffer(part.column(0)), length, gram)[4] for part in few([batch])])

    def few(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), TEXTS):
                yield batch.slice(k, TEXTS)

    def arrow(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STRETCH_ARROW.types)], schema=_STRETCH_ARROW)

    known = repeated(docs.select("text"), hashes, slices, most)
    if isinstance(known, Repeats):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def suspects(batches) -> Iterator[pa.RecordBatch]:
            for batch in few(batches):
                yield from arrow(list(_stretches(batch.column(0).to_pylist(), batch.column(1), lambda h, *_: shared.value.suspects(h), length, gram)))

        return docs.select("doc_id", "text").mapInArrow(suspects, _STRETCH)

    # The filter stays where it is: phrases' hashes go there, and what is suspected comes back by document.
    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, *_, h = phrases_of(*_buffer(batch.column(1)), length, gram)
            yield _arrow({"hash": h.view(np.int64), "doc_id": _of(batch, "doc_id")[0][text], "k": _steps(text)})

    phrases = known.only(docs.select("doc_id", "text").mapInArrow(each, "hash long, doc_id long, k long"))
    marked = docs.select("doc_id", "text").join(phrases.groupBy("doc_id").agg(F.collect_list("k").alias("marked")).hint("shuffle_hash"), "doc_id")

    def given(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            text, k = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.array(x, np.int64) for x in lists])
            yield from arrow(list(_stretches(batch.column(0).to_pylist(), batch.column(1), lambda _, t, n: np.isin(t << 40 | n, text << 40 | k), length, gram)))

    return marked.select("doc_id", "text", "marked").mapInArrow(given, _STRETCH)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slices: int | None = None, crowded: int = CROWDED, most: int = BROADCAST) -> DataFrame:
    """(doc_id, start, size): runs of windows that also start earlier. docs: doc_id, text; ids are unique."""
    width = shuffle_width(docs.sparkSession)
    found = stored(_suspected(docs, length, gram, slices, most), "stretches")
    # Equal stretches: the first stands for all.
    own = found.select("digest", "doc_id", "start", (F.length("data") - (length - 1)).cast("long").alias("size"))
    firsts = own.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    copies = stored(join_counted(own, firsts, "digest", "rows").where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "size"), "copies")
    columns = ("sizes", "offsets", "data")
    flagged = copies.select("doc_id", "start", F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in columns))
    flagged = flagged.unionByName(found.select("doc_id", "start", F.lit(1).alias("kind"), *columns))
    flagged = flagged.repartitionByRange(width, "doc_id", "start").sortWithinPartitions("doc_id", "start", "kind")
    single = stored(flagged.mapInArrow(_number, _NUMBERED), "single-stretches")
    discard(found)

    hashed = stored(single.mapInArrow(lambda b: _hashed(b, length, gram), _HASHED), "symbols")
    names = _sample(hashed)
    flags = _compared(hashed, names)
    discard(hashed, names)
    parts = stored(single.join(flags.hint("shuffle_hash"), "stretch", "left").mapInArrow(lambda b: _parts(b, length, gram), _PART), "phrases")
    discard(single, flags)
    out = parts.where("kind = 0").select("doc_id", "start", "size").unionByName(copies)
    edges = parts.where("kind = 1").drop("kind")
    many = stored(edges.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor"), "crowded-anchors")
    if not many.isEmpty():
        out = out.unionByName(_dealt_windows(edges.join(many, "anchor", "left_semi"), length))
        edges = edges.join(many, "anchor", "left_anti")
    edges = edges.select("anchor", "doc_id", "start", "size", "data").repartition("anchor").sortWithinPartitions("anchor")
    return out.unionByName(edges.mapInArrow(lambda b: _later_windows(b, length), "doc_id long, start long, size long"))


def _cut(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans, and what stays."""
    spans: list[tuple[int, int]] = []
    for start, size in sorted(runs):
        end = start + size + length - 1
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return spans, b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, gram: int = GRAM, slices: int | None = None, crowded: int = CROWDED, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<start,end long>> of bytes, kept binary: a row for each text."""
    own = narrow(docs, id_col, text_col)
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _removed(own, length, gram, slices, crowded, most).withColumn("doc_id", given_id())
    # Ids that are shared: each different text gets a number of its own, in the order of (id, text).
    texts = prefix_sums(own.distinct().withColumn("one", F.lit(1)), ["doc_id", "text"], "one", "number")
    texts = stored(texts.select("number", F.col("doc_id").alias("given"), F.col("text").alias("own_text")), "numbered")
    found = _removed(texts.select(F.col("number").alias("doc_id"), F.col("own_text").alias("text")), length, gram, slices, crowded, most)
    rows = own.join(texts, (F.col("doc_id") == F.col("given")) & F.col("text").eqNullSafe(F.col("own_text"))).select("number", "given")
    found = rows.join(found.withColumnRenamed("doc_id", "number"), "number").withColumn("doc_id", given_id("given"))
    return found.select("doc_id", "n_bytes", "n_removed", "spans", "kept")


def _removed(own: DataFrame, length: int, gram: int, slices: int | None, crowded: int, most: int) -> DataFrame:
    runs = repeats(own, length, gram, slices, crowded, most)
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    joined = own.join(runs.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "runs")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own_runs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                text = text or b""
                spans, kept = _cut(text, [(r["start"], r["size"]) for r in own_runs or ()], length)
                rows.append((doc, len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
