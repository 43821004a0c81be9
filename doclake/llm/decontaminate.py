"""Benchmark decontamination by a generalised suffix automaton.

The automaton reads the words of all test items; its states are the word sequences that occur in an item. Each document's
words run through it, and the longest match that ends at each word is followed. Where that length reaches the window,
the window's words are hit; an item shorter than the window must be met whole. Cleaning removes the hit spans, and drops
documents of which more than max_coverage is hit.

Words: A-Z in lower case, then runs of what is neither ASCII punctuation, blank nor control. Null or empty texts have no
words and stay as they are; items without words are never found; items that repeat are all reported. Null item ids are not
reported, but their windows count. Ties: windows that overlap, or are in several items, hit a word once, and every item with one is
named. Repeated rows are judged each; very long texts are read whole. Empty tables: no documents, or none hit.

Items are read in blocks of at most BLOCK words, one automaton each. With several, the documents are read once for each, so that
a worker holds one automaton (some 120 MB) however long the test set is, and what they found is joined by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, stored

WINDOW = 10
#: Words of an automaton; it has at most twice as many states.
BLOCK = 200_000
#: Documents with a larger share of hit words are dropped.
MAX_COVERAGE = 0.8

#: A-Z to lower case, what is no word character to a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split(b" ")


def word_list(text: bytes | None) -> list[bytes]:
    return [w for w in words(text) if w]


class Automaton:
    """Generalised suffix automaton over word numbers, with what is needed to report items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        sequences = [[self.numbers.setdefault(w, len(self.numbers)) for w in own] for _, own in items]
        for own in sequences:
            state = 0
            for c in own:
                state = self._extend(state, c)
        #: Per state: the items whose window is the state's suffix of that length.
        self.ends: dict[int, set[int]] = {}
        for item, own in enumerate(sequences):
            need, state, length = min(window, len(own)), 0, 0
            for c in own:
                state, length = self.step(state, length, c)
                if need and length >= need:
                    self.ends.setdefault(self.suffix(state, need), set()).add(item)
        #: Lengths below the window at which an item is whole, per state.
        self.short: dict[int, list[int]] = {}
        for item, own in enumerate(sequences):
            if 0 < len(own) < window:
                state = 0
                for c in own:
                    state = self.next[state][c]
                if len(own) not in self.short.setdefault(state, []):
                    self.short[state].append(len(own))
        self.least = min((min(window, len(own)) for own in sequences if own), default=window)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest sequence and c alone, apart from q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest match that ends with c, from the longest that ended before it."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def suffix(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (from, to), sorted and disjoint, and the items found."""
        numbers = np.fromiter(map(self.numbers.get, own, [-1] * len(own)), np.int64, len(own))
        # Only runs of known words that are long enough for a window can hold a match.
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.least:
                continue
            state = length = 0
            for i, c in enumerate(numbers[a:b].tolist(), a):
                state, length = self.step(state, length, c)
                if length < self.least:
                    continue
                lengths = [self.window] if length >= self.window else []
                if self.short:
                    s = state
                    while s > 0:
                        lengths += [n for n in self.short.get(s, ()) if n <= length]
                        s = self.link[s]
                for n in lengths:
                    found |= self.ends.get(self.suffix(state, n), set())
                if lengths:
                    start = i + 1 - max(lengths)
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found


def item_blocks(items: DataFrame, item_col: str, text_col: str, block: int = BLOCK) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, block by block; one partition of them is on the driver at a time."""
    held, n = [], 0
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    for item, text in rows.toLocalIterator():
        own = word_list(text.encode() if text is not None else None)
        if held and n + len(own) > block:
            yield held
            held, n = [], 0
        held.append((item, own))
        n += len(own)
    if held:
        yield held


def _offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where the words of a text start and end."""
    inside = np.frombuffer(b" " + text.translate(_TABLE) + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the bytes from the first to the last word of each span."""
    if not spans:
        return text
    starts, ends = _offsets(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, text_col="text", item_col="item_id", item_text="text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit long, items array<string> (sorted), spans array<struct<start,end int>> of words, and clean_text.

    A clashing column name gets underscores.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    added = [fresh(docs, x) for x in ("n_words", "n_hit", "items", "spans", "clean_text")]
    blocks = item_blocks(items, item_col, item_text, block)
    first, second = next(blocks, []), next(blocks, None)
    kinds = ("long", "long", "array<string>", "array<struct<start:int,end:int>>", "string")
    schema = docs.select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(added, kinds))).schema
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(first, window))

        def hits_of(batch) -> Iterator[tuple[list[bytes], list, set]]:
            for text in as_bytes(batch.column(at)):
                own = word_list(text)
                hit, item = shared.value.hits(own)
                yield own, hit, {shared.value.names[k] for k in item}

        return docs.mapInArrow(lambda batches: _reported(batches, at, names, added, hits_of), schema)

    row, hits, found = (fresh(docs, x) for x in ("row", "hits", "found"))
    base = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    parts = [_block_hits(base.select(row, text_col), Automaton(own, window)) for own in chain((first, second), blocks)]
    every = reduce(DataFrame.unionByName, parts)
    every = every.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias(hits), F.flatten(F.collect_list("found")).alias(found)).withColumnRenamed("row", row)
    joined = base.join(every, row, "left").select(*names, hits, found)

    def joined_hits(batch) -> Iterator[tuple[list[bytes], list, set]]:
        for text, own, item in zip(as_bytes(batch.column(at)), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
            yield word_list(text), [(h["start"], h["end"]) for h in own or ()], set(item or ())

    return joined.mapInArrow(lambda batches: _reported(batches, at, names, added, joined_hits), schema)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _block_hits(texts: DataFrame, automaton: Automaton) -> DataFrame:
    """(row, hits, found) of the texts that an automaton hits; written, so that the automaton may go."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def find(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                hit, item = shared.value.hits(word_list(text))
                if hit:
                    rows.append((row, [{"start": a, "end": b} for a, b in hit], [shared.value.names[k] for k in item]))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), _SPAN, pa.list_(pa.string())))], names=["row", "hits", "found"])

    out = stored(texts.mapInArrow(find, "row long, hits array<struct<start:int,end:int>>, found array<string>"), "block-hits")
    shared.destroy()
    return out


def _reported(batches, at: int, names: list[str], added: list[str], hits_of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hits, found, spans, clean = [], [], [], [], []
        for text, (own, hit, item) in zip(as_bytes(batch.column(at)), hits_of(batch)):
            hit = _union(hit)
            counts.append(len(own))
            hits.append(sum(b - a for a, b in hit))
            found.append(sorted(x for x in item if x is not None))
            spans.append([{"start": a, "end": b} for a, b in hit])
            clean.append(None if text is None else without(text, hit))
        extra = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, _SPAN), pa.array(clean, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *extra], names=[*names, *added])


def clean(docs: DataFrame, items: DataFrame, text_col="text", max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """docs, its columns as they were, with hit spans cut from the text and documents hit beyond max_coverage dropped."""
    n_words, n_hit, _, _, text = (fresh(docs, x) for x in ("n_words", "n_hit", "items", "spans", "clean_text"))
    found = contamination(docs, items, text_col, **options)
    found = found.where((F.col(n_hit) == 0) | (F.col(n_hit) <= max_coverage * F.col(n_words)))
    return found.withColumn(text_col, F.col(text)).select(*docs.columns)
