"""Phrases of two to four words that stay together, per language, by direct-address tiling.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and pieces into words at blanks and tabs. Frequent words get ids by
rank within their language. A phrase is a pair: a frequent unit (a word, or a frequent pair or triple that was ranked in turn) and the
word after it. The grid of units and words is cut into tiles. As ids are ranks, tiles near the origin are crowded: the plan, made from
the counts, gives the most crowded ones a place in an array that a task counts into by bincount. All other tiles are
sorted coordinates with counts. Both are merged by tile; pairs found `least` times are the next round's units, ranked anew. A phrase
is only counted if its parts are frequent, which loses none.

What workers hold is bounded: HEAD_WORDS words, HEAD_UNITS units of each length, and a filter of 64 MiB at most for the rest. Phrases with
a frequent word or unit beyond these are counted exactly too, by a shuffle of their words or ids with counts per task; a filter only
spares phrases that can't be frequent. Counts of a tile or phrase combine in the tasks, so a common word is a row a task.

A candidate's cut is the one with the lowest score floor(scale * a / (l + r)), the first of equal ones. Candidates that lie within a
longer one with at least `within` percent of their count are dropped. Products are decimals of 38 digits, so they don't overflow.

Null text: empty. Null language: `und`, with that language's own. Ids aren't read: repeated rows count each. Very long texts are read
whole. Equal scores go by count, then by the phrase's UTF-8 bytes. An empty table, or one without frequent phrases, gives no rows. Other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import BROADCAST, Repeats, repeated, slices_for
from .common import as_bytes, discard, mix, shuffle_width, stored

#: Counts of a phrase; words of the longest; rows given a language; the share of a longer phrase; the score's scale.
LEAST, LONGEST, TOP, WITHIN, SCALE = 30, 4, 2000, 80, 2_000_000
UNKNOWN = "und"
#: Words, and units of each length, that workers know by id.
HEAD_WORDS, HEAD_UNITS = 1 << 18, 1 << 20
#: A word id's bits in a key; a tile's side is 2**SIDE, and a task's array has room for so many tiles.
WORD, SIDE, TILES = 20, 7, 256
CELLS = 1 << 2 * SIDE
#: A task counts sparse pairs after so many, and gives words away after so many different ones.
FLUSH, WORDS_HELD = 1 << 22, 1 << 19
#: Codes of a position without a known word: an end of a piece or a rare word; a word beyond the head that may be frequent.
BREAK, TAIL = -1, -2

# Fixed values of the text rule: separators of pieces become a full stop, tabs blanks, capitals small.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + b"\t" + _ENDS, bytes(range(ord("a"), ord("z") + 1)) + b" " + b"." * len(_ENDS))
_END = b"."


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a full stop wherever a piece ends; no word has one."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_col].cast("string").alias("text"))


def word_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, n of words with n >= least; and a row a language without a word: n of all its words."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs = [lang for lang, own in held.items() for _ in own]
            words = [w for own in held.values() for w in own]
            numbers = [n for own in held.values() for n in own.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(numbers, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not text:
                    continue
                own = tokens(text)
                counts = held.setdefault(lang, Counter())
                counts.update(own)
                totals[lang] += len(own) - counts.pop(_END, 0)
            if sum(map(len, held.values())) > WORDS_HELD:
                yield out()
                held = {}
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "n"])

    summed = texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= least) | F.col("word").isNull())


def _head(rows: DataFrame, most: int) -> tuple[pa.Table, Column | None]:
    """The rows of the highest n, at most so many, and a condition for the others (None if there are none). Bounds go by bins of n."""
    bins = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n")) * 64))
    total, bound, rest = 0, 0, False
    for b, n in sorted(rows.groupBy(bins.alias("bin")).count().collect(), reverse=True):
        total += n
        if total > most:
            bound, rest = b + 1, True
            break
    return rows.where(bins >= bound).toArrow(), (bins < bound if rest else None)


def _places(lang: np.ndarray) -> np.ndarray:
    """Ids of rows that are sorted by language: each language begins a tile, unless there are very many of them."""
    side = 1 << SIDE if len(np.unique(lang)) << SIDE <= 1 << WORD - 1 else 1
    begin = np.flatnonzero(np.diff(lang, prepend=-1))
    sizes = np.diff(np.append(begin, len(lang)))
    padded = -(-sizes // side) * side
    return np.arange(len(lang)) + np.repeat(np.cumsum(padded) - padded - begin, sizes)


def _at(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values by id, zero where there is none."""
    out = np.zeros(places[-1] + 1 if len(places) else 0, np.int64)
    out[places] = values
    return out


class Words:
    """The words that workers know: ids by language and rank."""

    def __init__(self, table: pa.Table, rest: Repeats | None):
        rows = sorted(zip(table["lang"].to_pylist(), table["n"].to_pylist(), table["word"].to_pylist()), key=lambda r: (r[0], -r[1], r[2]))
        names = sorted({r[0] for r in rows})
        number = {lang: k for k, lang in enumerate(names)}
        own = np.array([number[r[0]] for r in rows], np.int64)
        places = _places(own)
        self.counts, self.lang = _at(places, np.array([r[1] for r in rows], np.int64)), _at(places, own)
        self.names = names
        self.words: list[bytes | None] = [None] * len(self.counts)
        for k, r in zip(places.tolist(), rows):
            self.words[k] = r[2]
        self.rest = rest
        self._ids: dict[str, dict[bytes, int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_ids": {}}

    def ids(self, lang: str) -> dict[bytes, int]:
        if not self._ids:
            for k, (own, word) in enumerate(zip(self.lang.tolist(), self.words)):
                if word is not None:
                    self._ids.setdefault(self.names[own], {})[word] = k
        return self._ids.get(lang, {})

    def codes(self, lang: str, own: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """An id or code for each token, and the words of those beyond the head that may be frequent."""
        get = self.ids(lang).get
        out = np.array([get(w, BREAK) for w in own], np.int32)
        if self.rest is None:
            return out, []
        unknown = [k for k in np.flatnonzero(out == BREAK).tolist() if own[k] != _END]
        may = self.rest.suspects(np.array([_word_hash(lang, own[k]) for k in unknown], np.uint64)) if unknown else np.zeros(0, bool)
        found = [k for k, m in zip(unknown, may.tolist()) if m]
        out[found] = TAIL
        return out, [own[k] for k in found]


def _word_hash(lang: str, word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode() + b"\0" + word, digest_size=8).digest(), "little")


def _members(rows: DataFrame, hashes_of) -> Repeats:
    """A filter that holds all hashes of the rows, of 64 MiB at most: given twice each, all are met twice."""
    return repeated(rows, lambda batch: np.repeat(hashes_of(batch), 2), min(slices_for(rows.count()), BROADCAST), BROADCAST)


def _encoded(texts: DataFrame, words) -> DataFrame:
    """lang, ids (little-endian 32-bit codes of many texts, with breaks between them), tails (their words beyond the head)."""

    def encode(batches) -> Iterator[pa.RecordBatch]:
        known: Words = words.value
        held: dict[str, list] = {}
        sizes: Counter = Counter()
        schema = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("tails", pa.list_(pa.binary()))])

        def out(lang: str) -> pa.RecordBatch:
            parts = held.pop(lang)
            del sizes[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.concatenate([p[0] for p in parts]).astype("<i4").tobytes()]), pa.array([[w for p in parts for w in p[1]]], schema.types[2])], schema=schema)

        end = np.array([BREAK], np.int32)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not text:
                    continue
                ids, tails = known.codes(lang, tokens(text))
                # A run of breaks is one.
                ids = np.concatenate([ids[(ids != BREAK) | (np.concatenate([end, ids[:-1]]) != BREAK)], end])
                held.setdefault(lang, []).append((ids, tails))
                sizes[lang] += len(ids)
                if sizes[lang] > 1 << 18:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    return texts.mapInArrow(encode, "lang string, ids binary, tails array<binary>")


class Lookup:
    """Ids of frequent phrases of one length by their keys (the unit before and the last word), and a filter of those without an id."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rest: Repeats | None):
        self.keys, self.ids, self.rest = keys, ids.astype(np.int32), rest

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of these keys, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at].astype(np.int64), -1)


class Units:
    """The frequent phrases of one length that workers know, ranked within their languages: their counts, languages and words by id."""

    def __init__(self, table: pa.Table, words: Words, rest: Repeats | None):
        keys, n, hi, lo = (table[c].to_numpy().astype(np.int64) for c in ("key", "n", "hi", "lo"))
        lang = words.lang[hi >> WORD] if len(hi) else hi
        rank = np.lexsort((keys, -n, lang))
        places = _places(lang[rank])
        self.counts, self.lang, self.hi, self.lo = (_at(places, x[rank]) for x in (n, lang, hi, lo))
        order = np.argsort(keys[rank])
        self.lookup = Lookup(keys[rank][order], places[order], rest)


def _hashes(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hi.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * mix(lo.astype(np.uint64) + np.uint64(1)))


class Plan:
    """Which tiles are crowded: for each block of units, how many blocks of words from its language's first on have a place."""

    def __init__(self, units: Words | Units, words: Words):
        side, grand = 1 << SIDE, float(words.counts.sum()) or 1.0
        blocks = lambda x: np.add.reduceat(x.astype(np.float64), np.arange(0, len(x), side)) if len(x) else np.zeros(0)
        of_units, of_words, unit_lang, word_lang = blocks(units.counts), blocks(words.counts), units.lang[::side], words.lang[::side]
        self.first, self.width = np.zeros(len(of_units), np.int64), np.zeros(len(of_units), np.int64)
        found = []
        for lang in np.unique(unit_lang).tolist() if len(words.names) << SIDE <= 1 << WORD - 1 else []:
            us, ws = np.flatnonzero(unit_lang == lang), np.flatnonzero(word_lang == lang)
            self.first[us] = ws[0]
            # Pairs that a task's array gets in FLUSH pairs, if words came independently. Ranks fall, so the first blocks are enough.
            share = np.outer(of_units[us[:TILES]], of_words[ws[:TILES]]) / of_words[ws].sum() * FLUSH / grand
            found += [(-share[u, k], int(us[u]), k) for u, k in np.argwhere(share >= CELLS / 8).tolist()]
        for _, u, k in sorted(found)[:TILES]:
            if k == self.width[u]:  # a block's places lie side by side
                self.width[u] += 1
        self.start = np.cumsum(self.width) - self.width
        self.slots = int(self.width.sum())
        self.owner = np.repeat(np.arange(len(self.width)), self.width)
        self.word_block = self.first[self.owner] + np.arange(self.slots) - self.start[self.owner]

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of the array that crowded keys have, the other keys)."""
        if not self.slots:
            return np.zeros(0, np.int64), keys
        unit, word = keys >> WORD, keys & (1 << WORD) - 1
        block = unit >> SIDE
        at = (word >> SIDE) - self.first[block]
        crowded = (at >= 0) & (at < self.width[block])
        unit, word, block, at = unit[crowded], word[crowded], block[crowded], at[crowded]
        side = (1 << SIDE) - 1
        return (self.start[block] + at) * CELLS + ((unit & side) << SIDE | word & side), keys[~crowded]

    def keys(self, slot: int) -> np.ndarray:
        """The keys of a crowded tile's cells."""
        side = np.arange(1 << SIDE)
        return (((self.owner[slot] << SIDE) + side)[:, None] << WORD | ((self.word_block[slot] << SIDE) + side)[None, :]).ravel()


_PACKED = "bucket int, slot int, payload binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("payload", pa.binary())])


def _coo(keys: np.ndarray, n: np.ndarray) -> bytes:
    return keys.astype("<i8").tobytes() + n.astype("<i8").tobytes()


def _from_coo(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, "<i8").reshape(2, -1)
    return both[0], both[1]


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Tiles are dealt out: keys of one tile are in one bucket."""
    tile = keys >> (WORD + SIDE) << WORD | (keys & (1 << WORD) - 1) >> SIDE
    return ((mix(tile.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets).astype(np.int32)


class Tiles:
    """What a task has counted."""

    def __init__(self, plan: Plan, buckets: int):
        self.plan, self.buckets = plan, buckets
        self.crowded = np.zeros(plan.slots * CELLS, np.int64)
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        cells, rest = self.plan.split(np.concatenate(self.held))
        self.held, self.size = [], 0
        if len(cells):
            self.crowded += np.bincount(cells, minlength=len(self.crowded))
        if len(rest):
            keys, n = np.unique(rest, return_counts=True)
            at = _buckets(keys, self.buckets)
            order = np.argsort(at, kind="stable")
            keys, n, at = keys[order], n[order], at[order]
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            rows = [(int(at[a]), -1, _coo(keys[a:b], n[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_ARROW.types)], schema=_PACKED_ARROW)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush()
        for slot in range(self.plan.slots):
            own = self.crowded[slot * CELLS : (slot + 1) * CELLS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([self.buckets + slot], pa.int32()), pa.array([slot], pa.int32()), pa.array([own.astype("<i8").tobytes()], pa.binary())], schema=_PACKED_ARROW)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, np.concatenate(n))
    return found, out


def _merged(packed: DataFrame, plan, before, level: int, least: int, width: int) -> DataFrame:
    """key, hi, lo, n of the pairs found often enough: the rows of a bucket one after another, a bucket at a time."""

    def merge(batches) -> Iterator[pa.RecordBatch]:
        last, tile, cells, keys, numbers, size = None, -1, None, [], [], 0
        units: Units | None = before.value if before is not None else None

        def done() -> Iterator[pa.RecordBatch]:
            if cells is not None:
                found, n = plan.value.keys(tile), cells
            else:
                found, n = _summed(keys, numbers)
            often = n >= least
            found, n = found[often], n[often]
            unit, word = found >> WORD, found & (1 << WORD) - 1
            if level == 2:
                hi, lo = found, np.zeros(len(found), np.int64)
            elif level == 3:
                hi, lo = units.hi[unit], word
            else:
                hi, lo = units.hi[unit], units.lo[unit] << WORD | word
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(hi), pa.array(lo), pa.array(n)], names=["key", "hi", "lo", "n"])

        for batch in batches:
            for bucket, slot, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != last:
                    if last is not None:
                        yield from done()
                    last, tile, cells, keys, numbers, size = bucket, slot, None, [], [], 0
                if slot >= 0:
                    own = np.frombuffer(payload.as_py(), "<i8")
                    cells = own.copy() if cells is None else cells + own
                    continue
                k, n = _from_coo(payload.as_py())
                keys.append(k)
                numbers.append(n)
                size += len(k)
                if size > FLUSH and len(keys) > 1:
                    k, n = _summed(keys, numbers)
                    keys, numbers, size = [k], [n], 0
        if last is not None:
            yield from done()

    dealt = packed.repartition(width, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(merge, "key long, hi long, lo long, n long")


class Reader:
    """What a task knows of a text's positions, length by length."""

    def __init__(self, ids: np.ndarray, units: list[Lookup]):
        self.a = ids.astype(np.int64)
        self.units = units
        #: By length: the id of the unit that begins at a position (-1: none), and whether a unit may begin there that isn't known by id.
        self.known: list[np.ndarray] = [np.where(self.a >= 0, self.a, -1)]
        self.maybe: list[np.ndarray] = [np.zeros(len(ids), bool)]
        for level, own in enumerate(units, 2):
            keys = self.keys(level)
            found = own.find(keys)
            maybe = np.zeros(len(found), bool)
            if own.rest is not None:
                at = np.flatnonzero((found < 0) & self._whole(level))
                maybe[at[own.rest.suspects(_hashes(*self.explicit(at, level)))]] = True
            self.known.append(found)
            self.maybe.append(maybe)

    def _whole(self, level: int) -> np.ndarray:
        """Where a phrase of so many known words begins."""
        n = max(0, len(self.a) - level + 1)
        out = np.ones(n, bool)
        for k in range(level):
            out &= self.a[k : n + k] >= 0
        return out

    def keys(self, level: int) -> np.ndarray:
        """Keys of the pairs of a unit and the word after it, -1 where there is none."""
        unit, word = self.known[level - 2], self.a[level - 1 :]
        n = len(word)
        return np.where((unit[:n] >= 0) & (word >= 0), unit[:n] << WORD | word, -1)

    def explicit(self, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        hi = self.a[at] << WORD | self.a[at + 1]
        if level == 2:
            return hi, np.zeros(len(at), np.int64)
        return hi, self.a[at + 2] if level == 3 else self.a[at + 2] << WORD | self.a[at + 3]

    def candidates(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys of phrases whose unit is known, positions of those whose unit may only be frequent); the end is frequent too, or may be."""
        keys = self.keys(level)
        n = len(keys)
        end = (self.known[level - 2][1 : n + 1] >= 0) | self.maybe[level - 2][1 : n + 1]
        direct = (keys >= 0) & end
        rest = self.maybe[level - 2][:n] & self._whole(level) & end
        return keys[direct], np.flatnonzero(rest)


def _level(rows: DataFrame, level: int, units, plan, before, least: int, width: int, rest: bool) -> DataFrame:
    """key (null beyond the head), hi, lo, n of the frequent phrases of so many known words."""
    buckets = 8 * width

    def count(batches) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(plan.value, buckets)
        for batch in batches:
            for ids in batch.column(0):
                keys, _ = Reader(np.frombuffer(ids.as_py(), "<i4"), units.value).candidates(level)
                yield from tiles.add(keys)
        yield from tiles.close()

    def others(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column(0):
                reader = Reader(np.frombuffer(ids.as_py(), "<i4"), units.value)
                at = reader.candidates(level)[1]
                if not len(at):
                    continue
                pairs, n = np.unique(np.stack(reader.explicit(at, level)), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], names=["hi", "lo", "n"])

    found = _merged(rows.select("ids").mapInArrow(count, _PACKED), plan, before, level, least, width)
    if not rest:
        return found
    more = rows.select("ids").mapInArrow(others, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.unionByName(more.withColumn("key", F.lit(None).cast("long")))


def _tail_phrases(rows: DataFrame, words, least: int, longest: int) -> DataFrame:
    """lang, phrase, n of the frequent phrases with a word beyond the head."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        known = words.value.words
        for batch in batches:
            for lang, ids, tails in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a = np.frombuffer(ids.as_py(), "<i4")
                place, own = np.cumsum(a == TAIL) - 1, tails.as_py()
                word = lambda k: own[place[k]] if a[k] == TAIL else known[a[k]]  # noqa: B023, E731
                found: Counter = Counter()
                for size in range(2, longest + 1):
                    n = max(0, len(a) - size + 1)
                    good, tail = np.ones(n, bool), np.zeros(n, bool)
                    for k in range(size):
                        good &= a[k : n + k] != BREAK
                        tail |= a[k : n + k] == TAIL
                    found.update(b" ".join(word(k + j) for j in range(size)) for k in np.flatnonzero(good & tail).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "phrase", "n"])

    return rows.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _spelled(found: DataFrame, level: int, words) -> DataFrame:
    """lang, phrase, n from ids."""

    def spell(batches) -> Iterator[pa.RecordBatch]:
        known, low = words.value, (1 << WORD) - 1
        for batch in batches:
            hi, lo = (batch.column(k).to_numpy().astype(np.int64) for k in range(2))
            ids = [hi >> WORD, hi & low] + ([lo] if level == 3 else [lo >> WORD, lo & low] if level == 4 else [])
            phrases = [b" ".join(map(known.words.__getitem__, row)) for row in zip(*(x.tolist() for x in ids))]
            langs = pa.array([known.names[k] for k in known.lang[ids[0]].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.binary()).cast(pa.string()), batch.column(2)], names=["lang", "phrase", "n"])

    return found.select("hi", "lo", "n").mapInArrow(spell, "lang string, phrase string, n long")


def phrases(docs: DataFrame, text_col="text", lang_col="lang", least: int = LEAST, longest: int = LONGEST, head_words: int = HEAD_WORDS, head_units: int = HEAD_UNITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n of all phrases of up to `longest` words found `least` times; lang, n of all words)."""
    if not 2 <= longest <= 4 or head_words > 1 << WORD or head_units > 1 << 62 - WORD:
        raise ValueError("phrases have two to four words, and ids must fit in a key")
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    share = spark.sparkContext.broadcast
    texts = _texts(docs, text_col, lang_col)
    counted = stored(word_counts(texts, least), "words")
    frequent = counted.where("word is not null")
    table, beyond = _head(frequent, head_words)
    rest = None
    if beyond is not None:
        rest = _members(frequent.where(beyond).select("lang", "word"), lambda b: np.array([_word_hash(lang, w) for lang, w in zip(*(c.to_pylist() for c in b.columns))], np.uint64))
    known = Words(table, rest)
    words = share(known)
    rows = stored(_encoded(texts, words), "ids")
    out = [frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), "n")]
    units: list[Units] = []
    done = []
    for level in range(2, longest + 1):
        lookups = [u.lookup for u in units]
        plan, shared, before = share(Plan(units[-1] if units else known, known)), share(lookups), share(units[-1]) if units else None
        found = stored(_level(rows, level, shared, plan, before, least, width, any(u.rest is not None for u in lookups)), f"phrases-{level}")
        out.append(_spelled(found, level, words).select("lang", "phrase", F.lit(level).alias("words"), "n"))
        done.append(found)
        for b in (plan, shared, before):
            if b is not None:
                b.unpersist()
        if level == longest:
            break
        by_key = found.where("key is not null")
        table, beyond = _head(by_key, head_units)
        others = found.where(F.col("key").isNull() | beyond) if beyond is not None else found.where("key is null")
        rest = None
        if not others.isEmpty():
            rest = _members(others.select("hi", "lo"), lambda b: _hashes(b.column(0).to_numpy(), b.column(1).to_numpy()))
        units.append(Units(table, known, rest))
    if known.rest is not None:
        spelled = _tail_phrases(rows, words, least, longest)
        out.append(spelled.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    every = stored(every, "phrases")
    totals = counted.where("word is null").select("lang", "n")
    discard(rows, *done)
    return every, totals


def collocations(docs: DataFrame, text_col="text", lang_col="lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, within: int = WITHIN, scale: int = SCALE, head_words: int = HEAD_WORDS, head_units: int = HEAD_UNITS) -> DataFrame:
    """Per language the best phrases: lang, rank, phrase, a, l, r, n, score."""
    every, totals = phrases(docs, text_col, lang_col, least, longest, head_words, head_units)
    own = every.where("words > 1")
    sides = F.expr("flatten(transform(sequence(1, words - 1), k -> array(struct(k, true as head, substring_index(phrase, ' ', k) as part), struct(k, false as head, substring_index(phrase, ' ', k - words) as part))))")
    parts = own.select("lang", "phrase", F.col("n").alias("a"), F.inline(sides))
    looked = parts.join(every.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    side = lambda head: F.max(F.when(F.col("head") == head, F.col("n")))
    cuts = looked.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), side(True).alias("l"), side(False).alias("r"))
    scored = cuts.withColumn("score", F.expr(f"(cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r")
    # The largest count of the longer phrases that a phrase lies in.
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    around = own.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left")
    kept = kept.where(F.expr(f"longer is null or 100 * cast(longer as decimal(19, 0)) < {within} * cast(a as decimal(19, 0))"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
