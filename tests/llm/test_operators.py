"""Each operator against plain Python on the small table and on odd rows; empty tables."""

import bisect
import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from llm_tools import texts_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doclake.llm import bloom, decontaminate, language_id, line_dedup, packing, quality_model, quality_rules, queries, simhash, suffix_dedup, token_counts, token_store, tokens
from doclake.llm.common import NO_ID, join_counted, prefix_sums

sha = lambda b: hashlib.sha256(b).hexdigest()
WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(params=["docs", "odd", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def most_in_a_task(spark, df):
    """Rows of the largest partition, where small ones aren't put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return max((r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()), default=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


# 1


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_line_dedup(table):
    rows = texts_of(table)
    where = collections.defaultdict(set)
    key = lambda line: ascii_lower(line.strip(WHITE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where[key(line)].add(NO_ID if i is None else i)
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where[key(x)]) < 2 or min(where[key(x)]) == (NO_ID if i is None else i)]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    found = line_dedup.dedup_lines(table)
    counts = found.columns[-2:]
    assert bag(found.select("doc_id", *counts, "text")) == want
    assert found.columns[: len(table.columns)] == table.columns


def test_line_dedup_of_heavy_lines(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line of all documents\n"), F.col("id").cast("string")).alias("text"))
    found = line_dedup.dedup_lines(df, slices=1)
    assert found.where("n_dropped = 1").count() == 2999 and found.where("n_dropped = 0").first().doc_id == 0


def hasher():
    """By value, as workers don't have this module."""
    return lambda numbers: np.asarray(numbers, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def test_filters_miss_no_repeat(spark):
    hashed = hasher()
    df = spark.range(20000).select((F.col("id") % 15000).alias("x"))
    own = bloom.repeated(df.repartition(5), lambda b: hashed(b.column(0).to_pylist()), 2)
    found = own.suspects(hashed(np.arange(15000)))
    assert found[:5000].all() and found[5000:].mean() < 0.05


def test_filters_grow(spark):
    """Ten times the hashes of a slice: few are suspected, broadcast or by slice."""
    hashed, n = hasher(), 10 << (bloom.SLICE_BITS - 3)
    df = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7000).otherwise(F.col("id")).alias("x"))
    of = lambda b: hashed(b.column(0).to_numpy())
    slices = bloom.slices_for(n)
    assert slices == 10
    every = np.arange(0, n)
    repeats = (every % 100 == 0) & (every < 7000)
    own = bloom.repeated(df, of, slices).suspects(hashed(every))
    assert own[repeats].all() and own[every % 100 > 0].mean() < 0.05
    far = bloom.repeated(df, of, slices, most=9)
    assert isinstance(far, bloom.Sliced)
    rows = spark.createDataFrame([(int(h), k) for k, h in enumerate(hashed(every[:60_000]).view(np.int64))], "hash long, k int")
    got = {r.k for r in far.only(rows).collect()}
    assert got == set(np.flatnonzero(own[:60_000]).tolist())


def test_line_dedup_by_slices(docs, odd):
    """A filter that isn't broadcast finds the same."""
    for df in (docs, odd):
        assert bag(line_dedup.dedup_lines(df, slices=3, most=2)) == bag(line_dedup.dedup_lines(df))


# 2


def without_repeats(rows, length):
    seen, out = set(), []
    for i, b in rows:
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                mark[p : p + length] = 1
            seen.add(b[p : p + length])
        edges = np.diff(np.concatenate([[0], mark[:-1], [0]]))
        out.append((i, len(b), int(mark[:-1].sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[mark[:-1] == 0])))
    return out


def suffix_rows(df, **options):
    found = suffix_dedup.remove_repeats(df, **options)
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect())


def test_suffix_dedup(table):
    rows = texts_of(table)
    distinct = sorted({(NO_ID if i is None else i, t or "", t is None) for i, t in rows})
    found = dict(zip(distinct, without_repeats([(i, t.encode()) for i, t, _ in distinct], 100)))
    want = collections.Counter((i, *found[(NO_ID if i is None else i, t or "", t is None)][1:]) for i, t in rows)
    assert suffix_rows(table, slices=1) == want


def test_suffix_dedup_of_repeated_ids(odd):
    """A row that is there twice is one text: it loses nothing to itself."""
    found = suffix_dedup.remove_repeats(odd, slices=1).where("doc_id = 6")
    assert [r.n_removed for r in found.collect()] == [0, 0]


@pytest.mark.parametrize("crowded", [2, 10_000])
def test_suffix_dedup_of_random_passages(spark, crowded):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(12)] + ["=" * 300, "-+" * 90]
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        a, b = rng.choice(passages), rng.choice(passages)
        cut = rng.randrange(len(a))
        texts.append(parts[0] + a[cut:] + parts[1] + b + parts[2] + (b if rng.random() < 0.2 else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = collections.Counter(without_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100))
    assert suffix_rows(df, slices=1, crowded=crowded) == want


def test_suffix_dedup_of_a_repeat_that_comes_again(spark):
    """A text holds, several times in a row, what an earlier text has too."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared = some(70)
    texts = [some(30) + shared, some(20) + shared * 3 + some(3), shared[100:] + shared * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_rows(df) == collections.Counter(without_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100))


def test_a_run_may_go_on_in_the_next_range():
    """The last run of a range of names is not the last of a task, whose rows of other kinds come after it."""
    columns = {"kind": [0, 0, 0, 2, 2, 4], "a": [5, 6, 7, 1 << 33, 2 << 33, 1 << 33], "b": [1 << 33, 2 << 33, 3 << 33, 0, 0, 0], "prefix": [1, 2, 3, 4, 5, 6], "least": [1] * 6, "rows": [1] * 6}
    (found,) = suffix_dedup._classes([suffix_dedup._arrow({k: np.array(v) for k, v in columns.items()})])
    several = dict(zip(found["prefix"].to_pylist(), found["several"].to_pylist()))
    assert (several[1], several[2], several[3]) == (1, 0, 1)


def test_classes_are_what_finds_repeats(spark, monkeypatch):
    """Without the classes of equal prefixes nothing that a text shares with another is found. (The order of the suffixes is not tested by this.)"""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    shared = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(60)) + f" {k} " + shared + f" {k} " + " ".join(word() for _ in range(60)) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = collections.Counter(without_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100))
    assert sum(r[2] * n for r, n in want.items()) >= 19 * len(shared)
    assert suffix_rows(df) == want
    monkeypatch.setattr(suffix_dedup, "_classes", lambda batches: iter(()))
    assert sum(r[2] for r in suffix_rows(df)) == 0


def stretches_of(spark, symbols):
    rows = [(k << 20, np.array(own, np.int64).tobytes(), np.arange(len(own), dtype=np.int64).tobytes()) for k, own in enumerate(symbols)]
    return spark.createDataFrame(rows, "stretch long, symbols binary, prefixes binary").repartition(3)


def test_names_are_the_order_of_suffixes(spark):
    """To the end, however long a repeat is; equal suffixes have one name."""
    rng = random.Random(7)
    long = [rng.randrange(1, 4) << 33 for _ in range(150)]
    symbols = [[rng.randrange(1, 4) << 33 for _ in range(rng.randrange(0, 30))] + rng.choice([[], long, long[:140], [1 << 33] * 90]) for _ in range(40)]
    names = suffix_dedup._sample(stretches_of(spark, symbols))
    found = {}
    for r in names.collect():
        own = symbols[r.stretch >> 20]
        sample = [k for k in range(len(own)) if k % 3]
        assert len(r.names) == 8 * len(sample) and not any(r.live)
        found |= {(r.stretch >> 20, k): n for k, n in zip(sample, np.frombuffer(r.names, "<i8").tolist())}
    assert len(found) == sum(len([k for k in range(len(x)) if k % 3]) for x in symbols)
    suffix = lambda at: symbols[at[0]][at[1] :]
    order = sorted(found, key=suffix)
    for a, b in zip(order, order[1:]):
        assert (found[a] == found[b]) if suffix(a) == suffix(b) else (found[a] < found[b])


def test_names_of_a_heavy_passage(spark, monkeypatch):
    """A passage of all stretches, each going on in its own way: no task has more than twice the mean."""
    rng = random.Random(9)
    passage = [(k + 1) << 33 for k in range(12)]
    symbols = [[rng.getrandbits(62)] + passage + [rng.getrandbits(62) for _ in range(4)] for _ in range(3000)]
    hashed = stretches_of(spark, symbols)
    triples = hashed.mapInArrow(suffix_dedup._first_triples, suffix_dedup._TRIPLE)
    monkeypatch.setattr(suffix_dedup, "RANGE", 100)
    ranked = suffix_dedup._ranked(triples)
    per_task = [r["count"] for r in ranked.groupBy("part").count().collect()]
    assert max(per_task) < 2 * sum(per_task) / 4
    names, heavy = suffix_dedup._sample(hashed), suffix_dedup._heavy(hashed)
    bounds = suffix_dedup._bounds(names)
    assert heavy.tolist() == [x >> 32 for x in passage]
    joined = hashed.join(names.select("stretch", "names"), "stretch", "left")
    orders = joined.mapInArrow(lambda b: suffix_dedup._orders(b, heavy, bounds, 4), suffix_dedup._ORDER).where("kind % 2 > 0")
    assert max(r["count"] for r in orders.groupBy("kind", "part").count().collect()) < 2 * orders.count() / 12


@pytest.mark.parametrize("where, crowded", [("end", 200), ("middle", 10_000), ("middle", 200)])
def test_suffix_dedup_of_a_passage_of_all_documents(spark, where, crowded):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(20)) + " " + passage + (" " + " ".join(word() for _ in range(20)) if where == "middle" else "") for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = collections.Counter(without_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100))
    assert suffix_rows(df, crowded=crowded) == want


def test_suffix_dedup_by_slices(odd):
    """A filter that isn't broadcast finds the same."""
    assert suffix_rows(odd, slices=3, most=2) == suffix_rows(odd)


def test_suffix_dedup_of_long_texts(spark):
    """Five million characters: one text that repeats itself, and one that shares a part of it."""
    rng = random.Random(4)
    a = " ".join(f"{rng.getrandbits(36):x}" for _ in range(250_000))
    rows = [(1, a + a[: len(a) // 2]), (2, "x" * 300_000), (3, a[1000:2000] + "new")]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_removed == len(a) // 2 and [tuple(s) for s in found[1].spans] == [(len(a), len(a) + len(a) // 2)]
    assert found[2].n_removed == 300_000 - 1 and bytes(found[3].kept) == b"new"


def test_phrases_depend_on_their_text_alone(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bc", "def", "ghij"]) for _ in range(n)).encode() for n in (900, 0, 20, 45, 400)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = suffix_dedup.phrases_of(data, offsets)
    for chunk in (211, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        for k, text in enumerate(texts):
            alone = suffix_dedup.phrases_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            own = whole[0] == k
            assert own.sum() == len(alone[0]) and (len(text) < 100 or own.any())
            for x, y in zip(whole[1:4], alone[1:4]):
                assert (x[own] - offsets[k] == y).all()
            assert (whole[4][own] == alone[4]).all()


# 3

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_of(text, items, window=10):
    own = WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        grams = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(own) - n + 1 if n else 0):
            if tuple(own[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(name)
    return own, hit, found


def test_decontaminate(table, spark, sf):
    extra = [("0", "quick brown fox"), ("1", "the Lazy dog and then"), ("2", ""), ("3", None), ("4", "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16"), (None, "lazy dog"), ("5", "the quick brown fox jumps over the lazy dog and then runs")]
    items = spark.createDataFrame(extra, "item_id string, text string").union(spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("cast(item_id + 100 as string)", "text"))
    listed = [(r.item_id, WORD.findall(ascii_lower(r.text or ""))) for r in items.collect()]
    want = collections.Counter()
    for i, t in texts_of(table):
        own, hit, found = contamination_of(t, listed)
        want[(i, len(own), len(hit), ",".join(sorted(x for x in found if x is not None)))] += 1
    for block in (30, 500_000):  # many automata, and one
        found = decontaminate.contamination(table, items, block=block)
        n_words, n_hit, names = found.columns[len(table.columns) : len(table.columns) + 3]
        assert bag(found.select("doc_id", n_words, n_hit, F.array_join(names, ","))) == want


def test_clean_cuts_passages(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, f"Before, {passage.title()}! after these many more words that are clean"), (2, passage), (3, "clean text"), (4, None)]
    found = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "Before, ! after these many more words that are clean"), (3, "clean text"), (4, None)]


# 4


@functools.lru_cache
def library(name):
    """A tokenizer of the tests' own."""
    return Tokenizer.from_file(tokens.vocabulary(name))


def encoded(name, text, end):
    tokenizer = library(name)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_store_round_trip(table, spark):
    folder = token_store.store_folder(spark)
    token_store.write_store(table, folder)
    assert token_store.verify_manifest(spark, folder).isEmpty()
    found = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    want = [(NO_ID if i is None else i, encoded("word_bpe_49k.json", t, 2).tobytes()) for i, t in texts_of(table)]
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == sorted(want)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()[: len(found)]
    assert spark.read.parquet(f"{folder}/chunks").groupBy("address").count().where("count > 1").isEmpty()
    sums = collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, folder).collect())
    assert sums == collections.Counter((None if r.doc_id == NO_ID else r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found)


def test_token_store_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string")
    folder = f"file://{tmp_path}/s"
    token_store.write_store(df, folder)
    other = token_store.pack_ids(np.array([1, 2, 3], np.uint32))
    damaged = spark.read.parquet(f"{folder}/chunks").withColumn("ids", F.lit(bytearray(other)))
    damaged.write.parquet(f"{folder}/new")
    spark.read.parquet(f"{folder}/new").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="does not agree"):
        token_store.read_store(spark, folder).collect()
    spark.read.parquet(f"{folder}/recipes").withColumn("root", F.lit(bytearray(b"x"))).write.mode("append").parquet(f"{folder}/recipes")
    assert not token_store.verify_manifest(spark, folder).isEmpty()


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50000, 60000).astype("<u4")
    b = np.concatenate([rng.integers(0, 50000, 777).astype("<u4"), a])
    parts = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    assert len(parts(a) & parts(b)) > 0.8 * len(parts(a))
    for n in (1, 255, 256, 257, 40000):
        assert token_store.cuts(np.zeros(n, "<u4"))[-1] == n


def test_prefix_sums(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(6)
    got = prefix_sums(df, ["id"], "v", "before").orderBy("id").collect()
    assert [r.before for r in got] == np.concatenate([[0], np.cumsum([r.v for r in got])[:-1]]).tolist()


SPECIAL = [
    f"{a}{x}{b}"
    for x in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|><|endoftext|>")
    for a, b in (("", ""), ("end of page ", " next"), ("glued", "word"), ("two  ", "  blanks"), ("line\n", "\n\nline two"), ("Größe, ", "."), (" ", " "))
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens(spark, name):
    """Literals of special tokens, against a tokenizer of the test's own."""
    fresh = library(name)
    want = {t: fresh.encode(t, add_special_tokens=False) for t in SPECIAL}
    assert max(want[SPECIAL[0]].ids) == max(fresh.get_added_tokens_decoder()) and len(want[SPECIAL[0]].ids) == 1
    for t in SPECIAL:
        assert np.frombuffer(tokens.encoder(tokens.vocabulary(name)).encode(t), "<u4").tolist() == want[t].ids
    table = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    found = {r.doc_id: r for r in packing.pack(table, path=tokens.vocabulary(name), end_id=0).collect()}
    for k, t in enumerate(SPECIAL):
        assert found[k].ids_crc32 == zlib.crc32(np.array([*want[t].ids, 0], "<u4").tobytes())
    counts = collections.Counter()
    for r in token_counts.count_sections(table, path=tokens.vocabulary(name)).collect():
        counts[(r.doc_id, r.section)] = r.n_tokens
    for k, t in enumerate(SPECIAL):
        starts = [0, *(m.end() for m in re.finditer("\n", t) if m.end() < len(t))]
        own = collections.Counter(bisect.bisect_right(starts, s) - 1 for s, _ in want[t].offsets)
        assert [counts[(k, s)] for s in range(len(starts))] == [own[s] for s in range(len(starts))]


def test_token_store_of_special_tokens(spark):
    fresh = library("word_bpe_49k.json")
    folder = token_store.store_folder(spark)
    token_store.write_store(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string"), folder)
    found = {r.doc_id: bytes(r.ids) for r in token_store.read_store(spark, folder).collect()}
    assert found == {k: np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in enumerate(SPECIAL)}


ODD = ["a", "B", "é", "İ", "ß", "ﬁ", "ǅ", "Σ", "日", "ก็", "e\u0301", "\u0307", "1", "²", "½", "_", "-", ".", ",", "'", "'s", "'LL", "!", "…", "—", "“", "€", "🙂", "\u200b", "\u200d", "\xa0", "\u3000", "\u2028", "\x85", "\x1c", "\x00", " ", " ", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", "the", "Word", "İ_", "<|endoftext|>", "<|", "|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_odd_texts(name, monkeypatch):
    """Random strings of odd characters, against the library; with memos that are cleared all the time, too."""
    rng, own = random.Random(9), tokens.Encoder(tokens.vocabulary(name))
    small = tokens.Encoder(tokens.vocabulary(name))
    small.pieces.most = small.firsts.most = 2000
    texts = ["İ_ x", "İ_", "x İ. y", *("".join(rng.choice(ODD) for _ in range(rng.randrange(1, 14))) for _ in range(20_000))]
    for text, want in zip(texts, library(name).encode_batch(texts, add_special_tokens=False)):
        ids = np.array(want.ids, "<u4").tobytes()
        assert own.encode(text) == ids and small.encode(text) == ids, repr(text)


def test_token_store_of_one_chunk_for_all(spark):
    """A chunk of all documents, null ids among them, is written once and read for each."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("the same words").alias("text"))
    folder = token_store.store_folder(spark)
    token_store.write_store(df, folder)
    assert spark.read.parquet(f"{folder}/chunks").count() == 1
    found = token_store.read_digests(spark, folder)
    assert found.count() == 3000 and found.where("doc_id is null").count() == 1000 and found.select("ids_crc32").distinct().count() == 1
    assert found.agg(F.max("start")).first()[0] == 2999 * found.first().n_tokens
    # Each task of the read has a share of the places.
    assert most_in_a_task(spark, token_store._parts(spark, folder)) < 2 * 3000 / 4


# 5


def measures_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(table):
    want = collections.Counter()
    for i, t in texts_of(table):
        m = measures_of(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    found = quality_rules.score_quality(table)
    assert bag(found.select("doc_id", *quality_rules.MEASURES, "base_failed")) == want
    votes = [c for c in found.columns if c.startswith("vote_")]
    rows = found.collect()
    judged = [r for r in rows if not r.base_failed]
    model = quality_rules.estimate(dict(collections.Counter(tuple(r[v] for v in votes) for r in judged))) if judged else quality_rules.start(len(votes))
    for r in rows:
        p = quality_rules.posterior_of(tuple(r[v] for v in votes), model)
        assert abs(p - r.posterior) < 1e-9 and r.kept == (not r.base_failed and p >= 0.5)


def test_quality_of_long_texts(spark):
    """Five million characters, with and without repeats."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.getrandbits(40):x}" for _ in range(420_000)), "some words that go on and on " * 170_000]
    found = quality_rules.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_repeat_words) for r in found] == [(420_000, 0), (1_190_000, 1_190_000)]


def test_quality_rules_beat_all_must_pass(spark):
    """Estimation moves verdicts, and agrees with labels better than the demand that no rule votes bad."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_rules.score_quality(docs)
    votes = [c for c in found.columns if c.startswith("vote_")]
    rows = found.join(labels, "doc_id", "left").where("not base_failed").collect()
    passed = [all(r[v] >= 0 for v in votes) for r in rows]
    first = quality_rules.start(len(votes))
    begun = [quality_rules.posterior_of(tuple(r[v] for v in votes), first) >= 0.5 for r in rows]
    kept = [r.kept for r in rows]
    assert sum(a != b for a, b in zip(kept, passed)) >= 0.005 * len(rows)
    assert sum(a != b for a, b in zip(kept, begun)) >= 0.02 * len(rows)
    right = lambda own: np.mean([k == (r.quality == 1) for k, r in zip(own, rows) if r.quality is not None])
    assert right(kept) > 0.97 and right(kept) > right(passed) and right(kept) > right(begun)


def test_estimation_finds_the_rates():
    """Votes drawn from known rates: one rule is often wrong about good documents, and estimation learns not to heed it alone."""
    rng = random.Random(8)
    off, on, wrong = (0.01, 0.04, 0.95), (0.9, 0.06, 0.04), (0.1, 0.05, 0.85)
    of_kind = [(wrong, off, off, off), (on, off, off, off), (wrong, on, off, off), (wrong, off, on, off), (wrong, off, off, on)]
    patterns = collections.Counter()
    for _ in range(20_000):
        kind = rng.choices(range(5), (0.8, 0.05, 0.05, 0.05, 0.05))[0]
        patterns[tuple(rng.choices((-1, 0, 1), p)[0] for p in of_kind[kind])] += 1
    shares, rates = quality_rules.estimate(patterns)
    assert abs(shares[0] - 0.8) < 0.05 and abs(rates[0][0][0] - 0.1 / 0.95) < 0.03
    verdict = lambda *votes: quality_rules.posterior_of(votes, (shares, rates)) > 0.5
    assert verdict(-1, 1, 1, 1) and verdict(1, 1, 1, 1) and not verdict(-1, -1, 1, 1) and not verdict(1, -1, 1, 1) and not verdict(1, 1, -1, 1)
    # Abstentions say nothing: a document without a vote has the share of good ones, and they move no rate.
    assert abs(quality_rules.posterior_of((0, 0, 0, 0), (shares, rates)) - shares[0]) < 1e-9 and all(abs(sum(r) - 1) < 1e-9 for own in rates for r in own)


def test_filter_keeps_columns(odd, docs):
    """Rows that pass stay as they are; what has no word, or few, goes."""
    found = quality_rules.filter_quality(odd)
    assert found.columns == odd.columns and found.where("text is null or length(text) < 50").isEmpty()
    more = docs.selectExpr("*", "'clash' as kept", "'clash' as kept_id", "'clash' as posterior")
    kept = quality_rules.filter_quality(more)
    assert kept.columns == more.columns and 0 < kept.count() < more.count() and kept.exceptAll(more).isEmpty()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.score_quality(docs).where("kept").collect()}


# 6


def test_language_id(docs):
    held_out = language_id.in_fold(F.col("doc_id"), 5, 0)
    learned = language_id.profiles(docs.where(~held_out))
    rows = language_id.predict(docs.where(held_out), learned).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_vectors_equal_their_definition(docs):
    text = docs.where("length(text) < 400").first().text
    d = 64
    chars = [32] + [ord(c.lower()[0]) if c.isalpha() else 32 for c in text] + [32]
    chars = [c for k, c in enumerate(chars) if not k or c != 32 or chars[k - 1] != 32]
    want = sum(np.roll(language_id.letter(a, d), 2).astype(int) * np.roll(language_id.letter(b, d), 1) * language_id.letter(c, d) for a, b, c in zip(chars, chars[1:], chars[2:]))
    assert (next(language_id.bundles([text], d)) == want).all()


def test_language_id_of_odd_rows(odd, empty):
    learned = language_id.profiles(odd)
    assert set(learned) == {"en", "fr"}
    for r in language_id.predict(odd, learned, score="cosine").collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.profiles(empty) == {} and language_id.predict(empty, {}).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, {}, score="cosine").collect()} == {"und"}


def test_language_id_of_clashing_names(odd):
    """Added columns get other names, and the given ones stay."""
    found = language_id.predict(odd.withColumn("lang_pred", F.lit("mine")), language_id.profiles(odd))
    assert found.columns[-2:] == ["lang_pred_", "score_"]
    assert {(r.lang_pred, r.score) for r in found.collect()} == {("mine", "clash")}


def test_prototypes_without_ones_own(spark):
    """A document is judged by the other folds' documents: what nothing else is like scores nothing like itself."""
    rows = [(k, f"plain words number {k} in this language", "en") for k in range(40)] + [(100, "жжж ффф щщщ ююю", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("f", language_id.fold_of(F.col("doc_id"), 5).cast("int"))
    sums = language_id.fold_profiles(df, F.col("f"))
    found = language_id.predict(df, language_id.without_own(sums, 5), fold="f")
    scores = {r.doc_id: r.score for r in found.collect()}
    assert scores[100] < language_id.MIN_SCORE < min(v for k, v in scores.items() if k < 100)
    whole = language_id.profiles(df)["en"]
    assert np.allclose(whole, sum(v for (_, f), v in sums.items()))


def test_many_languages_leave_tasks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 3)
    df = spark.createDataFrame([(f"text of language {k % 11}", f"l{k % 11}") for k in range(50)], "text string, lang string").coalesce(1)
    assert len(language_id.profiles(df)) == 11
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="languages"):
        language_id.profiles(df)


# 7


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(table, rule):
    tokenizer = library("byte_bpe_50k.json")
    want = collections.Counter()
    for i, t in texts_of(table):
        lines = re.findall(r"[^\n]*\n|[^\n]+$", t or "") or [""]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist()
        counts, crossing = [0] * len(lines), [0] * len(lines)
        for s, e in tokenizer.encode(t or "", add_special_tokens=False).offsets:
            parts = [min(e, b) - max(s, a) for a, b in zip(bounds, bounds[1:])]
            inside = [k for k, p in enumerate(parts) if p > 0] or [max(k for k, a in enumerate(bounds[:-1]) if a <= s)]
            own = {"start": inside[0], "end": inside[-1], "most": max(inside, key=lambda k: parts[k])}[rule]
            counts[own] += 1
            crossing[own] += len(inside) > 1
        for k, line in enumerate(lines):
            want[(i, k, bounds[k], bounds[k + 1], counts[k], crossing[k])] += 1
    assert bag(token_counts.count_sections(table, rule=rule)) == want


def test_token_counts_of_fields(spark):
    """Fields are one text; a token across their border goes by the rule."""
    tokenizer = library("byte_bpe_50k.json")
    rows = [(1, "Title", "and text"), (2, None, "日本語 only"), (3, "a ", None), (None, "x", "y"), (None, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, title string, section string")
    for separator, rule in (("\n\n", "start"), (" ", "end"), ("", "most")):
        want = collections.Counter()
        for i, a, b in rows:
            a, b = (a or "") + separator, b or ""
            counts, crossing = [0, 0], [0, 0]
            for s, e in tokenizer.encode(a + b, add_special_tokens=False).offsets:
                first, last = s >= len(a), max(s, e - 1) >= len(a)
                own = {"start": first, "end": last, "most": first if first == last else len(a) - s < e - len(a)}[rule]
                counts[own] += 1
                crossing[own] += first != last
            want[(i, "title", 0, len(a), counts[0], crossing[0])] += 1
            want[(i, "section", len(a), len(a + b), counts[1], crossing[1])] += 1
        found = token_counts.count_fields(df, ["title", "section"], separator=separator, rule=rule)
        assert found.columns == ["doc_id", "field", "start", "end", "n_tokens", "n_crossing"]
        assert bag(found) == want


def test_headings():
    assert token_counts.headings("a\n# b\nc\n#d").tolist() == [0, 2, 8, 10] and token_counts.headings("").tolist() == [0, 0]


def test_spans_of_odd_texts():
    """Of random strings, against the library's offsets."""
    rng, spans = random.Random(10), token_counts.Spans(tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")))
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 20))) for _ in range(10_000)]
    for text, want in zip(texts, library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)):
        assert list(zip(*(x.tolist() for x in spans.of(text)))) == want.offsets, repr(text)


# 8


def test_packing(table):
    rows = packing.pack(table).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    want = collections.Counter()
    for i, t in texts_of(table):
        ids = encoded("byte_bpe_50k.json", t, 0)
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.SIZE)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len(by_sequence) <= 1 + 1.02 * sum(r.length for r in rows) / packing.SIZE + len(rows) * 0.01


def best_fit(histogram, size):
    rooms, used = [], 0
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else size
        used += room == size
        if room > n:
            bisect.insort(rooms, room - n)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 10 ** rng.randrange(1, 4)) for _ in range(60)}
    runs = packing.plan(histogram, 100)
    placed = collections.Counter()
    for pattern, count in runs:
        assert sum(pattern) <= 100 and count > 0
        for n in pattern:
            placed[n] += count
    assert placed == histogram
    assert sum(c for _, c in runs) <= 1.03 * best_fit(histogram, 100) + 2


def test_pieces_of_one_length(spark):
    """All pieces are full, or equal: no task numbers more than twice its share, and every place is taken once."""
    df = spark.range(6000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    found = spark.createDataFrame([(None, 0, 0, 7, 1, k) for k in range(6000)], packing._PIECES.replace("doc_id long", "doc_id long") + ", row long")
    numbered = packing.numbered(found, {7: 6000}, part=100)
    assert sorted(r.k for r in numbered.select("k").collect()) == list(range(6000))
    assert most_in_a_task(spark, numbered) < 2 * 6000 / 4
    rows = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 6000


def test_packing_of_a_long_text(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.getrandbits(30):x}" for _ in range(200_000))
    rows = sorted(packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.piece))
    ids = encoded("byte_bpe_50k.json", text, 0)
    own = [r for r in rows if r.doc_id == 1]
    assert sum(r.length for r in own) == len(ids) and all(r.length == packing.SIZE for r in own[1:])
    assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]


# 9


def test_quality_model(docs, spark):
    """Held-out rows alone, at sf0.01; without the pairs it does worse."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held_out = language_id.in_fold(F.col("doc_id"), 4, 2)
    model = quality_model.learn(docs, labels.where(~held_out))
    rows = quality_model.score(docs.where(held_out), model).join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.9

    def order(own):
        good, bad = ([x for x, r in zip(own, rows) if r.quality == q] for q in (1, 0))
        return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])

    alone = quality_model.Machine(model.bias, model.weights, np.zeros_like(model.vectors))
    without = [alone.score(*quality_model.inputs(r.text.encode() if r.text is not None else None)) for r in rows]
    assert order([r.score for r in rows]) > max(0.97, order(without))


def test_scores_equal_their_definition(odd):
    """Every pair of inputs, one after another."""
    rng = np.random.default_rng(5)
    size = quality_model.SIZE
    model = quality_model.Machine(0.2, rng.normal(0, 0.1, size).astype(np.float32), rng.normal(0, 0.1, (size, 3)).astype(np.float32))
    for r in quality_model.score(odd.where("length(text) < 300 or text is null"), model).collect():
        text = (r.text or "").encode()
        x = np.zeros(size)
        words = text.split()
        for k, own in enumerate(([w.strip(quality_model._STRIP).lower() for w in words], words)):
            counts = collections.Counter(zlib.crc32(w) % quality_model.BUCKETS for w in own)
            length = sum(n * n for n in counts.values()) ** 0.5
            for at, n in counts.items():
                x[k * quality_model.BUCKETS + at] = n / length
        x[2 * quality_model.BUCKETS :] = quality_model.measures(text, words)
        there = np.flatnonzero(x).tolist()
        pairs = sum(float(model.vectors[i] @ model.vectors[j]) * x[i] * x[j] for i in there for j in there if i < j)
        want = 1 / (1 + np.exp(-(0.2 + float(model.weights @ x) + pairs)))
        assert r.score == "clash" and abs(r.score_ - want) < 1e-3


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    model = quality_model.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.arange(7) * 3, rng.normal(size=7)
    pairs = sum(model.vectors[at[i]] @ model.vectors[at[j]] * x[i] * x[j] for i in range(7) for j in range(i))
    assert abs(model.margin(at, x) - (0.3 + model.weights[at] @ x + pairs)) < 1e-9


def test_quality_model_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (12, None), (3, 1)], "doc_id long, quality int")
    found = quality_model.score(odd, quality_model.learn(odd, labels), out="p").collect()
    assert len(found) == odd.count() and all(0 <= r.p <= 1 for r in found)
    none = quality_model.learn(odd, labels.limit(0))
    assert {r.p for r in quality_model.score(odd, none, out="p").collect()} == {0.5}
    assert quality_model.score(empty, none).count() == 0


def test_fit_and_score_have_the_same_inputs(spark):
    """A text of 10,000 different words is fitted as it is scored; ids that repeat give one text; two fits agree; entries bound the rows."""
    long = " ".join(f"w{k}x" for k in range(10_000))
    docs = spark.createDataFrame([(1, long), (2, "short words"), (3, None), (4, "one"), (4, "other"), (5, "not labelled")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: (np.frombuffer(bytes(r.at), np.int32), np.frombuffer(bytes(r.x), np.float32), r.y) for r in quality_model.labelled(docs, labels).collect()}
    least = min(("one", "other"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for i, t, y in ((1, long, 1), (2, "short words", 0), (3, None, 0), (4, least, 1)):
        at, x = quality_model.inputs(t.encode() if t else None)
        assert np.array_equal(rows[i][0], at) and np.array_equal(rows[i][1], x) and rows[i][2] == y
    assert len(rows) == 4 and len(rows[1][0]) > 15_000
    a, b = quality_model.learn(docs, labels), quality_model.learn(docs.repartition(5), labels.repartition(2))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights) and np.array_equal(a.vectors, b.vectors)
    few = quality_model.learn(docs, labels, entries=10)
    assert not np.array_equal(few.weights, a.weights)


# 10


def fingerprint_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(points):
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(points)
    array = np.array(listed, np.uint64)
    for k, p in enumerate(listed):
        for m in np.flatnonzero(np.bitwise_count(array[:k] ^ array[k]) <= 3).tolist():
            a, b = find(p), find(listed[m])
            parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in listed}


def test_simhash(table):
    rows = texts_of(table)
    prints = {t: fingerprint_of(t) for _, t in rows}
    root = roots_of(set(prints.values()))
    least = {}
    for i, t in rows:
        r = root[prints[t]]
        least[r] = min(least.get(r, NO_ID), NO_ID if i is None else i)
    want = collections.Counter((i, f"{prints[t]:016x}", least[root[prints[t]]]) for i, t in rows)
    want = collections.Counter({(i, f, None if c == NO_ID else c): n for (i, f, c), n in want.items()})
    assert bag(simhash.near_duplicates(table)) == want


@pytest.mark.parametrize("cell", [3, 2048])
def test_links_of_crowded_cells(spark, cell):
    """Fingerprints around a few centers: many in one cell, at distances up to 6."""
    rng = random.Random(2)
    points = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(120):
            x = center
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            points.add(x)
    points |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long").repartition(4)
    found = simhash.components(simhash.links(df, cell))
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.root].add(r.node % (1 << 64))
    want = collections.defaultdict(set)
    for p, r in roots_of(points).items():
        want[r].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_hub_of_links(spark):
    """A node of a third of all edges."""
    edges = [(0, k) for k in range(1, 4000)] + [(k, k + 1) for k in range(10_000, 14_000, 2)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(4000), 0), **{k: k - k % 2 for k in range(10_000, 14_000)}}


def test_keep_first(odd, empty):
    found = simhash.keep_first(odd)
    assert found.columns == odd.columns
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert 0 in ids and 7 not in ids and ids.count(6) == 2
    assert simhash.keep_first(empty).count() == 0


def test_keep_first_of_rows_without_ids(spark):
    """Each row without an id, or with another's id, is judged by its own text."""
    rng = random.Random(5)
    unlike = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60))
    a, b, c, d, e, f = (unlike() for _ in range(6))
    rows = [(1, a, "first"), (None, a, "copy"), (None, b, "own"), (None, c, "own"), (None, d, "x"), (None, d, "y"), (None, d, "z")]
    rows += [(5, e, "own"), (5, a, "copy"), (5, f, "own"), (6, b, "copy of none"), (7, e, "copy"), (7, e, "copy"), (8, f + " end", "copy"), (9, unlike(), "own"), (9, None, "empty"), (None, "", "empty")]
    found = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, what string")).collect()]
    assert simhash.fingerprint((f + " end").encode()) != 0
    near = np.bitwise_count(np.uint64(simhash.fingerprint(f.encode()) ^ simhash.fingerprint((f + " end").encode()))) <= 3
    kept = collections.Counter((i, t) for i, t, _ in found)
    want = collections.Counter([(1, a), (None, c), (None, d), (5, e), (5, f), (6, b), (9, rows[14][1]), (9, None)] + ([] if near else [(8, f + " end")]))
    assert kept == want


def test_keep_first_of_heavy_rows_without_ids(spark):
    """A third of the rows has no id, and one text is heavy."""
    rows = [(None if k % 3 == 0 else k, f"text number{k} of{k} its{k} own{k} words{k}" if k % 2 else "the same words in every one") for k in range(3000)]
    found = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = collections.Counter(tuple(r) for r in found.collect())
    prints = {t: fingerprint_of(t) for _, t in rows}
    root = roots_of(set(prints.values()))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[root[prints[t]]].append((NO_ID if i is None else i, t))
    assert sum(kept.values()) == len(groups)
    for (i, t), n in kept.items():
        assert n == 1 and (NO_ID if i is None else i) == min(x for x, _ in groups[root[prints[t]]])


def test_join_counted(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    assert bag(join_counted(left, right, "key", "n").select("v", "top")) == bag(left.join(right, "key").select("v", "top"))


# SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, duck, name):
    from tools import rows

    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())
