"""Every operator on very long texts: what it gives is what it gives for short ones."""

import collections
import random
import zlib

import numpy as np
import pytest
from llm_tools import texts_of
from pyspark.sql import functions as F
from test_operators import WORD, contamination_of, encoded, fingerprint_of

from doclake.llm import collocations, decontaminate, filter_audit, language_id, line_dedup, quality_model, simhash, token_counts, token_store, warc


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of two million characters, the second with parts of the first, and short ones."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) for _ in range(4000)]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 20)))
    lines = [line() for _ in range(35_000)]
    second = [*(line() for _ in range(20_000)), *lines[100:15_000]]
    rows = [(1, "\n".join(lines), "en"), (2, "\n".join(second), "en"), (3, "short text\n" + lines[5], "fr"), (4, None, "fr"), (5, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def test_lines(long):
    rows = dict(texts_of(long))
    where = collections.defaultdict(set)
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(x) >= 10:
                where[x].add(i)
    for r in line_dedup.dedup_lines(long).collect():
        own = (rows[r.doc_id] or "").split("\n")
        kept = [x for x in own if len(where[x]) < 2 or min(where[x]) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text or "") == (len(own), len(own) - len(kept), "\n".join(kept))


def test_items_at_the_end(spark, long):
    text = dict(texts_of(long))[1]
    items = [("a", " ".join(text.split()[-10:])), ("b", " ".join(text.split()[150_000:150_030])), ("c", "not there at all")]
    found = {r.doc_id: r for r in decontaminate.contamination(long, spark.createDataFrame(items, "item_id string, text string")).collect()}
    own, hit, names = contamination_of(text, [(n, WORD.findall(t)) for n, t in items])
    assert (found[1].n_words, found[1].n_hit, sorted(found[1]["items"])) == (len(own), len(hit), sorted(names)) and {"a", "b"} <= names
    assert found[4].n_words == 0


def test_tokens(spark, long):
    rows = {i: encoded("word_bpe_49k.json", t, 2) for i, t in texts_of(long)}
    folder = token_store.store_folder(spark)
    token_store.write_store(long, folder)
    got = {r.doc_id: r for r in token_store.read_digests(spark, folder).collect()}
    assert all((got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) for i, ids in rows.items())
    counted = token_counts.count_sections(long).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("sections")).collect()
    texts = dict(texts_of(long))
    assert {r.doc_id: r.sections for r in counted} == {i: len((t or "").split("\n")) for i, t in texts.items()}
    assert all(r.n > 100_000 for r in counted if r.doc_id in (1, 2)) and {r.n for r in counted if r.doc_id > 3} == {0}


def test_languages_and_scores(spark, long):
    learned = language_id.profiles(long)
    found = {r.doc_id: r for r in language_id.predict(long.select("doc_id", "text"), learned).collect()}
    assert found[1].lang_pred == found[2].lang_pred == "en" and found[1].score > 0.5 and found[4].lang_pred == language_id.UNKNOWN
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_model.score(long, quality_model.learn(long, labels)).collect()}
    assert scores[1] > 0.5 > scores[3] and all(0 <= s <= 1 for s in scores.values()) and len(scores) == 5


def test_fingerprints(long):
    rows = dict(texts_of(long))
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(long).collect()} == {i: fingerprint_of(t) for i, t in rows.items()}


def test_payloads_and_phrases(spark, long, tmp_path):
    pages = long.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    warc.write_warc(pages, f"{tmp_path}/w", block=1000)
    rows = dict(texts_of(long))
    got = {r.page_id: r.payload for r in warc.whole(warc.read_warc(spark, f"{tmp_path}/w")).collect()}
    assert all(bytes(got[i]).decode() == (t or "") for i, t in rows.items())
    n = {r.lang: r.n for r in collocations.phrases(long)[1].collect()}
    assert n["en"] == sum(len(rows[i].split()) for i in (1, 2))
    assert filter_audit.patterns(long, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("n")).first()[0] == 5


def test_pipeline(spark, long, tmp_path):
    """All stages; of the second text stays what the first one doesn't have, and pieces hold all of its tokens."""
    import corpus_pipeline

    long.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = dict(texts_of(long))
    first = set(texts[1].split("\n"))
    kept = {1: texts[1], 2: "\n".join(x for x in texts[2].split("\n") if x not in first or len(x) < 10)}
    for i, t in kept.items():
        pieces = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == i)
        assert len(pieces) > 100 and sum(n for _, _, n in pieces) == len(encoded("byte_bpe_50k.json", t, 0))
        assert [s for _, s, _ in pieces] == np.cumsum([0, *(n for _, _, n in pieces[:-1])]).tolist()
