"""The pipeline against plain Python, and on odd and empty tables."""

import collections
import random
import zlib

import numpy as np
import pytest
from llm_tools import texts_of
from test_operators import NO_ID, WHITE, WORD, ascii_lower, contamination_of, encoded, fingerprint_of, roots_of

from doclake.llm import decontaminate, language_id, packing

pipeline = pytest.importorskip("corpus_pipeline")


def plain(rows, items):
    """(doc_id, text) of what the first four stages keep."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    where = collections.defaultdict(set)
    key = lambda x: ascii_lower(x.strip(WHITE))
    for i, t in rows:
        for line in t.split("\n"):
            where[key(line)].add(i)
    rows = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(where[key(x)]) == i)) for i, t in rows]
    prints = {i: fingerprint_of(t) for i, t in rows}
    root = roots_of(set(prints.values()))
    first = {}
    for i, _ in rows:
        first.setdefault(root[prints[i]], i)
    rows = [(i, t) for i, t in rows if first[root[prints[i]]] == i]
    out = []
    for i, t in rows:
        own, hit, _ = contamination_of(t, items)
        if hit and len(hit) > decontaminate.MAX_COVERAGE * len(own):
            continue
        spans = [m.span() for m in WORD.finditer(ascii_lower(t))]
        drop = set()
        for k in hit:
            drop |= set(range(*spans[k]))
            if k + 1 in hit:
                drop |= set(range(spans[k][1], spans[k + 1][0]))
        out.append((i, "".join(c for p, c in enumerate(t) if p not in drop)))
    return out


def test_pipeline(docs, spark, sf):
    items = [(r.item_id, WORD.findall(ascii_lower(r.text or ""))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = collections.Counter()
    for i, t in plain(texts_of(docs), items):
        ids = encoded("byte_bpe_50k.json", t, packing.END_ID)
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.SIZE)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    rows = pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def cosine_of(text, prototypes):
    """The greatest cosine with a prototype, by the definition."""
    vector = vector_of(text)
    return max(float(vector @ p / np.linalg.norm(vector) / np.linalg.norm(p)) for p in prototypes)


def vector_of(text, d=language_id.DIMENSIONS):
    chars = [32] + [ord(c.lower()[0]) if c.isalpha() else 32 for c in text] + [32]
    chars = [c for k, c in enumerate(chars) if not k or c != 32 or chars[k - 1] != 32]
    runs = collections.Counter(zip(chars, chars[1:], chars[2:]))
    vectors = {c: np.random.Generator(np.random.PCG64([language_id.SEED, c])).integers(0, 2, d) * 2 - 1 for c in set(chars)}
    return sum(n * np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c] for (a, b, c), n in runs.items())


def test_noise_is_no_language(docs, spark, sf):
    """Foreign scripts and letter noise go, short clean texts stay."""
    rng = random.Random(3)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(n))
    scripts = [[chr(c) for c in range(a, b)] for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0xAC00, 0xB400), (0x4E00, 0x5A00))]
    planted = [noise(s, n) for s in scripts for n in (5, 50, 300) for _ in range(3)] + [noise("abcdefghijklmnopqrstuvwxyz", 30) for _ in range(12)]
    known = [(r.lang, r.text, r.doc_id) for r in docs.where("text is not null and lang is not null").collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % pipeline.FOLDS
    sums = [{} for _ in range(pipeline.FOLDS)]  # per fold, of the documents that aren't in it
    for lang, text, i in known:
        if any(c.isalpha() for c in text):
            vector = vector_of(text)
            for f in range(pipeline.FOLDS):
                if f != fold(i):
                    sums[f][lang] = sums[f].get(lang, 0) + vector
    short = [" ".join(t.split()[5:17]) for _, t, _ in known if len(t.split()) > 60][:40]
    rows = [(10**6 + k, t, None, "planted", len(t)) for k, t in enumerate(planted + short)]
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id for r in pipeline.known_language(spark, every, sf).where("source = 'planted'").collect()}
    scores = [cosine_of(t, list(sums[fold(i)].values())) for i, t, *_ in rows]
    floor = 4 / language_id.DIMENSIONS**0.5
    assert got == {i for (i, *_), s in zip(rows, scores) if s >= floor}
    foreign, latin = range(10**6, 10**6 + 36), range(10**6 + 36, 10**6 + 48)
    assert not got & set(foreign) and len(got & set(latin)) <= 2 and len(got - set(latin)) >= 0.9 * len(short)


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_stages_keep_columns(request, spark, sf, name):
    docs = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        found = stage(spark, docs, sf)
        if k + 1 < len(pipeline.STAGES):
            assert found.schema.simpleString() == docs.schema.simpleString()
        assert found.count() <= docs.count() or k + 1 == len(pipeline.STAGES)


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert NO_ID == 2**63 - 1
