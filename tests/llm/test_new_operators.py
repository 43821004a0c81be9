"""Operators 11 to 13 against plain Python."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclake.llm import collocations, filter_audit, warc
from doclake.llm.common import join_counted

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    """{(part, order, step): numbers}, document by document; docs: (id, text, part) in any order."""
    docs = [(2**63 - 1 if i is None else i, i, t or "", p or "") for i, t, p in docs]
    first = {}
    for i, _, t, _ in docs:
        first[t] = min(i, first.get(t, i))
    rows = {}
    for i, own, t, p in docs:
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first[t] < i}
        said = [x for x in labels if own is not None and x[0] == own]
        rows.setdefault(p, []).append(({f for f in fails if fails[f]}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for p, own in rows.items():
        total = Counter()
        for order in permutations("ABCDE"):
            kept = own
            for step, f in enumerate(order, 1):
                gone, gone_before = [x for x in kept if f in x[0]], [x for x in own if f in x[0] and x[0] & set(order[: step - 1])]
                kept = [x for x in kept if f not in x[0]]
                total[f] += len(gone)
                out[p, "".join(order), step] = [len(kept), len(gone), len(gone_before), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (q, order, step), numbers in out.items():
            if q == p:
                numbers.append(total[order[step - 1]])
    return out


def reported(df):
    found = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(out) == len(found)
    return out


def test_audit_of_odd_rows(spark, odd):
    labels = [(0, 1, 0), (6, 1, 1), (6, 0, 0), (7, None, 1), (10, 0, None), (None, 1, 1), (99, 1, 1)]
    rows = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    found = reported(filter_audit.audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == audited(rows, labels) and {p for p, _, _ in found} == {"", "en", "fr"} and len(found) == 3 * 600


def test_audit_of_random_texts(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab Ab $ word other # xé Zz".split(" ")) + str(rng.randrange(400)) * rng.randrange(2) for _ in range(rng.choice([3, 150, 199, 200, 201, 400]))) for _ in range(40)]
    docs = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice(base), rng.choice(["x", "y", None, ""])) for _ in range(200)]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 150, 2)]
    found = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert reported(found) == audited(docs, labels)


def test_audit_limits():
    """Just below, at and above each limit."""
    words = [f"w{k}" for k in range(200)]
    assert filter_audit.pattern(" ".join(words[:199]).encode(), 700) & 1 and not filter_audit.pattern(" ".join(words).encode(), 700) & 1
    twice = lambda n: (" ".join(words[:n]) + " " + " ".join("w0" for _ in range(200 - n))).encode()
    assert filter_audit.pattern(twice(99), 700) & 2 and not filter_audit.pattern(twice(100), 700) & 2
    assert not filter_audit.pattern(b"AAA" + b"x" * 97, 100) & 4 and filter_audit.pattern(b"AAAA" + b"x" * 96, 100) & 4
    assert not filter_audit.pattern(("Ä" * 4 + "x" * 96).encode(), 100) & 4
    assert filter_audit.pattern(b"", 0) == 1 and all(filter_audit.pattern(bytes([c]), 1) & 8 for c in b"#$%&*|")
    assert filter_audit.pattern("a b c".encode(), 5) == filter_audit.pattern(b"a", 1)


def test_shapley_by_least_squares_is_the_mean_over_orders():
    rng = random.Random(5)
    for players in (2, 3, 5):
        v = [0] + [rng.randrange(10**20) for _ in range((1 << players) - 1)]
        total = [0] * players
        for order in permutations(range(players)):
            at = 0
            for p in order:
                total[p] += v[at | 1 << p] - v[at]
                at |= 1 << p
        assert [x * factorial(players) for x in filter_audit.shapley(v, players)] == total


def test_audit_of_copies(spark):
    """A third of all rows are copies of one text; an id is repeated; the copies lie in several parts."""
    docs = [(k, "same text" if k % 3 == 0 else f"text {k}", ("x", "y")[k % 2]) for k in range(300)] + [(0, "same text", "x")] * 2
    found = reported(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found == audited(docs, []) and found["x", "EABCD", 1][1] == 49 and found["y", "EABCD", 1][1] == 50


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# WARC.


def archived(rows, least=1000):
    """[(page_id, payload_bytes, digest, type, refers_to)] of (page_id, html)."""
    out = []
    for i, html in rows:
        own = (html or "").encode()
        same = [j for j, h in rows if (h or "") == (html or "") and j is not None] if len(own) >= least else []
        target = max(same) if same and max(same) != i else None
        out.append((i, len(own), hashlib.sha1(own).hexdigest(), "response" if target is None else "revisit", target))
    return sorted(out, key=repr)


def read_back(spark, folder):
    found = warc.whole(warc.read_warc(spark, folder)).collect()
    return found, sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in found), key=repr)


ODD_PAGES = [(1, "x" * 1000), (2, "x" * 1000), (9, "x" * 1000), (9, "x" * 1000), (None, "x" * 1000), (3, "x" * 999), (4, "x" * 999), (5, None), (6, ""), (7, "é" * 500), (8, "é" * 500), (10, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 30), (None, "only nulls" * 200), (None, "only nulls" * 200), (11, "\x1f\x8b\x08 \u0000 \r\n\r\n" * 200), (12, "long " * 400_000)]


@pytest.mark.parametrize("gzipped", [True, False])
def test_warc_of_odd_rows(spark, tmp_path, gzipped):
    rows = [(i, ("http://a/b c\n", None, "")[k % 3], h, "clash", "clash") for k, (i, h) in enumerate(ODD_PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, target string").repartition(3)
    warc.write_warc(pages, f"{tmp_path}/w", gzipped=gzipped, block=5000, blocks=2)
    found, own = read_back(spark, f"{tmp_path}/w")
    assert own == archived(ODD_PAGES) and warc.gaps(warc.read_warc(spark, f"{tmp_path}/w")).isEmpty()
    text = {i: h or "" for i, h in ODD_PAGES}
    assert all(bytes(r.payload).decode() == text[r.page_id] for r in found if r.page_id is not None)
    assert {r.url for r in found if r.page_id == 1} == {"http://a/b%20c%0A"} and {r.url for r in found if r.page_id == 2} == {"urn:page:2"}


def test_warc_members_are_gzip(spark, tmp_path):
    """Other gzip readers read the files: members one after another, each record whole."""
    warc.write_warc(spark.createDataFrame([(k, "u", "text" * k) for k in range(50)], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 51 and data.endswith(b"\r\n\r\n")


def test_warc_of_nothing(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert read_back(spark, f"{tmp_path}/w") == ([], [])


def records_of(gzipped, n=40):
    rng = random.Random(n)
    made = [warc.page_record(k, f"u{k}", bytes(rng.choices(b"abc \r\n", k=rng.choice([0, 5, 300, 3000]))), b"k%d" % k, None) for k in range(n)]
    return [warc._member(r) for r in made] if gzipped else made


@pytest.mark.parametrize("gzipped", [True, False])
def test_salvage_of_damaged_files(gzipped):
    """Whatever bytes are changed, cut out or put in: records that weren't touched are read, gaps and records tile the file."""
    parts = records_of(gzipped)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    data, rng = b"".join(parts), random.Random(7)
    ids = lambda found: [int(x[3].fields.get("x-page-id", -1)) for x in found if x[0] == "record"]
    assert ids(warc.salvage(data)) == list(range(len(parts)))
    for _ in range(150):
        at, n = rng.randrange(len(data)), rng.choice([1, 2, 50, 5000])
        kind = rng.choice(["change", "cut", "put"])
        if kind == "change":
            broken = data[:at] + bytes(b ^ rng.randrange(1, 256) for b in data[at : at + n]) + data[at + n :]
        elif kind == "cut":
            broken = data[:at] + data[at + n :]
        else:
            broken = data[:at] + bytes(rng.randrange(256) for _ in range(n)) + data[at:]
        reach = at + (0 if kind == "put" else min(n, len(data) - at))
        touched = {k for k in range(len(parts)) if starts[k] < max(reach, at + 1) and starts[k + 1] > at}
        found = list(warc.salvage(broken))
        got = ids(found)
        assert set(range(len(parts))) - touched <= set(got)
        # What no digest covers, the header of a plain record, may change and leave it valid; all else that was touched is a gap.
        assert not gzipped or not touched & set(got) or broken[: len(data)] == data
        at_ = 0
        for kind_, start, stop, _ in found:
            assert start == at_ and stop > start
            at_ = stop
        assert at_ == len(broken)


def test_salvage_names_what_failed():
    good = warc.page_record(1, "u", b"payload " * 20, b"k", None)
    other = warc.page_record(2, "u", b"more", b"k", None)
    def reasons(data):
        return [x[1:] if x[0] == "gap" else x[3].fields["x-page-id"] for x in warc.salvage(data)]
    n = len(good)
    assert reasons(good.replace(b"payload", b"PAYLOAD") + other) == [(0, n, "digest"), "2"]
    assert reasons(good[:-30] + other) == [(0, n - 30, "length"), "2"]
    assert reasons(b"junk" + other) == [(0, 4, "version"), "2"]
    assert reasons(other + b"WARC/1.1\r\nno header") == ["2", (len(other), len(other) + 19, "header")]
    inside = warc._member(good.replace(b"payload", b"PAYLOAD") + other)
    assert reasons(inside) == [(0, n, "digest in member at 0"), "2"]
    cut = warc._member(good)[:-9]
    assert reasons(cut + other + warc._member(good)) == [(0, len(cut), "member"), "2", "1"]
    # A record in the payload of a damaged one, whose frame is whole, is not one of its own.
    nest = warc.page_record(3, "u", b"\r\n\r\n" + other, b"k", None)
    assert reasons(nest.replace(b"HTTP/1.1 200", b"HTTP/1.1 500") + other) == [(0, len(nest), "digest"), "2"]
    assert zlib.decompressobj(31).decompress(warc.NOTHING) == b"" and list(warc.salvage(warc.NOTHING)) == [] and list(warc.salvage(b"")) == []


def test_damaged_archive(spark, tmp_path):
    """Files that lost bytes: the rest is read, gaps are logged, a revisit whose response was lost keeps nulls."""
    rows = [(k, "u", f"page {k} " * 200 if k % 2 else "copies " * 300) for k in range(60)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w", block=4000, blocks=3)
    lost = set()
    for k, path in enumerate(sorted((tmp_path / "w").glob("part-*"))):
        data = bytearray(path.read_bytes())
        for kind, start, stop, what in list(warc.salvage(bytes(data))):
            if "x-page-id" in what.fields and int(what.fields["x-page-id"]) in (5, 21, 58):
                data[start + 40] ^= 255
                lost.add(int(what.fields["x-page-id"]))
        (tmp_path / "broken").mkdir(exist_ok=True)
        (tmp_path / "broken" / path.name).write_bytes(data)
    assert lost == {5, 21, 58}
    found = warc.read_warc(spark, f"{tmp_path}/broken")
    assert {r.page_id for r in found.where("kind = 'record'").collect()} == set(range(60)) - lost
    assert [r.reason for r in warc.gaps(found).collect()] == ["member"] * 3
    assert all(r.refers_to is None and r.payload is None for r in warc.whole(found).where("type = 'revisit'").collect())


def test_join_counted_with_very_many_heavy_keys(spark):
    """Tens of thousands of keys of over 1,000 rows and one of a third of all: at most 16 keys a partition are broadcast."""
    counts = spark.range(60_000).select(F.col("id").alias("key"), (F.when(F.col("id") == 7, 30_000_000).otherwise(1001)).alias("n"), (F.col("id") * 2).alias("value"))
    left = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 70_000).alias("key"), "id")
    found = join_counted(left, counts, "key", "n")
    key = lambda k: 7 if k % 3 == 0 else k % 70_000
    want = sorted((k, 2 * key(k)) for k in range(200_000) if key(k) < 60_000)
    assert sorted((r.id, r.value) for r in found.collect()) == want
    outer = join_counted(left, counts, "key", "n", "left")
    assert outer.count() == 200_000 and outer.where("value is null").count() == 200_000 - len(want)
    assert "Broadcast" in found._jdf.queryExecution().toString()


# Collocations.


def mined(docs, least, longest=4, top=2000, within=80, scale=2_000_000):
    """[(lang, rank, phrase, a, l, r, n, score)] by the definition."""
    counts, n = {}, Counter()
    for text, lang in docs:
        text, lang = (text or "").translate({c: c + 32 for c in range(65, 91)}), "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for k in range(len(w) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(w[k : k + size])] += 1
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            score, k = min((scale * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= within * a for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, k, p.decode(), -a, lo, r, n[lang], -score) for k, (score, a, p, lo, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrased(rng, n=120):
    """Texts of few words, so that phrases repeat, with every separator and odd words."""
    words = ["the", "The", "of", "a", "new", "york", "City", "É", "日本", "x-y", "\u00a0", "\x00b", "\x1c", "'s"] + [f"rare{k}" for k in range(60)]
    weights = [8, 3, 6, 6, 4, 4, 3, 2, 2, 2, 1, 1, 1, 1] + [0.1] * 60
    docs = []
    for k in range(n):
        own = rng.choices(words, weights, k=rng.choice([0, 3, 40, 200]))
        text = "".join(w + rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b", "; "]) for w in own)
        docs.append((text, ("en", "de", None, "")[k % 7 % 4]))
    return [*docs, (None, "en"), ("", None), ("new york city. " * 50, "en"), ("aa " * 3000, "en")]


@pytest.mark.parametrize("head_words,head_units", [(1 << 18, 1 << 20), (9, 12), (0, 0), (40, 0)])
def test_collocations_are_the_definition(spark, head_words, head_units):
    """With all words and units known by id, with few, and with none: the counts are the same."""
    docs = phrased(random.Random(11))
    df = spark.createDataFrame([(t, lang, "clash", "clash") for t, lang in docs], "text string, lang string, n string, phrase string").repartition(5)
    found = collocations.collocations(df, least=4, top=40, head_words=head_words, head_units=head_units)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(docs, 4, top=40)
    assert sorted(map(tuple, found.collect())) == want and {len(r[2].split(" ")) for r in want} == {2, 3, 4}


def test_collocations_tiles_and_flushes(spark, monkeypatch):
    """Crowded tiles in arrays and the rest as coordinates, in many small parts; most pairs lie in crowded tiles."""
    for name, value in (("FLUSH", 300), ("WORDS_HELD", 20)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(2)
    words = collocations.Words(pa.table({"lang": ["a"] * 300 + ["b"] * 200, "word": [b"w%d" % k for k in range(500)], "n": [10**6 // (k + 1) for k in range(300)] + [10**6 // (k + 1) for k in range(200)]}), None)
    monkeypatch.setattr(collocations, "FLUSH", 1 << 22)
    plan = collocations.Plan(words, words)
    assert 1 < plan.slots <= collocations.TILES
    pairs = np.array([rng.randrange(300) << collocations.WORD | rng.randrange(300) for _ in range(50_000)] + [(384 + rng.randrange(200)) << collocations.WORD | (384 + rng.randrange(200)) for _ in range(50_000)])
    cells, rest = plan.split(pairs)
    n = np.bincount(cells, minlength=plan.slots * collocations.CELLS)
    again = Counter(rest.tolist())
    for slot in range(plan.slots):
        keys = plan.keys(slot)
        again.update({k: c for k, c in zip(keys.tolist(), n[slot * collocations.CELLS : (slot + 1) * collocations.CELLS].tolist()) if c})
    assert again == Counter(pairs.tolist()) and len(cells) > 0 and len(rest) > 0
    monkeypatch.setattr(collocations, "FLUSH", 300)
    docs = phrased(random.Random(12))
    found = collocations.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), least=4)
    assert sorted(map(tuple, found.collect())) == mined(docs, 4)


def test_collocations_of_odd_rows(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == mined(rows, 2)
    assert collocations.collocations(empty).collect() == [] and collocations.collocations(odd.limit(3)).collect() == []


def test_collocation_products_do_not_overflow(spark):
    """Counts beyond what 64 bits hold times the scale."""
    score = spark.sql("select (cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(a as decimal(19, 0)) + cast(a as decimal(19, 0))) as s from values (9000000000000000000) as t(a)")
    assert score.first()[0] == 1_000_000
