"""The registered queries: each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, filter_audit, language_id, line_dedup, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts, token_store, warc
from .common import given_id, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_store(spark, sf_dir):
    folder = token_store.store_folder(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), folder)
    if not token_store.verify_manifest(spark, folder).isEmpty():
        raise ValueError("recipe files do not agree with their manifest")
    return token_store.read_digests(spark, folder)


def op5_quality_rules(spark, sf_dir):
    found = quality_rules.score_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "posterior")


def quality_measures(spark, sf_dir):
    """What op5_quality_rules measures, without its verdicts: this part has SQL."""
    found = quality_rules.measures(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.MEASURES, quality_rules.base_failed().alias("base_failed"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.in_fold(F.col("doc_id"), 5, 0)
    learned = language_id.profiles(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), learned).select("doc_id", "held_out", "lang_pred", "score")


def op7_token_counts(spark, sf_dir):
    return token_counts.count_sections(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality_model(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = language_id.in_fold(F.col("doc_id"), 4, 2)
    model = quality_model.learn(docs, labels.where(~held_out))
    found = quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark, sf_dir):
    folder = warc.archive_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    found = stored(warc.read_warc(spark, folder, payloads=False), "records")
    if not warc.gaps(found).isEmpty():
        raise ValueError("the archive that was just written has damaged bytes")
    return warc.whole(found).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_suffix_dedup, op3_decontaminate, op4_token_store, op5_quality_rules, op6_language_id, op7_token_counts, op8_best_fit_packing, op9_quality_model, op10_simhash, op11_warc, op12_collocations, op13_filter_audit, quality_measures)
    return {f.__name__: f for f in own}


#: The line rule in SQL.
LINE_DEDUP = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
firsts as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
marked as (
  select l.*, f.first is not null and f.first <> l.doc_id as dropped from keyed l left join firsts f on l.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""

#: Windows of ten words, and whole shorter items, in SQL.
DECONTAMINATE = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from item_words where len(w) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from doc_words),
found as (
  select p.doc_id, p.i, s.n, v.item_id
  from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from places, sizes where i + n - 1 <= len(w)) p
  join sizes s on s.n = p.n join windows v on v.n = p.n and v.g = p.g),
hit as (select distinct doc_id, unnest(range(i, i + n)) as i from (select distinct doc_id, i, n from found)),
hits as (select doc_id, count(*) as n_hit from hit group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hits using (doc_id) left join items using (doc_id)
"""


#: The measures of the quality rules in SQL.
QUALITY_MEASURES = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
worded as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from worded where len(w) > 2)),
repeated as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from windows) where n > 1),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from repeated) group by doc_id),
lines as (select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from texts)
  where trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
again as (select doc_id, count(*) - count(distinct line) as n from lines group by doc_id),
measured as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(a.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from worded left join again a using (doc_id) left join covered c using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured
"""


#: Which pages revisit which, and the digests of their payloads.
WARC = """
with payloads as (select page_id, coalesce(html, '') as html from pages),
marked as (select *, case when strlen(html) >= 1000 then max(page_id) over (partition by html) else page_id end as target from payloads)
select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest, case when page_id = target then 'response' else 'revisit' end as record_type,
       case when page_id <> target then target end as refers_to
from marked
"""

#: Phrases of up to four words, counted as they stand.
COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
sizes as (select unnest([1, 2, 3, 4]) as m),
grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) as g from worded, sizes where len(w) >= m),
counted as (select lang, m, g, count(*)::bigint as f from grams group by all having count(*) >= 30),
candidates as (select lang, m, g, f as a from counted where m > 1),
cuts as (
  select c.lang, c.m, c.g, c.a, k, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, m)) as k from candidates) c
  join counted x on x.lang = c.lang and x.g = c.g[1 : c.k] join counted y on y.lang = c.lang and y.g = c.g[c.k + 1 : c.m]),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (
  select lang, unnest(list_transform(range(1, m - s + 2), lambda i: g[i : i + s - 1])) as g, a
  from (select *, unnest(range(2, m)) as s from candidates where m > 2)),
around as (select lang, g, max(a) as longer from inner_ group by lang, g),
kept as (
  select c.lang, array_to_string(c.g, ' ') as phrase, c.a, c.l, c.r, c.score from lowest c left join around o on o.lang = c.lang and o.g = c.g
  where o.longer is null or 100::hugeint * o.longer < 80::hugeint * c.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select k.lang, rank, phrase, a, l, r, t.n, score from ranked k join totals t on t.lang = k.lang where rank <= 2000
"""

#: All orders of five filters by their definition, document by document.
FILTER_AUDIT = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as first from texts),
marked as (
  select d.doc_id, part,
         (len(w) < 200)::int as a, (100 * len(list_distinct(w)) < 50 * len(w))::int as b,
         (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::int as c,
         regexp_matches(text, '[#$%&*|]')::int as d, (d.doc_id > first)::int as e,
         coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from worded d left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l on l.doc_id = d.doc_id),
grouped as (
  select part, a, b, c, d, e, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
fails as (
  select s.filter_order, s.step, g.part, g.n, g.good, g.toxic,
         case filter_order[step] when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end = 1 as own,
         (a = 1 and instr(filter_order[1 : step - 1], 'A') > 0) or (b = 1 and instr(filter_order[1 : step - 1], 'B') > 0) or (c = 1 and instr(filter_order[1 : step - 1], 'C') > 0)
           or (d = 1 and instr(filter_order[1 : step - 1], 'D') > 0) or (e = 1 and instr(filter_order[1 : step - 1], 'E') > 0) as earlier,
         a + b + c + d + e as failed
  from steps s cross join grouped g),
counted as (
  select part, filter_order, step, coalesce(sum(n) filter (not own and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (own and not earlier), 0)::bigint as removed,
         coalesce(sum(n) filter (own and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (own and failed = 1), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (own and not earlier), 0)::bigint as good_lost, coalesce(sum(toxic) filter (own and not earlier), 0)::bigint as toxic_lost
  from fails group by part, filter_order, step)
select *, sum(removed) over (partition by part, filter_order[step])::bigint as shapley from counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op3_decontaminate": DECONTAMINATE, "op11_warc": WARC, "op12_collocations": COLLOCATIONS, "op13_filter_audit": FILTER_AUDIT, "quality_measures": QUALITY_MEASURES}


__all__ = ["given_id", "oracle_sql", "queries"]
