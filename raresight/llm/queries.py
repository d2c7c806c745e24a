"""One registered query per operator, each over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from raresight.llm import collocations, hard_negatives, hilbert, html_crf, langid, line_dedup, mixing, packing, quality, secret_scan, simhash, topk, toxicity
from raresight.llm.common import table

K = 5
SHINGLE, DISTANCE = 4, 4


def is_query(key):
    return key % 50 == 0


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    parser = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), langid.identify(spark, parser, F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score")


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    kinds = [number(k).alias(f"n_{k}") for k in secret_scan.BASE]
    base = F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *kinds, base.alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf, "documents"), shingle=SHINGLE, distance=DISTANCE)
    return groups.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    model = html_crf.fit(pages)
    found = pages.select("page_id", "url", html_crf.main_text(spark, model, F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    found = docs.select("doc_id", toxicity.severity(spark, model, F.col("text")).alias("x"))
    return found.select("doc_id", "x.severity", "x.p_toxic", "x.grade", (F.col("x.p_toxic") >= toxicity.REJECT).alias("toxic"))


def op9_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk.sparse_rows(table(spark, sf, "embeddings"))
    return topk.search(rows.where(is_query(F.col("id"))), rows, K)


def op10_hilbert_ann(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.search(table(spark, sf, "embeddings"), is_query, K)


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), is_query, label=label)


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels").where(~quality.held_out(F.col("doc_id"))))
    found = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(spark, model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


MIXING_SQL = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('1|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 9))::bigint as h
  from documents),
src as (select source, sum(size)::bigint as source_size from docs group by source),
weighed as (
  select *, 3 * source_size as cap, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from src),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over w, 0))::double / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level,
         row_number() over (order by cap::double / weight, source nulls last) as k
  from weighed window w as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select arg_min(level, k) as level from filled where weight * level <= cap),
targets as (select source, source_size, case when weight * l.level > cap then cap::double else weight * l.level end as target from filled, level l),
parts as (
  select source, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
units as (
  select source, h, sum(size) as unit, sum(sum(size)) over (partition by source order by h) - sum(size) as before
  from docs group by source, h)
select d.doc_id, d.size, p.source_size, p.target,
       (least(p.whole::bigint + (2 * u.before + u.unit <= 2 * (p.target - p.whole * p.source_size))::int, 3) * d.size)::bigint as taken
from docs d join parts p on d.source is not distinct from p.source
join units u on u.source is not distinct from d.source and u.h = d.h
"""

TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

COLLOCATIONS_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from w, unnest(range(1, len(ws) + 1)) as a(i), (values (1), (2), (3), (4), (5)) as b(k) where i + k - 1 <= len(ws)),
f as materialized (select lang, phrase, k, count(*) as f from g group by all having count(*) >= 100),
inside as (
  select lang, f, array_to_string(string_split(phrase, ' ')[1:k - 1], ' ') as phrase from f where k > 2
  union select lang, f, array_to_string(string_split(phrase, ' ')[2:k], ' ') from f where k > 2),
cuts as (
  select f.lang, f.phrase, f.f as a, c as k, array_to_string(string_split(f.phrase, ' ')[1:c], ' ') as x, array_to_string(string_split(f.phrase, ' ')[c + 1:k], ' ') as y
  from f, unnest(range(1, k)) as t(c) where k > 1
  and not exists (select 1 from inside i where i.lang = f.lang and i.phrase = f.phrase and i.f = f.f)),
scored as (
  select c.lang, c.phrase, c.a, c.k, l.f as l, r.f as r, n.n, (1000 * c.a::hugeint * n.n::hugeint // (l.f::hugeint * r.f::hugeint))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.x join f r on r.lang = c.lang and r.phrase = c.y join n on n.lang = c.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score
from weakest qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select q.vec_id as anchor_id, c.vec_id as id, q.label = c.label as same, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify row_number() over w <= 3
"""

QUERIES = {
    "op1_line_dedup": (op1_line_dedup, None),
    "op2_language_id": (op2_language_id, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_simhash": (op4_simhash, None),
    "op5_html_text": (op5_html_text, None),
    "op6_mixing": (op6_mixing, MIXING_SQL),
    "op7_packing": (op7_packing, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_exact_topk": (op9_exact_topk, TOPK_SQL),
    "op10_hilbert_ann": (op10_hilbert_ann, None),
    "op11_collocations": (op11_collocations, COLLOCATIONS_SQL),
    "op12_hard_negatives": (op12_hard_negatives, NEGATIVES_SQL),
    "op13_quality": (op13_quality, None),
}
