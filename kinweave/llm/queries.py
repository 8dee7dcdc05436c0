"""The registered queries of the operators: each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, bloom_sketch, divergence, edit_counts, language, neardup, packing, pieces, pitman_yor, ranked, records, toxicity, urls, vectors


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch(spark, "records")
    records.write(base.table(spark, sf_dir, "documents"), path)
    return records.read(spark, path)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, base.table(spark, sf_dir, "labels")))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.evaluate(base.table(spark, sf_dir, "documents"), base.fold("doc_id", 7) == 2)


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes_of(base.table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(base.table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.table(spark, sf_dir, "documents"))


def op8_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_sketch.fingerprints(base.table(spark, sf_dir, "documents"), full=True)


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count(edit_counts.sample_edits(base.table(spark, sf_dir, "documents")))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(base.table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.index(base.table(spark, sf_dir, "documents")), base.table(spark, sf_dir, "benchmark"))


#: Verdict, host and path of the rules of op12.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(base.table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(base.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_language_id, op3_toxicity, op4_pitman_yor, op5_setsketch, op6_piece_encoding, op7_packing, op8_bloom_sketch, op9_edit_counts, op10_projection_forest, op11_ranked_search, op12_url_filters, op13_source_divergence)}

_OP5 = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
sets as (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 4 then [w]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) end s from words),
shingles as (select doc_id, len(s) n, unnest(s) g from sets),
coded as (select doc_id, n, hash(g) g from shingles),
common as (
  select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c from coded a join coded b on a.g = b.g and a.doc_id < b.doc_id
  group by all),
links as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select s.doc_id, len(s.s)::bigint n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) kept
from sets s left join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""

_OP10 = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
good as (
  select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) u from v
  where len(e) > 0 and list_aggregate(list_transform(e, lambda x: coalesce(isfinite(x), false)::int), 'min') = 1 and list_dot_product(e, e) > 0),
links as (
  select a.vec_id a, b.vec_id b from good a join good b on a.vec_id < b.vec_id and len(a.u) = len(b.u)
  where list_dot_product(a.u, b.u) >= 0.9),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
least_of as (select a, min(b) m from reach group by a),
degree as (select a, count(*) n from both_ways group by a)
select v.vec_id, coalesce(d.n, 0)::bigint n_links, least(v.vec_id, coalesce(m, v.vec_id)) component_id,
  v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) kept
from v left join least_of l on l.a = v.vec_id left join degree d on d.a = v.vec_id
"""

_OP11 = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
tf as (select doc_id, term, count(*) tf from terms group by all),
lengths as (select doc_id, sum(tf)::bigint n from tf group by doc_id),
totals as (select count(*)::bigint n_docs, sum(n)::bigint n_terms from lengths),
weights as (
  select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1)))::bigint w
  from tf, totals group by term, n_docs),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint score
  from asked join tf using (term) join weights using (term) join lengths using (doc_id), totals group by all)
select item_id, rank::int rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scored where score > 0)
where rank <= 10
"""

_OP12 = r"""
with recursive parts as (
  select page_id, html, coalesce(regexp_extract(url, '^(?s:.*?)://([^#]*)', 1), '') rest from pages),
cut as (
  select page_id, html, rest, translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?]*([^?]*)', 1) path from parts),
nodes as (select *, host || rest[len(host) + 1:] node from cut),
tags as (
  select node, host, path, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<link\b[^>]*\brel=.?canonical[^>]*>')) tag from nodes
  where html ilike '%canonical%'),
hrefs as (select node, host, regexp_extract(tag, '\shref="([^"#]*)', 1) href from tags),
edges as (
  select node a, case when href like '%://%' then regexp_replace(href, '^.*?://', '') when href like '/%' then host || href end b from hrefs),
both_ways as (select a, b from edges where b is not null union select b, a from edges where b is not null),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
rules(verdict, host, path) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
places as (
  select node, host, path from nodes
  union select b, regexp_extract(b, '^[^/?]*'), regexp_extract(b, '^[^/?]*([^?]*)', 1) from both_ways),
fits as (
  select node, r.host || r.path rule, verdict, row_number() over (partition by node order by len(r.host || r.path) desc, verdict) k
  from places p join rules r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path)),
best as (select node, rule, verdict from fits where k = 1),
spread as (
  select a node, case when bool_or(verdict = 'block') and not bool_or(verdict = 'allow') then 'block' end verdict
  from reach join best on best.node = reach.b group by a)
select page_id, host, path, rule, coalesce(best.verdict, spread.verdict, 'allow') verdict
from nodes left join best using (node) left join spread using (node)
"""

_OP13 = r"""
with docs as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text from documents),
groups as (select distinct lang, source from docs),
words as (
  select doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs),
kept as (select lang, term, count(*) n from words group by lang, term having count(distinct doc_id) >= 30),
langs as (select lang, count(*) v, sum(n) total from kept group by lang),
counts as (select w.lang, source, term, count(*) n from words w semi join kept k on w.lang = k.lang and w.term = k.term group by all),
totals as (select lang, source, sum(n) total from counts group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) p,
    1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) q
  from groups g join kept k on g.lang = k.lang join langs l on g.lang = l.lang
  left join totals t on g.lang = t.lang and g.source = t.source
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
priced as (
  select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all),
pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(p.value, 0)::bigint value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join priced p on p.lang = a.lang and p.source = a.source and p.item = b.source),
surplus as (select lang, source, 'term' part, term item, (p - q)::bigint value from shares where n > 0 and p > q),
ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank
  from (select * from pairs union all select * from surplus))
select * from ranked where part = 'pair' or rank <= 50
"""

#: SQL for the queries whose results SQL can express; the others are tested against brute force.
ORACLE_SQL = {"op5_setsketch": _OP5, "op10_projection_forest": _OP10, "op11_ranked_search": _OP11, "op12_url_filters": _OP12, "op13_source_divergence": _OP13}
