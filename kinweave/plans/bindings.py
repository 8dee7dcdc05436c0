"""Queries of the operators over the given tables, each with the SQL that must give the same rows.

A contact network is laid over the tables: customers are contacts, orders are needs (open or resolved) and offers, events
are notes, order priorities are tags, orders that follow each other connect customers. Both sides share these views' text;
what is done with the views is written twice, once with the operators and once in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import phones
from ..functions import text as X
from ..operators import contacts as C
from ..operators import mapping, matching, mutations, postings, resolve, search
from ..operators.ranks import numbered
from ..schemas import STAGES, is_web_email, validate
from ..sources.scratch import scratch, spread
from ..sources.tabular import is_header_column
from ..streaming import rates

_STAGE = "case c_custkey % 5 " + " ".join(f"when {k} then '{s}'" for k, s in enumerate(STAGES)) + " end"
VIEWS = {
    "contacts": f"""select c_custkey as id, c_name as name,
        case c_mktsegment when 'MACHINERY' then 'archived' when 'FURNITURE' then 'imported' else 'active' end as status,
        {_STAGE} as stage, case c_custkey % 4 when 0 then 'founder' when 1 then 'investor' when 2 then 'operator' end as role,
        case when c_custkey % 6 > 0 then c_mktsegment end as company, cast(null as string) as title,
        case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then lower(n_name) else n_name end as city,
        cast(null as string) as country, concat(lower(c_name), '@example.org') as email, cast(null as string) as phone,
        concat('https://example.org/p/', cast(c_custkey as string)) as linkedin_url, cast(null as string) as birthday,
        case when c_custkey % 10 = 0 then 'summer fair' end as how_we_met, cast(c_custkey % 5 + 1 as int) as closeness,
        'csv' as source, cast(null as string) as last_contact_at, '2024-01-01' as created_at, '2024-01-01' as updated_at
        from {{customer}} join {{nation}} on c_nationkey = n_nationkey""",
    "needs": """select o_orderkey as id, o_custkey as contact_id, o_orderpriority as text, cast(cast(o_orderdate as date) as string) as created_at,
        case when o_orderstatus = 'F' then cast(cast(o_orderdate as date) as string) end as resolved_at from {orders} where o_orderstatus in ('O', 'F')""",
    "offers": """select o_orderkey as id, o_custkey as contact_id, o_orderpriority as text, cast(cast(o_orderdate as date) as string) as created_at,
        cast(null as string) as resolved_at from {orders} where o_orderstatus = 'P'""",
    "notes": "select event_id as id, user_id as contact_id, event_type as body, cast(cast(ts as date) as string) as occurred_on, cast(cast(ts as date) as string) as created_at from {events}",
    "tags": "select distinct cast(substring(o_orderpriority, 1, 1) as bigint) as id, lower(replace(o_orderpriority, ' ', '-')) as name from {orders}",
    "contact_tags": "select distinct o_custkey as contact_id, cast(substring(o_orderpriority, 1, 1) as bigint) as tag_id from {orders}",
    "connections": """select a.o_orderkey as id, least(a.o_custkey, b.o_custkey) as contact_a_id, greatest(a.o_custkey, b.o_custkey) as contact_b_id, a.o_orderpriority as note,
        '2024-01-01' as created_at from {orders} a join {orders} b on b.o_orderkey = a.o_orderkey + 1 where a.o_custkey <> b.o_custkey""",
}
_TABLES = ("customer", "nation", "orders", "events")


def network(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    files = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    if "connections" in names:  # orders meet orders: as many tasks as they need
        files["orders"] = spread(files["orders"], 500_000, "o_orderkey")
    return [spark.sql(VIEWS[n], **{t: df for t, df in files.items() if f"{{{t}}}" in VIEWS[n].replace("{{", "{").replace("}}", "}")}) for n in names]


def _with(*names: str) -> str:
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    for t in _TABLES:
        views = views.replace(f"{{{t}}}", t)
    return f"with {views}"


VIEWS["contacts"] = VIEWS["contacts"].replace("{{", "{").replace("}}", "}")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPEN = "(select count(*) from needs n where n.contact_id = c.id and n.resolved_at is null)"


@_query(f"""{_with("contacts", "needs")} select id, name, city, {_OPEN}::bigint as open_needs_count from contacts c
    where status = 'active' and exists (select 1 from needs n where n.contact_id = c.id and n.resolved_at is null)""")
def q_list_open_counts(spark, sf_dir):
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    return C.filtered(C.with_open_count(contacts, needs), needs, None, None, status="active", has_open_needs=True).select("id", "name", "city", "open_needs_count")


@_query(f"""{_with("contacts")} select id, name, count(*) over ()::bigint as total_matches, row_number() over (order by name, id)::int as position
    from contacts where status <> 'archived' order by name, id limit 50""")
def q_list_default(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    return C.listed(C.filtered(contacts, None, None, None), 50).select("id", "name", "total_matches", "position")


@_query(f"""{_with("contacts", "needs")} select id, stage, role from contacts c where status <> 'archived' and stage = 'close' and role = 'founder'
    and not exists (select 1 from needs n where n.contact_id = c.id and n.resolved_at is null and n.created_at >= '1998-01-01')""")
def q_no_open_items(spark, sf_dir):
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    return C.filtered(contacts, needs.where("created_at >= '1998-01-01'"), None, None, stage="close", role="founder", has_open_needs=False).select("id", "stage", "role")


@_query(f"""{_with("contacts", "tags", "contact_tags")} select id from contacts c where status <> 'archived'
    and exists (select 1 from contact_tags l join tags t on l.tag_id = t.id where l.contact_id = c.id and t.name = '1-urgent')""")
def q_tag_semi(spark, sf_dir):
    contacts, tags, links = network(spark, sf_dir, "contacts", "tags", "contact_tags")
    return C.filtered(contacts, None, links, tags, tag=" 1-Urgent ").select("id")


@_query(f"{_with('contacts')} select id, city from contacts where status <> 'archived' and lower(strip_accents(city)) = 'nation_3'")
def q_city_fold(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    return C.filtered(contacts, None, None, None, city=" Nàtion_3 ").select("id", "city")


@_query(f"{_with('tags')} select id, name from tags where starts_with(name, '4-n')")
def q_prefix_escape(spark, sf_dir):
    (tags,) = network(spark, sf_dir, "tags")
    return C.search_tags(tags, "4-N")


def _sorted(by: str, descending: bool, order: str, column: str):
    @_query(f"{_with('contacts', 'needs')} select id, row_number() over (order by {order})::int as position from (select c.*, {_OPEN} as open_needs_count from contacts c) order by {order} limit 50")
    def run(spark, sf_dir):
        contacts, needs = network(spark, sf_dir, "contacts", "needs")
        return C.listed(C.with_open_count(contacts, needs), 50, by, descending).select("id", "position")

    name = f"q_sort_{column}"
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_sorted("name", True, "name desc, id", "name_desc")
_sorted("city", False, "translate(city, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') asc nulls last, name, id", "nulls_last")
_sorted("company", True, "lower(company) desc nulls last, name, id", "company_desc")
_sorted("open_needs_count", True, "open_needs_count desc, name, id", "open_count_desc")
_sorted("stage", False, "list_position(['new', 'reached_out', 'in_touch', 'close', 'dormant'], stage), name, id", "stage_domain")


@_query(f"{_with('tags', 'contact_tags')} select contact_id, string_agg(name, ',' order by name) as tags from contact_tags join tags on tag_id = id group by contact_id")
def q_tags_collected(spark, sf_dir):
    tags, links = network(spark, sf_dir, "tags", "contact_tags")
    return C.tag_lists(links, tags).select("contact_id", F.array_join("tags", ",").alias("tags"))


@_query(f"{_with('needs')} select contact_id, arg_min(text, (created_at, id)) as top_open_need from needs where resolved_at is null group by contact_id")
def q_oldest_open(spark, sf_dir):
    return C.oldest_open(*network(spark, sf_dir, "needs"))


@_query(f"{_with('contacts')} select v.status, count(c.id)::bigint as n from (values ('imported'), ('active'), ('archived')) v(status) left join contacts c on c.status = v.status group by 1")
def q_count_by_status(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    return C.counts_by(contacts, "status")


@_query(f"{_with('contacts')} select v.stage, count(c.id)::bigint as n from (values ('new'), ('reached_out'), ('in_touch'), ('close'), ('dormant')) v(stage) left join contacts c on c.stage = v.stage group by 1")
def q_count_by_stage(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    return C.counts_by(contacts, "stage")


@_query(f"{_with('contacts')} select lower(strip_accents(city)) as key, min(city) as city from contacts where city is not null group by 1")
def q_distinct_folded(spark, sf_dir):
    return C.distinct_cities(*network(spark, sf_dir, "contacts"))


@_query(f"""{_with("contacts", "needs")}, first as (select contact_id, arg_min(text, (created_at, id)) as top_open_need from needs where resolved_at is null group by contact_id)
    select stage, id, name, top_open_need, row_number() over (partition by stage order by name, id)::int as position from contacts left join first on contact_id = id where status = 'active'""")
def q_board(spark, sf_dir):
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    return C.board(contacts, needs).select("stage", "id", "name", "top_open_need", "position")


@_query(f"{_with('contacts', 'needs')} select c.id, string_agg(n.text, ' ' order by n.id) as needs_text from contacts c left join needs n on n.contact_id = c.id group by c.id")
def q_group_concat(spark, sf_dir):
    contacts, needs, offers = network(spark, sf_dir, "contacts", "needs", "offers")
    return search.indexed_text(contacts, needs, offers).select("id", "needs_text")


@_query(f"""{_with("contacts", "needs", "offers", "tags", "contact_tags", "notes")} select c.id,
    (select string_agg(text, '|' order by resolved_at is not null, created_at, n.id) from needs n where n.contact_id = c.id) as needs,
    (select count(*) from offers o where o.contact_id = c.id)::bigint as n_offers,
    (select string_agg(t.name, '|' order by t.name) from contact_tags l join tags t on l.tag_id = t.id where l.contact_id = c.id) as tags,
    (select count(*) from notes n where n.contact_id = c.id)::bigint as n_notes from contacts c""")
def q_detail_nested(spark, sf_dir):
    detail = C.detail(*network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags", "notes"))
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long").alias(f"n_{c}")
    return detail.select("id", F.array_join(F.transform("needs", lambda x: x["text"]), "|").alias("needs"), count("offers"), F.array_join("tags", "|").alias("tags"), count("notes"))


@_query(f"""{_with("connections")} select contact_id, count(*)::bigint as n, count(distinct other_id)::bigint as others from (
    select contact_a_id as contact_id, contact_b_id as other_id from connections union all select contact_b_id, contact_a_id from connections) group by 1""")
def q_connections_incident(spark, sf_dir):
    both = C.incident(*network(spark, sf_dir, "connections"))
    return both.groupBy("contact_id").agg(F.count("*").alias("n"), F.countDistinct("other_id").alias("others"))


@_query(f"""{_with("connections")}, known as (select min(id) as id, contact_a_id, contact_b_id, min(note) as note, '2024-01-01' as created_at from connections group by all),
    pairs as (select least(o_custkey, o_orderkey % 1000) as contact_a_id, greatest(o_custkey, o_orderkey % 1000) as contact_b_id, max(o_orderpriority) as note from orders where o_custkey <> o_orderkey % 1000 group by 1, 2)
    select contact_a_id, contact_b_id, coalesce(p.note, k.note) as note, coalesce(k.created_at, '2025-01-01') as created_at from known k full join pairs p using (contact_a_id, contact_b_id)""")
def q_connection_normalise(spark, sf_dir):
    """Pairs in either order over known connections: a known one takes over the greatest new note, others are made."""
    (known,) = network(spark, sf_dir, "connections")
    known = known.groupBy("contact_a_id", "contact_b_id").agg(F.min("id").alias("id"), F.min("note").alias("note"), F.min("created_at").alias("created_at")).select("id", "contact_a_id", "contact_b_id", "note", "created_at")
    pairs = _table(spark, sf_dir, "orders").selectExpr("o_custkey a", "o_orderkey % 1000 b", "o_orderpriority note").where("a <> b")
    return mutations.connect(known, pairs, "2025-01-01").select("contact_a_id", "contact_b_id", "note", "created_at")


_TOKENS = r"""docs as (select doc_id as id, lang, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents)"""


def _bm25(phrases: list[str], need: str, tail: str) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{p}'))) as f{k}" for k, p in enumerate(phrases))
    stats = ", ".join(f"count(*) filter (f{k} > 0) as n{k}" for k in range(len(phrases)))
    score = " + ".join(f"(case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 then ln((n - n{k} + 0.5) / (n{k} + 0.5)) else 1e-6 end) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / m))" for k in range(len(phrases)))
    return f"with {_TOKENS}, f as (select id, len(t) as l, {counts} from docs), s as (select count(*) as n, avg(l) as m, {stats} from f) select id, round(-({score}), 6) as rank from f, s where {need} {tail}"


def _documents(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 6).alias("rank"))


@_query(_bm25(["the", "on"], "f0 > 0 and f1 > 0", ""))
def q_fts_and(spark, sf_dir):
    return _rounded(search.ranked(_documents(spark, sf_dir), search.prefix_query("the on"), ["text"]))


@_query(_bm25(["eron", "der", "que"], "f0 + f1 + f2 > 0", ""))
def q_fts_or(spark, sf_dir):
    return _rounded(search.ranked(_documents(spark, sf_dir), [["eron"], ["der"], ["que"]], ["text"], any_of=True))


@_query(_bm25(["the", "in"], "f0 > 0 and f1 > 0", "order by rank, id limit 50"))
def q_bm25_topk(spark, sf_dir):
    return _rounded(search.ranked(_documents(spark, sf_dir), search.prefix_query("The IN"), ["text"])).orderBy("rank", "id").limit(50)


@_query(f"with {_TOKENS} select id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' and starts_with(t[i + 1], 'th')))::bigint as n from docs where len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' and starts_with(t[i + 1], 'th'))) > 0")
def q_fts_phrase(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("id", search.occurrences(X.tokens(F.col("text")), ["the", "th"]).cast("long").alias("n"))
    return rows.where("n > 0")


@_query(r"""with w as (select turn, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t, role from conversations)
    select turn, role, sum(len(t))::bigint as tokens, count(*) filter (len(list_filter(t, lambda x: starts_with(x, 'la'))) > 0)::bigint as hits from w group by turn, role""")
def q_fts_columns(spark, sf_dir):
    t = X.tokens(F.col("text"))
    rows = _table(spark, sf_dir, "conversations").select("turn", "role", F.size(t).alias("n"), search.occurrences(t, ["la"]).alias("f"))
    return rows.groupBy("turn", "role").agg(F.sum("n").alias("tokens"), F.count_if(F.col("f") > 0).alias("hits"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(matching.STOP_WORDS))
_TERM_ROWS = rf"""words as (select item_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term, generate_subscripts(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), 1) as pos from benchmark),
    firsts as (select item_id, term, min(pos) as pos from words where len(term) >= 3 and term not in ({_STOPS}) group by 1, 2),
    terms as (select item_id, term, place from (select *, row_number() over (partition by item_id order by pos) as place from firsts) where place <= 24)"""


@_query(f"with {_TERM_ROWS} select item_id, string_agg(term, ' ' order by place) as terms from terms group by item_id")
def q_extract_terms(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(matching.terms_of(F.col("text")), " ").alias("terms")).where("terms <> ''")


@_query(f"""with {_TERM_ROWS}, {_TOKENS}, counts as (select id, lang, len(t) as l, unnest(t) as token from docs), posts as (select id, lang, l, token, count(*) as f from counts group by all),
    vocab as (select distinct token from posts), asked as (select distinct term from terms), reach as (select term, token from vocab join asked on starts_with(token, term)),
    hits as (select term, id, lang, l, sum(f) as f from posts join reach using (token) group by all),
    s as (select count(*) as n, avg(len(t)) as m from docs), idf as (select term, case when ln((n - k + 0.5) / (k + 0.5)) > 0 then ln((n - k + 0.5) / (k + 0.5)) else 1e-6 end as idf, m from (select term, count(*) as k from hits group by term), s),
    scored as (select item_id as source_id, id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m))), 6) as rank, count(*)::bigint as n_terms, arg_min(term, place) as first_term
      from terms join hits using (term) join idf using (term) where lang <> 'de' group by 1, 2)
    select * from (select *, row_number() over (partition by source_id order by rank, id)::int as place from scored) where place <= 10""")
def q_match_batch(spark, sf_dir):
    sources = _table(spark, sf_dir, "benchmark").selectExpr("item_id source_id", "text")
    return matching.match_batch(sources, _documents(spark, sf_dir).select("id", "text", (F.col("lang") != "de").alias("active")))


@_query(None)
def q_match_one(spark, sf_dir):
    return matching.find_matches(*network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags"), contact_id=7, query="urgent fair").select("place", "id", "name", F.to_json("matched_on").alias("matched_on"))


_LISTED = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PAIRED = f"""{_with("contacts", "needs", "offers", "tags", "contact_tags")},
    items as (select 0 as side, *, {_LISTED.format("text")} as t from offers union all select 1, *, {_LISTED.format("text")} from needs),
    firsts as (select contact_id as source_id, 1 - side as side, term, min((created_at, id, pos)) as spot from (select *, unnest(t) as term, generate_subscripts(t, 1) as pos from items where resolved_at is null)
      where len(term) >= 3 and term not in ({_STOPS}) group by all),
    terms as (select source_id, side, term, ord from (select *, row_number() over (partition by source_id, side order by spot) as ord from firsts) where ord <= 24),
    lens as (select c.id, c.status, c.name, len({_LISTED.format("concat_ws(' ', c.name, c.company, c.title, c.how_we_met)")}) + coalesce((select sum(len(t)) from items i where i.contact_id = c.id), 0) as l from contacts c),
    s as (select count(*) as n, avg(l) as m from lens),
    posts as (select side, contact_id as id, token, count(*) as f from (select side, contact_id, unnest(t) as token from items) group by all),
    hits as (select p.side, a.term, p.id, sum(f) as f from posts p join (select distinct side, term from terms) a on a.side = p.side and starts_with(p.token, a.term) join contacts c on c.id = p.id group by all),
    idf as (select side, term, case when ln((n - k + 0.5) / (k + 0.5)) > 0 then ln((n - k + 0.5) / (k + 0.5)) else 1e-6 end as idf, m from (select side, term, count(*) as k from hits group by all), s),
    scored as (select t.source_id, t.side, h.id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m))), 9) as rank from terms t join hits h using (side, term) join idf using (side, term) join lens on lens.id = h.id
      where status = 'active' group by all),
    pools as (select source_id, id, rank from (select *, row_number() over (partition by source_id, side order by rank, id) as k from scored) where k <= 200),
    tag_pairs as (select own.contact_id as source_id, l.contact_id as id, t.name as tag, o.name as term from contact_tags own join tags o on o.id = own.tag_id join tags t on t.name = o.name or (len(o.name) >= 3 and o.name not in ({_STOPS}) and starts_with(t.name, o.name))
      join contact_tags l on l.tag_id = t.id),
    best as (select source_id, id, min(rank) as rank from (select * from pools union all select distinct source_id, tp.id, 'infinity'::double from tag_pairs tp join contacts c on c.id = tp.id where c.status = 'active') where source_id <> id group by all),
    proof as (select b.source_id, b.id, i.side, i.created_at || '|' || lpad(i.id::varchar, 20, '0') as o, lpad(t.ord::varchar, 4, '0') as spot, case i.side when 0 then 'offer' else 'need' end as kind, i.text, t.term
        from best b join terms t on t.source_id = b.source_id join items i on i.contact_id = b.id and i.side = t.side and i.resolved_at is null and len(list_filter(i.t, lambda w: starts_with(w, t.term))) > 0
      union all select b.source_id, b.id, 2, tag, term, 'tag', tag, term from best b join tag_pairs p on p.source_id = b.source_id and p.id = b.id),
    placed as (select *, row_number() over (partition by source_id order by rank, lower(name), id) as place from (select b.*, c.name from best b join contacts c on c.id = b.id where exists (select 1 from proof p where p.source_id = b.source_id and p.id = b.id))),
    shown as (select p.*, row_number() over (partition by source_id, id order by side, o, spot, term) as k from proof p)
    select source_id, place::int as place, id, any_value(name) as name, string_agg(kind || ':' || text || ':' || term, '|' order by k) as matched_on from placed join shown using (source_id, id) where place <= 10 and k <= 12 group by all"""


@_query(_PAIRED)
def q_match_all(spark, sf_dir):
    found = matching.match_all(*network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags"))
    return found.withColumn("matched_on", F.array_join(F.transform("matched_on", lambda e: F.concat_ws(":", e["kind"], e["text"], e["term"])), "|"))


@_query(f"{_with('tags')}, terms(term) as (values ('1-urgent'), ('2-h'), ('lo'), ('3-')) select name, string_agg(term, ',' order by term) as hits from tags join terms on name = term or (len(term) >= 3 and starts_with(name, term)) group by name")
def q_tag_term_match(spark, sf_dir):
    (tags,) = network(spark, sf_dir, "tags")
    hits = matching.tag_hits(F.col("name"), ["1-urgent", "2-h", "3-", "lo"])
    return tags.select("name", F.array_join(F.array_sort(hits), ",").alias("hits")).where("hits <> ''")


@_query(r"""select c_custkey, trim(regexp_replace(lower(concat(' Dr. ', c_name, ' ')), '[^\p{L}\p{N}]+', ' ', 'g')) as name,
    regexp_replace(lower(trim(concat(c_mktsegment, '  tag '))), '\s+', '-', 'g') as tag, lower(regexp_replace(concat(' ', c_name, ' @ Example.org'), '\s+', '', 'g')) as email,
    c_custkey % 2 = 0 as looks, upper(concat(substring(c_mktsegment, 1, 1), substring(c_name, 1, 1))) as initials, concat_ws(' · ', case when c_custkey % 2 = 0 then c_mktsegment end, c_name) as subtitle from customer""")
def q_norm_strings(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return rows.select(
        "c_custkey", X.person_name(F.concat(F.lit(" Dr. "), name, F.lit(" "))).alias("name"), X.tag_name(F.concat(segment, F.lit("  tag "))).alias("tag"),
        X.email(F.concat(F.lit(" "), name, F.lit(" @ Example.org"))).alias("email"), X.looks_like_email(F.when(F.col("c_custkey") % 2 == 0, "a@b").otherwise("a@b@c")).alias("looks"),
        X.initials(F.concat(segment, F.lit(" x "), name)).alias("initials"), X.subtitle(F.when(F.col("c_custkey") % 2 == 0, segment), name).alias("subtitle"),
    )


@_query(r"""select page_id, concat(lower(regexp_extract(url, '^([a-z]+)://', 1)), '://', lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')) as url from pages""")
def q_canonical_url(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@_query("""select o_orderkey, case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""")
def q_parse_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    at = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "yyyy/M/d")).when(k == 1, F.date_format(at, "d.M.yyyy")).when(k == 2, F.date_format(at, "d MMM yyyy")).when(k == 3, F.date_format(at, "MMMM d, yyyy")).otherwise(F.date_format(at, "d/M/yyyy"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.parse_day(text).alias("day"))


@_query("""select o_orderkey, case when d < 7 then 'day' when d < 30 then 'week' when d < 365 then 'month' else 'year' end as unit,
    (case when d < 7 then d when d < 30 then d // 7 when d < 365 then d // 30 else d // 365 end)::int as n from (select o_orderkey, abs(date_diff('day', o_orderdate::date, date '1998-08-01')) as d from orders)""")
def q_relative(spark, sf_dir):
    age = D.age(F.col("o_orderdate").cast("date"), F.lit("1998-08-01").cast("date"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", age["unit"].alias("unit"), age["n"].alias("n"))


@_query(r"""with cells as (select p_partkey, case p_partkey % 3 when 0 then ['First Column', p_name, ''] when 1 then [p_name, '12.5'] else [p_name, null] end as c from part),
    filled as (select p_partkey, list_filter(list_transform(c, lambda x: trim(coalesce(x, ''))), lambda x: x <> '') as f from cells)
    select p_partkey, len(f) >= 2 and len(list_filter(f, lambda x: len(x) > 60 or regexp_full_match(x, '[+-]?[0-9]+([.,][0-9]+)?'))) = 0 and 2 * len(list_filter(f, lambda x: regexp_matches(x, '\p{L}'))) >= len(f)
      and len(list_distinct(list_transform(f, lambda x: lower(x)))) >= 2 and 3 * len(list_distinct(list_transform(f, lambda x: lower(x)))) >= 2 * len(f) as header from filled""")
def q_header_heuristic(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    cells = F.when(k == 0, F.array(F.lit("First " + "Column"), name, F.lit(""))).when(k == 1, F.array(name, F.lit("12.5"))).otherwise(F.array(name, F.lit(None)))
    return _table(spark, sf_dir, "part").select("p_partkey", is_header_column(cells).alias("header"))


def _foreign(spark, sf_dir) -> DataFrame:
    """Customers as a foreign table with faults."""
    mail = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.concat("c_name", F.lit("@Example.ORG ")))
    day = F.when(F.col("c_custkey") % 5 == 0, "1/2/2024").otherwise("3. März 2021")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_number"), F.col("c_mktsegment").alias("Vorname"), F.col("c_name").alias("Nachname"), mail.alias("E-Mail"), day.alias("Connected On"))


@_query("""select c_custkey as row_number, concat(c_mktsegment, ' ', c_name) as name, case when c_custkey % 4 <> 0 then concat(c_name, '@Example.ORG') end as email,
    case when c_custkey % 5 <> 0 then '2021-03-03' end as created_at, ((c_custkey % 4 = 0)::int + (c_custkey % 5 = 0)::int)::int as n_dropped from customer""")
def q_map_row(spark, sf_dir):
    rows = _foreign(spark, sf_dir)
    return mapping.map_rows(rows, mapping.suggest(rows.columns[1:]).mapping).select("row_number", "name", "email", "created_at", F.size("dropped").alias("n_dropped"))


@_query("""select field, reason, count(*)::bigint as n, min(value) as example from (select 'email' as field, 'not an e-mail address' as reason, 'n/a' as value from customer where c_custkey % 4 = 0
    union all select 'created_at', 'unreadable day', '1/2/2024' from customer where c_custkey % 5 = 0) group by field, reason""")
def q_dropped_histogram(spark, sf_dir):
    rows = _foreign(spark, sf_dir)
    return mapping.dropped_histogram(mapping.map_rows(rows, mapping.suggest(rows.columns[1:]).mapping))


def _everyone(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All customers as known contacts; all customers (even numbers) and all suppliers (odd ones) as incoming rows. Of the
    customers' incoming addresses half have the known scheme and half another."""
    site = F.concat(F.lit("example.org/p/"), F.col("c_custkey").cast("string"))
    customers, suppliers = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    known = customers.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Person "), F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("@example.org"))).alias("email"), F.when(F.col("c_custkey") % 3 == 0, site).alias("linkedin_url"))
    address = F.when(F.col("c_custkey") % 4 == 0, F.concat(site, F.lit("/"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("http://"), site))
    again = customers.select((2 * F.col("c_custkey")).alias("row_number"), F.concat(F.lit("PERSON-"), F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("@Example.org"))).alias("email"), address.alias("linkedin_url"))
    first = suppliers.select((2 * F.col("s_suppkey") + 1).alias("row_number"), F.concat(F.lit("PERSON-"), F.col("s_nationkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("@Example.org"))).alias("email"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://Example.org/s/"), F.col("s_suppkey").cast("string"))).alias("linkedin_url"))
    return known, again.unionByName(first)


_EVERYONE = """known as (select c_custkey as id, concat('person ', c_nationkey) as name, case when c_custkey % 4 = 0 then lower(concat(c_name, '@example.org')) end as email, case when c_custkey % 3 = 0 then concat('https://example.org/p/', c_custkey) end as url from customer),
    new as (select 2 * c_custkey as row_number, concat('person ', c_nationkey) as name, case when c_custkey % 5 = 0 then lower(concat(c_name, '@example.org')) end as email, case c_custkey % 4 when 0 then concat('https://example.org/p/', c_custkey) when 2 then concat('http://example.org/p/', c_custkey) end as url from customer
      union all select 2 * s_suppkey + 1, concat('person ', s_nationkey), case when s_suppkey % 2 = 0 then lower(concat(s_name, '@example.org')) end, case when s_suppkey % 3 = 0 then concat('https://example.org/s/', s_suppkey) end from supplier)"""
_ALL_MATCHED = f"""with {_EVERYONE}, m as (select n.row_number,
      (select min(id) from known k where k.url = n.url) as by_url, (select min(id) from known k where k.email = n.email) as by_email,
      (select min(id) from known k where k.name = n.name and not coalesce(n.url <> k.url, false) and not coalesce(n.email <> k.email, false)) as by_name from new n)
    select row_number, coalesce(by_url, by_email, by_name) as contact_id, case when by_url is not null then 'url' when by_email is not null then 'email' when by_name is not null then 'name' end as matched_by from m"""


@_query(_ALL_MATCHED)
def q_dedupe_match_all(spark, sf_dir):
    return resolve.match(*_everyone(spark, sf_dir)).select("row_number", "contact_id", "matched_by")


@_query(f"""with o as ({_ALL_MATCHED}) select count(*)::bigint as total, count(*) filter (contact_id is null)::bigint as created, 0::bigint as enriched, count(contact_id)::bigint as skipped, 0::bigint as errors, count(contact_id)::bigint as matched, 0 as exit_code from o""")
def q_import_summary_all(spark, sf_dir):
    found = resolve.match(*_everyone(spark, sf_dir))
    return resolve.summary(found.withColumn("outcome", F.when(F.col("contact_id").isNull(), "created").otherwise("skipped")))


@_query(f"""with o as ({_ALL_MATCHED}) select matched_by, count(*)::bigint as n, min(row_number) as first_row from o where matched_by is not null group by 1""")
def q_matched_histogram_all(spark, sf_dir):
    return resolve.histogram(resolve.match(*_everyone(spark, sf_dir)), "matched_by")


@_query(None)
def q_dedupe_replay(spark, sf_dir):
    return resolve.replay(*_everyone(spark, sf_dir))


@_query(f"""{_with("contacts")} select id, coalesce(nullif(company, ''), 'Acme') as company, coalesce(title, concat('T', id % 3)) as title, case when title is null or company is null then '2025-01-01' else updated_at end as updated_at,
    company is null or title is null as enriched from contacts where id % 2 = 0 union all select id, company, title, updated_at, false from contacts where id % 2 = 1""")
def q_enrich(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    values = contacts.where("id % 2 = 0").selectExpr("id", "'Acme' company", "concat('T', id % 3) title")
    return mutations.enrich(contacts, values, "2025-01-01").select("id", "company", "title", "updated_at", "enriched")


@_query(f"""{_with("contacts")} select id, case when id % 3 = 0 then null else city end as city, case when id % 3 = 0 and status = 'imported' then 'active' else status end as status,
    case when id % 3 = 0 then '2025-01-01' else updated_at end as updated_at from contacts""")
def q_update_patch(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    patches = contacts.where("id % 3 = 0").selectExpr("id", "named_struct('value', cast(null as string)) city")
    return mutations.update_contacts(contacts, patches, "2025-01-01").select("id", "city", "status", "updated_at")


@_query(f"""{_with("contacts", "needs", "contact_tags", "connections")} select (select count(*) from contacts where id % 4 <> 0)::bigint as contacts, (select count(*) from needs where contact_id % 4 <> 0)::bigint as needs,
    (select count(*) from contact_tags where contact_id % 4 <> 0)::bigint as contact_tags, (select count(*) from connections where contact_a_id % 4 <> 0 and contact_b_id % 4 <> 0)::bigint as connections""")
def q_delete_cascade(spark, sf_dir):
    names = ["contacts", "needs", "contact_tags", "connections"]
    tables = dict(zip(names, network(spark, sf_dir, *names), strict=True))
    left = mutations.delete_contacts(tables, tables["contacts"].where("id % 4 = 0").select("id"))
    counts = [left[n].agg(F.count("*").alias(n)) for n in names]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2])).join(F.broadcast(counts[3]))  # one row each


@_query(f"{_with('contacts', 'notes')} select c.id, max(n.occurred_on) as last_contact_at from contacts c left join notes n on n.contact_id = c.id group by c.id")
def q_last_contact_bump(spark, sf_dir):
    return mutations.bump_last_contact(*network(spark, sf_dir, "contacts", "notes")).select("id", "last_contact_at")


@_query("""select user_id as code, user_id as position, count(e.event_id)::bigint as referrals, greatest(1, user_id - 10 * count(e.event_id))::bigint as effective
    from (select distinct user_id from events) u left join (select event_id, user_id from events where event_type = 'signup' and value > 10) e using (user_id) group by user_id""")
def q_waitlist_position(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return mutations.waitlist_positions(events.selectExpr("user_id code", "user_id position").distinct(), events.where("event_type = 'signup' and value > 10").selectExpr("user_id code"))


@_query("""select event_id, user_id % 5 = 0 or row_number() over (partition by user_id order by event_id) > 1 as duplicate from events""")
def q_upsert_first_wins(spark, sf_dir):
    new = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id contact", "event_id at")
    return mutations.waitlist_upsert(new.where("contact % 5 = 0").select("contact"), new).select("event_id", "duplicate")


@_query("""with recursive hits as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as place from events),
    kept as (select event_id, user_id, place, true as accepted, [ts] as log from hits where place = 1
      union all select h.event_id, h.user_id, h.place, len(list_filter(k.log, lambda x: h.ts - x < interval 86400 seconds)) < 5,
        case when len(list_filter(k.log, lambda x: h.ts - x < interval 86400 seconds)) < 5 then list_append(k.log, h.ts) else k.log end from kept k join hits h on h.user_id = k.user_id and h.place = k.place + 1)
    select event_id, user_id, accepted from kept""")
def q_rate_limit(spark, sf_dir):
    hits = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rates.limited(hits, "user_id", "ts", "event_id", window=86_400).select("event_id", "user_id", "accepted")


@_query("""select '{"event_id":' || event_id || ',"event_type":"' || event_type || '"' || coalesce(',"k":' || (props->>'$.k')::bigint, '') || '}' as json from events""")
def q_json_props(spark, sf_dir):
    kind = T.StructType([T.StructField("k", T.LongType())])
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", kind)["k"].alias("k"), F.lit(None).cast("string").alias("gone"))
    return C.compact_json(rows, "event_id", "event_type", "k", "gone")


_FAULTY = """select c_custkey as id, case when c_custkey % 3 = 0 then ' ' when c_custkey % 5 = 0 then repeat(c_name, 12) else c_name end as name, case when c_custkey % 3 = 1 then 'x' else 'new' end as stage,
    case when c_custkey % 7 = 0 then 'gone' else 'active' end as status, cast(c_custkey % 8 as int) as closeness, case c_custkey % 4 when 0 then '2023-02-30' when 1 then '2024-02-29' end as last_contact_at,
    case c_custkey % 6 when 0 then '--02-29' when 1 then '1999-13-01' when 2 then '--04-31' when 3 then '2000-01-31' end as birthday, repeat('1', cast(c_custkey % 80 as int)) as phone from {customer}"""


@_query(f"""with rows as ({_FAULTY.replace("{customer}", "customer")}) select id, concat_ws(';', case when trim(name) = '' then 'name: required' end, case when len(name) > 200 then 'name: too long' end, case when len(phone) > 60 then 'phone: too long' end,
    case when stage not in ('new', 'reached_out', 'in_touch', 'close', 'dormant') then 'stage: unknown value' end, case when status not in ('imported', 'active', 'archived') then 'status: unknown value' end,
    case when last_contact_at is not null and try_cast(last_contact_at as date) is null then 'last_contact_at: not a day' end,
    case when birthday is not null and try_cast(replace(birthday, '--', '2000-') as date) is null then 'birthday: not a day' end, case when closeness not between 1 and 5 then 'closeness: 1 to 5' end) as errors from rows""")
def q_validate(spark, sf_dir):
    rows = spark.sql(_FAULTY, customer=_table(spark, sf_dir, "customer"))
    return validate(rows).select("id", F.array_join("errors", ";").alias("errors"))


_INDEXED = """texts as (select c.*, lower(concat_ws(' ', c.name, c.company, c.how_we_met, (select string_agg(n.text, ' ') from needs n where n.contact_id = c.id), (select string_agg(o.text, ' ') from offers o where o.contact_id = c.id))) as whole from contacts c),
    words as (select *, list_filter(regexp_split_to_array(whole, '[^a-z0-9]+'), lambda x: x <> '') as t from texts),
    f as (select *, len(t) as l, len(list_filter(t, lambda x: starts_with(x, 'auto'))) as f0, len(list_filter(t, lambda x: starts_with(x, 'urg'))) as f1 from words),
    s as (select count(*) as n, avg(l) as m, count(*) filter (f0 > 0) as n0, count(*) filter (f1 > 0) as n1 from f),
    r as (select f.*, -(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 0.000001) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 0.000001) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m))) as rank from f, s where f0 > 0 and f1 > 0)"""


@_query(f"""{_with("contacts", "needs", "offers")}, {_INDEXED}, kept as (select * from r where status <> 'archived' and exists (select 1 from needs n where n.contact_id = r.id and n.resolved_at is null))
    select id, row_number() over (order by round(rank, 9), lower(name), id)::bigint as position, count(*) over ()::bigint as total_matches from kept""")
def q_search_filtered(spark, sf_dir):
    """Filters before the limit, ranks over all contacts, ties by name and id; every hit is returned."""
    net = network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags")
    hits = search.listed_by(*net, query="Auto -- URG", has_open_needs=True)
    hits = numbered(hits.withColumn("rank", F.round("rank", 9)), ["rank", X.nocase(F.col("name")), "id"])
    return hits.join(F.broadcast(hits.agg(F.count("*").alias("total_matches")))).select("id", "position", "total_matches")


@_query(_bm25(["the", "on"], "f0 > 0 and f1 > 0", ""))
def q_fts_index(spark, sf_dir):
    index = postings.indexed(_documents(spark, sf_dir), ["text"], scratch(spark, "index"))
    return _rounded(postings.found(index, search.prefix_query("the on")))


@_query(_bm25(["eron", "que"], "f0 + f1 > 0", "order by rank, id limit 50"))
def q_fts_index_topk(spark, sf_dir):
    """The best of an index that leaves out blocks whose bounds are too low."""
    index = postings.indexed(_documents(spark, sf_dir), ["text"], scratch(spark, "index"))
    return _rounded(postings.best(index, [["eron"], ["que"]], 50, any_of=True))


_EDITED = _bm25(["der", "eron"], "f0 + f1 > 0", "").replace("coalesce(text, '')", "coalesce(case when source = 'src3' then 'Eron ' || text || ' der Ort' else text end, '')").replace("from documents", "from documents where source <> 'src4' or source is null")


@_query(_EDITED)
def q_fts_index_refreshed(spark, sf_dir):
    """One source's texts change and another's go, after the whole corpus was indexed: ranks are those of the corpus as it is then."""
    docs = _documents(spark, sf_dir)
    index = postings.indexed(docs, ["text"], scratch(spark, "index"))
    changed = docs.where("source = 'src3'").withColumn("text", F.concat(F.lit("Eron "), "text", F.lit(" der Ort")))
    index = postings.refresh(index, changed, docs.where("source = 'src4'"))
    return _rounded(postings.found(index, [["der"], ["eron"]], any_of=True))


@_query(rf"""with {_TOKENS}, f as (select id, len(t) + 1 as l, starts_with(lang, 'de')::int as f0 from docs), s as (select count(*) as n, avg(l) as m, count(*) filter (f0 > 0) as n0 from f)
    select id, round(-((case when ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 then ln((n - n0 + 0.5) / (n0 + 0.5)) else 1e-6 end) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m))), 6) as rank from f, s where f0 > 0""")
def q_fts_allowed(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("none")))
    return _rounded(search.ranked(rows, [["de"]], ["text", "lang"], allowed=["lang"]))


@_query(f"""{_with("contacts")}, asked as (select c_custkey as row_number, ' ' || upper(c_name) || '@Example.ORG' as email from customer union all select -1 - s_suppkey, s_name || '@example.org' from supplier)
    select row_number, min(c.id) as id from asked a left join contacts c on lower(c.email) = lower(trim(a.email)) group by row_number""")
def q_lookup_email(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_number"), F.concat(F.lit(" "), F.upper("c_name"), F.lit("@Example.ORG")).alias("email"))
    suppliers = _table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("row_number"), F.concat("s_name", F.lit("@example.org")).alias("email"))
    return C.by_email(contacts, customers.unionByName(suppliers)).select("row_number", "id")


@_query(f"""{_with("contacts")}, asked as (select c_custkey as row_number, (case c_custkey % 3 when 0 then 'http://example.org/p/' when 1 then 'HTTPS://Example.ORG/p/' else 'https://example.org/p/' end) || c_custkey || '/?from=mail' as url from customer)
    select row_number, min(c.id) as id from asked a left join contacts c on lower(c.linkedin_url) = lower(regexp_replace(regexp_replace(a.url, '\\?.*$', ''), '/+$', '')) group by row_number""")
def q_lookup_url(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    k = F.col("c_custkey")
    url = F.concat(F.when(k % 3 == 0, "http://example.org/p/").when(k % 3 == 1, "HTTPS://Example.ORG/p/").otherwise("https://example.org/p/"), k.cast("string"), F.lit("/?from=mail"))
    return C.by_url(contacts, _table(spark, sf_dir, "customer").select(k.alias("row_number"), url.alias("url"))).select("row_number", "id")


@_query(f"""{_with("contacts", "connections")}, both_ways as (select contact_a_id as contact_id, contact_b_id as other_id, id, created_at from connections union all select contact_b_id, contact_a_id, id, created_at from connections)
    select b.contact_id, b.id, row_number() over (partition by b.contact_id order by b.created_at desc, b.id desc)::bigint as position from both_ways b join contacts c on c.id = b.other_id""")
def q_connections_ordered(spark, sf_dir):
    contacts, connections = network(spark, sf_dir, "contacts", "connections")
    return C.connected(connections, contacts).select("contact_id", "id", "position")


@_query(f"""{_with("contacts")} select id, coalesce(company, case when id % 6 > 0 then 'Other' end) as company, coalesce(title, 'T' || (id % 3)) as title, '2025-01-01' as updated_at from contacts
    union all select (select max(id) from contacts) + row_number() over (order by s_suppkey), 'Supplies', null, '2025-01-01' from supplier""")
def q_import_applied(spark, sf_dir):
    """Every contact gets a title by its e-mail; suppliers are new, in row order."""
    (contacts,) = network(spark, sf_dir, "contacts")
    again = contacts.select(F.col("id").alias("row_number"), "name", F.upper("email").alias("email"), F.concat(F.lit("T"), F.col("id") % 3).alias("title"), F.lit("Other").alias("company"))
    again = again.withColumn("company", F.when(F.col("row_number") % 6 > 0, F.col("company")))
    first = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("row_number"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("title"), F.lit("Supplies").alias("company"))
    outcomes = resolve.replay(contacts, again.unionByName(first))
    return resolve.applied(contacts, outcomes, "2025-01-01").select("id", "company", "title", F.col("updated_at"))


_SHOWN = "(day(d)::varchar || '. ' || list_extract(['Jan', 'Feb', 'Mrz', 'Apr', 'Mai', 'Jun', 'Jul', 'Aug', 'Sep', 'Okt', 'Nov', 'Dez'], month(d)::int) || ' ' || year(d)::varchar)"


@_query(f"""select o_orderkey, case when o_orderkey % 4 = 3 then '–' else {_SHOWN} end as shown, case when o_orderkey % 4 = 3 then '' else strftime(d, '%Y-%m-%d') end as input,
    case o_orderkey % 4 when 3 then '–' when 2 then regexp_replace({_SHOWN}, ' [0-9]+$', '') else {_SHOWN} end as birthday from (select *, o_orderdate::date as d from orders)""")
def q_shown_dates(spark, sf_dir):
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    day = F.date_format(at, "yyyy-MM-dd")
    text = F.when(k == 3, "2023-02-30").when(k == 1, F.concat(F.lit(" "), day)).otherwise(F.concat(day, F.lit("T10:00:00Z")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.shown(text).alias("shown"), D.input_day(text).alias("input"), D.shown_birthday(F.when(k == 2, F.date_format(at, "'--'MM-dd")).otherwise(text)).alias("birthday"))


@_query("""select o_orderkey, case o_orderkey % 3 when 0 then '--' || strftime(o_orderdate, '%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') end as birthday from orders""")
def q_birthday(spark, sf_dir):
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(at, "'--'MM-dd")).when(k == 1, F.date_format(at, "d. MMMM yyyy")).otherwise(F.lit("--13-01"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", D.parse_birthday(text).alias("birthday"))


@_query("""select c_custkey as id, c_custkey % 7 + count(event_id)::bigint as referrals from customer left join events on user_id = c_custkey and event_type = 'signup' group by 1""")
def q_referrals_bumped(spark, sf_dir):
    entries = _table(spark, sf_dir, "customer").selectExpr("c_custkey id", "cast(c_custkey as string) referral_code", "c_custkey % 7 referrals")
    codes = _table(spark, sf_dir, "events").where("event_type = 'signup'").selectExpr("cast(user_id as string) code")
    return mutations.bump_referrals(entries, codes).select("id", "referrals")


@_query(f"{_with('tags', 'contact_tags')} select id, name from tags where id not in (select tag_id from contact_tags where contact_id = 32)")
def q_tags_left(spark, sf_dir):
    tags, links = network(spark, sf_dir, "tags", "contact_tags")
    return C.tags_left(tags, links, 32)


@_query(f"""{_with("contacts", "needs", "offers", "notes")}, n as (select 'contacts' as "table", count(*) as n from contacts union all select 'needs', count(*) from needs union all select 'offers', count(*) from offers union all select 'notes', count(*) from notes)
    select "table", n::bigint as n from n union all select 'all', sum(n)::bigint from n""")
def q_table_sizes(spark, sf_dir):
    names = ["contacts", "needs", "offers", "notes"]
    return C.sizes(dict(zip(names, network(spark, sf_dir, *names), strict=True)))


@_query(f"""{_with("contacts")} select id, name, status from contacts union all select (select max(id) from contacts) + row_number() over (order by s_name), s_name, 'active' from supplier""")
def q_seed(spark, sf_dir):
    """Everyone again and the suppliers: only these are new."""
    (contacts,) = network(spark, sf_dir, "contacts")
    again = contacts.select(F.upper("name").alias("name"), F.lower("company").alias("company"))
    first = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("Supplies").alias("company"))
    return mutations.seed(contacts, again.unionByName(first), "2025-01-01").select("id", "name", "status")


@_query("select doc_id, sha256(text) as checksum from documents where text is not null")
def q_checksum(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.checksum(F.col("text")).alias("checksum"))


_WAITING = """select c_custkey as id, case c_custkey % 9 when 0 then concat(' ', c_name, '@Example.Org ') when 1 then concat('0664/', lpad(cast(c_custkey as string), 7, '1')) when 2 then concat('+43 (0)1 ', lpad(cast(c_custkey as string), 6, '5'))
    when 3 then concat('0049 30 ', lpad(cast(c_custkey as string), 7, '2')) when 4 then concat('+1 (212) 555-', lpad(cast(c_custkey % 10000 as string), 4, '0')) when 5 then concat('+41 44 ', lpad(cast(c_custkey as string), 6, '3'))
    when 6 then concat(c_name, '@nowhere') when 7 then concat('call 0664 ', cast(c_custkey as string)) when 8 then '+999 12345678' end as raw from {customer}"""


@_query(rf"""with raws as ({_WAITING.replace("{customer}", "customer")}), plain as (select id, trim(raw) as t, regexp_replace(regexp_replace(trim(raw), '\(0\)', ''), '[ ()./-]', '', 'g') as d from raws),
    made as (select id, t, case when regexp_matches(t, '[A-Za-z]') then null when d like '+%' then d when d like '00%' then '+' || d[3:] else '+43' || regexp_replace(d, '^0', '') end as n from plain)
    select id, case when regexp_full_match(t, '[^ @]+@[^ @]+\.[^ @]+') then 'email' when regexp_full_match(n, '\+(43[1-9][0-9]{{3,12}}|49[1-9][0-9]{{3,13}}|41[2-9][0-9]{{8}}|1[2-9][0-9]{{2}}[2-9][0-9]{{6}})') then 'phone' end as kind,
      case when regexp_full_match(t, '[^ @]+@[^ @]+\.[^ @]+') then lower(t) when regexp_full_match(n, '\+(43[1-9][0-9]{{3,12}}|49[1-9][0-9]{{3,13}}|41[2-9][0-9]{{8}}|1[2-9][0-9]{{2}}[2-9][0-9]{{6}})') then n end as value from made""")
def q_waitlist_entries(spark, sf_dir):
    entry = phones.waitlist_entry(F.col("raw"))
    return spark.sql(_WAITING, customer=_table(spark, sf_dir, "customer")).select("id", entry["kind"].alias("kind"), entry["value"].alias("value"))


@_query(f"""{_with("contacts", "needs", "tags", "contact_tags")} select c.id, c.name, {_OPEN}::int as open_needs_count,
    coalesce((select string_agg(t.name, ',' order by t.name) from contact_tags l join tags t on l.tag_id = t.id where l.contact_id = c.id), '') as tags from contacts c""")
def q_list_rows_of_details(spark, sf_dir):
    detail = C.detail(*network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags", "notes"))
    return C.list_rows(detail).select("id", "name", "open_needs_count", F.array_join("tags", ",").alias("tags"))


@_query(f"""{_with("contacts")}, cards as (select id, name, case when id % 4 = 0 then 'close' when id % 9 = 0 then 'new' else stage end as stage from contacts where status = 'active')
    select stage, id, row_number() over (partition by stage order by lower(name), id)::bigint as position from cards""")
def q_board_moved(spark, sf_dir):
    """Cards move to other columns, some twice, some to where they are, some that aren't there."""
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    moves = contacts.selectExpr("id", "1 seq", "if(id % 9 = 0, 'new', null) stage").unionByName(contacts.selectExpr("id", "2 seq", "if(id % 4 = 0, 'close', null) stage")).unionByName(contacts.selectExpr("-1 - id id", "3 seq", "'new' stage"))
    return C.moved(C.board(contacts, needs), moves).select("stage", "id", "position")


@_query(f"""{_with("contacts", "needs")}, r as (select n.contact_id as id, list(struct_pack(closed := n.resolved_at is not null or n.id % 3 = 0, at := n.created_at, id := n.id) order by n.resolved_at is not null or n.id % 3 = 0, n.created_at, n.id) as l from needs n group by 1)
    select id, array_to_string(list_transform(l, lambda x: x.id), ',') as ids from r""")
def q_items_replaced(spark, sf_dir):
    """Every third item of a nested list is replaced by its resolved form, one after another, and each list is in order again."""
    needs = network(spark, sf_dir, "needs")[0].withColumn("resolved_at", F.when(F.col("id") % 3 == 0, F.coalesce("resolved_at", F.lit("2025-01-01"))).otherwise(F.col("resolved_at")))
    lists = network(spark, sf_dir, "needs")[0].groupBy(F.col("contact_id").alias("id")).agg(F.collect_list(F.struct("id", "text", "created_at", "resolved_at")).alias("items"))
    new = needs.where("id % 3 = 0").groupBy(F.col("contact_id").alias("id")).agg(F.collect_list(F.struct("id", "text", "created_at", "resolved_at")).alias("new"))
    held = lists.join(new, "id", "left").select("id", F.aggregate(F.coalesce("new", F.array().cast(lists.schema["items"].dataType)), C.sorted_items(F.col("items")), lambda l, x: C.replaced_item(l, x)).alias("items"))
    return held.select("id", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"))


@_query(f"""{_with("contacts")} select id, total_matches, least(total_matches, 20)::bigint as returned, total_matches > 20 as truncated
    from (select id, lower(name) as n, count(*) over ()::bigint as total_matches from contacts where lower(coalesce(name, '') || coalesce(' ' || company, '')) like '%auto%') order by n, id limit 20""")
def q_topk_truncated_counts(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    return C.counted_page(C.options_with(contacts, " AUTO", "name", "company"), 20, [F.lower("name"), "id"]).select("id", "total_matches", "returned", "truncated")


_HOSTED = "select c_custkey as id, concat(case c_custkey % 5 when 0 then 'https://linkedin.com' when 1 then 'https://de.LinkedIn.com' when 2 then 'http://linkedin.com' when 3 then 'https://www.linkedin.com' else 'https://notlinkedin.com' end, case when c_custkey % 7 = 0 then '' else concat('/in/', c_name) end) as linkedin_url from {customer}"


@_query(f"""with u as ({_HOSTED.replace("{customer}", "customer")}), h as (select *, lower(regexp_extract(linkedin_url, '^https://([^/]*)', 1)) as host from u)
    select id, case when host = 'linkedin.com' or (host like '%.linkedin.com' and host <> 'www.linkedin.com') then 'https://www.linkedin.com' || substr(linkedin_url, 9 + len(host)) else linkedin_url end as linkedin_url from h""")
def q_hosts_migrated(spark, sf_dir):
    return mutations.canonical_hosts(spark.sql(_HOSTED, customer=_table(spark, sf_dir, "customer"))).select("id", "linkedin_url")


@_query(f"""{_with("contacts", "needs")}, kept as (select id, contact_id, case when text = '1-URGENT' then 'Very urgent' else text end as text, created_at,
      case text when '5-LOW' then coalesce(resolved_at, '2025-01-01') when '2-HIGH' then null else resolved_at end as resolved_at from needs where text <> '4-NOT SPECIFIED')
    select * from kept union all select (select max(id) from kept) + row_number() over (order by id), id, 'call back', '2025-01-01', null from contacts""")
def q_items_changed(spark, sf_dir):
    """Needs of one priority get another text, others are resolved, reopened or deleted; then each contact gets one more."""
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    of = lambda text: needs.where(F.col("text") == text)
    changed = mutations.set_text(needs, of("1-URGENT").select("id", F.lit("Very urgent").alias("text")))
    changed = mutations.set_resolved(mutations.set_resolved(changed, of("5-LOW"), "2025-01-01"), of("2-HIGH"), None)
    changed = mutations.delete_rows(changed, of("4-NOT SPECIFIED"))
    return mutations.add_items(changed, contacts.select(F.col("id").alias("contact_id"), F.lit("call back").alias("text")), "2025-01-01")


@_query(f"""{_with("contacts", "notes")}, new as (select id as contact_id, case when city is null then '1990-01-01' else '2025-02-03' end as occurred_on from contacts)
    select c.id, greatest(c.last_contact_at, max(w.occurred_on)) as last_contact_at, (select count(*) from notes n where n.contact_id = c.id)::bigint + count(w.contact_id)::bigint as n_notes,
      (select max(id) from notes) + row_number() over (order by c.id) as note_id from contacts c join new w on w.contact_id = c.id group by c.id, c.last_contact_at""")
def q_notes_added(spark, sf_dir):
    """A note for each contact, of an old day where it has no city and of today elsewhere."""
    contacts, notes = network(spark, sf_dir, "contacts", "notes")
    new = contacts.select(F.col("id").alias("contact_id"), F.lit("called").alias("body"), F.when(F.col("city").isNull(), "1990-01-01").alias("occurred_on"))
    after, people = mutations.add_notes(notes, contacts, new, "2025-02-03T10:00:00")
    top = after.groupBy(F.col("contact_id").alias("id")).agg(F.count("*").alias("n_notes"), F.max(F.when(F.col("body") == "called", F.col("id"))).alias("note_id"))
    return people.select("id", "last_contact_at").join(top, "id")


@_query(f"""{_with("contacts", "tags", "contact_tags")}, wanted as (select id as contact_id, lower(company) as name from contacts where company is not null),
    known as (select id, name from tags union all select (select max(id) from tags) + row_number() over (order by name), name from (select distinct name from wanted) where name not in (select name from tags)),
    linked as (select contact_id, tag_id from contact_tags union select w.contact_id, k.id from wanted w join known k on k.name = w.name)
    select contact_id, k.name, k.id as tag_id from linked l join known k on k.id = l.tag_id where k.name <> '1-urgent'""")
def q_tags_changed(spark, sf_dir):
    """Companies become tags of their contacts; one tag is untied everywhere."""
    contacts, tags, links = network(spark, sf_dir, "contacts", "tags", "contact_tags")
    wanted = contacts.where("company is not null").select(F.col("id").alias("contact_id"), F.concat(F.lit(" "), "company", F.lit(" ")).alias("name"))
    known = mutations.ensure_tags(tags, wanted)
    named = known.select(F.col("id").alias("tag_id"), "name")
    linked = mutations.link_tags(links, wanted.withColumn("name", X.tag_name(F.col("name"))).join(named, "name").select("contact_id", "tag_id"))
    linked = mutations.unlink_tags(linked, linked.join(named.where("name = '1-urgent'"), "tag_id").select("contact_id", "tag_id"))
    return linked.join(named, "tag_id").select("contact_id", "name", "tag_id")


@_query(f"""{_with("contacts", "needs")} select id, case when n then 'archived' else status end as status, case when n then '2025-01-01' else updated_at end as updated_at
    from (select *, id not in (select contact_id from needs) as n from contacts)""")
def q_status_set(spark, sf_dir):
    contacts, needs = network(spark, sf_dir, "contacts", "needs")
    idle = contacts.join(needs.select(F.col("contact_id").alias("id")), "id", "left_anti")
    return mutations.set_status(contacts, idle, "archived", "2025-01-01").select("id", "status", "updated_at")


_MESSY = "select p_partkey as id, concat(' ', chr(1), p_name, chr(9), p_brand, chr(127), ' ') as raw, case when p_size > 25 then concat(p_brand, '@', p_type) else concat(replace(p_brand, '#', ''), '@x.org') end as mail, p_size from {part}"


@_query(rf"""with m as ({_MESSY.replace("{part}", "part")}) select id, regexp_replace(raw, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') as stripped, regexp_replace(raw, '[\x00-\x1F\x7F]', '', 'g') as quiet,
    regexp_replace(lower(regexp_replace(raw, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')), '[^a-z0-9]+', '', 'g') as header, trim(regexp_replace(raw, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) as cell,
    lpad(p_size::varchar, 4, '0') as padded, regexp_full_match(mail, '[^@\s]+@[^@\s]+\.[^@\s]+') as web_mail, sha256(mail) as checksum from m""")
def q_text_rules(spark, sf_dir):
    rows, raw = spark.sql(_MESSY, part=_table(spark, sf_dir, "part")), F.col("raw")
    return rows.select("id", X.strip_control(raw).alias("stripped"), X.strip_search_noise(raw).alias("quiet"), X.header_key(raw).alias("header"), X.clean_cell(raw).alias("cell"), X.zero_padded(F.col("p_size")).alias("padded"), is_web_email(F.col("mail")).alias("web_mail"), X.checksum(F.col("mail")).alias("checksum"))


_DAYS = "select o_orderkey as id, concat(substring(cast(o_orderdate as string), 1, 8), case when o_orderstatus = 'F' then '31' when o_orderstatus = 'O' then '29' else '07' end) as day, o_orderpriority as kind from {orders}"


@_query(f"""with d as ({_DAYS.replace("{orders}", "orders")}) select id, try_cast(day as date) is not null as is_day, try_cast(day as date) is not null and kind <> '5-LOW' as is_iso, case when kind = '5-LOW' then null else strftime(try_cast(day as date), '%Y-%m-%d') end as birthday,
    case when try_cast(day as date) is null or kind = '5-LOW' then '–' else day(day::date)::varchar || '. ' || list_extract(['Jan', 'Feb', 'Mrz', 'Apr', 'Mai', 'Jun', 'Jul', 'Aug', 'Sep', 'Okt', 'Nov', 'Dez'], month(day::date)::int) || ' ' || year(day::date)::varchar || case when kind = '1-URGENT' then ', 18:05' else ', 00:00' end end as shown from d""")
def q_day_rules(spark, sf_dir):
    """Days that some months lack, with and without a time, and with something behind them that is none."""
    rows = spark.sql(_DAYS, orders=_table(spark, sf_dir, "orders"))
    text = F.concat("day", F.when(F.col("kind") == "1-URGENT", "T18:05:00").when(F.col("kind") == "5-LOW", ", or so").otherwise(""))
    return rows.select("id", D.is_day(F.col("day")).alias("is_day"), D.is_iso(text).alias("is_iso"), D.parse_birthday(F.when(F.col("kind") == "5-LOW", text).otherwise(F.col("day"))).alias("birthday"), D.shown_time(text).alias("shown"))


@_query(f"""{_with("contacts", "notes")}, n as (select contact_id, string_agg(id, ',' order by occurred_on desc, created_at desc, id desc) as notes from notes group by 1)
    select c.id, n.notes from contacts c join n on n.contact_id = c.id""")
def q_notes_ordered(spark, sf_dir):
    detail = C.detail(*network(spark, sf_dir, "contacts", "needs", "offers", "contact_tags", "tags", "notes"))
    shuffled = detail.where("notes is not null").withColumn("notes", F.array_sort("notes"))
    return shuffled.select("id", F.array_join(F.transform(C.sorted_notes(F.col("notes")), lambda n: n["note_id"].cast("string")), ",").alias("notes"))


@_query(f"""{_with("contacts", "notes")}, last as (select c.id, c.name, max(n.occurred_on) as day from contacts c left join notes n on n.contact_id = c.id group by 1, 2)
    select id, row_number() over (order by day desc nulls last, lower(name), id)::int as position from last order by position limit 100""")
def q_sort_last_contact(spark, sf_dir):
    return C.listed(mutations.bump_last_contact(*network(spark, sf_dir, "contacts", "notes")), 100, "last_contact_at", True).select("id", "position")


@_query(f"{_with('tags')} select id, name, row_number() over (order by lower(name))::bigint as position from tags")
def q_tags_ordered(spark, sf_dir):
    (tags,) = network(spark, sf_dir, "tags")
    return numbered(C.search_tags(tags, ""), [X.nocase(F.col("name"))]).select("id", "name", "position")


@_query(f"""{_with("contacts")} select p.s_suppkey as pair, min(a.id) as a, min(b.id) as b from supplier p join contacts a on lower(a.name) = 'customer#' || lpad((p.s_suppkey + 1)::varchar, 9, '0')
    join contacts b on lower(b.name) = 'customer#' || lpad((p.s_suppkey + 2)::varchar, 9, '0') group by 1""")
def q_pairs_by_name(spark, sf_dir):
    (contacts,) = network(spark, sf_dir, "contacts")
    name = lambda k: F.concat(F.lit("CUSTOMER - "), F.lpad((F.col("s_suppkey") + k).cast("string"), 9, "0"))
    pairs = _table(spark, sf_dir, "supplier").select(name(1).alias("name_a"), name(2).alias("name_b"), F.col("s_suppkey").alias("note"))
    return C.named_pairs(contacts, pairs).select(F.col("note").alias("pair"), "a", "b")


@_query(r"""with t as (select doc_id as id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') as t from documents)
    select id, array_to_string(list_filter(['the', 'eron', 'und', 'que', 'zzz'], lambda p: len(list_filter(t, lambda w: starts_with(w, p))) > 0), ',') as terms from t""")
def q_text_evidence(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", F.array_join(matching.text_hits(F.coalesce("text", F.lit("")), ["the", "eron", "und", "que", "zzz"]), ",").alias("terms"))
