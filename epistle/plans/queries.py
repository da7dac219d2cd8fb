"""The archive's queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, integrity, people, search, threads, timeline
from ..operators import ledger as ledgers
from ..operators.graph import shared_dir, staged
from ..operators.index import SearchIndex
from ..sources import sinks
from .archive import KINDS, SQL, Archive

THIS_YEAR = 2024
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of an Archive under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("with ") else f"with {SQL}{sql}"
        return f

    return add


_CENSUS = """, d as (select item_id, kind, occurred[1:7] as month from items where occurred[1:4]::int between 1970 and 2025),
c as (select month, kind, count(distinct item_id) as items, count(distinct source_id) as sources from d left join item_sources using (item_id) group by all),
spine as (select strftime(unnest(generate_series(min(month || '-01')::date, max(month || '-01')::date, interval 1 month)), '%Y-%m') as month from d),
census as (select month, kind, coalesce(items, 0) as items, coalesce(sources, 0) as sources
  from spine cross join (select distinct kind from d) left join c using (month, kind)),
total as (select month, sum(items)::bigint as n from census group by month),
classed as (select month, n, case when n = 0 then 'hard_gap'
  when count(case when n > 0 then 1 end) over w >= 6 and n < 0.15 * quantile_cont(case when n > 0 then n end, 0.5) over w then 'soft_gap' end as gap
  from total window w as (order by month rows between 12 preceding and 1 preceding))
"""


def _census(a: Archive) -> DataFrame:
    return timeline.census(a.items, a.item_sources, THIS_YEAR)


@query(_CENSUS + "select * from census")
def coverage_census(a):
    return _census(a)


@query(_CENSUS + "select * from classed")
def coverage_gaps(a):
    return timeline.classed(_census(a))


@query(
    _CENSUS.replace("from items where", "from items where occurred[1:7] not in ('1997-03', '1997-04', '1999-11') and")
    + """, r as (select gap, month, occurred.i - row_number() over (partition by gap order by month) as run from (select *, (month[1:4]::int * 12 + month[6:7]::int) as i from classed where gap is not null) occurred)
select gap, min(month) as first_month, max(month) as last_month, count(*) as months from r group by gap, run"""
)
def coverage_gap_runs(a):
    holes = a.items.where(~F.substring("occurred", 1, 7).isin("1997-03", "1997-04", "1999-11"))
    return timeline.gap_runs(timeline.classed(timeline.census(holes, a.item_sources, THIS_YEAR)))


@query(
    _CENSUS
    + "select month[1:4] as year, "
    + ", ".join(f"max(case when month[6:7] = '{k:02d}' then n end) as m{k:02d}" for k in range(1, 13))
    + ", sum(n)::bigint as total, case when sum(n) = 0 then 'hard_gap' when count(gap) > 0 then 'partial' else 'none' end as class from classed group by 1"
)
def coverage_map(a):
    return timeline.coverage_map(timeline.classed(_census(a)))


def _timeline(chars: int) -> str:
    kinds = ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in KINDS)
    return f""" select period, {', '.join(KINDS)}, total, coalesce(sources, 0) as sources from
(select occurred[1:{chars}] as period, {kinds}, count(*) as total from items group by 1)
left join (select occurred[1:{chars}] as period, count(distinct source_id) as sources from items join item_sources using (item_id) group by 1) using (period)"""


@query(_timeline(4))
def timeline_year(a):
    return timeline.timeline(a.items, a.item_sources, 4, KINDS)


@query(_timeline(7))
def timeline_month(a):
    return timeline.timeline(a.items, a.item_sources, 7, KINDS)


@query(_timeline(10))
def timeline_day(a):
    return timeline.timeline(a.items, a.item_sources, 10, KINDS)


@query(
    """ select 'kind' as facet, kind as value, count(*) as n from items group by kind
union all select 'subject', subject, count(*) from items group by subject
union all (select 'source', source_id::varchar, count(*) as n from item_sources group by source_id order by n desc, source_id limit 100)"""
)
def facets(a):
    return timeline.facets(a.items, a.item_sources)


@query(
    """, s as (select source_id, count(*) as n from item_sources group by 1 having count(*) >= 10),
p as (select a.source_id as a, b.source_id as b, count(*) as shared from item_sources a join item_sources b using (item_id) where a.source_id < b.source_id group by 1, 2)
select a, b, shared, shared / least(x.n, y.n) as overlap from p join s x on a = x.source_id join s y on b = y.source_id where shared / least(x.n, y.n) >= 0.05"""
)
def source_overlap(a):
    return people.source_overlap(a.item_sources, 10, 0.05)


_YEARS = """, y as (select distinct o_custkey as source_id, year(o_orderdate)::int as year from orders)"""


def _mailboxes(a: Archive) -> DataFrame:
    """Each sender's own mailbox as a source of what they sent."""
    return a.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("source_id"))


@query(
    _YEARS
    + """, s as (select source_id, unnest(range(min(year) + 1, max(year))) as year from y group by source_id)
select source_id, year::int as year from s anti join y using (source_id, year)"""
)
def source_year_holes(a):
    return integrity.year_holes(a.items, _mailboxes(a))


@query(
    """ select person_id, count(*) as items, min(occurred) as first_seen, max(occurred) as last_seen
from (select distinct person_id, item_id from participations) join items using (item_id) group by person_id"""
)
def person_stats(a):
    return people.statistics(a.participations, a.items)


@query(
    """, p as (select a.person_id, b.person_id as other_id, count(distinct item_id) as shared from participations a join participations b using (item_id)
  where a.role = 'from' and b.role = 'to' and a.person_id <> b.person_id group by 1, 2)
select person_id, other_id, shared, rank::int as rank from (select *, row_number() over (partition by person_id order by shared desc, other_id) as rank from p) where rank <= 15"""
)
def top_correspondents(a):
    return people.correspondents(a.participations, 15)


@query(
    """, c as (select person_id, occurred[1:4]::int as year, count(*) as items from (select distinct person_id, item_id from participations) join items using (item_id) group by 1, 2),
s as (select person_id, unnest(range(min(year), max(year) + 1)) as year from c group by person_id)
select person_id, year::int as year, coalesce(items, 0) as items from s left join c using (person_id, year)"""
)
def person_per_year(a):
    return people.per_year(a.participations, a.items)


@query(
    """ select person_id, count(*) as sent, count(*) / (select count(*) from participations where role = 'from') as share
from participations where role = 'from' group by person_id having count(*) / (select count(*) from participations where role = 'from') >= 0.001"""
)
def self_identity_share(a):
    return people.sender_share(a.participations, 0.001)


@query(
    """ select item_id, kind, occurred, subject from items i where kind in ('message', 'event') and occurred >= '1996' and occurred < '1999-07'
and exists (select 1 from item_sources s where s.item_id = i.item_id and source_id <= 20) order by lower(subject), occurred desc, item_id limit 500 offset 100"""
)
def items_filtered_table(a):
    wanted = a.items.where("kind in ('message', 'event') and occurred >= '1996' and occurred < '1999-07'")
    wanted = wanted.join(a.item_sources.where("source_id <= 20"), "item_id", "left_semi")
    return wanted.orderBy(F.lower("subject").asc_nulls_last(), F.desc_nulls_last("occurred"), "item_id").offset(100).limit(500)


@query(
    """ select doc_id, sha256(coalesce(text, '')) as content_key, min(doc_id) over (partition by coalesce(text, '')) as keeper_id,
count(*) over (partition by coalesce(text, '')) as copies from documents"""
)
def dedup_documents(a):
    d = a.table("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"))
    groups = d.groupBy("content_key").agg(F.min("doc_id").alias("keeper_id"), F.count("*").alias("copies"))
    return d.join(groups, "content_key").select("doc_id", "content_key", "keeper_id", "copies")


@query(
    r""" select o_orderkey as item_id, sha256('msg|' || o_custkey || '|' || coalesce(r, '') || '|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') || '|' || lower(o_orderpriority)) as dedup_key
from orders left join (select item_id, string_agg(person_id::varchar, ',' order by person_id::varchar) as r from participations where role = 'to' group by item_id) on item_id = o_orderkey"""
)
def message_dedup_key(a):
    to = a.participations.where("role = 'to'").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("person_id").cast("string"))), ",").alias("r"))
    sent = a.table("orders").select(F.col("o_orderkey").alias("item_id"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred"), F.col("o_orderpriority").alias("subject"))
    j = sent.join(to, "item_id", "left")
    return j.select("item_id", X.key(F.lit("msg"), F.col("o_custkey"), F.col("r"), F.substring("occurred", 1, 16), X.normalized_subject(F.col("subject"))).alias("dedup_key"))


@query(
    """ select text_key, copies, keeper_id, bytes * copies as wasted from (select md5(text) as text_key, count(*) - 1 as copies, arg_min(doc_id, struct_pack(l := length(source), s := source, d := doc_id)) as keeper_id,
max(strlen(text)) as bytes from documents where text is not null group by text having count(*) > 1)"""
)
def duplicate_file_groups(a):
    d = a.table("documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("text_key"), F.octet_length("text").alias("bytes"))
    g = d.groupBy("text_key").agg(F.count("*").alias("n"), F.min(F.struct(F.length("source"), "source", "doc_id")).alias("keep"), F.max("bytes").alias("bytes")).where("n > 1")
    return g.select("text_key", (F.col("n") - 1).alias("copies"), F.col("keep.doc_id").alias("keeper_id"), (F.col("bytes") * (F.col("n") - 1)).alias("wasted"))


@query(
    r""" select doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[ \t\n\f\r]+', ' ', 'g')) as subject from documents where text is not null"""
)
def normalize_subject(a):
    first = F.split("text", "\n")[0]
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Re: [list] FW: "), first)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("AW[2]: "), first)).otherwise(first)
    return a.table("documents").where("text is not null").select("doc_id", X.normalized_subject(raw).alias("subject"))


@query(
    """ select person_id, lower(replace(name, '#', '.')) || '@' || lower(n_name) || '.example' as address, 'smtp' as address_type
from people join nation on nation = n_nationkey"""
)
def normalize_address(a):
    n = a.table("nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    raw = F.concat(F.col("name"), F.lit(" <"), F.replace("name", F.lit("#"), F.lit(".")), F.lit("+tag@"), "n_name", F.lit(".Example.>"))
    return a.people.join(F.broadcast(n), "nation").select("person_id", X.identity(raw).alias("i")).select("person_id", "i.*")


@query(""" select person_id, lower(replace(name, '#', ' ')) as norm, string_split(lower(replace(name, '#', ' ')), ' ')[-1] as surname, string_split(lower(replace(name, '#', ' ')), ' ')[1] as given from people""")
def name_parts(a):
    n = F.regexp_replace("name", "^", "Dr. ")
    return a.people.select("person_id", X.normalized_name(n).alias("norm"), X.surname(n).alias("surname"), X.given_name(n).alias("given"))


@query(
    """, l as (select distinct l_partkey as person_id, l_orderkey as other_id from lineitem),
p as (select distinct x.person_id as a, y.person_id as b, u.p_name as na, v.p_name as nb from l x join l y using (other_id) join part u on u.p_partkey = x.person_id join part v on v.p_partkey = y.person_id where x.person_id < y.person_id)
select a, b, round(jaro_winkler_similarity(na, nb), 6) as score from p where na <> nb and jaro_winkler_similarity(na, nb) >= 0.8"""
)
def jaro_winkler_pairs(a):
    """Names of parts that met in an order; an order has few lines, so the pairs grow with the orders."""
    names = a.table("part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
    links = a.table("lineitem").select(F.col("l_partkey").alias("person_id"), F.col("l_orderkey").alias("other_id")).distinct()
    return people.similar_names(names, links, 0.8).select("a", "b", F.round("score", 6).alias("score"))


def _messages(a: Archive) -> DataFrame:
    sender = a.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("participant"))
    m = a.items.where("kind = 'message'").join(sender, "item_id")
    return m.select("item_id", X.normalized_subject(F.col("subject")).alias("subject"), "participant", F.to_date(F.substring("occurred", 1, 10)).alias("day"))


@query(
    """, m as (select o_orderkey as item_id, o_custkey as p, o_orderpriority as s, o_orderdate::date as day from orders where o_orderstatus = 'O'),
g as (select *, case when day - lag(day) over w <= 180 then 0 else 1 end as new from m window w as (partition by s, p order by day, item_id)),
r as (select *, sum(new) over (partition by s, p order by day, item_id) as run from g)
select min(item_id) as thread_id, count(*) as messages, min(day) as first_day, max(day) as last_day from r group by s, p, run"""
)
def thread_summary(a):
    """Short subjects link too here."""
    m = _messages(a)
    return threads.summary(m, threads.threads(m, threads.subject_links(m, 180, shortest=1)))


@query(
    """, m as (select o_orderkey as item_id, o_custkey as p, o_orderpriority as s, o_orderdate::date as day from orders where o_orderstatus = 'O'),
g as (select *, case when length(s) >= 6 and day - lag(day) over w <= 180 then 0 else 1 end as new from m window w as (partition by s, p order by day, item_id)),
r as (select *, sum(new) over (partition by s, p order by day, item_id) as run from g)
select min(item_id) as thread_id, count(*) as messages, min(day) as first_day, max(day) as last_day from r group by s, p, run"""
)
def thread_summary_strict(a):
    """Subjects under six characters link nothing."""
    m = _messages(a)
    return threads.summary(m, threads.threads(m, threads.subject_links(m, 180)))


@query(
    """, c as (select conv_id, turn, count(*) filter (turn % 5 = 3 or turn = 0) over (partition by conv_id order by turn) as part from conversations)
select min(conv_id * 1000000 + turn) as thread_id, count(*) as messages from c group by conv_id, part"""
)
def thread_chains(a):
    """Conversation turns as replies by message id; every fifth turn answers nothing and begins a thread of its own."""
    name = lambda t: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"), F.lit("@x>"))
    t = F.col("turn")
    m = a.table("conversations").select(
        (F.col("conv_id") * 1000000 + t).alias("item_id"), name(t).alias("message_id"), F.when((t % 5 != 3) & (t % 2 == 0), name(t - 1)).alias("in_reply_to"),
        F.when((t % 5 != 3) & (t % 2 == 1), F.array(name(t - 1), F.lit("<lost@x>"))).alias("refs"),
    )
    return threads.threads(m, threads.chain_links(m)).groupBy("thread_id").agg(F.count("*").alias("messages"))


@query(
    """ select c.conv_id, count(*) as orphans from conversations c anti join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 and p.turn % 4 <> 1
where c.turn > 0 group by c.conv_id"""
)
def orphan_replies(a):
    c = a.table("conversations").select("conv_id", "turn")
    parents = c.where("turn % 4 <> 1").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return c.where("turn > 0").join(parents, ["conv_id", "turn"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("orphans"))


_POSTS = r"""with posts as (select doc_id, unnest(range(len(t))) as pos, unnest(t) as term
from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as t from documents)) """


_BUILT: dict[tuple[str, str], SearchIndex] = {}


def _indexed(a) -> SearchIndex:
    """The index of a folder's documents, built by the first search of a session."""
    at = (a.spark.sparkContext.applicationId, a.dir)
    if at not in _BUILT:
        index = SearchIndex(a.spark, f"{shared_dir(a.spark)}/epistle/{at[0]}/documents-{uuid.uuid4().hex[:12]}")
        index.build(a.table("documents"))
        _BUILT[at] = index
    return _BUILT[at]


@query(_POSTS + "select doc_id from posts group by doc_id having bool_or(term = 'the') and (bool_or(term = 'stat') or bool_or(starts_with(term, 'clow'))) and not bool_or(term = 'from')")
def search_boolean(a):
    return search.boolean(_indexed(a).postings("the", "stat", "clow*", "from"), all_of=["the"], any_of=["stat", "clow*"], none_of=["from"])


@query(_POSTS + "select doc_id, pos::int as start from (select *, lead(term) over (partition by doc_id order by pos) as next from posts) where term = 'of' and next = 'the'")
def search_phrase(a):
    return search.phrase(_indexed(a).postings("of", "the"), ["of", "the"]).select("doc_id", F.col("start").cast("int").alias("start"))


@query(_POSTS + "select distinct a.doc_id from posts a join posts b on a.doc_id = b.doc_id and a.term = 'that' and b.term = 'stat' and abs(a.pos - b.pos) <= 11")
def search_near(a):
    return search.near(_indexed(a).postings("that", "stat"), "that", "stat")


@query(
    _POSTS
    + """, l as (select doc_id, count(*) as len from posts group by 1), s as (select count(*) as docs, avg(len) as al from l),
tf as (select doc_id, term, count(*) as tf from posts where term in ('stat', 'clown', 'the') group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select doc_id, round(sum(case when ln((docs - df + 0.5) / (df + 0.5)) > 0 then ln((docs - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) as score
from tf join df using (term) join l using (doc_id) cross join s group by doc_id"""
)
def search_bm25(a):
    return _indexed(a).bm25(["stat", "clown", "the"]).select("doc_id", F.round("score", 6).alias("score"))


_BENT = "case when item_id % 50 = 0 then '1961' || occurred[5:] when item_id % 70 = 1 then '2099' || occurred[5:] else occurred end"


def _bent(a: Archive) -> DataFrame:
    tail = F.substring("occurred", 5, 30)
    return a.items.withColumn("occurred", F.when(F.col("item_id") % 50 == 0, F.concat(F.lit("1961"), tail)).when(F.col("item_id") % 70 == 1, F.concat(F.lit("2099"), tail)).otherwise(F.col("occurred")))


@query(f", b as (select item_id, {_BENT} as occurred from items) select * from b where occurred[1:4]::int < 1970 or occurred[1:4]::int > 2025")
def implausible_dates(a):
    return integrity.implausible(_bent(a), THIS_YEAR)


@query(
    f""", b as (select item_id, {_BENT} as occurred from items), f as (select item_id, 'implausible_date' as code from b where occurred[1:4]::int < 1970 or occurred[1:4]::int > 2025)
select code, source_id, count(distinct item_id) as items from f join item_sources using (item_id) group by 1, 2 having count(distinct item_id) >= 5"""
)
def record_quality_rollup(a):
    bad = integrity.implausible(_bent(a), THIS_YEAR).select("item_id", F.lit("implausible_date").alias("code"))
    return integrity.rollup(bad, a.item_sources)


_LEDGER = """, ledger as (select 'partial_parse' as code, s_suppkey as source_id, -1::bigint as item_id, '' as period,
  case s_suppkey % 5 when 0 then 'open' when 1 then 'acknowledged' when 2 then 'resolved' when 3 then 'explained' else 'wont_fix' end as state,
  (s_suppkey % 7)::bigint as loss, '2024-01-01' as first_seen, '2024-01-02' as last_seen, case when s_suppkey % 5 = 2 then '2024-01-03' end as resolved_at, case when s_suppkey % 5 = 3 then 'known' end as note from supplier where s_suppkey % 2 = 0),
seen as (select case when s_suppkey % 11 = 0 then 'hard_gap' else 'partial_parse' end as code, s_suppkey as source_id, -1::bigint as item_id, '' as period, (s_suppkey % 9)::bigint as loss from supplier where s_suppkey % 3 = 0)
"""


def _ledger(a: Archive) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    state = F.element_at(F.array(*map(F.lit, ("open", "acknowledged", "resolved", "explained", "wont_fix"))), (k % 5 + 1).cast("int"))
    none = [F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("period")]
    ledger = a.table("supplier").where(k % 2 == 0).select(
        F.lit("partial_parse").alias("code"), k.alias("source_id"), *none, state.alias("state"), (k % 7).alias("loss"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-02").alias("last_seen"),
        F.when(k % 5 == 2, "2024-01-03").alias("resolved_at"), F.when(k % 5 == 3, "known").alias("note"),
    )
    seen = a.table("supplier").where(k % 3 == 0).select(F.when(k % 11 == 0, "hard_gap").otherwise("partial_parse").alias("code"), k.alias("source_id"), *none, (k % 9).alias("loss"))
    return ledger, seen


_UPSERT = (
    _LEDGER
    + """, merged as (select code, source_id, item_id, period,
  case when l.state is null then 'open' when s.loss is not null and l.state = 'resolved' then 'open' when s.loss is null and l.state in ('open', 'acknowledged') then 'resolved' else l.state end as state,
  case when s.loss is not null then s.loss else l.loss end as loss, coalesce(first_seen, '2024-06-01') as first_seen, case when s.loss is not null then '2024-06-01' else last_seen end as last_seen,
  case when s.loss is not null then (case when l.state <> 'resolved' then resolved_at end) when l.state in ('open', 'acknowledged') then '2024-06-01' else resolved_at end as resolved_at, note
  from ledger l full join seen s using (code, source_id, item_id, period))
"""
)


@query(_UPSERT + "select * from merged")
def findings_upsert(a):
    return integrity.upsert(*_ledger(a), "2024-06-01")


@query(_UPSERT + "select code, count(*) as findings, sum(case when loss > 0 then loss end)::bigint as estimated_missing from merged where state in ('open', 'acknowledged') group by code")
def honest_counts(a):
    return integrity.qualifiers(integrity.upsert(*_ledger(a), "2024-06-01"))


@query(
    """ select lang as kind, count(*) as files, sum(strlen(text))::bigint as bytes, count(*) filter (strlen(text) = 0) as empty, max(strlen(text))::bigint as largest, count(distinct source) as sources from documents group by lang"""
)
def inventory_summary(a):
    d = a.table("documents").withColumn("b", F.octet_length("text").cast("long"))
    return d.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.count_if(F.col("b") == 0).alias("empty"), F.max("b").alias("largest"), F.countDistinct("source").alias("sources"))


@query()
def html_to_text_pages(a):
    return a.table("pages").select("page_id", X.html_text("html").alias("text"))


@query(""" select ts::date as day, event_type as kind, count(*) as n, count(distinct user_id) as users, sum(case when value is not null then 1 else 0 end)::bigint as with_value from events group by 1, 2""")
def event_days(a):
    return a.table("events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count("value").alias("with_value"))


@query(""" select event_id, (props->>'$.k')::int as k from events where json_valid(props)""")
def json_field(a):
    return a.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")).where("k is not null")


@query(
    """, s as (select item_id, arg_min(name, struct_pack(r := role, p := person_id)) as first_person, count(*) as people from participations join people using (person_id) group by item_id)
select item_id, kind, occurred[1:10] as date, occurred[12:16] as time, subject, first_person, coalesce(people, 0) as people, coalesce(f.n, 0) as sources,
  case when f.n is null then 'no source' else '' end as data_quality
from items left join s using (item_id) left join (select item_id, count(*) as n from item_sources group by 1) f using (item_id)"""
)
def export_rows(a):
    who = a.participations.join(a.people, "person_id").groupBy("item_id").agg(F.min_by("name", F.struct("role", "person_id")).alias("first_person"), F.count("*").alias("people"))
    found = a.item_sources.groupBy("item_id").agg(F.count("*").alias("sources"))
    j = a.items.join(who, "item_id", "left").join(found, "item_id", "left")
    return j.select(
        "item_id", "kind", F.substring("occurred", 1, 10).alias("date"), F.substring("occurred", 12, 5).alias("time"), X.safe_cell(F.col("subject")).alias("subject"), "first_person",
        F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.col("sources").isNull(), "no source").otherwise("").alias("data_quality"),
    )


@query(
    """, n as (select person_id, nation as org, person_id % 500 as norm from people), i as (select norm, org, min(person_id) as k from n group by all), o as (select norm, min(k) as k from i group by norm)
select i.k as a, person_id as b, 0.9::double as confidence from n join i using (norm, org) where person_id > i.k
union all select o.k, i.k, 0.75 from i join o using (norm) where i.k > o.k"""
)
def merge_proposals_same_name(a):
    named = a.people.select("person_id", F.concat(F.lit("Dr. Pat Number"), (F.col("person_id") % 500).cast("string")).alias("name"), F.col("nation").alias("org"))
    return people.same_name(named)


@query(
    """, p as (select item_id, case when person_id between 5 and 999999999 then person_id - person_id % 4 else person_id end as person_id from participations)
select person_id, count(distinct item_id) as items from p group by 1"""
)
def merge_apply(a):
    k = F.col("c_custkey")
    chain = a.table("customer").where((k > 4) & (k % 4 != 0)).select(k.alias("loser"), (k - 1).alias("winner"))
    return people.merged(a.participations, chain).groupBy("person_id").agg(F.countDistinct("item_id").alias("items"))


@query(
    _LEDGER
    + """, d as (select s_suppkey as source_id, case when s_suppkey % 4 = 0 then 'explained' else 'open' end as new_state from supplier where s_suppkey % 7 = 0)
select code, source_id, item_id, period, coalesce(new_state, state) as state, loss, first_seen, last_seen,
case when new_state = 'explained' then '2024-07-01' when new_state is null then resolved_at end as resolved_at, case when new_state is not null then 'seen' else note end as note from ledger left join d using (source_id)"""
)
def findings_resolve(a):
    ledger, _ = _ledger(a)
    k = F.col("source_id")
    d = ledger.where(k % 7 == 0).select(*integrity.KEY, F.when(k % 4 == 0, "explained").otherwise("open").alias("new_state"), F.lit("seen").alias("new_note"))
    return ledgers.decided(ledger, d, "2024-07-01")


@query(
    """, g as (select source_id, count(*) as got from item_sources group by 1), c as (select source_id, (100 + source_id % 12) * got // 100 as claimed from g union all select 0, 7)
select source_id, claimed, coalesce(got, 0) as got, claimed - coalesce(got, 0) as loss from c left join g using (source_id) where coalesce(got, 0) < 0.95 * claimed"""
)
def partial_parse(a):
    k, n = F.col("source_id"), F.count("*")
    claims = a.item_sources.groupBy("source_id").agg(n.alias("n")).select("source_id", F.floor((k % 12 + 100) * F.col("n") / 100).alias("claimed"))
    claims = claims.union(a.spark.range(1).select("id", F.lit(7).cast("long")))
    return integrity.partial_parse(claims, a.item_sources)


@query(
    """, s as (select case when user_id % 50 = 0 then 'info@' || user_id else 'u@' || user_id end as address, event_type || '-' || event_id % 3 as name from events)
select address, count(distinct name) as names, starts_with(address, 'info@') as role from s group by 1 having count(distinct name) > 8 or starts_with(address, 'info@')"""
)
def over_merged_risk(a):
    user = F.col("user_id").cast("string")
    seen = a.table("events").select(F.concat(F.when(F.col("user_id") % 50 == 0, "info@").otherwise("u@"), user).alias("address"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("name"))
    return integrity.over_merged(seen)


_HIT = r"regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') in ('stat', 'clown')"


@query(
    rf"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents where text is not null),
h as (select *, list_position(list_transform(w, lambda x: {_HIT}), true)::int as p from d)
select doc_id, array_to_string(list_transform(w[greatest(1, p - 6):greatest(1, p - 6) + 23], lambda x: case when {_HIT} then '<mark>' || x || '</mark>' else x end), ' ') as snippet from h where p > 0"""
)
def search_snippets(a):
    return search.snippets(a.table("documents"), ["stat", "clown"])


@query(f""", t as ({_timeline(7)}), s as (select strftime(unnest(generate_series((min(period)[1:4] || '-01-01')::date, (max(period)[1:4] || '-12-31')::date, interval 1 month)), '%Y-%m') as period from t)
select period, coalesce(message, 0) as message, coalesce(event, 0) as event, coalesce(task, 0) as task, coalesce(total, 0) as total, coalesce(sources, 0) as sources from s left join t using (period)""")
def timeline_dense_month(a):
    return timeline.dense(timeline_month_rows(a), "month")


def timeline_month_rows(a: Archive) -> DataFrame:
    return timeline.timeline(a.items, a.item_sources, 7, KINDS)


@query(""" select * from (select min(year(o_orderdate))::int as first_item, (select min(1991 + s_suppkey % 5)::int from supplier) as oldest_file from orders) where first_item - oldest_file >= 3""")
def edge_truncation(a):
    files = a.table("supplier").select((F.col("s_suppkey") % 5 + 1991).alias("year"))
    return checks.edge_truncation(a.items, files, THIS_YEAR)


@query(
    _YEARS
    + """, n as (select c_custkey as source_id, (1995 + c_custkey % 7)::int as year from customer), s as (select source_id, min(year) as lo, max(year) as hi from y group by 1)
select source_id, year from n join s using (source_id) anti join y using (source_id, year) where year > lo and year < hi"""
)
def source_named_years(a):
    path = F.concat(F.lit("mail of "), (F.col("c_custkey") % 7 + 1995).cast("string"), F.lit("/"), "c_name")
    return checks.named_years(a.table("customer").select(F.col("c_custkey").alias("source_id"), path.alias("path")), a.items, _mailboxes(a))


@query(""" select c_custkey as source_id, (c_custkey % 4)::int as folders from customer where c_custkey % 4 > 0 and not exists (select 1 from orders where o_custkey = c_custkey)""")
def empty_tree(a):
    return checks.empty_tree(a.table("customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 4).cast("int").alias("folders")), _mailboxes(a))


@query(""" select l_suppkey as source_id, count(*) as a, count(distinct l_orderkey) as b from lineitem group by 1 having count(*) <> count(distinct l_orderkey) and count(*) - count(distinct l_orderkey) >= 0.02 * count(*)""")
def backend_disagreement(a):
    g = a.table("lineitem").groupBy(F.col("l_suppkey").alias("source_id"))
    return checks.backend_disagreement(g.agg(F.count("*").alias("n")), g.agg(F.countDistinct("l_orderkey").alias("n")), 0.02)


@query(""" select source_id, count(*) as failed from (select l_orderkey as item_id from lineitem where l_returnflag = 'R') join item_sources using (item_id) group by 1""")
def attachment_unreadable(a):
    files = a.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"))
    return checks.unreadable_attachments(files, a.item_sources)


@query(""" select md5(l_partkey::varchar) as content_hash, count(*) as attachments from lineitem where l_partkey not in (select p_partkey from part where p_size > 5) group by 1""")
def missing_blob(a):
    md5 = lambda c: F.md5(F.col(c).cast("string")).alias("content_hash")
    return checks.missing_blobs(a.table("lineitem").select(md5("l_partkey")), a.table("part").where("p_size > 5").select(md5("p_partkey")))


@query(
    """, r as (select c.conv_id % 20 as source_id, p.conv_id is null as orphan from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 and p.turn % 4 <> 1 where c.turn > 0)
select source_id, count(*) as replies, count(*) filter (orphan) as orphans, case when count(*) filter (orphan) / count(*) >= 0.3 then 'high' else 'medium' end as severity
from r group by 1 having orphans > 0 and (orphans >= 10 or orphans / replies >= 0.2)"""
)
def orphan_reply(a):
    c = a.table("conversations").select("conv_id", "turn")
    parents = c.where("turn % 4 <> 1").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("found"))
    return checks.orphan_reply(c.where("turn > 0").join(parents, ["conv_id", "turn"], "left").select((F.col("conv_id") % 20).alias("source_id"), F.col("found").isNull().alias("orphan")))


_OWN = "select person_id from people where nation < 8"


@query(f""" select person_id, count(*) as sent, count(*) / (select count(*) from orders) as share from participations where role = 'from' and person_id not in ({_OWN}) group by 1 having share >= 0.001""")
def self_identity_unclaimed(a):
    return checks.unclaimed_self(a.participations, a.people.where("nation < 8").select("person_id"), 0.001)


@query(
    f""", m as (select * from participations where person_id in ({_OWN})), b as (select distinct x.item_id from m x join m y using (item_id) where x.role = 'from' and y.role = 'to' and x.person_id <> y.person_id)
select source_id, count(distinct item_id) as items from b join item_sources using (item_id) group by 1"""
)
def identity_conflict(a):
    return checks.identity_conflict(a.participations, a.people.where("nation < 8").select("person_id"), a.item_sources)


@query(""" select person_id, count(distinct item_id) as items from participations where person_id % 3 = 0 and person_id % 6 <> 0 group by 1""")
def ambiguous_legacydn(a):
    k = F.col("person_id")
    raw = F.array_compact(F.array(F.when(k % 3 == 0, F.concat(F.lit("/o=Org/ou=x/cn="), "name")), F.when((k % 3 != 0) | (k % 6 == 0), F.concat(k.cast("string"), F.lit("@x.example")))))
    ids = a.people.select("person_id", F.explode(raw).alias("raw")).select("person_id", X.identity(F.col("raw")).alias("i")).select("person_id", "i.*")
    return checks.legacy_only(ids, a.participations)


_NAMED = """, n as (select person_id, 'smith' || person_id % 30 as last, nation as domain, case person_id % 5 when 0 then '' when 1 then 'p' when 2 then 'pat' when 3 then 'paula' else 'quinn' end as given from people),
f as (select last, domain, given, min(person_id) as k from n group by all),
p as (select k as a, person_id as b, 0.8::double as confidence from n join f using (last, domain, given) where person_id > k
union all select least(f.k, g.k), greatest(f.k, g.k), 0.8 from f join f g using (last, domain) where f.given = '' and g.given <> ''
union all select least(f.k, g.k), greatest(f.k, g.k), 0.7 from f join f g using (last, domain) where f.given = 'p' and g.given in ('pat', 'paula'))
"""


def _surnames(a: Archive) -> DataFrame:
    k = F.col("person_id")
    given = F.element_at(F.array(*map(F.lit, ("", "P. ", "Pat ", "Paula ", "Quinn "))), (k % 5 + 1).cast("int"))
    return people.same_surname(a.people.select("person_id", F.concat(given, F.lit("Smith"), (k % 30).cast("string")).alias("name"), F.col("nation").alias("domain")))


@query(_NAMED + "select * from p")
def merge_proposals_surname(a):
    return _surnames(a)


@query(
    _NAMED
    + """, s as (select person_id, count(distinct item_id) as items from participations group by 1)
select case when coalesce(y.items, 0) > coalesce(x.items, 0) then b else a end as keep, case when coalesce(y.items, 0) > coalesce(x.items, 0) then a else b end as merge, confidence
from p left join s x on x.person_id = a left join s y on y.person_id = b where (a + b) % 7 <> 0"""
)
def merge_queue(a):
    p = _surnames(a)
    return people.merge_queue(p, p.where("(a + b) % 7 = 0").select("a", "b"), people.statistics(a.participations, a.items))


@query(
    """ select kind, count(*) as items, min(occurred) as first_seen, max(occurred) as last_seen, count(distinct subject) as subjects, count(*) filter (not exists (select 1 from item_sources s where s.item_id = items.item_id)) as without_source
from items group by kind"""
)
def home_counts(a):
    found = a.item_sources.select("item_id").distinct().withColumn("found", F.lit(True))
    j = a.items.join(found, "item_id", "left")
    return j.groupBy("kind").agg(
        F.count("*").alias("items"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"), F.countDistinct("subject").alias("subjects"), F.count_if(F.col("found").isNull()).alias("without_source"),
    )


@query(""" select source_id, count(*) as items, min(occurred) as first_seen, max(occurred) as last_seen, count(distinct occurred[1:7]) as months from item_sources join items using (item_id) group by 1""")
def sources_summary(a):
    j = a.item_sources.join(a.items.select("item_id", "occurred"), "item_id")
    return j.groupBy("source_id").agg(F.count("*").alias("items"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"), F.countDistinct(F.substring("occurred", 1, 7)).alias("months"))


@query(
    """ select 'u' || user_id as address, count(*) as uses, count(distinct name) as names, arg_min(name, struct_pack(a := ts, n := name)) filter (name is not null) as first_name, min(ts) as first_seen, max(ts) as last_seen
from (select *, case when event_id % 4 > 0 then event_type end as name from events) group by 1"""
)
def identity_usage(a):
    seen = a.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("address"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("name"), F.col("ts").alias("at"))
    return people.identities(seen)


@query(
    _UPSERT
    + """select code, count(*) as findings, count(*) filter (state in ('open', 'acknowledged')) as open, sum(loss) filter (state in ('open', 'acknowledged') and loss > 0)::bigint as estimated_missing,
count(distinct source_id) filter (source_id >= 0) as sources from merged group by code"""
)
def findings_summary(a):
    return integrity.summary(integrity.upsert(*_ledger(a), "2024-06-01"))


@query(
    _UPSERT
    + """, t as (select source_id, count(*) as items from items join item_sources using (item_id) where kind = 'event' and occurred >= '1996-03' and occurred < '1998-01' group by 1)
select code, count(*) as findings, sum(items)::bigint as items from merged join t using (source_id) where state in ('open', 'acknowledged') group by code"""
)
def export_statement(a):
    chosen = search.selected(a.items, ["event"], "1996-03", "1997")
    return integrity.statement(chosen, a.item_sources, integrity.upsert(*_ledger(a), "2024-06-01"))


@query(
    """ select item_id, kind, occurred, subject from items where kind in ('message', 'task') and occurred >= '1997' and occurred < '1999-03-01'
and item_id in (select item_id from participations where role = 'from' and person_id in (select person_id from people where nation = 3))
order by occurred desc, item_id limit 50 offset 50"""
)
def search_filters(a):
    sent = a.participations.where("role = 'from'").join(a.people.where("nation = 3").select("person_id"), "person_id", "left_semi").select("item_id")
    chosen = search.selected(a.items, ["message", "task"], "1997", "1999-02-28", people=sent)
    return search.page(chosen, F.desc("occurred"), F.col("item_id"), offset=50, limit=50)


@query(
    """, n as (select item_id, string_agg(distinct name, ' ' order by name) as names from participations join people using (person_id) group by 1),
d as (select item_id as doc_id, regexp_extract_all(lower(subject || ' ' || coalesce(names, '')), '[\\p{L}\\p{N}]+') as t from items left join n using (item_id))
select t.term as term, count(distinct doc_id) as docs, count(*) as uses from (select doc_id, unnest(t) as term from d) t group by 1"""
)
def search_vocabulary(a):
    return search.term_counts(staged(search.documents(a.items, a.participations, a.people), "documents"))


@query()
def search_stems(a):
    """Documents and uses of each stem; no SQL function stems."""
    return search.term_counts(a.table("documents"), stem=True)


@query(
    """, f as (select l_orderkey * 10 + l_linenumber as attachment_id, case l_linenumber when 1 then ' report?.PDF' when 2 then 'photo.jpg' when 3 then '' else 'Note' end || case when l_linenumber < 4 then '' else l_orderkey::varchar end as filename from lineitem),
s as (select *, case when trim(filename) = '' then 'attachment-' || attachment_id else replace(trim(filename), '?', '_') end as safe from f), r as (select *, row_number() over (partition by lower(safe) order by attachment_id) as n from s)
select attachment_id, filename, case when n = 1 then safe when safe like '%.%' then string_split(safe, '.')[1] || ' (' || n || ').' || string_split(safe, '.')[2] else safe || ' (' || n || ')' end as copied,
md5(attachment_id::varchar)[1:2] || '/' || md5(attachment_id::varchar)[3:4] || '/' || md5(attachment_id::varchar) || case l when 1 then '.pdf' when 2 then '.jpg' else '' end as blob from (select *, attachment_id % 10 as l from r)"""
)
def attachment_copies(a):
    n = F.col("l_linenumber")
    name = F.when(n == 1, " report?.PDF").when(n == 2, "photo.jpg").when(n == 3, "").otherwise(F.concat(F.lit("Note"), F.col("l_orderkey").cast("string")))
    files = a.table("lineitem").select((F.col("l_orderkey") * 10 + n).alias("attachment_id"), name.alias("filename"))
    return sinks.copied_names(files).withColumn("blob", sinks.blob_path(F.md5(F.col("attachment_id").cast("string")), F.col("filename")))


from . import contents, deliveries, filings, reports, upkeep  # noqa: E402, F401  register their queries here
