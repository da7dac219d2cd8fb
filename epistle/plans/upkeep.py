"""Queries of the search index, of what is read next and what is edited, and of rules for stores' records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, state, threads
from ..operators.graph import shared_dir, staged
from ..operators.index import SearchIndex
from ..sources import stores
from .queries import _POSTS, query
from .reports import _SOURCES, _sources

_NEW_POSTS = _POSTS.replace("from documents", "from (select doc_id, case when doc_id % 10 = 3 then 'the clown ' || coalesce(text, '') else text end as text from documents where doc_id % 10 <> 7)")


def _index(a) -> SearchIndex:
    """All documents are indexed; then those ending in 3 are changed, those ending in 7 taken out, and the index compacted."""
    at = f"{shared_dir(a.spark)}/epistle/{a.spark.sparkContext.applicationId}/index-{uuid.uuid4().hex[:12]}"
    docs, index = a.table("documents").select("doc_id", "text"), SearchIndex(a.spark, at)
    index.build(docs)
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("the clown "), F.coalesce("text", F.lit(""))).alias("text"))
    index.update(changed, docs.where("doc_id % 10 = 7"))
    return index.compact(at + "-whole")


@query(
    _NEW_POSTS
    + """, l as (select doc_id, count(*) as len from posts group by 1), s as (select count(*) as docs, avg(len) as al from l),
tf as (select doc_id, term, count(*) as tf from posts where term in ('stat', 'clown') group by 1, 2), df as (select term, count(*) as df from tf group by 1)
select doc_id, round(sum(case when ln((docs - df + 0.5) / (df + 0.5)) > 0 then ln((docs - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) as score
from tf join df using (term) join l using (doc_id) cross join s group by doc_id"""
)
def index_bm25(a):
    return _index(a).bm25(["stat", "clown"]).select("doc_id", F.round("score", 6).alias("score"))


@query(_NEW_POSTS + "select doc_id, pos::int as start from (select *, lead(term) over (partition by doc_id order by pos) as next from posts) where term = 'the' and next = 'clown'")
def index_phrase(a):
    return search.phrase(_index(a).postings("the", "clown"), ["the", "clown"]).select("doc_id", F.col("start").cast("int").alias("start"))


@query(_NEW_POSTS + "select term, count(*) as places, count(distinct doc_id) as docs from posts where starts_with(term, 'cl') or starts_with(term, 's') group by term")
def index_prefix(a):
    return _index(a).postings("cl*", "s*").groupBy("term").agg(F.count("*").alias("places"), F.countDistinct("doc_id").alias("docs"))


_FIELDS = """, n as (select item_id, string_agg(distinct name, ' ' order by name) as people from participations join people using (person_id) where item_id % 5 <> 0 group by 1),
f as (select item_id as doc_id, regexp_extract_all(lower(subject), '[\\p{L}\\p{N}]+') as s, regexp_extract_all(lower(coalesce(people, '')), '[\\p{L}\\p{N}]+') as p from items left join n using (item_id))"""


def _fielded(a) -> SearchIndex:
    """Items by subject and by the people in them; every fifth is taken in later, without people."""
    names = a.participations.where("item_id % 5 <> 0").join(a.people.select("person_id", "name"), "person_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("people"))
    docs = staged(a.items.join(names, "item_id", "left").select(F.col("item_id").alias("doc_id"), "subject", "people"), "fielded")
    index = SearchIndex(a.spark, f"{shared_dir(a.spark)}/epistle/{a.spark.sparkContext.applicationId}/fields-{uuid.uuid4().hex[:12]}")
    index.build(docs.where("doc_id % 5 <> 0"), ["subject", "people"])
    index.update(docs.where("doc_id % 5 = 0"))
    return index


@query(_FIELDS + " select doc_id, list_contains(s, 'urgent') as in_subject, list_contains(p, 'supplier') as in_people from f where list_contains(s, 'urgent') or list_contains(p, 'supplier')")
def index_fields(a):
    """Where a word stands: in the subject, among the people."""
    i = _fielded(a)
    one, two = i.postings("urgent", field="subject").select("doc_id").distinct(), i.postings("supplier", field="people").select("doc_id").distinct()
    both = one.withColumn("in_subject", F.lit(True)).join(two.withColumn("in_people", F.lit(True)), "doc_id", "full_outer")
    return both.fillna(False, ["in_subject", "in_people"])


@query(
    _FIELDS
    + """, s as (select sum(len(s) > 0)::bigint as docs, sum(len(s)) / sum(len(s) > 0)::double as al from f), h as (select doc_id, len(s) as len, len(list_filter(s, lambda x: x = 'urgent')) as tf from f where list_contains(s, 'urgent')),
w as (select count(*) as df from h)
select doc_id, round(case when ln((docs - df + 0.5) / (df + 0.5)) > 0 then ln((docs - df + 0.5) / (df + 0.5)) else 1e-6 end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)), 6) as score from h cross join s cross join w"""
)
def index_field_bm25(a):
    """Ranked within a field, by the field's own statistics as two generations leave them."""
    return _fielded(a).bm25(["urgent"], "subject").select("doc_id", F.round("score", 6).alias("score"))


@query(_POSTS + "select doc_id, count(*) as uses from posts where term in ('license', 'licensed', 'licenses', 'licensing') group by doc_id")
def index_stems(a):
    """Documents with any form of a word, by the stem that its forms share."""
    index = SearchIndex(a.spark, f"{shared_dir(a.spark)}/epistle/{a.spark.sparkContext.applicationId}/stems-{uuid.uuid4().hex[:12]}")
    index.build(a.table("documents"), ["text"], stem=True)
    return index.postings("Licensing").groupBy("doc_id").agg(F.count("*").alias("uses"))


_TICKS = "((epoch(o_orderdate)::bigint + 11644473600) * 10000000 + 5)"


@query(
    f""" select o_orderkey as item_id, case o_orderkey % 6 when 0 then 'message' when 1 then 'event' when 2 then 'contact' when 3 then 'task' when 4 then 'note' else 'message' end as kind,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then null else strftime(make_timestamp(({_TICKS} // 10000000 - 11644473600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') end as occurred from orders"""
)
def store_records(a):
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("IPM.Note", "ipm.schedule.meeting.request", "IPM.DistList", "IPM.Task.x", "IPM.StickyNote", "Other")))
    ticks = F.when(k % 11 == 0, 0).when(k % 13 == 0, (1 << 63) - 1).otherwise((F.unix_timestamp("o_orderdate") + stores.EPOCH_1601) * 10_000_000 + 5)
    return a.table("orders").select(k.alias("item_id"), stores.kind_of(F.element_at(names, (k % 6 + 1).cast("int"))).alias("kind"), stores.instant(ticks).alias("occurred"))


@query(
    """ select s_suppkey as source_id, case s_suppkey % 5 when 0 then 'network' when 1 then 'onedrive' when 2 then 'external' when 3 then 'network' else 'local' end as container,
  case s_suppkey % 4 when 0 then null when 1 then 'offline' when 2 then 'recall-on-open' else 'offline, recall-on-data-access' end as why from supplier"""
)
def file_places(a):
    k = F.col("s_suppkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("\\\\box\\share\\", "c:/users/ann/ONEDRIVE\\", "E:\\", "n:/", "C:\\Users\\Ann\\OneDrive2\\"))), (k % 5 + 1).cast("int")), F.col("s_name"))
    bits = F.element_at(F.array(*map(F.lit, (0x20, 0x1020, 0x40000, 0x401000))), (k % 4 + 1).cast("int"))
    return a.table("supplier").select(k.alias("source_id"), stores.container_of(path, ["C:\\Users\\Ann\\OneDrive\\"], ["e:"], ["N:"]).alias("container"), stores.cloud_reason(bits).alias("why"))


@query(""" select source_id, case when source_id % 3 = 0 then 'second' else 'first' end as reader, count(*) as items from item_sources group by all""")
def reader_choice(a):
    """The first reader opens no store whose number is divisible by three."""
    read = lambda name: a.item_sources.select("source_id", "item_id", F.lit(name).alias("reader"))
    return stores.first_that_reads(read("first").where("source_id % 3 <> 0"), read("second")).groupBy("source_id", "reader").agg(F.count("*").alias("items"))


@query(_SOURCES + """, c as (select bytes from sources where placeholder and copy_path is null) select 'C:' as drive, sum(bytes)::bigint as bytes from c union all select 'D:', sum(bytes)::bigint from c""")
def download_cost(a):
    return stores.download_cost(_sources(a).where("placeholder and copy_path is null"), "d:/copies")


@query(
    _SOURCES
    + """ select source_id, path, bytes from sources where (copy_path is not null or (not placeholder and readable) or (not readable and not placeholder and ext = '.pst' and lock_error = 'PermissionError 13')) and state <> 'done'"""
)
def sources_to_read(a):
    s = _sources(a).withColumn("state", F.when(F.col("state") == "new", "parsing").otherwise(F.col("state")))
    return state.to_read(s).select("source_id", "path", "bytes")


def _left(a) -> DataFrame:
    s = _sources(a).where("state <> 'done'").select("source_id", (F.col("source_id") % 8 != 3).alias("completed"))
    return state.finished(_sources(a), s, a.items, a.item_sources).select("source_id", "state", "items", "first_item", "last_item", "parse_error")


@query(
    _SOURCES
    + """, g as (select source_id, min(occurred) as lo, max(occurred) as hi from item_sources join items using (item_id) group by 1)
select source_id, case when state = 'done' then 'done' when source_id % 8 = 3 then 'parsing' else 'done' end as state, items, case when state <> 'done' then lo end as first_item, case when state <> 'done' then hi end as last_item,
  case when state = 'done' then parse_error end as parse_error from sources left join g using (source_id)"""
)
def sources_finished(a):
    return _left(a)


@query(""" select item_id from items where not exists (select 1 from item_sources s where s.item_id = items.item_id and source_id % 4 = 1) or exists (select 1 from item_sources s where s.item_id = items.item_id and source_id % 4 <> 1)""")
def items_without_sources(a):
    """Every fourth source, taken from the sources' table, is to be read once more."""
    again = a.item_sources.where("source_id % 4 = 1").withColumn("source_id", F.lit(1))
    kept, _ = state.without_sources(a.items, again.union(a.item_sources.where("source_id % 4 <> 1")), [1])
    return kept.select("item_id")


@query(""" select l_returnflag || l_linestatus as folder_id, count(distinct l_orderkey) as items from lineitem group by 1 union all select 'empty', 0""")
def folder_counts(a):
    line = a.table("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("folder_id"), F.col("l_orderkey").alias("item_id"))
    folders = line.select("folder_id").distinct().union(a.spark.createDataFrame([("empty",)], "folder_id string"))
    return state.folder_counts(folders, line)


@query(""", n as (select * from people) select person_id, case when person_id % 3 = 0 then 'Renamed ' || person_id else name end as name, nation, person_id % 3 = 0 as confirmed from n""")
def people_edited(a):
    table = a.people.withColumn("confirmed", F.lit(False))
    edits = a.people.where("person_id % 3 < 2").select("person_id", F.when(F.col("person_id") % 3 == 0, F.concat(F.lit("Renamed "), F.col("person_id").cast("string"))).alias("name"), F.lit(None).cast("int").alias("nation"))
    return state.edited(table, edits, "person_id", "confirmed")


@query(
    """, e(name, lo, hi) as (values ('one year', '1995-01-01', '1995-12-31'), ('to a month', '0000', '1993-02-28'), ('since a day', '1997-03-05', '9999'), ('nothing', '1950-01-01', '1950-12-31'))
select name, count(item_id) as items, min(occurred[1:10]) as first, max(occurred[1:10]) as last from e left join items on occurred[1:10] >= lo and occurred[1:10] <= hi group by name"""
)
def items_in_eras(a):
    eras = [state.era("one year", "1995", "1995"), state.era("to a month", None, "1993-02"), state.era("since a day", "1997-03-05", ""), state.era("nothing", "1950", "1950")]
    return state.in_eras(a.items, a.spark.createDataFrame(eras, "name string, start string, end string"))


@query(""" select o_custkey as thread_id, count(*) as messages, min(o_orderdate)::date as first_day, max(o_orderdate)::date as last_day, arg_min(o_orderpriority, struct_pack(d := o_orderdate::date, k := o_orderkey)) as subject from orders group by 1""")
def thread_subjects(a):
    """Orders of a customer as a thread, with the subject of its first."""
    m = a.items.select("item_id", F.to_date(F.substring("occurred", 1, 10)).alias("day"), "subject")
    return threads.with_subject(m, a.table("orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("thread_id")))
