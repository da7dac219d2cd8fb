"""Queries of folders, tags and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports, filing, search
from .queries import query

_FILED = """, folders as (select o_orderkey as item_id, n_name || '/' || c_mktsegment as folder from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
lines as (select l_orderkey as item_id, l_linenumber, p_name, p_brand, l_returnflag from lineitem join part on l_partkey = p_partkey),
tags as (select distinct item_id, p_brand as tag from lines),
att as (select item_id, string_agg(p_name, '; ' order by l_linenumber, p_name) as names from lines where l_returnflag = 'R' group by 1),
cat as (select item_id, string_agg(tag, '; ' order by tag) as category from tags group by 1),
filed as (select items.*, folder, category, names from items left join folders using (item_id) left join cat using (item_id) left join att using (item_id))"""

_FACETS = """, h as (select item_id from {}),
k as (select kind, count(*) as n from items semi join h using (item_id) group by 1),
p as (select person_id::varchar as value, count(distinct item_id) as n from participations semi join h using (item_id) group by 1 order by n desc, value limit 100),
s as (select source_id::varchar as value, count(distinct item_id) as n from item_sources semi join h using (item_id) group by 1 order by n desc, value limit 100),
f as (select folder as value, count(distinct item_id) as n from folders semi join h using (item_id) group by 1 order by n desc, value limit 200),
t as (select tag as value, count(distinct item_id) as n from tags semi join h using (item_id) group by 1 order by n desc, value limit 100),
o as (select occurred, count(*) as n from items semi join h using (item_id) where occurred is not null group by 1)
select 'kind' as facet, kind as value, n from k union all select 'person', value, n from p union all select 'source', value, n from s union all select 'folder', value, n from f union all select 'tag', value, n from t
union all select 'first', occurred, n from o where occurred = (select min(occurred) from o) union all select 'last', occurred, n from o where occurred = (select max(occurred) from o)
union all select 'undated', null, (select count(*) from items semi join h using (item_id) where occurred is null)"""


def _filed(a):
    return filing.filed(a.items, a.folders, a.tags, a.attachments)


@query(_FILED + _FACETS.format("items"))
def facets_all(a):
    """What a search can be narrowed by, over the whole archive."""
    return filing.facets(a.items, a.participations, a.item_sources, a.folders, a.tags)


@query(_FILED + _FACETS.format("filed where kind = 'message' and names is not null"))
def facets_of_hits(a):
    """The same, of messages with attachments alone."""
    hits = search.selected(_filed(a), kinds=["message"], attached=True)
    return filing.facets(a.items, a.participations, a.item_sources, a.folders, a.tags, hits)


@query(_FILED + " select item_id, folder from filed where names is null and folder = 'NATION_7/BUILDING' or names is null and item_id in (select item_id from tags where tag = 'Brand#13')")
def search_filed(a):
    """Items without attachments of one folder, and those of one tag."""
    items = _filed(a)
    tagged = search.selected(items, tags=a.tags.where("tag = 'Brand#13'"), attached=False)
    return search.selected(items, folder="NATION_7/BUILDING", attached=False).union(tagged).select("item_id", "folder").distinct()


@query(
    _FILED
    + """ select item_id, coalesce(folder, '') as folder, coalesce(names, '') as attachment_names, case when names is null then 'no' else 'yes' end as has_attachments from filed where kind = 'message'"""
)
def export_filed_messages(a):
    """Messages' rows with their folders and attachments."""
    none = a.item_sources.select("item_id", F.lit("").alias("path")).limit(0)
    who = a.participations.select("item_id", "role", F.col("person_id").cast("string").alias("name"), F.lit(None).cast("string").alias("address"))
    quality = a.items.select("item_id", F.lit("").alias("data_quality"))
    return exports.rows_of("message", _filed(a), who, none, quality).select("item_id", "folder", "attachment_names", "has_attachments")


@query(_FILED + """ select item_id, names as attachment_names from filed where kind = 'task' order by lower(names) desc nulls last, item_id limit 500""")
def tasks_by_attachments(a):
    """A page of tasks by a looked-up column, blanks last."""
    tasks = _filed(a).where("kind = 'task'").select("item_id", "attachment_names")
    return exports.ordered(tasks, "attachment_names", descending=True).limit(500)
