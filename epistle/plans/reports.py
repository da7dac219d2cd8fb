"""Queries of the ledger, the sources' list, qualified counts and exports, over tables made of the test tables by rules that both sides state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import exports, integrity, ledger, people, search, timeline
from ..settings import Settings
from . import audit
from .queries import _CENSUS, ORACLE_SQL, _census, query

_SOURCES = """, sources as (select s_suppkey as source_id, 'C:/Mail/' || s_name || case s_suppkey % 3 when 0 then '.PST' when 1 then '.ost' else '.mbox' end as path,
  case s_suppkey % 3 when 0 then '.pst' when 1 then '.ost' else '.mbox' end as ext, s_suppkey % 5 <> 0 as readable, s_suppkey % 7 = 0 as placeholder,
  case when s_suppkey % 14 = 0 then '/copies/' || s_suppkey end as copy_path, case when s_suppkey % 10 = 0 then 'PermissionError 13' when s_suppkey % 5 = 0 then 'disk error' end as lock_error,
  case s_suppkey % 4 when 0 then 'done' when 1 then 'failed' else 'new' end as state, case s_suppkey % 8 when 1 then 'file is Encrypted' when 5 then 'bad block' end as parse_error,
  coalesce(n, 0) as items, (s_suppkey * 37) % 1000 as claimed, (s_suppkey * 7919) % 5000000 as bytes, s_nationkey::varchar as container, case when s_suppkey % 9 = 0 then 1 end as duplicate_of
  from supplier left join (select source_id, count(*) as n from item_sources group by 1) on source_id = s_suppkey)"""


def _sources(a) -> DataFrame:
    k, n = F.col("s_suppkey"), a.item_sources.groupBy("source_id").agg(F.count("*").alias("n"))
    ext = F.when(k % 3 == 0, ".pst").when(k % 3 == 1, ".ost").otherwise(".mbox")
    name = F.concat(F.lit("C:/Mail/"), F.col("s_name"), F.when(k % 3 == 0, ".PST").otherwise(ext))
    return a.table("supplier").join(n, F.col("source_id") == k, "left").select(
        k.alias("source_id"), name.alias("path"), ext.alias("ext"), (k % 5 != 0).alias("readable"), (k % 7 == 0).alias("placeholder"), F.when(k % 14 == 0, F.concat(F.lit("/copies/"), k.cast("string"))).alias("copy_path"),
        F.when(k % 10 == 0, "PermissionError 13").when(k % 5 == 0, "disk error").alias("lock_error"), F.when(k % 4 == 0, "done").when(k % 4 == 1, "failed").otherwise("new").alias("state"),
        F.when(k % 8 == 1, "file is Encrypted").when(k % 8 == 5, "bad block").alias("parse_error"), F.coalesce("n", F.lit(0)).alias("items"), ((k * 37) % 1000).alias("claimed"), ((k * 7919) % 5000000).alias("bytes"),
        F.col("s_nationkey").cast("string").alias("container"), F.when(k % 9 == 0, 1).alias("duplicate_of"),
    )


_CHECKS = (
    _SOURCES
    + """, checks as (
  select 'locked_but_read' as code, 'info' as severity, source_id, null::bigint as item_id, null::bigint as loss, lock_error as evidence from sources where not readable and not placeholder and state = 'done' and items > 0
  union all select 'read_failure', 'critical', source_id, null, null, lock_error from sources where not readable and not placeholder and not (state = 'done' and items > 0)
  union all select case when parse_error = 'file is Encrypted' then 'needs_password' else 'read_failure' end, case when parse_error = 'file is Encrypted' then 'high' else 'critical' end, source_id, null, claimed, parse_error from sources where state = 'failed'
  union all select 'orphaned_ost', 'high', source_id, null, null, path from sources where ext = '.ost' and source_id % 2 = 1
  union all select 'low_confidence_text', 'medium', null, o_orderkey, null, '0.5' from orders where o_orderkey % 40 = 0
  union all select 'implausible_date', 'medium', null, o_orderkey, null, '1961' from orders where o_orderkey % 50 = 0)
"""
)


def _families(a) -> dict:
    s = _sources(a)
    profiles = s.where("source_id % 2 = 0").select(F.concat(F.lit("D:\\other\\"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    items = a.items.withColumn("confidence", F.when(F.col("item_id") % 40 == 0, 0.5).otherwise(1.0))
    old = a.items.withColumn("occurred", F.when(F.col("item_id") % 50 == 0, "1961").otherwise(F.col("occurred")))
    late = lambda: [ledger.found(integrity.implausible(old, 2024), "implausible_date", item_id=F.col("item_id"), evidence=F.col("occurred"))]
    return {
        "corrupt": lambda: ledger.unreadable(s) + ledger.failed_parses(s) + ledger.orphaned(s, profiles),
        "quality": lambda: ledger.guessed_text(items) + late(),
        "gaps": lambda: [a.table("no_such_table")],
    }


@query(_CHECKS + "select * from checks union all select 'check_failed', 'medium', null, null, null, 'gaps'")
def check_families(a):
    """Every family's ledger rows; one family is broken on purpose and costs the others nothing."""
    rows, counts = ledger.run_checks(a.spark, _families(a))
    assert counts["gaps"] == -1
    return rows.select("code", "severity", "source_id", "item_id", "loss", F.when(F.col("code") == "check_failed", F.substring_index("evidence", ":", 1)).otherwise(F.col("evidence")).alias("evidence"))


def _ledger_rows(a) -> DataFrame:
    parts = [f for name in ("corrupt", "quality") for f in _families(a)[name]()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    k = F.coalesce("source_id", "item_id")
    state = F.when(k % 6 == 0, "acknowledged").when(k % 6 == 1, "resolved").when(k % 6 == 2, "explained").otherwise("open")
    return integrity.keyed(rows.withColumns({"state": state, "period": F.when(k % 5 == 0, "1997-03").otherwise(F.lit(None))}))


_STATES = (
    _CHECKS.rstrip()
    + """, led as (select code, severity, coalesce(source_id, -1) as source_id, coalesce(item_id, -1) as item_id, loss, case when coalesce(source_id, item_id) % 5 = 0 then '1997-03' else '' end as period,
  case coalesce(source_id, item_id) % 6 when 0 then 'acknowledged' when 1 then 'resolved' when 2 then 'explained' else 'open' end as state from checks),
opened as (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end as sr,
  case when code in ('low_confidence_text', 'implausible_date') then 'record_quality' else 'FIRST' end as class from led where state in ('open', 'acknowledged'))
""".replace("FIRST", next(iter(ledger.CLASSES)))
)


@query(_STATES + "select severity, code, class, count(*) as findings from opened group by all")
def findings_counts(a):
    return ledger.counted(_ledger_rows(a))


@query(_STATES + "select code, severity, sr as severity_rank, class, source_id, path from opened join sources using (source_id) where severity = 'critical' order by sr, code, source_id limit 500")
def findings_listed(a):
    rows = ledger.listed(_ledger_rows(a), _sources(a), a.items, severity="critical", klass=next(iter(ledger.CLASSES)))
    return search.page(rows, F.col("severity_rank"), F.col("code"), F.col("source_id")).select("code", "severity", "severity_rank", "class", "source_id", "path")


@query(
    _STATES
    + """, per as (select source_id, count(*) as findings, arg_min(severity, sr) as worst_severity, sum(loss)::bigint as loss from opened where source_id >= 0 group by 1)
select source_id, path, items, coalesce(findings, 0) as findings, worst_severity, loss, (copy_path is not null or (not placeholder and readable)) as reachable, (placeholder and copy_path is null) as cloud_only,
  (not readable and not placeholder and ext = '.pst' and lock_error = 'PermissionError 13') as locked from sources left join per using (source_id) where findings > 0 and lower(path) like '%supplier#0000%' order by bytes, source_id limit 500"""
)
def sources_listed(a):
    rows = ledger.sources_where(ledger.with_state(_sources(a), _ledger_rows(a)), problems=True, like="supplier#0000")
    rows = rows.withColumn("locked", F.coalesce("locked", F.lit(False)))
    return search.page(rows, *ledger.read_order(rows)).select("source_id", "path", "items", "findings", "worst_severity", "loss", "reachable", "cloud_only", "locked")


@query(_SOURCES + "select 'C:' as drive, count(*) as files, sum(bytes)::bigint as bytes from sources where placeholder and copy_path is null")
def cloud_bytes_by_drive(a):
    return ledger.per_drive(_sources(a))


@query(
    _STATES
    + """, q as (select * from opened where code in ('read_failure', 'needs_password') and (period = '' or (period >= '1997-01' and period <= '1997-02')))
select code, count(*) as findings, nullif(sum(coalesce(loss, 0)), 0)::bigint as loss, arg_min(severity, sr) as severity, string_agg(source_id::varchar, ',' order by source_id, item_id, period) as ids from q group by code"""
)
def count_qualifiers(a):
    q = ledger.qualifiers(_ledger_rows(a), since="1997-01", until="1997-02")
    return q.select("code", "findings", "loss", "severity", F.array_join(F.transform("ids", lambda x: x["source_id"].cast("string")), ",").alias("ids"))


@query(
    _STATES
    + """, q as (select * from opened where code in ('read_failure', 'needs_password') and source_id in (3, 5, 9, 13, 15, 25, 45, 77))
select (select count(*) from items where occurred[1:7] between '1996-01' and '1997-12' and exists (select 1 from item_sources s where s.item_id = items.item_id and s.source_id in (3, 5, 9, 13, 15, 25, 45, 77))) as value,
  count(*) filter (period = '') > 0 as qualified, nullif(sum(coalesce(loss, 0)), 0)::bigint as estimated_missing, arg_min(severity, sr) as worst_severity, string_agg(distinct code, ',' order by code) as codes from q"""
)
def honest_count_of_a_slice(a):
    return ledger.honest_count(a.items, a.item_sources, _ledger_rows(a), source_ids=[3, 5, 9, 13, 15, 25, 45, 77], since="1996-01", until="1997-12")


@query(
    _STATES
    + """select count(distinct source_id) filter (code in ('read_failure', 'needs_password')) as files, 0::bigint as gaps, 0::bigint as people, count(*) filter (class = 'record_quality') as records,
  count(*) filter (code = 'orphaned_ost') as look, coalesce(sum(loss) filter (loss > 0), 0)::bigint as loss from opened"""
)
def problems_banner(a):
    return ledger.banner(_ledger_rows(a)).drop("sentence")


@query(
    """, d as (select occurred[1:7] as month, count(*) as n from items group by 1 having count(*) > 0),
spine as (select strftime(unnest(generate_series(min(month || '-01')::date, max(month || '-01')::date, interval 1 month)), '%Y-%m') as month from d),
c as (select month, coalesce(n, 0) as n, case when month in ('1996-05', '1996-06', '1997-08') then 'hard_gap' end as gap, month in ('1996-05', '1996-06') as explained from spine left join d using (month))
select count(*) as months, count(gap) as gap_months, count(*) filter (gap is not null and explained) as explained, bool_and(gap is null or explained) as all_explained from c"""
)
def coverage_summary(a):
    months = timeline.classed(_census(a)).select("month").withColumn("gap", F.when(F.col("month").isin("1996-05", "1996-06", "1997-08"), "hard_gap"))
    told = a.spark.createDataFrame([("hard_gap", "explained", "1996-05", "1996-06"), ("hard_gap", "open", "1997-08", None)], "code string, state string, period string, period_end string")
    return ledger.coverage_summary(ledger.explained_months(months, told))


_EXPORT = """, msg as (select *, case item_id % 3 when 0 then null else 'UTC' end as tz, case when item_id % 40 = 0 then 0.5 else 1.0 end as confidence from items where kind = 'message'),
who as (select p.item_id, role, name, 'p' || p.person_id || '@x.example' as address from participations p join people using (person_id)),
files as (select item_id, string_agg('/mail/' || source_id, ' | ' order by '/mail/' || source_id) as source_file from item_sources group by 1),
f as (select item_id, min(address) filter (role = 'from') as from_address, arg_min(name, address) filter (role = 'from') as from_name, string_agg(name || ' <' || address || '>', '; ' order by address) filter (role = 'to') as tos from who group by 1)
select occurred[1:10] as date, occurred[12:16] as time, coalesce(from_name, '') as from_name, coalesce(from_address, '') as from_address, coalesce(tos, '') as "to", '' as cc, subject, 'no' as has_attachments, '' as attachment_names, '' as folder,
  coalesce(source_file, '') as source_file, '' as body_preview, '' as message_id,
  concat_ws('; ', case when tz is null then 'timezone not recorded, the exact time is uncertain' end, case when confidence < 1 then 'text encoding was guessed (confidence 50%)' end, case when item_id % 50 = 0 then 'date cannot be right, kept as found' end) as data_quality, item_id
from msg left join f using (item_id) left join files using (item_id)"""


@query(_EXPORT)
def export_messages(a):
    items = a.items.withColumns({"tz": F.when(F.col("item_id") % 3 != 0, "UTC"), "confidence": F.when(F.col("item_id") % 40 == 0, 0.5).otherwise(1.0)})
    found = a.items.where("item_id % 50 = 0").select(F.lit("implausible_date").alias("code"), F.lit("open").alias("state"), "item_id")
    who = a.participations.join(a.people, "person_id").select("item_id", "role", "name", F.concat(F.lit("p"), F.col("person_id").cast("string"), F.lit("@x.example")).alias("address"))
    files = a.item_sources.select("item_id", F.concat(F.lit("/mail/"), F.col("source_id").cast("string")).alias("path"))
    return exports.rows_of("message", items, who, files, exports.quality(items, found))


@query(
    """, e as (select item_id, occurred, strftime(o_orderdate + to_minutes((item_id % 200 - 20)::int), '%Y-%m-%dT%H:%M:%SZ') as ends, subject, (item_id * 3) % 7 as n from items join orders on o_orderkey = item_id where kind = 'event')
select item_id, ends, case when item_id % 200 >= 20 then (item_id % 200 - 20)::varchar else '' end as duration_min from e order by try_cast(nullif(case when item_id % 200 >= 20 then (item_id % 200 - 20)::varchar else '' end, '') as bigint) desc nulls last, item_id limit 500"""
)
def events_by_duration(a):
    n = F.col("item_id") % 200 - 20
    length = F.concat(F.when(n < 0, "-PT").otherwise("PT"), F.floor(F.abs(n) / 60).cast("string"), F.lit("H"), (F.abs(n) % 60).cast("string"), F.lit("M"))
    e = a.items.where("kind = 'event'").withColumn("ends", exports.end_of(F.col("occurred"), length)).withColumn("duration_min", exports.minutes(F.col("occurred"), F.col("ends")))
    return exports.ordered(e.select("item_id", "ends", "duration_min"), "duration_min", descending=True).limit(500)


@query(
    """ select 'person' as facet, person_id::varchar as value, count(distinct item_id) as n from participations group by person_id order by n desc, person_id limit 100"""
)
def facet_people(a):
    n = a.participations.groupBy("person_id").agg(F.countDistinct("item_id").alias("n"))
    return n.orderBy(F.desc("n"), "person_id").limit(100).select(F.lit("person").alias("facet"), F.col("person_id").cast("string").alias("value"), "n")


@query(""" select min(occurred) as first, max(occurred) as last, count(*) filter (occurred is null) as undated from items""")
def facet_span(a):
    return a.items.agg(F.min("occurred").alias("first"), F.max("occurred").alias("last"), F.count_if(F.col("occurred").isNull()).alias("undated"))


@query(""" select count(*) as attachments, sum(strlen(text))::bigint as bytes, count(distinct sha256(text)) as contents from documents where text is not null""")
def attachment_totals(a):
    """Documents as attachments' contents."""
    d = a.table("documents").where("text is not null").select(F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("h"))
    return d.agg(F.count("*").alias("attachments"), F.sum("bytes").alias("bytes"), F.countDistinct("h").alias("contents"))


@query(
    """, c as (select person_id, name, '{"display_name": "' || name || '", "emails": ["p' || person_id || '@x.example", "second@x.example"], "phones": {"home": "+1 ' || person_id || '"}, "addresses": {"business": {"city": "Town", "country": ""}}}' as card from people)
select person_id, name || ' p' || person_id || '@x.example second@x.example +1 ' || person_id || ' Town' as words, 'p' || person_id || '@x.example; second@x.example' as emails, '+1 ' || person_id as phone_home, '' as phone_mobile, 'Town' as address from c"""
)
def contact_cards(a):
    pid = F.col("person_id").cast("string")
    card = F.concat(
        F.lit('{"display_name": "'), "name", F.lit('", "emails": ["p'), pid, F.lit('@x.example", "second@x.example"], "phones": {"home": "+1 '), pid,
        F.lit('"}, "addresses": {"business": {"city": "Town", "country": ""}}}'),
    )
    return a.people.select("person_id", X.card_words(card).alias("words"), X.card_fields(card).alias("f")).select("person_id", "words", "f.emails", "f.phone_home", "f.phone_mobile", "f.address")



@query(
    """, l as (select distinct item_id, person_id from participations),
p as (select a.person_id, b.person_id as other_id, count(*) as shared from l a join l b using (item_id) where a.person_id <> b.person_id group by 1, 2)
select person_id, other_id, shared, rank::int as rank from (select *, row_number() over (partition by person_id order by shared desc, other_id) as rank from p) where rank <= 5"""
)
def top_partners(a):
    """Any two people of an item, whatever their roles."""
    return people.partners(a.participations, 5)


_AUDITED = f""", i as (select item_id, kind, subject, item_id % 7 <> 0 as tz_known, case when item_id % 40 = 0 then 0.5 else 1.0 end as confidence, case when item_id % 90 = 0 then 'FREQ=DAILY' end as rule,
  case when item_id % 60 = 1 then null when item_id % 80 = 2 then '1931' || occurred[5:] else occurred end as occurred from items)
{_CENSUS.replace("from items", "from i").rstrip()},
runs as (select gap from (select gap, left(month, 4)::int * 12 + right(month, 2)::int - row_number() over (partition by gap order by month) as run from classed where gap is not null) group by gap, run),
y as (select distinct source_id, occurred[1:4]::int as year from i join item_sources using (item_id) where occurred is not null), span as (select source_id, min(year) as lo, max(year) as hi from y group by 1),
holes as (select source_id, year from (select source_id, unnest(range(lo + 1, hi)) as year from span) anti join y using (source_id, year)),
q as (select 'no_date' as code, item_id from i where occurred is null union all select 'unknown_timezone', item_id from i where occurred is not null and not tz_known union all select 'implausible_date', item_id from i where occurred[1:4]::int < 1970
  union all select 'unresolved_recurrence', item_id from i where rule is not null union all select 'low_confidence_text', item_id from i where confidence < 1),
per as (select code || '_summary' as code from q join item_sources using (item_id) group by q.code, source_id having count(distinct item_id) >= 5),
every as (select code, 'medium' as severity from q union all select code, 'medium' from per union all select gap, case gap when 'hard_gap' then 'high' else 'info' end from runs union all select 'source_contradiction', 'high' from holes
  union all select 'duplicate_account_store', 'medium' from ({ORACLE_SQL["source_overlap"]}) union all select 'self_identity_unclaimed', 'medium' from ({ORACLE_SQL["self_identity_unclaimed"]}) union all select 'identity_conflict', 'high' from ({ORACLE_SQL["identity_conflict"]}))
select code, severity, count(*) as findings from every group by all"""


@query(_AUDITED)
def audit_counts(a):
    """Findings by code of the families that need no files, from one run of all of them under a user's settings."""
    k = F.col("item_id")
    bent = F.when(k % 60 == 1, None).when(k % 80 == 2, F.concat(F.lit("1931"), F.expr("substring(occurred, 5)"))).otherwise(F.col("occurred"))
    items = a.items.withColumns({"tz_known": k % 7 != 0, "confidence": F.when(k % 40 == 0, 0.5).otherwise(1.0), "rule": F.when(k % 90 == 0, "FREQ=DAILY"), "occurred": bent})
    facts = audit.Facts(items, a.item_sources, participations=a.participations, own=a.people.where("nation < 8").select("person_id"))
    wanted = Settings().changed("doubts.same_store", 0.05).changed("doubts.frequent_sender", 0.001)
    rows, counts = ledger.run_checks(a.spark, audit.families(facts, 2024, wanted))
    return rows.groupBy("code", "severity").agg(F.count("*").alias("findings"))
