"""Queries of attachments' text and of series of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recurrence
from ..operators.graph import staged
from ..operators.index import SearchIndex
from ..sources import attached
from .deliveries import folder_for
from .queries import query

_FILES = """, files as (select doc_id as attachment_id, doc_id % 300 as item_id, 'file ' || doc_id || case doc_id % 5 when 0 then '.txt' when 1 then '.TXT' when 2 then '.bin' when 3 then '.docx' else '.md' end as filename, coalesce(text, '') as t from documents),
x as (select *, case when t = '' then 'skipped' when doc % 5 = 2 then 'unsupported' when doc % 5 = 3 then 'failed' else 'done' end as status from (select *, attachment_id as doc from files))"""


def _files(a):
    """Documents as attachments: texts, some that no reader takes, some that are not what their ending says."""
    d = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".TXT", ".bin", ".docx", ".md"))), (d % 5 + 1).cast("int"))
    return a.table("documents").select(d.alias("attachment_id"), (d % 300).alias("item_id"), F.concat(F.lit("file "), d.cast("string"), ending).alias("filename"), F.col("text").cast("binary").alias("data"))


@query(_FILES + " select attachment_id, status, sha256(case when status = 'done' then t else '' end) as text_key from x")
def attachment_texts(a):
    """Status and digest of the text of every attachment."""
    return attached.extracted(attached.parts(_files(a))).select("attachment_id", "status", F.sha2("text", 256).alias("text_key"))


@query(
    _FILES
    + r""", w as (select item_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as term from x where status = 'done' union all select item_id, unnest(regexp_extract_all(lower(filename), '[\p{L}\p{N}]+')) from x)
select item_id as doc_id, count(*) as uses from w where term in ('license', 'docx') group by 1"""
)
def index_attachments(a):
    """Items by what their attachments are called and say."""
    files = _files(a)
    text = attached.extracted(attached.parts(files)).select("attachment_id", "text")
    per = files.select("attachment_id", "item_id", "filename").join(text, "attachment_id").groupBy("item_id")
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct("attachment_id", c)))[c], "\n").alias(f"{c}s")
    index = SearchIndex(a.spark, folder_for(a, "attachments"))
    docs = staged(per.agg(lines("filename"), lines("text")).withColumnRenamed("item_id", "doc_id"), "attached")
    index.build(docs, ["filenames", "texts"])
    return index.postings("license", "docx").groupBy("doc_id").agg(F.count("*").alias("uses"))


_SERIES = """, e as (select event_id, event_id // 20 as s, event_id % 20 as k, ts from events),
own as (select s * 20 as series_id, event_id as item_id, k, case k when 1 then 'moved' when 2 then 'cancelled' when 3 then 'changed' end as what,
  strftime(timestamp '2004-03-01 09:00:00' + to_days(k::int), '%Y-%m-%dT%H:%M:%SZ') as original from e where k in (1, 2, 3)),
m as (select s * 20 as series_id from e where k = 0),
gone as (select series_id, null::bigint as item_id, unnest([2, 5, 6]) as k from m)
select case when series_id in (select series_id from m) then series_id end as series_id, item_id, original, what,
  case what when 'moved' then original[1:11] || '11:30:00Z' when 'changed' then original end as starts from own
union all select series_id, item_id, strftime(timestamp '2004-03-01 09:00:00' + to_days(k::int), '%Y-%m-%dT%H:%M:%SZ'), 'cancelled', null from gone where not exists (select 1 from own where own.series_id = gone.series_id and own.k = gone.k)"""


@query(_SERIES)
def event_exceptions(a):
    """Each twenty events as a series: its master, one occurrence moved, one cancelled, one changed, and days left out."""
    k, s = F.col("event_id") % 20, F.floor(F.col("event_id") / 20)
    at = lambda n: F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2004-03-01 09:00:00")) + n * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    original = F.when(k.isin(1, 2, 3), at(k))
    e = a.table("events").where(k < 4).select(
        F.col("event_id").alias("item_id"), F.concat(F.lit("series "), s.cast("string")).alias("uid"), original.alias("recurrence_id"), F.lit(0).alias("sequence"),
        F.when(k == 0, at(k)).when(k == 1, F.concat(F.substring(original, 1, 11), F.lit("11:30:00Z"))).otherwise(original).alias("starts"), F.lit(None).cast("string").alias("ends"),
        F.when(k == 2, "cancelled").alias("status"), F.when(k == 0, "FREQ=DAILY").alias("rule"), F.when(k == 0, F.array(*(at(F.lit(n)) for n in (2, 5, 6)))).alias("exdates"),
    )
    return recurrence.exceptions(e).drop("ends")
