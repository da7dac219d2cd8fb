"""Queries that write mailboxes from the documents, deliver them twice and read the archive that two refreshes leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merges
from ..operators.graph import shared_dir
from .delivery import Mailstore
from .queries import query


def folder_for(a, name: str) -> str:
    return f"{shared_dir(a.spark)}/epistle/{a.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Messages of one mailbox file.
MESSAGES = 10_000


def put_boxes(docs: DataFrame, folder: str) -> None:
    """Write (doc_id, box, subject, text) as mailboxes, in each folder ``box=N`` of ``folder`` as many files as its messages fill, in place of those that were there."""
    d = F.col("doc_id")
    head = F.format_string(
        "From x\nFrom: p%d@x.example\nTo: q%d@y.example\nSubject: %s\nMessage-ID: <%d@x.example>\nDate: %02d Mar 2001 10:%02d:00 +0000\nContent-Type: text/plain; charset=utf-8\n\n",
        d % 97, d % 89, F.col("subject"), d, d % 28 + 1, d % 60,
    )
    body = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), "\nFrom ", "\n>From ")
    files = docs.count() // MESSAGES + 1
    dealt = docs.repartition(files + 5, "box", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    boxes = dealt.select("box", F.concat(head, F.substring(body, F.lit(2), F.length(body)), F.lit("\n")).alias("value"))
    boxes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("box").text(folder)


def twice_delivered(a) -> Mailstore:
    """Boxes 0 to 4 by ids, every seventh document in a second one; then box 0 goes, box 1 is written anew and box 5 comes."""
    at, d = folder_for(a, "boxes"), F.col("doc_id")
    docs = a.table("documents").select("doc_id", "text").withColumn("subject", F.lit("first"))
    early = docs.where(d % 4 != 3)
    put_boxes(early.withColumn("box", d % 5).union(early.where(d % 7 == 0).withColumn("box", (d + 1) % 5)), at)
    store = Mailstore(a.spark, at, folder_for(a, "store"), ["message"], "*.txt")
    store.refresh()
    late = docs.withColumn("subject", F.lit("second"))
    # an empty box 0 holds one blank line and no message
    put_boxes(late.where(d % 5 == 1).withColumn("box", F.lit(1)).union(late.where((d % 4 == 3) & (d % 5 != 1)).withColumn("box", F.lit(5))), at)
    gone = a.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/box=0")
    gone.getFileSystem(a.spark._jsc.hadoopConfiguration()).delete(gone, True)
    store.refresh()
    return store


_BOXES = """, f as (select doc_id, doc_id % 5 as box, 'first' as subject from documents where doc_id % 4 <> 3 union all select doc_id, (doc_id + 1) % 5, 'first' from documents where doc_id % 4 <> 3 and doc_id % 7 = 0),
placed as (select * from f where box not in (0, 1) union all select doc_id, 1, 'second' from documents where doc_id % 5 = 1 union all select doc_id, 5, 'second' from documents where doc_id % 4 = 3 and doc_id % 5 <> 1)"""


@query(_BOXES + " select doc_id, count(*) as boxes, arg_min(subject, box) as subject from placed group by doc_id")
def second_delivery(a):
    """Each document's item after two deliveries: the boxes it lies in, and the subject in the first of them."""
    t = twice_delivered(a).tables()
    boxes = t.item_sources.groupBy("item_id").agg(F.count("*").alias("boxes"))
    return t.items.join(boxes, "item_id").select(F.regexp_extract("message_id", r"<(\d+)@", 1).cast("long").alias("doc_id"), "boxes", "subject")


@query(
    _BOXES
    + """, i as (select distinct doc_id from placed), m as (select 'p' || doc_id % 97 || '@x.example' as address, 'from' as role, doc_id from i union all select 'q' || doc_id % 89 || '@y.example', 'to', doc_id from i)
select address, count(*) as uses, min(strftime(make_timestamp(2001, 3, (doc_id % 28 + 1)::bigint, 10, (doc_id % 60)::bigint, 0), '%Y-%m-%dT%H:%M:%SZ')) as first_seen from m group by address"""
)
def delivered_people(a):
    """Addresses of the items after two deliveries, how often each is met and since when."""
    return twice_delivered(a).tables().identities.select("address", "uses", "first_seen")


_MERGED = """, c as (select c_custkey as person_id from customer),
r as (select person_id, case when person_id % 3 = 0 then person_id when person_id % 3 = 1 then case when person_id % 15 = 1 or person_id < 3 then person_id else person_id - 1 end
  else case when (person_id - 1) % 15 = 1 or person_id < 3 then person_id - 1 else person_id - 2 end end as root from c),
p as (select root, count(distinct item_id) as items, min(occurred) as first_seen, max(occurred) as last_seen from r join participations using (person_id) join items using (item_id) group by 1)
select person_id, case when root <> person_id then root end as merged_into, coalesce(case when root = person_id then items end, 0) as items, case when root = person_id then first_seen end as first_seen, case when root = person_id then last_seen end as last_seen
from r left join p using (root)"""


@query(_MERGED)
def merge_log_people(a):
    """Customers in threes, the third merged into the second and that into the first; some of the second merges are taken back later."""
    k = F.col("c_custkey")
    log = merges.MergeLog(a.spark, folder_for(a, "merges"))
    c = a.table("customer")
    log.merge(c.where((k % 3 == 2)).select(k.alias("loser"), (k - 1).alias("winner")), "2024-01-01")
    log.merge(c.where((k % 3 == 1) & (k > 3)).select(k.alias("loser"), (k - 1).alias("winner")), "2024-01-02")
    log.undo(merges.in_force(log.entries()).where("loser % 15 = 1").select("entry"), "2024-01-03")
    people = c.select(k.alias("person_id"), F.col("c_name").alias("name"), F.lit(False).alias("is_self"))
    own = a.participations.join(people.select("person_id"), "person_id", "left_semi")
    return merges.people_now(people, own, a.items, log.entries()).select("person_id", "merged_into", "items", "first_seen", "last_seen")
