"""From files to the archive's tables: one item per dedup key, every sighting kept as provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import threads
from ..operators.graph import staged
from ..sources import boxes as framed
from ..sources import mail

RECORD = ["kind", "path", "native_id", "message_id", "in_reply_to", "refs", "subject", "occurred", "tz_known", "sender", "receivers", "name", "org", "phones", "body", "rule", "recurrence_id", "error", "people"]


@dataclass
class Ingested:
    """Tables of an ingest.

    ``items``: item_id, dedup_key and the record that was first by path; ``item_sources``: item_id, path, native_id, sightings;
    ``identities``: person_id, address, address_type, uses, first_seen, last_seen; ``participations``: item_id, person_id, role;
    ``threads``: item_id, thread_id; ``findings``: code, path, item_id; ``outcomes``: path, records, errors, items.
    """

    items: DataFrame
    item_sources: DataFrame
    identities: DataFrame
    participations: DataFrame
    threads: DataFrame
    findings: DataFrame
    outcomes: DataFrame


def _records(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """``df`` as records of ``kind``: ``columns`` by name, columns it has itself, the rest null."""
    types = {"refs": "array<string>", "receivers": "array<string>", "phones": "array<string>", "tz_known": "boolean", "people": "array<struct<role:string,name:string,address:string>>"}
    pick = lambda c: columns.get(c, F.col(c) if c in df.columns else F.lit(None))
    return df.select(F.lit(kind).alias("kind"), *(pick(c).cast(types.get(c, "string")).alias(c) for c in RECORD if c != "kind"))


def read_all(spark: SparkSession, path: str | list[str], kinds: list[str] = ("message", "event", "contact"), boxes: str = mail.BOXES) -> DataFrame:
    """Records of every file under ``path``, a folder or a list of files, that has a reader; readers of kinds that are not wanted do not run.

    ``boxes`` is the pattern of mailboxes' names.
    """
    parts = []
    if "message" in kinds:
        # one name for each binary box, to be left to its own reader; Spark's listing of the folder is as long
        binary = [r["path"] for r in framed.claimed(spark, path).select("path").collect()]
        text = mail.read_mbox(spark, path, boxes).where(~F.col("path").isin(binary)) if binary else mail.read_mbox(spark, path, boxes)
        readers = [mail.read_eml(spark, path), text, mail.read_olm(spark, path), *([framed.read_mbx(spark, path)] if binary else [])]
        parts += [_records(r, "message", body=F.coalesce("body", X.html_text("html"))) for r in readers]
    if "event" in kinds:
        own = {"occurred": F.col("starts"), "tz_known": F.col("tz").isNotNull(), "sender": F.col("organizer"), "receivers": F.col("attendees"), "native_id": F.col("uid")}
        parts += [_records(r(spark, path), "event", **own) for r in (mail.read_ics, mail.read_vcs)]
    if "contact" in kinds:
        parts += [_records(r(spark, path), "contact", receivers=F.col("emails")) for r in (mail.read_vcf, mail.read_wab)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dedup_key(kind: Column) -> Column:
    """SHA-256 key of a record; null for contacts with nothing to tell them by."""
    c = F.col
    empty = F.array().cast("array<string>")
    addresses = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(a, empty), X.address_key))), ",")
    subject = X.normalized_subject(c("subject"))
    uid = F.trim(c("native_id"))
    event = F.when(F.coalesce(uid, F.lit("")) != "", X.key(F.lit("event"), uid, c("recurrence_id"), c("occurred"))).otherwise(
        X.key(F.lit("event-nouid"), subject, c("occurred"), X.address_key(c("sender")))
    )
    mid = F.lower(F.regexp_replace(F.trim(c("message_id")), "^<|>$", ""))
    body = F.trim(F.regexp_replace(F.substring("body", 1, 2000), r"\s+", " "))
    message = F.when(F.coalesce(mid, F.lit("")) != "", X.key(F.lit("msgid"), mid)).otherwise(
        X.key(F.lit("msg"), X.address_key(c("sender")), addresses(c("receivers")), F.substring("occurred", 1, 16), subject, body)
    )
    folded = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    digits = F.array_join(F.array_sort(F.transform(F.coalesce(c("phones"), empty), lambda p: F.regexp_replace(p, r"\D", ""))), ",")
    known = F.concat(folded(c("name")), folded(c("org")), digits) != ""
    contact = F.when(F.size(F.coalesce("receivers", empty)) > 0, X.key(F.lit("contact"), addresses(c("receivers")))).when(
        known, X.key(F.lit("contact-noaddr"), folded(c("name")), folded(c("org")), digits)
    )
    return F.when(kind == "event", event).when(kind == "contact", contact).otherwise(message)


def stable_id(key: Column) -> Column:
    """A whole number, not negative, that is the same for a key in every run and layout (63 bits of its hash)."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1))


def person_id() -> Column:
    return stable_id(F.concat_ws("|", "address_type", "address"))


def people_in(heads: DataFrame) -> DataFrame:
    """(item_id, occurred, role, address, address_type): everybody whom the heads of items name, once for each time."""
    none = F.array().cast("array<struct<role:string,raw:string>>")
    people = F.coalesce("people", F.array().cast("array<struct<role:string,name:string,address:string>>"))
    copied = F.transform(F.filter(people, lambda p: p["role"].isin("cc", "bcc")), lambda p: F.struct(p["role"].alias("role"), p["address"].alias("raw")))
    sent = F.struct(F.when(F.col("kind") == "event", "organizer").otherwise("from").alias("role"), F.col("sender").alias("raw"))
    to = F.when(F.col("people").isNotNull(), F.transform(F.filter("people", lambda p: p["role"] == "to"), lambda p: p["address"])).otherwise(F.coalesce("receivers", F.array().cast("array<string>")))
    got = F.transform(to, lambda a: F.struct(F.when(F.col("kind") == "event", "attendee").when(F.col("kind") == "contact", "card").otherwise("to").alias("role"), a.alias("raw")))
    roles = F.concat(copied, F.when(F.col("sender").isNotNull(), F.array(sent)).otherwise(none), got)
    return heads.select("item_id", "occurred", F.explode(roles).alias("r")).select("item_id", "occurred", "r.role", X.identity(F.col("r.raw")).alias("i")).where("i.address <> ''").select("item_id", "occurred", "role", "i.*")


def messages_of(heads: DataFrame) -> DataFrame:
    """What threads are made from: item_id, message_id, in_reply_to, refs, subject, day of each message."""
    return heads.where("kind = 'message'").select("item_id", "message_id", "in_reply_to", "refs", X.normalized_subject(F.col("subject")).alias("subject"), F.to_date(F.substring("occurred", 1, 10)).alias("day"))


def conversations(messages: DataFrame, smtp: DataFrame) -> DataFrame:
    """(item_id, thread_id) of messages, linked by replies and by subjects among people (``smtp``: item_id, participant) within half a year."""
    by_subject = threads.subject_links(messages.join(smtp, "item_id"), 180)
    return threads.threads(messages, threads.chain_links(messages).union(by_subject))


def noted(heads: DataFrame) -> DataFrame:
    """(code, path, item_id): findings that an item's own record gives."""
    dated = F.col("occurred").isNotNull()
    note = F.array_compact(
        F.array(
            F.when((F.col("kind") != "contact") & ~dated, "no_date"), F.when((F.col("kind") != "contact") & dated & ~F.col("tz_known"), "unknown_timezone"),
            F.when(F.col("rule").isNotNull(), "unresolved_recurrence"),
        )
    )
    return heads.select(F.explode(note).alias("code"), "path", "item_id")


def ingest(spark: SparkSession, path: str, kinds: list[str] = ("message", "event", "contact")) -> Ingested:
    """Read everything under ``path`` into the archive's tables. Running it again gives the same keys and ids, which are hashes of keys.

    Records are written once, with a number each; of records with one key the first by path and number becomes the item,
    and only numbers and keys, never bodies, take part in finding it.
    """
    keyed = read_all(spark, path, kinds).withColumn("dedup_key", F.when(F.col("error").isNull(), dedup_key(F.col("kind")))).withColumn("row", F.monotonically_increasing_id())
    records = staged(keyed, "records")
    good = records.where("dedup_key is not null")
    first = staged(good.groupBy("dedup_key").agg(F.min(F.struct("path", "row")).alias("f")).select("dedup_key", F.col("f.row").alias("row"), stable_id(F.col("dedup_key")).alias("item_id")), "keys")
    items = good.join(first.select("row", "item_id"), "row").drop("row")
    heads = staged(items.drop("body", "attachments"), "heads")  # what people, threads and findings need, joined once
    seen = good.select("dedup_key", "path", F.coalesce("native_id", F.lit("")).alias("native_id")).join(first.drop("row"), "dedup_key")
    item_sources = seen.groupBy("item_id", "path", "native_id").agg(F.count("*").alias("sightings"))

    who = people_in(heads)
    met = who.groupBy("address", "address_type").agg(F.count("*").alias("uses"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"))
    identities = staged(met.withColumn("person_id", person_id()), "identities")
    participations = staged(who.join(identities.select("address", "address_type", "person_id"), ["address", "address_type"]).select("item_id", "person_id", "role").distinct(), "participations")

    messages = messages_of(heads)
    smtp = participations.join(identities.where("address_type = 'smtp'").select("person_id"), "person_id", "left_semi").select("item_id", F.col("person_id").alias("participant")).distinct()
    linked = conversations(messages, smtp)

    failed = records.where("dedup_key is null").select(F.lit("read_failure").alias("code"), "path", F.lit(None).cast("long").alias("item_id"))
    findings = noted(heads).union(failed)
    read = records.groupBy("path").agg(F.count("*").alias("records"), F.count_if(F.col("dedup_key").isNull()).alias("errors"))
    outcomes = read.join(item_sources.groupBy("path").agg(F.countDistinct("item_id").alias("items")), "path", "left").fillna(0, ["items"])
    return Ingested(items, item_sources, identities, participations, linked, findings, outcomes)
