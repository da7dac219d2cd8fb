"""Checks of sources, accounts and files: each returns the rows that a finding would be raised for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .people import sender_share
from .timeline import plausible

# First bytes of files, the extensions they belong to, extensions of plain text,
# and the sizes below which a file of a type cannot be whole.
SIGNATURES = [
    (b"!BDN", [".pst", ".ost"]),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", [".msg"]),
    (b"\xcf\xad\x12\xfe", [".dbx"]),
    (b"JMF9", [".mbx"]),
    (b"PK\x03\x04", [".olm"]),
    (b"\x9c\xcb\xcb\x8d\x13u\xd2\x11", [".wab"]),
    (b"BEGIN:VCALENDAR", [".ics", ".vcs"]),
    (b"BEGIN:VCARD", [".vcf"]),
    (b"From ", [".mbox"]),
]
TEXTUAL = [".eml", ".mbox", ".ics", ".vcs", ".vcf"]
LEAST_BYTES = {".pst": 262144, ".ost": 262144, ".dbx": 2048, ".mbx": 1024, ".olm": 256, ".wab": 512, ".pab": 512, ".msg": 512}


def signature_of(head: Column) -> Column:
    """Extensions that the first bytes of a file speak for; null where they match no signature."""
    found = F.lit(None).cast("array<string>")
    for first, exts in reversed(SIGNATURES):
        # letters of plain text may be of either case
        same = F.upper(F.decode(head, "ISO-8859-1")).startswith(first.decode()) if first[:6] == b"BEGIN:" else F.substring(head, 1, len(first)) == F.lit(first)
        found = F.when(same, F.array(*map(F.lit, exts))).otherwise(found)
    return found


def file_checks(files: DataFrame) -> DataFrame:
    """(path, code) of files (path, ext, size, head) whose first bytes contradict their extension or that are too small to be whole."""
    sniffed = signature_of(F.col("head"))
    least = F.coalesce(*(F.when(F.col("ext") == e, n) for e, n in LEAST_BYTES.items()), F.lit(1))
    wrong = F.when(sniffed.isNotNull(), ~F.array_contains(sniffed, F.col("ext"))).otherwise(F.col("ext").isin([e for _, x in SIGNATURES for e in x]) & ~F.col("ext").isin(TEXTUAL))
    codes = F.array_compact(F.array(F.when((F.col("size") > 0) & wrong, "magic_mismatch"), F.when(F.col("size") < least, "zero_or_tiny")))
    return files.select("path", F.explode(codes).alias("code"))


def edge_truncation(items: DataFrame, files: DataFrame, this_year: int, years: int = 3, not_before: int = 1990) -> DataFrame:
    """One row (first_item, oldest_file) if the earliest plausible item is that many years younger than the oldest file (year)."""
    first = items.where(plausible(F.col("occurred"), this_year)).agg(F.min(F.substring("occurred", 1, 4).cast("int")).alias("first_item"))
    oldest = files.agg(F.min("year").cast("int").alias("oldest_file"))
    return first.join(F.broadcast(oldest), (F.col("first_item") - F.col("oldest_file") >= years) & (F.col("oldest_file") >= not_before))


def named_years(sources: DataFrame, items: DataFrame, item_sources: DataFrame) -> DataFrame:
    """(source_id, year): years that a source's path names, inside its own span, without items."""
    named = sources.select("source_id", F.explode(F.regexp_extract_all("path", F.lit(r"(?<!\d)(19[7-9]\d|20[0-4]\d)(?!\d)"), F.lit(1))).alias("year")).select("source_id", F.col("year").cast("int").alias("year")).distinct()
    years = item_sources.join(items.select("item_id", F.substring("occurred", 1, 4).cast("int").alias("year")), "item_id").select("source_id", "year").distinct()
    span = years.groupBy("source_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return named.join(span, "source_id").where("year > lo and year < hi").select("source_id", "year").join(years, ["source_id", "year"], "left_anti")


def empty_tree(sources: DataFrame, item_sources: DataFrame) -> DataFrame:
    """Sources (source_id, folders) with folders but no item at all."""
    return sources.where("folders > 0").join(item_sources, "source_id", "left_anti")


def backend_disagreement(first: DataFrame, second: DataFrame, least: float = 0.05) -> DataFrame:
    """(source_id, a, b) where two readers' counts (source_id, n) differ by that part of the larger one."""
    j = first.select("source_id", F.col("n").alias("a")).join(second.select("source_id", F.col("n").alias("b")), "source_id", "full_outer").fillna(0, ["a", "b"])
    return j.where(F.abs(F.col("a") - F.col("b")) >= least * F.greatest("a", "b")).where("a <> b")


def unreadable_attachments(attachments: DataFrame, item_sources: DataFrame) -> DataFrame:
    """(source_id, failed) of attachments (item_id, status) that could not be read."""
    return attachments.where("status = 'failed'").join(item_sources, "item_id").groupBy("source_id").agg(F.count("*").alias("failed"))


def missing_blobs(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """(content_hash, attachments) of attachments (content_hash) whose content is not among ``blobs`` (content_hash)."""
    lost = attachments.where("content_hash is not null").join(blobs, "content_hash", "left_anti")
    return lost.groupBy("content_hash").agg(F.count("*").alias("attachments"))


def orphan_reply(replies: DataFrame, least: int = 10, share: float = 0.2, high: float = 0.3) -> DataFrame:
    """(source_id, replies, orphans, severity) of replies (source_id, orphan), where orphans are many or a large part."""
    g = replies.groupBy("source_id").agg(F.count("*").alias("replies"), F.count_if("orphan").alias("orphans"))
    part = F.col("orphans") / F.col("replies")
    return g.where((F.col("orphans") > 0) & ((F.col("orphans") >= least) | (part >= share))).withColumn("severity", F.when(part >= high, "high").otherwise("medium"))


def unclaimed_self(participations: DataFrame, own: DataFrame, least: float = 0.02) -> DataFrame:
    """(person_id, sent, share) of people who sent that part of all and are not among ``own`` (person_id)."""
    return sender_share(participations, least).join(own, "person_id", "left_anti")


def identity_conflict(participations: DataFrame, own: DataFrame, item_sources: DataFrame) -> DataFrame:
    """(source_id, items) of items that one own identity sent to another."""
    mine = participations.join(own, "person_id", "left_semi")
    sent = mine.where("role = 'from'").select("item_id", F.col("person_id").alias("a"))
    got = mine.where("role <> 'from'").select("item_id", F.col("person_id").alias("b"))
    both = sent.join(got, "item_id").where("a <> b").select("item_id").distinct()
    return both.join(item_sources, "item_id").groupBy("source_id").agg(F.countDistinct("item_id").alias("items"))


def legacy_only(identities: DataFrame, participations: DataFrame) -> DataFrame:
    """(person_id, items) of people in use who have a legacy name (address_type 'ex') and no mail address."""
    kinds = identities.groupBy("person_id").agg(F.bool_or(F.col("address_type") == "ex").alias("ex"), F.bool_or(F.col("address_type") == "smtp").alias("smtp"))
    used = participations.groupBy("person_id").agg(F.countDistinct("item_id").alias("items"))
    return kinds.where("ex and not smtp").join(used, "person_id").select("person_id", "items")
