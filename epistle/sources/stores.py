"""Rules for records that another program took out of a mail store: classes, instants, attributes, places, choice of reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of message classes by the kind of record they stand for; all other classes are messages.
CLASSES = {
    "event": ("IPM.APPOINTMENT", "IPM.SCHEDULE.MEETING"),
    "contact": ("IPM.CONTACT", "IPM.DISTLIST"),
    "task": ("IPM.TASK",),
    "note": ("IPM.STICKYNOTE", "IPM.ACTIVITY"),
}
# File attribute bits of files whose bytes are still in the cloud.
CLOUD_BITS = {"offline": 0x1000, "recall-on-data-access": 0x400000, "recall-on-open": 0x40000}
#: Seconds from 1601 to 1970, and the last second of 2999.
EPOCH_1601, LAST = 11_644_473_600, 32_503_679_999


def kind_of(message_class: Column) -> Column:
    """The kind of a record by its class, in any case of letters; a record of an unknown class is kept as a message."""
    up = F.upper(F.coalesce(message_class, F.lit("")))
    hit = lambda kind: reduce(lambda a, b: a | b, (up.startswith(p) for p in CLASSES[kind]))
    return reduce(lambda c, kind: c.when(hit(kind), kind), list(CLASSES)[1:], F.when(hit("event"), "event")).otherwise("message")


def instant(ticks: Column) -> Column:
    """UTC text of a count of 100-nanosecond ticks since 1601; null for none, zero and what lies beyond the year 2999."""
    seconds = F.floor(ticks.cast("decimal(20,0)") / F.lit(10_000_000)).cast("long") - EPOCH_1601
    return F.when((ticks > 0) & (seconds <= LAST), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def cloud_reason(attributes: Column) -> Column:
    """Names of the attribute bits that keep a file in the cloud, joined by a comma; null for a file that is here."""
    names = F.array_compact(F.array(*(F.when(attributes.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in CLOUD_BITS.items())))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def container_of(path: Column, cloud_roots: list[str] = (), removable: list[str] = (), remote: list[str] = ()) -> Column:
    """network, onedrive, external or local, by the path; the drives that are removable or remote ('E:') are told."""
    slashed = F.lower(F.regexp_replace(path, r"\\", "/"))
    roots = [r.replace("\\", "/").rstrip("/").lower() for r in cloud_roots]
    below = reduce(lambda a, r: a | (slashed == r) | slashed.startswith(r + "/"), roots, F.lit(False))
    drive = F.substring(slashed, 1, 2)
    on = lambda drives: drive.isin([d.lower() for d in drives]) if drives else F.lit(False)
    return F.when(slashed.startswith("//"), "network").when(below, "onedrive").when(on(remote), "network").when(on(removable), "external").otherwise("local")


def first_that_reads(*readers: DataFrame) -> DataFrame:
    """Rows (source_id, ...) of the first reader that has any of a source; a later one fills in only where all before it read nothing."""
    out = readers[0]
    for r in readers[1:]:
        out = out.union(r.join(out.select("source_id").distinct(), "source_id", "left_anti").select(out.columns))
    return out


def download_cost(files: DataFrame, kept_on: str | None = None) -> DataFrame:
    """(drive, bytes) that fetching ``files`` (path, bytes) takes: on each file's own drive and once more on that of the copies."""
    drive = lambda c: F.upper(F.regexp_extract(c, r"^([A-Za-z]:|/[^/]*)", 1))
    size = F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    need = files.select(drive(F.col("path")).alias("drive"), size)
    if kept_on is not None:
        need = need.union(files.select(drive(F.lit(kept_on)), size))
    return need.groupBy("drive").agg(F.sum("bytes").alias("bytes"))
