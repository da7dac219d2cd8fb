"""Rows of an export by kind, notes on each row's quality, sorting of tables, and exports that are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_cell
from ..sources import sinks
from .integrity import OPEN

# The columns of each kind of export, and what is said of an item's findings.
COLUMNS = {
    "event": [
        "date", "start", "end", "duration_min", "subject", "location", "organizer", "attendee_count", "attendees", "category", "source_file", "all_day", "timezone", "timezone_known",
        "recurring", "recurrence_rule", "meeting_status", "busy_status", "responses", "notes", "data_quality", "item_id",
    ],
    "message": ["date", "time", "from_name", "from_address", "to", "cc", "subject", "has_attachments", "attachment_names", "folder", "source_file", "body_preview", "message_id", "data_quality", "item_id"],
    "contact": [
        "display_name", "given_name", "surname", "organization", "title", "emails", "phone_business", "phone_home", "phone_mobile", "address", "first_seen", "last_seen", "item_count", "source_file", "item_id",
    ],
    "task": ["date", "due_date", "subject", "body", "importance", "folder", "source_file", "data_quality", "item_id"],
    "note": ["date", "subject", "body", "folder", "source_file", "data_quality", "item_id"],
}
NOTES = {
    "unresolved_recurrence": "repeat rule not read, only this occurrence is shown",
    "implausible_date": "date cannot be right, kept as found",
    "orphan_reply": "answers something that is not here",
    "missing_blob": "an attachment has no contents here",
}
#: Columns put together from several values, by which a table is not sorted.
GATHERED = ["to", "cc", "attendees", "data_quality", "emails", "address", "responses"]
ATTENDING = ["attendee", "optional", "resource"]


def preview(body: Column, most: int = 300) -> Column:
    """White space collapsed; at most so many characters, with an ellipsis where more follow."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def day(at: Column) -> Column:
    return F.coalesce(F.substring(at, 1, 10), F.lit(""))


def clock(at: Column) -> Column:
    return F.when(F.length(at) >= 16, F.substring(at, 12, 5)).otherwise("")


def minutes(start: Column, end: Column) -> Column:
    """Whole minutes as text; blank where an end is not known or before its start. Not known is not zero."""
    seconds = F.unix_timestamp(F.try_to_timestamp(F.substring(end, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - F.unix_timestamp(F.try_to_timestamp(F.substring(start, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(seconds >= 0, F.bround(seconds / 60).cast("long").cast("string")).otherwise("")


def days_between(start: Column, end: Column) -> Column:
    """Days with fractions, as a sort key for durations."""
    return F.expr("null").cast("double") if start is None else (F.unix_timestamp(F.try_to_timestamp(F.substring(end, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - F.unix_timestamp(F.try_to_timestamp(F.substring(start, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))) / 86400.0


def end_of(start: Column, duration: Column) -> Column:
    """The end of an event from its start and an ISO duration (weeks, days, hours, minutes, seconds; negative ones too)."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(duration, unit, 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    date, time = F.split(duration, "T")[0], r"T(?:.*\D)?(\d+)"
    total = (part(r"^[+-]?P(?:.*\D)?(\d+)W") * 7 + part(r"^[+-]?P(?:[^T]*\D)?(\d+)D")) * 86400 + part(time + "H") * 3600 + part(time + "M") * 60 + part(time + "S")
    total = F.when(date.startswith("-"), -total).otherwise(total)
    at = F.try_to_timestamp(F.substring(start, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    moved = F.date_format(F.timestamp_seconds(F.unix_timestamp(at) + total), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(duration.rlike(r"^[+-]?P"), F.concat(moved, F.when(start.endswith("Z"), "Z").otherwise("")))


def quality(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(item_id, data_quality): what is uncertain about each item (item_id, occurred, tz, confidence), '' where nothing is."""
    codes = findings.where(F.col("state").isin(OPEN) & (F.col("item_id") >= 0)).groupBy("item_id").agg(F.collect_set("code").alias("codes"))
    j = items.join(codes, "item_id", "left")
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    said = F.array(
        F.when(F.col("occurred").isNull(), "no date, in no range of dates"), F.when(F.col("occurred").isNotNull() & F.col("tz").isNull(), "timezone not recorded, the exact time is uncertain"),
        F.when(sure < 1, F.concat(F.lit("text encoding was guessed (confidence "), F.round(sure * 100).cast("int").cast("string"), F.lit("%)"))),
        *(F.when(F.array_contains("codes", c), text) for c, text in NOTES.items()),
    )
    return j.select("item_id", F.array_join(F.array_compact(said), "; ").alias("data_quality"))


def label(name: Column, address: Column) -> Column:
    return F.when(name.isNotNull() & address.isNotNull() & (name != address), F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(F.coalesce(name, address, F.lit("")))


def by_role(people: DataFrame) -> DataFrame:
    """One row an item: each role's labels in order of address, of rows (item_id, role, name, address)."""
    p = people.withColumn("label", label(F.col("name"), F.col("address")))
    listed = lambda hit: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("address", "label")))), lambda x: x["label"]), "; ")
    role = F.col("role")
    first = F.min(F.when(role == "from", F.struct("address", "name")))
    return p.groupBy("item_id").agg(
        F.coalesce(first["name"], F.lit("")).alias("from_name"), F.coalesce(first["address"], F.lit("")).alias("from_address"), listed(role == "to").alias("to"), listed(role == "cc").alias("cc"),
        F.coalesce(F.min(F.when(role == "organizer", F.struct("address", "label")))["label"], F.lit("")).alias("organizer"), F.count_if(role.isin(ATTENDING)).alias("attendee_count"), listed(role.isin(ATTENDING)).alias("attendees"),
    )


def rows_of(kind: str, items: DataFrame, people: DataFrame, sources: DataFrame, quality_: DataFrame) -> DataFrame:
    """The export's columns for items of ``kind``; what a table does not hold is blank.

    ``people``: item_id, role, name, address. ``sources``: item_id, path. Bridges are gathered by item first, so no join multiplies rows.
    """
    i = items.where(F.col("kind") == kind)
    files = sources.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("path")), " | ").alias("source_file"))
    i = i.join(files, "item_id", "left").join(quality_, "item_id", "left")
    if kind in ("message", "event"):
        i = i.join(by_role(people), "item_id", "left")
    has = lambda c: F.col(c) if c in i.columns else F.lit(None).cast("string")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    timed = ~F.coalesce(has("all_day").cast("boolean"), F.lit(False))
    at, end = F.col("occurred"), has("ends")
    made = {
        "date": day(at), "time": clock(at), "start": F.when(timed, clock(at)), "end": F.when(timed, clock(end)), "duration_min": F.when(timed, minutes(at, end)), "due_date": day(end),
        "all_day": yes(~timed), "timezone": F.coalesce(has("tz"), F.lit("unknown")), "timezone_known": yes(has("tz").isNotNull()), "recurring": yes(has("rule").isNotNull()), "recurrence_rule": has("rule"),
        "has_attachments": yes(F.coalesce(has("has_attachments").cast("boolean"), F.coalesce(has("attachment_names"), F.lit("")) != "")), "body_preview": preview(has("body")), "body": preview(has("body"), 2000), "notes": F.trim(has("body")), "first_seen": day(at),
        "display_name": F.coalesce(has("display_name"), F.col("subject")),
    }
    return i.select(*(F.col(c).alias(c) if c in ("item_id", "attendee_count") else F.coalesce(made.get(c, has(c)).cast("string"), F.lit("")).alias(c) for c in COLUMNS[kind]))


def ordered(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """``rows`` by one of their columns, looked-up ones (folder, category, attachments, source files, first sender) too: texts in any case of letters, blanks and nulls last either way, then by id."""
    if key not in rows.columns or key in GATHERED:
        raise ValueError(f"no column {key!r}")
    c = F.nullif(F.lower(key), F.lit("")) if dict(rows.dtypes)[key] == "string" else F.col(key)
    c = c.cast("long") if key == "duration_min" else c
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "item_id")


def guarded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: safe_cell(F.col(f"`{c}`")) for c, t in rows.dtypes if t == "string"})


def run_export(rows: DataFrame, path: str, form: str, selected: int) -> int:
    """Write ``rows`` as ``csv`` or ``json`` and hold the rows written against the rows selected; raises where they differ."""
    written = sinks.write_csv(rows, path) if form == "csv" else sinks.write_json(rows, rows.limit(0), path)
    if written != selected:
        raise RuntimeError(f"{written} rows written to {path} where {selected} were selected")
    return written


def export_kinds(items: DataFrame, people: DataFrame, sources: DataFrame, quality_: DataFrame, path: str, form: str = "csv", selection: DataFrame | None = None) -> dict[str, int]:
    """Write each kind's rows under ``path``, of all items or of a search's ``selection`` (item_id); rows written of each kind."""
    items = items if selection is None else items.join(selection.select("item_id").distinct(), "item_id", "left_semi")
    counts = {r["kind"]: r["count"] for r in items.groupBy("kind").count().collect()}  # one row a kind
    return {k: run_export(rows_of(k, items, people, sources, quality_), f"{path}/{k}", form, n) for k, n in sorted(counts.items()) if k in COLUMNS}
