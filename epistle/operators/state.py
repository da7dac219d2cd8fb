"""What a run reads next, what it leaves, and what people change by hand; every function returns the new table."""

from __future__ import annotations

import calendar
import datetime
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import locked, reachable, read_order

UNREAD = ["pending", "selected", "parsing", "failed"]


def to_read(sources: DataFrame, resume: bool = True, ids: list[int] | None = None) -> DataFrame:
    """Sources to read, smallest first: reachable ones and those a mail client holds open; on resuming not those that are done.

    A source that was left half-way (``parsing``) is read again from its start.
    """
    s = sources.where(reachable() | locked())
    s = s.where(F.col("source_id").isin(list(ids))) if ids is not None else s
    return (s.where(F.col("state").isin(UNREAD)) if resume else s).orderBy(*read_order(sources))


def finished(sources: DataFrame, read: DataFrame, items: DataFrame, item_sources: DataFrame) -> DataFrame:
    """Sources with state, items and span brought up to date for those in ``read`` (source_id, completed)."""
    links = item_sources.join(read.select("source_id"), "source_id", "left_semi").select("source_id", "item_id").distinct()
    got = links.join(items.select("item_id", "occurred"), "item_id").groupBy("source_id").agg(F.count("*").alias("got"), F.min("occurred").alias("lo"), F.max("occurred").alias("hi"))
    j = sources.join(read.select("source_id", "completed"), "source_id", "left").join(got, "source_id", "left")
    new = F.col("completed").isNotNull()
    old = lambda c, v: F.when(new, v).otherwise(F.col(c) if c in sources.columns else F.lit(None)).alias(c)
    changed = {
        "state": old("state", F.when(F.col("completed"), "done").otherwise("parsing")),
        "items": old("items", F.coalesce("got", F.lit(0))), "first_item": old("first_item", F.col("lo")), "last_item": old("last_item", F.col("hi")), "parse_error": old("parse_error", F.lit(None).cast("string")),
    }
    return j.select(*(F.col(c) for c in sources.columns if c not in changed), *changed.values())


def pending_again(sources: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Sources (all, or ``ids``) as before they were read; the inventory, notes and copies stay."""
    hit = F.lit(True) if ids is None else F.col("source_id").isin(list(ids))
    blank = {"state": F.lit("pending"), "items": F.lit(0), "parse_error": F.lit(None), "first_item": F.lit(None), "last_item": F.lit(None)}
    return sources.withColumns({c: F.when(hit, v.cast(sources.schema[c].dataType)).otherwise(F.col(c)) for c, v in blank.items() if c in sources.columns})


def without_sources(items: DataFrame, item_sources: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(items, item_sources) without what only the sources ``ids`` hold, to read these once more, by another reader say."""
    rest = item_sources.where(~F.col("source_id").isin(list(ids)))
    only = item_sources.where(F.col("source_id").isin(list(ids))).select("item_id").distinct().join(rest.select("item_id"), "item_id", "left_anti")
    return items.join(only, "item_id", "left_anti"), rest


def edited(table: DataFrame, edits: DataFrame, key: str, confirmed: str | None = None) -> DataFrame:
    """``table`` with the columns of ``edits`` (key, columns; null: unchanged) put in; ``confirmed`` names a flag set on rows with an edit."""
    names = [c for c in edits.columns if c != key]
    e = edits.select(key, *(F.col(c).alias(f"new_{c}") for c in names), F.lit(True).alias("edited"))
    some = F.coalesce(F.col("edited") & F.coalesce(*(F.col(f"new_{c}").cast("string") for c in names)).isNotNull(), F.lit(False))
    flag = lambda c: (some | F.col(c)).alias(c) if c == confirmed else F.col(c)
    return table.join(e, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in names else flag(c) for c in table.columns))


def folder_counts(folders: DataFrame, item_sources: DataFrame) -> DataFrame:
    """Folders (folder_id, ...) with ``items``, the distinct items in each, recounted from the links (folder_id, item_id)."""
    n = item_sources.where("folder_id is not null").groupBy("folder_id").agg(F.countDistinct("item_id").alias("items"))
    return folders.drop("items").join(n, "folder_id", "left").fillna(0, ["items"])


def era_date(text: str | None, last: bool = False) -> str | None:
    """A day from a year, month or day as people write it; the end of an era is its last day. Raises ValueError for anything else."""
    text = (text or "").split("T")[0].strip()
    if not text:
        return None
    if not re.fullmatch(r"\d+(-\d+){0,2}", text):
        raise ValueError(f"{text!r} is no date: write 1984, 1984-06 or 1984-06-01")
    year, *rest = text.split("-")
    if len(year) != 4:
        raise ValueError(f"write the year of {text!r} in full")
    month = int(rest[0]) if rest else 12 if last else 1
    if not 1 <= month <= 12 or int(year) < 1:
        raise ValueError(f"{text!r} has no such month")
    end = calendar.monthrange(int(year), month)[1]
    return datetime.date(int(year), month, int(rest[1]) if len(rest) > 1 else end if last else 1).isoformat()


def era(name: str, start: str | None, end: str | None) -> tuple[str, str | None, str | None]:
    """A named era with its first and last day; a row for the table of eras (name, start, end)."""
    name, start, end = name.strip(), era_date(start), era_date(end, True)
    if not name or (start and end and end < start):
        raise ValueError("an era needs a name" if not name else f"{name} ends ({end}) before it starts ({start})")
    return name, start, end


def in_eras(items: DataFrame, eras: DataFrame) -> DataFrame:
    """(name, items, first, last) for each era (name, start, end; null: open), a row for one without items too."""
    days = items.where("occurred is not null").groupBy(F.substring("occurred", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    on = (F.col("start").isNull() | (F.col("day") >= F.col("start"))) & (F.col("end").isNull() | (F.col("day") <= F.col("end")))
    # days, not items, meet the eras: a table of a few thousand rows at any size of the archive
    return eras.join(days, on, "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.min("day").alias("first"), F.max("day").alias("last"))


def month_bound(text: str | None, end: bool = False) -> str | None:
    """The month that a bound of coverage falls in; a bare year is its January, or its December as an end."""
    text = (text or "").strip()
    return None if not text else f"{text}-{'12' if end else '01'}" if len(text) == 4 else text[:7]
