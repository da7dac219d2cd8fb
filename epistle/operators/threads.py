"""Conversation threads: chains of replies and of like subjects, as connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


# Subjects too common to link messages.
WEAK_SUBJECTS = [
    "", "hello", "hi", "hey", "thanks", "thank you", "fyi", "test", "meeting", "invoice", "update", "question", "quick question", "info", "information",
    "follow up", "reminder", "no subject", "(no subject)", "read receipt", "out of office", "автоответ", "delivery status notification",
]


def chain_links(messages: DataFrame) -> DataFrame:
    """Edges (a, b) from replies to what they answer: item_id, message_id, in_reply_to, refs; the first item with an id stands for it."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"^<|>$", "")
    known = messages.where("message_id is not null").groupBy(bare(F.col("message_id")).alias("ref")).agg(F.min("item_id").alias("b"))
    named = F.array_distinct(F.transform(F.array_compact(F.array_append(F.coalesce("refs", F.array().cast("array<string>")), F.col("in_reply_to"))), bare))
    return messages.select(F.col("item_id").alias("a"), F.explode(named).alias("ref")).join(known, "ref").where("a <> b").select("a", "b")


def subject_links(messages: DataFrame, days: int, shortest: int = 6) -> DataFrame:
    """Edges (a, b) between messages of one subject and participant within ``days`` of each other.

    ``messages``: item_id, subject, participant, day. Time is cut into spans of ``days`` + 1 days, within which any two are near
    enough: each message is linked to the smallest of its span, and a span to the next one where its last day and the next
    one's first are near enough. The components are those of all pairs, and no task has to hold a subject as a whole.
    Subjects under ``shortest`` characters or too common to mean anything link nothing, nor do undated messages.
    """
    at = ["subject", "participant", "span"]
    m = messages.where((F.length("subject") >= shortest) & ~F.col("subject").isin(WEAK_SUBJECTS) & F.col("day").isNotNull() & F.col("participant").isNotNull())
    m = m.select("item_id", "subject", "participant", "day", F.floor(F.unix_date("day") / (days + 1)).alias("span"))
    spans = m.groupBy(at).agg(F.min("item_id").alias("first"), F.min("day").alias("lo"), F.max("day").alias("hi"))
    within = m.join(spans, at).where("item_id <> first").select(F.col("item_id").alias("a"), F.col("first").alias("b"))
    before = spans.select("subject", "participant", (F.col("span") + 1).alias("span"), F.col("first").alias("b"), F.col("hi").alias("last"))
    across = spans.join(before, at).where(F.datediff("lo", "last") <= days).select(F.col("first").alias("a"), "b")
    return within.union(across)


def threads(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, thread_id): every message in one thread, alone if nothing links it; the id is its smallest item."""
    found = components(edges)
    return messages.select("item_id").distinct().join(found, F.col("item_id") == F.col("id"), "left").select("item_id", F.coalesce("root", "item_id").alias("thread_id"))


def summary(messages: DataFrame, threads_: DataFrame) -> DataFrame:
    """(thread_id, messages, first_day, last_day)."""
    j = messages.select("item_id", "day").distinct().join(threads_, "item_id")
    return j.groupBy("thread_id").agg(F.count("*").alias("messages"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def with_subject(messages: DataFrame, threads_: DataFrame) -> DataFrame:
    """``summary`` with the subject of each thread's first message (item_id, day, subject), undated ones coming last."""
    j = messages.join(threads_, "item_id")
    first = F.min_by("subject", F.struct(F.col("day").isNull(), "day", "item_id"))
    return j.groupBy("thread_id").agg(F.count("*").alias("messages"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), first.alias("subject"))
