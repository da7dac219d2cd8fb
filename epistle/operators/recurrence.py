"""Series of events and their exceptions: which occurrence was moved, changed or cancelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(at: Column) -> Column:
    """The key of an occurrence: its instant to the minute, or its day where it has no time."""
    return F.when(F.length(at) > 10, F.substring(at, 1, 16)).otherwise(at)


def newest(events: DataFrame) -> DataFrame:
    """Of several copies of an event, or of one occurrence of a series (uid, recurrence_id), the one with the highest sequence, of equals the first by ``item_id``."""
    copies = Window.partitionBy("uid", occurrence(F.col("recurrence_id"))).orderBy(F.coalesce("sequence", F.lit(0)).desc(), "item_id")
    return events.withColumn("__n", F.row_number().over(copies)).where("__n = 1").drop("__n")


def exceptions(events: DataFrame) -> DataFrame:
    """(series_id, item_id, original, what, starts, ends): what differs from the rules of series.

    ``events``: item_id, uid, recurrence_id (null: not an occurrence of its own), sequence, starts, ends, status, rule, exdates (array).
    A master (uid with a rule) names the series. An occurrence of its own is ``cancelled`` where its status says so, ``moved`` where it
    starts at another time than it stands for, else ``changed``; days that a master excludes are ``cancelled``, without an item, unless an
    occurrence of its own stands for them. Occurrences whose master is not there have a null series and are given as they are.
    """
    e = newest(events)
    masters = e.where("recurrence_id is null and rule is not null").groupBy("uid").agg(F.min(F.struct("item_id", "starts", "exdates")).alias("m"))
    own = e.where("recurrence_id is not null").join(masters.select("uid", F.col("m.item_id").alias("series_id")), "uid", "left")
    what = F.when(F.upper("status") == "CANCELLED", "cancelled").when(occurrence(F.col("starts")) != occurrence(F.col("recurrence_id")), "moved").otherwise("changed")
    found = own.select("uid", "series_id", "item_id", F.col("recurrence_id").alias("original"), what.alias("what"), F.when(what != "cancelled", F.col("starts")).alias("starts"), F.when(what != "cancelled", F.col("ends")).alias("ends"))
    left_out = masters.select("uid", F.col("m.item_id").alias("series_id"), F.explode(F.array_distinct("m.exdates")).alias("original"))
    left_out = left_out.withColumn("key", occurrence(F.col("original"))).join(found.select("uid", occurrence(F.col("original")).alias("key")), ["uid", "key"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    gone = left_out.select("series_id", none(events.schema["item_id"].dataType).alias("item_id"), "original", F.lit("cancelled").alias("what"), none("string").alias("starts"), none("string").alias("ends"))
    return found.drop("uid").unionByName(gone)


def with_exceptions(events: DataFrame) -> DataFrame:
    """Masters (item_id, uid, rule, starts) with ``cancelled`` and ``moved``: sorted lists of the occurrences left out, and of (original, starts)."""
    x = exceptions(events).where("series_id is not null").groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("what") == "cancelled", F.col("original")))).alias("cancelled"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "moved", F.struct("original", "starts")))).alias("moved"),
    )
    masters = newest(events).where("recurrence_id is null and rule is not null").select("item_id", "uid", "rule", "starts")
    return masters.join(x, F.col("item_id") == F.col("series_id"), "left").drop("series_id")
