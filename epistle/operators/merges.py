"""Merges of people as an append-only log: what is in force follows from the log, and the tables keep the ids that records came with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .versions import Versions

#: entry: its number; action: merge or undo; undoes: the entry that an undo takes back.
LOG = "entry long, action string, loser long, winner long, undoes long, at string"


class MergeLog:
    """The log at ``path``, a folder that executors and driver share; each change of it is a version of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def entries(self) -> DataFrame:
        found = self.versions.table("log")
        return self.spark.createDataFrame([], LOG) if found is None else found

    def merge(self, pairs: DataFrame, at: str) -> None:
        """Append merges of ``pairs`` (loser, winner); pairs of one person with itself are left out."""
        self._append(pairs.where("loser <> winner").select(F.lit("merge").alias("action"), "loser", "winner", F.lit(None).cast("long").alias("undoes"), F.lit(at).alias("at")))

    def undo(self, entries: DataFrame, at: str) -> None:
        """Append that ``entries`` (entry) are taken back, in whatever order they were made; what is no merge in force is passed over."""
        known = in_force(self.entries()).join(entries.select("entry").distinct(), "entry", "left_semi")
        self._append(known.select(F.lit("undo").alias("action"), "loser", "winner", F.col("entry").alias("undoes"), F.lit(at).alias("at")))

    def last(self) -> int:
        """The number of the last entry, 0 if there is none."""
        return self.entries().agg(F.max("entry")).first()[0] or 0

    def _append(self, rows: DataFrame) -> None:
        # numbers rise and are not dense
        numbered = rows.withColumn("entry", F.lit(self.last() + 1) + F.monotonically_increasing_id())
        self.versions.commit({"log": (numbered.select(*(c.split()[0] for c in LOG.split(", "))), "entry", self.spark.createDataFrame([], "entry long"))})


def in_force(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The merges that hold as of an entry (the last if none is named): those that no entry so far takes back."""
    so_far = log if upto is None else log.where(F.col("entry") <= upto)
    taken = so_far.where("action = 'undo'").select(F.col("undoes").alias("entry"))
    return so_far.where("action = 'merge'").join(taken, "entry", "left_anti")


def roots(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(person_id, root) of everybody in a merge: who a chain of merges ends with, the smallest id where it ends with several or runs in a circle."""
    held = in_force(log, upto)
    groups = components(held.select(F.col("loser").alias("a"), F.col("winner").alias("b"))).select(F.col("id").alias("person_id"), F.col("root").alias("part"))
    everybody = groups.union(groups.select(F.col("part").alias("person_id"), "part")).distinct()
    lost = held.select(F.col("loser").alias("person_id")).distinct().withColumn("lost", F.lit(True))
    ends = everybody.join(lost, "person_id", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("lost", F.lit(False)).alias("lost"), "person_id"))["person_id"].alias("root"))
    return everybody.join(ends, "part").select("person_id", "root")


def repointed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``person_id`` as merges have it, and ``original_id`` as it came."""
    base = rows.withColumnRenamed("person_id", "original_id")
    return base.join(found.withColumnRenamed("person_id", "original_id"), "original_id", "left").withColumn("person_id", F.coalesce("root", "original_id")).drop("root")


def people_now(people: DataFrame, participations: DataFrame, items: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """People (person_id, name, is_self) with ``merged_into``, and for those who stand for themselves items, first and last date and self flag of all that they stand for.

    An item in which two of them took part counts once. Nothing of the tables given changes, so leaving a merge out gives what was before.
    """
    found = roots(log, upto)
    everybody = repointed(people, found)
    own = everybody.groupBy("person_id").agg(F.bool_or("is_self").alias("self_of_all"))
    links = repointed(participations.select("person_id", "item_id"), found).select("person_id", "item_id").distinct().join(items.select("item_id", "occurred"), "item_id")
    met = links.groupBy("person_id").agg(F.count("*").alias("items"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"))
    stands = F.col("original_id") == F.col("person_id")
    j = everybody.join(own, "person_id").join(met, "person_id", "left")
    return j.select(
        F.col("original_id").alias("person_id"), "name", F.when(~stands, F.col("person_id")).alias("merged_into"), F.when(stands, F.col("self_of_all")).otherwise(F.col("is_self")).alias("is_self"),
        F.when(stands, F.coalesce("items", F.lit(0))).otherwise(0).alias("items"), F.when(stands, F.col("first_seen")).alias("first_seen"), F.when(stands, F.col("last_seen")).alias("last_seen"),
    )
