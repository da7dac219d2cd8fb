"""An archive that is kept up to date: a run reads only files that are new or changed, and changes only what they and vanished ones touch.

The tables are those of ``ingest`` over the folder as it is, whatever the deliveries were. Records keep the file that they came from;
a run takes the keys of records that came or went, finds the first record of each of these keys again, and writes their items,
sightings, people and threads as one version of all tables (``Versions``), so that no reader sees a part of a delivery.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import staged
from ..operators.versions import Versions
from ..sources import mail
from .ingest import Ingested, conversations, dedup_key, messages_of, noted, people_in, person_id, read_all, stable_id

#: Paths up to which old records are read by a filter that the scan can use to pass over others.
FEW_PATHS = 1000
#: Layers of a table from which a run folds them into one.
MANY_LAYERS = 16


def literal(path: str) -> str:
    """A path with the characters escaped that Spark's file sources take for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class Mailstore:
    """The archive at ``path`` (shared by executors and driver) of the mail files under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, path: str, kinds: list[str] = ("message", "event", "contact"), boxes: str = mail.BOXES):
        self.spark, self.folder, self.kinds, self.boxes = spark, folder, list(kinds), boxes
        self.versions = Versions(spark, path)

    def listing(self) -> DataFrame:
        """(path, size, modified) of the files that are there now; listing reads no content."""
        patterns = ["*.{eml,olm}", self.boxes] * ("message" in self.kinds) + ["*.{ics,vcs}"] * ("event" in self.kinds) + ["*.{vcf,wab}"] * ("contact" in self.kinds)
        one = lambda glob: self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(self.folder)
        return reduce(DataFrame.union, (one(p).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified")) for p in patterns)).distinct()

    def _table(self, name: str, like: DataFrame) -> DataFrame:
        found = self.versions.table(name)
        return self.spark.createDataFrame([], like.schema) if found is None else found

    def refresh(self, stop_before: str | None = None) -> dict[str, int]:
        """Bring the archive up to date: how many files were new, changed and gone, and the records read; nothing is written if none was.

        A run that fails, or whose driver is lost, leaves the version before in force and is simply run again.
        """
        now = staged(self.listing(), "listing")
        old = self._table("files", now)
        both = now.withColumn("here", F.lit(True)).join(old.select("path", F.col("size").alias("s"), F.col("modified").alias("m")), "path", "full_outer")
        kind = F.when(F.col("here").isNull(), "gone").when(F.col("s").isNull(), "new").when((F.col("s") != F.col("size")) | (F.col("m") != F.col("modified")), "changed")
        touched = staged(both.select("path", kind.alias("what")).where("what is not null"), "touched")
        counts = {"new": 0, "changed": 0, "gone": 0} | {r["what"]: r["count"] for r in touched.groupBy("what").count().collect()}
        if not any(counts.values()):
            return counts | {"records": 0}
        generation = self.versions.version() + 1

        # the paths that are read: as long as the list of files that Spark makes of any folder that it reads
        paths = [literal(r["path"]) for r in touched.where("what <> 'gone'").select("path").collect()]
        read = read_all(self.spark, paths or self.folder, self.kinds, self.boxes)
        keyed = (read if paths else read.limit(0)).withColumn("dedup_key", F.when(F.col("error").isNull(), dedup_key(F.col("kind"))))
        keyed = keyed.withColumns({"row": F.monotonically_increasing_id(), "generation": F.lit(generation).cast("long"), "item_id": F.when(F.col("dedup_key").isNotNull(), stable_id(F.col("dedup_key")))})
        fresh = staged(keyed.repartitionByRange("path", "row").sortWithinPartitions("path", "row"), "fresh")
        records = self._table("records", fresh)
        stay = records.join(touched.select("path"), "path", "left_anti").select(fresh.columns)

        # items whose records came or went, and the first record of each now
        lost = records.join(touched.select("path"), "path", "left_semi")
        affected = staged(lost.select("item_id").union(fresh.select("item_id")).where("item_id is not null").distinct(), "affected")
        slim = ["item_id", "path", "row", "generation", "native_id"]
        holds = staged(stay.select(slim).union(fresh.select(slim)).join(affected, "item_id", "left_semi"), "holders")
        first = holds.groupBy("item_id").agg(F.min(F.struct("path", "row", "generation")).alias("f")).select("item_id", "f.*")
        items = self._table("items", fresh.drop("error"))
        same = ["item_id", "path", "row", "generation"]
        moved = staged(first.join(items.select(same), same, "left_anti"), "moved")
        dropped = affected.join(holds.select("item_id"), "item_id", "left_anti")
        replaced = staged(moved.select("item_id").union(dropped), "replaced")
        elsewhere = moved.where(F.col("generation") != generation)
        from_paths = [r["path"] for r in elsewhere.select("path").distinct().limit(FEW_PATHS + 1).collect()]
        older = stay.where(F.col("path").isin(from_paths)) if len(from_paths) <= FEW_PATHS else stay
        new_items = fresh.union(older.select(fresh.columns)).join(moved.select(same), same, "left_semi").select(fresh.columns).drop("error")
        new_items = staged(new_items, "items")
        seen = holds.groupBy("item_id", "path", F.coalesce("native_id", F.lit("")).alias("native_id")).agg(F.count("*").alias("sightings"))

        # everybody in the replaced items, and the people who were in them or are now
        heads = new_items.drop("body")
        met = people_in(heads).withColumn("person_id", person_id()).groupBy("item_id", "occurred", "role", "person_id", "address", "address_type").agg(F.count("*").alias("uses"))
        met = staged(met, "meetings")
        meetings = self._table("meetings", met)
        rest = meetings.join(replaced, "item_id", "left_anti").select(met.columns)
        persons = staged(meetings.join(replaced, "item_id", "left_semi").select("person_id").union(met.select("person_id")).distinct(), "persons")
        theirs = rest.union(met).join(persons, "person_id", "left_semi")
        identities = theirs.groupBy("person_id", "address", "address_type").agg(F.sum("uses").alias("uses"), F.min("occurred").alias("first_seen"), F.max("occurred").alias("last_seen"))

        threads, apart = self._threads(items, heads, replaced, rest, met)
        self.versions.commit(
            {
                "records": (fresh, "path", touched), "items": (new_items, "item_id", replaced), "item_sources": (seen, "item_id", affected), "meetings": (met, "item_id", replaced),
                "identities": (identities, "person_id", persons), "threads": (threads, "item_id", apart), "files": (now, "path", None),
            },
            stop_before,
        )
        if self.versions.layers("items") >= MANY_LAYERS:
            self.versions.compact()
        return counts | {"records": fresh.count()}

    def _threads(self, items: DataFrame, heads: DataFrame, replaced: DataFrame, rest: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(item_id, thread_id) of the threads that the replaced items were in or touch now, and the items that this replaces.

        A link between two messages that both stay as they were was there before, so its ends lie in one old thread: the old
        threads of replaced messages and of their neighbours, with the new messages, hold every link that can have changed.
        """
        new = messages_of(heads)
        old = messages_of(items.drop("body"))
        stays = staged(old.join(replaced, "item_id", "left_anti").select(new.columns), "messages")
        before = self._table("threads", new.select("item_id", F.col("item_id").alias("thread_id")))
        bare = lambda c: F.regexp_replace(F.trim(c), r"^<|>$", "")
        ids = F.transform(F.array_compact(F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.array("in_reply_to", "message_id"))), bare)
        tokens = lambda m: m.select("item_id", F.explode(F.array_distinct(F.array_append(F.transform(ids, lambda x: F.concat(F.lit("i"), x)), F.concat(F.lit("s"), "subject")))).alias("token")).where("token <> 's'")
        # a message that went may have stood for an id or bridged two others: its neighbours are asked too
        asked = tokens(new).union(tokens(old.join(replaced, "item_id", "left_semi").select(new.columns))).select("token").distinct()
        near = tokens(stays).join(asked, "token", "left_semi").select("item_id").union(replaced).distinct()
        whole = before.join(before.join(near, "item_id", "left_semi").select("thread_id").distinct(), "thread_id", "left_semi").select("item_id")
        apart = staged(whole.union(near).union(new.select("item_id")).distinct(), "apart")
        within = stays.union(new).join(apart, "item_id", "left_semi").select(new.columns)
        smtp = rest.union(met).where("address_type = 'smtp'").join(apart, "item_id", "left_semi").select("item_id", F.col("person_id").alias("participant")).distinct()
        return staged(conversations(within, smtp), "threads"), apart

    def tables(self, version: int | None = None) -> Ingested:
        """The archive as ``ingest`` returns it, all tables as of one version (the latest if none is named)."""
        version = self.versions.version() if version is None else version
        records, items, sources, met, people, threads = (self.versions.table(t, version) for t in ("records", "items", "item_sources", "meetings", "identities", "threads"))
        failed = records.where("dedup_key is null").select(F.lit("read_failure").alias("code"), "path", F.lit(None).cast("long").alias("item_id"))
        read = records.groupBy("path").agg(F.count("*").alias("records"), F.count_if(F.col("dedup_key").isNull()).alias("errors"))
        outcomes = read.join(sources.groupBy("path").agg(F.countDistinct("item_id").alias("items")), "path", "left").fillna(0, ["items"])
        return Ingested(items.drop("row", "generation"), sources, people, met.select("item_id", "person_id", "role").distinct(), threads, noted(items).union(failed), outcomes)
