"""Folders, tags and attachments of items: what filters, facets, exports and sort keys read of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most values of a facet that a search offers; kinds are few and all given.
PEOPLE, SOURCES, FOLDERS, TAGS = 100, 100, 200, 100


def filed(items: DataFrame, folders: DataFrame | None = None, tags: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """``items`` with folder, category (tags in order), attachment_names (in order of ids), has_attachments.

    ``folders``: item_id, folder; of several the first by name. ``tags``: item_id, tag. ``attachments``: item_id,
    attachment_id, filename; one without a name counts, and adds nothing to the names. Each table is gathered by item
    first, so no join multiplies rows; what an item has nothing of is null, and has_attachments false.
    """
    per = lambda t, *c: t.groupBy("item_id").agg(*c)
    out = items
    if folders is not None:
        out = out.join(per(folders, F.min("folder").alias("folder")), "item_id", "left")
    if tags is not None:
        out = out.join(per(tags, F.array_join(F.array_sort(F.collect_set("tag")), "; ").alias("category")), "item_id", "left")
    if attachments is not None:
        named = F.array_sort(F.collect_list(F.when(F.col("filename") != "", F.struct("attachment_id", "filename"))))["filename"]
        gathered = per(attachments, F.nullif(F.array_join(named, "; "), F.lit("")).alias("attachment_names"), F.lit(True).alias("has_attachments"))
        out = out.join(gathered, "item_id", "left").withColumn("has_attachments", F.coalesce("has_attachments", F.lit(False)))
    return out


def _most(t: DataFrame, facet: str, value: str, top: int | None) -> DataFrame:
    n = t.where(F.col(value).isNotNull()).select("item_id", F.col(value).cast("string").alias("value")).distinct().groupBy("value").agg(F.count("*").alias("n"))
    n = n if top is None else n.orderBy(F.desc("n"), "value").limit(top)
    return n.select(F.lit(facet).alias("facet"), "value", "n")


def facets(items: DataFrame, participations: DataFrame, sources: DataFrame, folders: DataFrame, tags: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """(facet, value, n): items of each kind, and of the most frequent people, sources, folders and tags, ties by value; the span of dates and the undated.

    With ``selection`` (item_id) only those items count, so a search shows what its own hits can be narrowed by. The span
    is two rows, ``first`` and ``last``, whose value is the instant and whose n counts the items at it.
    """
    if selection is not None:
        ids = selection.select("item_id").distinct()
        items, participations, sources, folders, tags = (t.join(ids, "item_id", "left_semi") for t in (items, participations, sources, folders, tags))
    at = items.groupBy("occurred").agg(F.count("*").alias("n"))
    ends = at.where("occurred is not null").agg(F.min(F.struct("occurred", "n")).alias("first"), F.max(F.struct("occurred", "n")).alias("last"))
    span = ends.select(F.explode(F.array(*(F.struct(F.lit(e).alias("facet"), F.col(e)["occurred"].alias("value"), F.col(e)["n"].alias("n")) for e in ("first", "last")))).alias("r")).select("r.*").where("n is not null")
    undated = items.where("occurred is null").agg(F.count("*").alias("n")).select(F.lit("undated").alias("facet"), F.lit(None).cast("string").alias("value"), "n")
    out = _most(items, "kind", "kind", None)
    for part in (
        _most(participations, "person", "person_id", PEOPLE), _most(sources, "source", "source_id", SOURCES), _most(folders, "folder", "folder", FOLDERS), _most(tags, "tag", "tag", TAGS), span, undated,
    ):
        out = out.union(part)
    return out
