"""Exact dedup with a heavy-hitter split (built-in functions only).

A Misra-Gries style counter summary (Spark's ``approx_top_k``, the mergeable frequent-items sketch) names
the digests that may hold more than 1/HEAVY of all rows. Their winners are computed exactly from a filtered
pre-aggregated scan and broadcast (at most HEAVY rows, whatever the input), so copies of a hot text are
decided where they are read. All other digests have few rows each and meet in an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, staged, text_of

#: At most so many digests take the broadcast path; any with over 1/HEAVY of the rows is among them.
HEAVY = 1000
#: Counters of the summary; its error is about 3.5 / 2**14 of the rows, well under 1/HEAVY.
COUNTERS = 10_000


def digest(text: str | Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(text_of(text), BLANKS, ""), 256))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept.

    Texts are equal when identical without white space; null counts as empty, and empty texts form one group.
    The longest original text stays (code points), then the smallest id, null ids last; among rows with
    equal id and length an arbitrary but fixed one stays, so exactly one row of a group is kept. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    slim = staged(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.char_length(text_of(text_col)).alias("n"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")
        ),
        "digests",
    )
    rows = slim.count()
    key = F.xxhash64("digest")
    top = slim.agg(F.expr(f"approx_top_k(xxhash64(digest), {HEAVY}, {COUNTERS})").alias("top")).select(F.explode("top").alias("t"))
    hot = top.where(F.col("t.count") > F.lit(max(rows // HEAVY, 1))).select(F.col("t.item").alias("h"))
    # longest first, then smallest id (null last), then the first row
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("u"), F.col("id").alias("id"), F.col("row").alias("row"))
    winners = slim.withColumn("h", key).join(F.broadcast(hot), "h", "left_semi").groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("size"))
    winners = F.broadcast(staged(winners, "winners"))
    heavy = slim.join(winners, "digest").select("id", "digest", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"))
    group = Window.partitionBy("digest")
    first = F.min(best).over(group)
    light = (
        slim.join(winners, "digest", "left_anti")
        .select("id", "digest", "row", first.alias("best"), F.count("*").over(group).alias("group_size"))
        .select("id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    )
    return heavy.unionByName(light).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) without dropped copies; rows equal in id and text are one document."""
    keys = ["__i", "__u", "__d"]
    of = lambda df: df.withColumns({"__i": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__u": F.col(id_col).isNull()})
    kept = of(decisions(docs, id_col, text_col).where("kept").withColumnRenamed("digest", "__d")).select(keys).distinct()
    out = of(docs).withColumns({"__d": digest(text_col), "__n": F.char_length(text_of(text_col))}).join(kept, keys, "left_semi")
    return out.withColumn("__k", F.row_number().over(Window.partitionBy(keys).orderBy(F.desc("__n")))).where("__k = 1").drop(*keys, "__n", "__k")
