"""Tables staged in the folder that executors and driver share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a share of a table that is grouped or sorted.
ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors and driver share; one of this machine's own only where Spark runs on it alone and none is set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="epistle-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the column ``by`` if it is named, and read it back: lineage ends there.

    Nothing reads the writing's shuffles again, so their files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/epistle/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_out(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about so many rows, dealt by ``keys`` in shares of ``ROWS``: what a task sorts or counts does not grow with the table."""
    return df.repartition(rows // ROWS + 1, *keys)


def stars_only(edges: DataFrame) -> bool:
    """Whether each node has one neighbour below it and none of those has one: the edges name their components then."""
    per = edges.groupBy("a").agg(F.count("*").alias("c"))
    tops = edges.select(F.col("b").alias("a")).distinct()
    return not per.where("c > 1").select("a").union(per.select("a").join(tops, "a", "left_semi")).take(1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (id, root), root the smallest id reachable.

    Alternating large-star and small-star steps; every step is a grouping on the edge table alone, so neither nodes
    nor edges reach the driver. The least neighbours are staged before the edges meet them: a hub's edges so come from a
    shuffle of their own, which adaptive execution splits. Ends as soon as the edges are stars.
    """
    e = staged(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    for _ in range(rounds):
        if stars_only(e):
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "edges")
        down = staged(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
