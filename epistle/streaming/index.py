"""A search index that a stream of documents fills: new ones are appended, known ones passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import postings


#: Folders that ids are dealt to.
PARTS = 256


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS)).cast("int")


def fill(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the postings of a streaming table (doc_id, text) to ``path/postings`` and its ids to ``path/docs``, a folder to each batch.

    A batch that is run again overwrites its own folders, so an executor or driver lost half-way leaves nothing twice. A
    document is indexed once: those of earlier batches, and repeats within a batch, are passed over. Ids lie in folders by their hash,
    and a batch meets those of its own folders only, never postings.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(["doc_id"]).withColumn("part", part_of(F.col("doc_id")))
        if number:
            own = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS rows at most
            new = new.join(known(df, path).where((F.col("batch") < number) & F.col("part").isin(own)), "doc_id", "left_anti")
        postings(new).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        new.select("doc_id", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/docs/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def indexed(df: DataFrame, path: str) -> DataFrame:
    """Postings at ``path`` (doc_id, pos, term, batch), read in the session of ``df``."""
    return df.sparkSession.read.schema("doc_id long, pos int, term string, batch long").option("basePath", f"{path}/postings").parquet(f"{path}/postings")


def known(df: DataFrame, path: str) -> DataFrame:
    """Ids of documents at ``path`` (doc_id, batch, part), those without words too."""
    return df.sparkSession.read.schema("doc_id long, batch long, part int").option("basePath", f"{path}/docs").parquet(f"{path}/docs")


def missing(docs: DataFrame, path: str) -> DataFrame:
    """Ids of documents that the index at ``path`` lacks."""
    return docs.select("doc_id").distinct().join(known(docs, path), "doc_id", "left_anti")
