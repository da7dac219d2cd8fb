"""A folder of mail files as a stream: each batch of new files brings the archive up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.delivery import Mailstore


def follow(store: Mailstore, checkpoint: str, **trigger) -> StreamingQuery:
    """Refresh ``store`` whenever files arrive in its folder; with no trigger named, once for all that are there.

    The stream's checkpoint keeps which files have been announced, the store's versions what was read: a batch that is run again
    finds nothing left to do, so a driver lost half-way leaves nothing twice. A file that changes under its name, or goes, is
    taken in with the next batch, as a stream of files announces names only.
    """
    spark = store.spark
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(store.folder)

    def batch(df: DataFrame, number: int) -> None:
        if df.select("path").take(1):
            store.refresh()

    return seen.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
