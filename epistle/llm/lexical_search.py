"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

``lists`` writes one list of (document, impact) per term of the query set, partitioned by term and sorted by falling impact; a list
that holds a great part of all postings is split over several partitions. A search then takes three phases:

1. each list gives its head, the ``k`` entries of highest impact; the k-th largest sum of an item's head entries is a lower bound;
2. that bound divided by the item's number of lists is one threshold for all its lists. Each entry at or above the threshold of some
   item is sent once, to its document, where the sums of all items are built side by side; a document whose sum, with what the lists
   that did not send can still hold below the threshold, stays under the bound goes at once. The k-th largest sum raises the bound;
3. the documents that are left are looked up in every list of their item, and the exact scores ranked.

A document that no list sent has less than threshold * lists, so less than the bound: nothing is lost, ties included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, PLAIN, if_small, staged

#: Documents returned for an item.
TOP = 10
#: A list is split so that no part holds more than 1/PARTS of all postings.
PARTS = 256
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 22

POSTING = "row long, doc long, n long, term string, tf long"


def counted(text: bytes) -> Counter:
    """Occurrences of each term of a text, split chunk by chunk."""
    plain, out, at = text.translate(PLAIN), Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        out.update(plain[at:end].split())
        at = end
    return out


def postings(texts: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """(row, doc, n, term, tf) for ``texts`` of (row, doc, text as binary): one row per document and term, and one with the empty term per document that has terms.

    The empty term, which no text holds, carries the document's length. With a ``vocabulary`` only its terms are kept.
    """
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = counted(text.as_py() or b"")
                n = found.total()
                if not n:
                    continue
                terms = found.keys() if vocabulary is None else found.keys() & vocabulary
                size = len(terms) + 1
                rows[0] += [row] * size
                rows[1] += [doc] * size
                rows[2] += [n] * size
                rows[3] += ["", *(t.decode("utf-8", "replace") for t in terms)]
                rows[4] += [n, *(found[t] for t in terms)]
                if len(rows[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return texts.mapInArrow(run, POSTING)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))


def lists(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, terms, documents) over all ``docs`` for the distinct terms ``wanted`` (term, tid).

    Entries: tid, row, impact, partitioned by term and sorted by falling impact. Terms: tid, df, w. Documents: row, doc.
    """
    few = {r["term"].encode() for r in wanted.select("term").toLocalIterator()} if n_wanted <= BROADCAST_ROWS else None
    found = staged(postings(_texts(docs, id_col, text_col), few), "postings")
    whole = found.where("term = ''")
    total = whole.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = total["docs"], total["words"] or 1
    own = found.where("term <> ''").join(if_small(wanted, n_wanted), "term")
    per = own.groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    terms = staged(per.select("tid", "df", weight.alias("w")), "terms")
    share = terms.agg(F.sum("df")).first()[0] or 1
    length = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {n_words}L)")
    entry = own.join(if_small(terms, n_wanted), "tid").withColumn("m", length).select(
        "tid", "row", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)").alias("impact"), F.expr(f"pmod(xxhash64(row), 1 + df * {PARTS} div {share}L)").alias("part")
    )
    entries = staged(entry.repartition("tid", "part").sortWithinPartitions("tid", F.desc("impact")).drop("part"), "lists")
    return entries, terms, whole.select("row", "doc")


def kth(sums: DataFrame, k: int) -> DataFrame:
    """(q, bound): the k-th largest ``s`` of each q that has as many."""
    ranked = sums.select("q", "s", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"))).alias("at")).where(F.col("at") <= k)
    return ranked.groupBy("q").agg(F.max("at").alias("most"), F.min("s").alias("bound")).where(F.col("most") == k).select("q", "bound")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``items``, equal scores by ascending doc_id, null last.

    Null and empty texts have no terms: such documents match nothing, such items get no rows. Repeated rows are documents, or
    items, of their own, and an item's ranks are unique; other columns are ignored. Texts are read whole, however long.
    An empty table of documents or items gives no rows.
    """
    asked = staged(postings(_texts(items, item_col, item_text)).where("term <> ''").select(F.col("row").alias("q"), F.col("doc").alias("item"), "term"), "items")
    wanted = staged(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "wanted")
    n_wanted, n_asked = wanted.count(), asked.count()
    entries, terms, documents = lists(docs, wanted, n_wanted, id_col, text_col)

    # each item's lists; those without weight or entries add nothing
    heads = Window.partitionBy("tid").orderBy(F.desc("impact"), "row")
    head = staged(entries.withColumn("at", F.row_number().over(heads)).where(F.col("at") <= k), "heads")
    most = head.groupBy("tid").agg(F.max("impact").alias("most"))
    known = terms.where("w > 0").join(most.where("most > 0"), "tid")
    asked = staged(asked.join(if_small(wanted, n_wanted), "term").join(if_small(known, n_wanted), "tid").select("q", "item", "tid", "w", "most"), "asked")

    # phase 1: lower bounds from the heads, and one threshold for all lists of an item
    first = head.join(if_small(asked, n_asked), "tid").groupBy("q", "row").agg(F.sum(F.expr("w * impact")).alias("s"))
    per = asked.groupBy("q").agg(F.count("*").alias("lists")).join(kth(first, k), "q", "left")
    per = per.select("q", F.coalesce("bound", F.lit(1)).alias("bound"), F.expr("greatest(1L, (coalesce(bound, 1L) + lists - 1) div lists)").alias("least"))
    # what a list can still hold for a document that it did not send
    asked = staged(asked.join(if_small(per, n_asked), "q").withColumn("rest", F.expr("least(least - 1, w * most)")), "thresholds")
    rest = asked.groupBy("q").agg(F.sum("rest").alias("rests"), F.first("bound").alias("bound"))

    # phase 2: entries at or above the threshold go to their documents, each once for all items
    floor = asked.groupBy("tid").agg(F.min(F.expr("(least + w - 1) div w")).alias("lowest"))
    sent = entries.join(if_small(floor, n_wanted), "tid").where("impact >= lowest").select("tid", "row", "impact").repartition("row")
    sums = (
        sent.join(if_small(asked.select("tid", "q", "w", "least", "rest"), n_asked), "tid")
        .where("w * impact >= least")
        .groupBy("row", "q")
        .agg(F.sum(F.expr("w * impact")).alias("s"), F.sum("rest").alias("off"))
        .join(if_small(rest, n_asked), "q")
        .where("s + rests - off >= bound")
        .select("q", "row", "s", F.expr("s + rests - off").alias("up"))
    )
    sums = staged(sums, "sums")
    raised = kth(sums, k)
    left = staged(sums.join(if_small(raised, n_asked), "q", "left").where("up >= coalesce(bound, 0)").select("q", "row"), "candidates")

    # phase 3: exact scores of the candidates
    n_left = left.count()
    slim = asked.select("q", F.col("tid").alias("t"), "w")
    looked = entries.join(if_small(left, n_left), "row").join(if_small(slim.withColumnRenamed("q", "p"), n_asked), (F.col("t") == F.col("tid")) & (F.col("p") == F.col("q")))
    exact = looked.groupBy("q", "row").agg(F.sum(F.expr("w * impact")).alias("score"))
    exact = documents.join(if_small(staged(exact, "scores"), n_left), "row").where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    best = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(if_small(asked.select("q", "item").distinct(), n_asked), "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
