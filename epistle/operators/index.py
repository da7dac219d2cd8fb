"""A durable search index: postings in folders by term, documents and statistics beside them, changed by generations.

``path/postings/gen=G/bucket=B`` holds (doc_id, pos, term, field, size, len), each file the words of one share of the documents,
sorted by term: a task writes what it splits, and no posting is shuffled. ``path/docs/gen=G`` holds (doc_id, len) with a null
length for a document that was taken out, and ``path/stats/gen=G``, written last, the fields, whether terms are stems, and how
many documents and words the whole index has. The last generation of a document counts; one that ``stats`` lacks was cut short
and counts for nothing: the next writer takes its number and overwrites it.

A posting carries the length of its field and of its document, and collections' statistics are two numbers a field, so ranking
reads the postings of its terms and nothing else. Only ids that generations after the first touched are looked up in a search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.repair import stem_of, stemmed
from .graph import staged
from .search import B, K1, TOKEN, shares

#: Terms are dealt by their first letters, so that a prefix of that length reads one folder too.
BUCKETS, LETTERS = 16, 2
#: Touched ids up to which the postings that are looked up among them stay where they are.
BROADCAST_IDS = 1_000_000
#: Positions of one field lie apart from those of the next, so that no phrase reaches from one into another.
APART = 1 << 40
_DOCS, _POSTS = "doc_id long, len long, gen int", "doc_id long, pos long, term string, field string, size long, len long, gen int, bucket int"
_STATS = "field string, docs long, words long, place int, stem boolean, gen int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, LETTERS)), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """The index at ``path``, a folder that executors and driver share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, fields: list[str] = ("text",), stem: bool = False) -> None:
        """Index ``docs`` (doc_id and ``fields``) as generation 0, with ``stem`` by stems without accents.

        A null field has no words, and of rows with one id any one counts.
        """
        self._write(docs, docs.select("doc_id").limit(0), 0, list(fields), stem)

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Index ``changed`` (doc_id and the fields) anew, and take out the ids of ``removed`` (doc_id) that are not changed."""
        stats = self.statistics()
        self._write(changed, changed.select("doc_id").limit(0) if removed is None else removed.select("doc_id"), self.generation() + 1, self.fields(), stats[""]["stem"])

    def compact(self, path: str) -> SearchIndex:
        """Copy what counts to ``path`` as one generation; the old folder stays until its owner deletes it."""
        out = SearchIndex(self.spark, path)
        out._write_postings(self._counting(self._all()).drop("gen", "bucket"), 0)
        self.documents().select("doc_id", "len").write.mode("overwrite").parquet(f"{out.path}/docs/gen=0")
        out._write_stats([(f, s["docs"], s["words"], s["place"], s["stem"]) for f, s in self.statistics().items()], 0)
        return out

    def statistics(self) -> dict[str, dict]:
        """(docs, words, place, stem) of each field, and of all as field '': what the last whole generation says."""
        rows = self.spark.read.schema(_STATS).option("basePath", f"{self.path}/stats").parquet(f"{self.path}/stats").collect()  # one row a field and generation
        last = max(r["gen"] for r in rows)
        return {r["field"]: r.asDict() for r in rows if r["gen"] == last}

    def generation(self) -> int:
        return self.statistics()[""]["gen"]

    def fields(self) -> list[str]:
        stats = self.statistics()
        return sorted((f for f in stats if f), key=lambda f: stats[f]["place"])

    def documents(self) -> DataFrame:
        """(doc_id, len, gen) of every document that is in: one grouping over ids, never over postings."""
        last = self._docs().groupBy("doc_id").agg(F.max_by("len", "gen").alias("len"), F.max("gen").alias("gen"))
        return last.where("len is not null")

    def term(self, word: str) -> str:
        """How a word of a search stands in the index; a star at its end, which stands for any ending, stays."""
        if word.endswith("*") or not self.statistics()[""]["stem"]:
            return word
        return stem_of(word.lower())

    def hits(self, *terms: str, field: str | None = None) -> DataFrame:
        """(doc_id, pos, term, field, size, len) of ``terms``, a star at an end standing for any ending; only their folders are read."""
        word = lambda t: F.col("term") == t
        start = lambda t: F.col("term").startswith(t[:-1])
        at = lambda t: F.col("bucket") == bucket(F.lit(t))
        one = lambda t: (start(t) if len(t) <= LETTERS else start(t) & at(t[:-1])) if t.endswith("*") else word(t) & at(t)
        posts = self._all().where(reduce(lambda a, b: a | b, map(one, map(self.term, terms))))
        if field is not None:
            if field not in self.fields():
                raise ValueError(f"{field!r} is no field of the index; there are {', '.join(self.fields())}")
            posts = posts.where(F.col("field") == field)
        return self._counting(posts).drop("gen", "bucket")

    def postings(self, *terms: str, field: str | None = None) -> DataFrame:
        """(doc_id, pos, term) of ``hits``, for the functions of ``search``."""
        return self.hits(*terms, field=field).select("doc_id", "pos", "term")

    def bm25(self, terms: list[str], field: str | None = None) -> DataFrame:
        """(doc_id, score) of documents with any of ``terms``, in ``field`` or anywhere; statistics come from the index's own table."""
        stats = self.statistics()[field or ""]
        size = F.col("size" if field else "len")
        tf = self.hits(*terms, field=field).groupBy("doc_id", "term", size.alias("len")).agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row a term of the search
        idf = F.log((stats["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(stats["words"] / max(stats["docs"], 1))))
        return tf.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(weight).alias("score"))

    def _docs(self) -> DataFrame:
        return self._whole(self.spark.read.schema(_DOCS).option("basePath", f"{self.path}/docs").parquet(f"{self.path}/docs"))

    def _all(self) -> DataFrame:
        return self._whole(self.spark.read.schema(_POSTS).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings"))

    def _whole(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("gen") <= self.generation())

    def _counting(self, posts: DataFrame) -> DataFrame:
        """Postings of each document's last generation; ids that only the first one has are not looked up."""
        if not self.generation():
            return posts
        touched = self._docs().where("gen > 0")
        later = touched.groupBy("doc_id").agg(F.max("gen").alias("last"))
        later = F.broadcast(later) if touched.count() <= BROADCAST_IDS else later
        return posts.join(later, "doc_id", "left").where("last is null or gen = last").drop("last")

    def _write_postings(self, posts: DataFrame, gen: int) -> None:
        # each task sorts what it has: a word that all documents hold lies in every share and never in one task
        dealt = posts.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "doc_id", "pos")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")

    def _write_stats(self, rows: list[tuple], gen: int) -> None:
        kinds = _STATS.rsplit(",", 1)[0]
        self.spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/gen={gen}")

    def _write(self, docs: DataFrame, removed: DataFrame, gen: int, fields: list[str], stem: bool) -> None:
        docs = docs.select("doc_id", *fields).where("doc_id is not null")
        docs = shares(docs, *fields).dropDuplicates(["doc_id"])
        tokens = {f: F.regexp_extract_all(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(TOKEN), F.lit(0)) for f in fields}
        split = docs.select("doc_id", *(tokens[f].alias(f) for f in fields))
        whole = reduce(lambda a, b: a + b, (F.size(f) for f in fields)).cast("long")
        each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k * APART).alias("base"), F.size(f).cast("long").alias("size"), F.col(f).alias("words")) for k, f in enumerate(fields)))
        split = split.select("doc_id", whole.alias("len"), F.explode(each).alias("f")).select("doc_id", "len", "f.*")
        posts = split.select("doc_id", "base", F.posexplode("words").alias("p", "term"), "field", "size", "len").select("doc_id", (F.col("p") + F.col("base")).alias("pos"), "term", "field", "size", "len")
        self._write_postings(posts.withColumn("term", stemmed("term")) if stem else posts, gen)

        # lengths and sums come from what was written, from the first word of each field: no text is split twice
        heads = staged(self._heads(self.spark.read.schema(_POSTS).parquet(f"{self.path}/postings/gen={gen}"), fields).select("doc_id", "field", "size", "len"), "heads")
        lengths = heads.groupBy("doc_id").agg(F.first("len").alias("len"))
        ids = docs.select("doc_id").join(lengths, "doc_id", "left").fillna(0, ["len"])
        gone = removed.distinct().join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("len"))
        ids.union(gone).write.mode("overwrite").parquet(f"{self.path}/docs/gen={gen}")
        sums = self._sums(heads, fields)
        if gen:
            before = self.statistics()
            touched = self.spark.read.schema("doc_id long, len long").parquet(f"{self.path}/docs/gen={gen}").select("doc_id")
            lost = self._sums(self._counting(self._heads(self._all(), fields)).join(touched, "doc_id", "left_semi"), fields)
            sums = {f: (before[f]["docs"] + n - lost[f][0], before[f]["words"] + w - lost[f][1]) for f, (n, w) in sums.items()}
        self._write_stats([(f, *sums[f], fields.index(f) if f else -1, stem) for f in ["", *fields]], gen)

    def _heads(self, posts: DataFrame, fields: list[str]) -> DataFrame:
        """The posting of the first word of each field of each document: it carries the field's and the document's length."""
        return posts.where(F.col("pos").isin([k * APART for k in range(len(fields))]))

    def _sums(self, heads: DataFrame, fields: list[str]) -> dict[str, tuple[int, int]]:
        """Documents with words, and words, of each field and of all ('')."""
        rows = heads.groupBy("field").agg(F.count("*").alias("docs"), F.sum("size").alias("words")).collect()  # one row a field
        found = {r["field"]: (r["docs"], r["words"]) for r in rows}
        docs = heads.select("doc_id").distinct().count() if len(fields) > 1 else sum(n for n, _ in found.values())
        return {f: found.get(f, (0, 0)) for f in fields} | {"": (docs, sum(w for _, w in found.values()))}
