"""Full text over postings (doc_id, pos, term): boolean, phrase and near queries, BM25."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repair import stemmed

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Characters of text in a share of the documents, whose words a task groups or sorts; about a sixth as many words.
SHARE = 16_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens).alias("pos", "term"))


def stems(posts: DataFrame) -> DataFrame:
    """Postings of word stems without accents; query terms are stemmed by the same function."""
    return posts.withColumn("term", stemmed("term"))


def shares(docs: DataFrame, *texts: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` dealt by id in shares of about ``SHARE`` characters of ``texts``, so that no task's words grow with the table."""
    chars = docs.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.length(t), F.lit(0)) for t in texts)).cast("long"))).first()[0] or 0
    return docs.repartition(chars // SHARE + 1, id_col)


def term_counts(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(term, docs, uses): documents with each term (or stem) of ``docs`` (doc_id, text), and its places.

    Words meet within the shares of their documents, so only a share's vocabulary is shuffled.
    """
    uses = postings(shares(docs.select("doc_id", "text"), "text")).groupBy("doc_id", "term").agg(F.count("*").alias("uses"))
    if stem:
        uses = stems(uses).groupBy("doc_id", "term").agg(F.sum("uses").alias("uses"))
    return uses.groupBy("term").agg(F.count("doc_id").alias("docs"), F.sum("uses").alias("uses"))


def documents(items: DataFrame, participations: DataFrame, people: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, text): subject, names of everybody in it and the body of each item, whole unless ``cap`` bounds its characters."""
    names = participations.join(people.select("person_id", "name"), "person_id").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    body = (F.substring("body", 1, cap) if cap else F.col("body")) if "body" in items.columns else F.lit(None)
    return items.join(names, "item_id", "left").select(F.col("item_id").alias("doc_id"), F.concat_ws("\n", "subject", "names", body).alias("text"))


def bounds(since: str | None, until: str | None) -> tuple[str | None, str | None]:
    """First instant and the one after the last of a range given by years, months or days ('1999', '1999-07', '1999-07-31')."""

    def after(d: str) -> str:
        parts = [int(x) for x in d.split("-")]
        if len(parts) == 1:
            return f"{parts[0] + 1:04d}"
        if len(parts) == 2:
            return f"{parts[0] + parts[1] // 12:04d}-{parts[1] % 12 + 1:02d}"
        return str(datetime.date(*parts) + datetime.timedelta(1))

    return since, until and after(until)


def selected(items: DataFrame, kinds: list[str] = (), since: str | None = None, until: str | None = None, undated: bool = False, people: DataFrame | None = None, sources: DataFrame | None = None,
             folder: str | None = None, tags: DataFrame | None = None, attached: bool | None = None) -> DataFrame:
    """Items of these kinds and dates that are linked to ``people``, ``sources`` and ``tags`` (tables with item_id); undated sets dates aside.

    ``folder`` and ``attached`` (with or without attachments) look at the columns that ``filing.filed`` gives.
    """
    low, high = bounds(since, until)
    if kinds:
        items = items.where(F.col("kind").isin(list(kinds)))
    if undated:
        items = items.where("occurred is null")
    else:
        items = items.where(F.col("occurred") >= low) if low else items
        items = items.where(F.col("occurred") < high) if high else items
    items = items if folder is None else items.where(F.col("folder") == folder)
    items = items if attached is None else items.where(F.col("has_attachments") == attached)
    for links in (people, sources, tags):
        items = items if links is None else items.join(links, "item_id", "left_semi")
    return items


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 500) -> DataFrame:
    """Rows ``offset`` to ``offset`` + ``limit`` in a total order; a page has 500 at most."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def with_term(posts: DataFrame, term: str) -> DataFrame:
    """Ids of documents that hold ``term``; a star at its end stands for any ending."""
    hit = F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term
    return posts.where(hit).select("doc_id").distinct()


def boolean(posts: DataFrame, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Ids of documents with all, any and none of the given terms, in one pass over the postings of these terms."""
    wanted = [*all_of, *any_of, *none_of]
    has = lambda t: F.bool_or(F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t)
    hit = reduce(lambda a, b: a | b, (F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t for t in wanted))
    keep = reduce(lambda a, b: a & b, [*map(has, all_of), *([reduce(lambda a, b: a | b, map(has, any_of))] if any_of else []), *(~has(t) for t in none_of)])
    return posts.where(hit).groupBy("doc_id").agg(keep.alias("keep")).where("keep").select("doc_id")


def phrase(posts: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, start) of places where ``words`` follow one another: shifted positions that meet, in one grouping."""
    shifts = reduce(lambda a, b: a.union(b), (posts.where(F.col("term") == w).select("doc_id", (F.col("pos") - k).alias("start"), F.lit(k).alias("k")) for k, w in enumerate(words)))
    return shifts.groupBy("doc_id", "start").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(words)).select("doc_id", "start")


def near(posts: DataFrame, a: str, b: str, between: int = 10) -> DataFrame:
    """Ids of documents where at most ``between`` words stand between the two, in either order.

    Of all places of the two words in order, the nearest two of different words follow one another, so one pass over them decides.
    """
    places = Window.partitionBy("doc_id").orderBy("pos")
    x = posts.where(F.col("term").isin(a, b)).select("doc_id", "pos", "term", F.lag("pos").over(places).alias("p"), F.lag("term").over(places).alias("t"))
    return x.where((F.col("pos") - F.col("p") <= between + 1) & (F.lit(a == b) | (F.col("term") != F.col("t")))).select("doc_id").distinct()


def bm25(posts: DataFrame, terms: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents with any of ``terms``; ``lengths`` (doc_id, len) of all documents with words, else counted from ``posts``."""
    hits = posts.where(F.col("term").isin(list(terms)))
    lengths = posts.groupBy("doc_id").agg(F.count("*").alias("len")) if lengths is None else lengths.select("doc_id", "len").where("len > 0")
    size = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    tf = hits.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(df), "term").join(lengths, "doc_id").join(F.broadcast(size)).groupBy("doc_id").agg(F.sum(weight).alias("score"))


def snippets(docs: DataFrame, terms: list[str], words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, snippet): up to ``words`` words from six before the first hit, hits marked, of documents with a hit."""
    w = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda x: x != "")
    bare = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    hit = lambda x: bare(x).isin(list(terms))
    d = docs.select(F.col(id_col).alias("doc_id"), w.alias("w")).withColumn("at", F.array_position(F.transform("w", hit), True)).where("at > 0")
    part = F.slice("w", F.greatest(F.lit(1), F.col("at").cast("int") - 6), F.lit(words))
    return d.select("doc_id", F.array_join(F.transform(part, lambda x: F.when(hit(x), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), " ").alias("snippet"))
