"""Quality rules with cross-document line frequency (built-in functions only).

Normalised lines (lower case, blanks collapsed) are hashed; for each host the distinct documents that hold
a line are counted, documents with identical text counting once, so that copies of a good page do not turn
its own lines into boilerplate. Lines above the host's limit are removed from the texts that stay, and a document
that has fewer than ``MIN_WORDS`` words left is rejected as depleted. Rules on the document itself come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, if_small, staged, text_of, words_of

MIN_WORDS = 10
#: Most words in repeated windows, in per cent of all words.
MAX_REPEATED = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate in more distinct documents of its host than both of these allow.
LINE_MIN_DOCS = 20
LINE_SHARE = 0.10


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it in inner lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in ``words``, first occurrences included."""
    n = F.size(words)
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    def covered(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        starts = let(marked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, x, k), F.lit(False))), lambda x: x["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, start, step)["n"]

    return F.when(n >= WINDOW, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).otherwise(0)


def normal_lines(text: Column) -> Column:
    """The normalised lines of ``text``, one for each of its lines."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "\n"), lambda x: F.btrim(x, F.lit(" ")))


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose normalised form has its hash in ``gone``."""
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), F.transform(normal_lines(text), lambda x: F.xxhash64(x)).alias("h"))
    return F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains(gone, x["h"])), lambda x: x["line"]), "\n")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Id, host, hash of the text, the base figures, and the (hash, words) of each line with a word."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    norm = F.filter(normal_lines(text), lambda x: x != "")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(host_col).alias("host"),
        F.xxhash64(text, F.lit(1)).alias("text_hash"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform(norm, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("w"))).alias("lines"),
        let(words_of(text_col), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
    ).select("*", "w.*").drop("w")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, the figures, base_failed, n_line_words (words in removed lines), gone (their hashes), kept.

    Null text counts as empty (and fails for want of words); rows without a host form one host. Repeated rows
    are judged one by one and alike, but count once for line frequency. An empty table gives no rows; further
    columns are ignored.
    """
    base = staged(measured(docs, id_col, text_col, host_col), "measured")
    lines = base.select("row", F.coalesce("host", F.lit("\0")).alias("host"), "text_hash", F.inline("lines"))
    sizes = base.groupBy(F.coalesce("host", F.lit("\0")).alias("host"), "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("docs"))
    spread = lines.groupBy("host", "h", "text_hash").agg(F.lit(1)).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > LINE_MIN_DOCS)
    common = staged(spread.join(sizes, "host").where(F.col("n") > LINE_SHARE * F.col("docs")).select("host", "h"), "common_lines")
    lost = lines.join(if_small(common, common.count()), ["host", "h"]).groupBy("row").agg(F.sum("w").alias("n_line_words"), F.collect_set("h").alias("gone"))
    out = base.drop("lines").join(lost, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= MIN_WORDS)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` (all its columns) without the rejected rows, and texts without the lines above their host's limit.

    Where lines go, a column ``n_chars`` is counted anew. Verdicts meet the rows again by id and text hash, which all
    rows of equal content share.
    """
    keys = ["__i", "__u", "__h", "__s"]
    mark = lambda df, h, s: df.withColumns({"__i": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__u": F.col(id_col).isNull(), "__h": h, "__s": F.coalesce(s, F.lit("\0"))})
    base = verdicts(docs, id_col, text_col, host_col)
    touched = mark(base.where("not kept or gone is not null"), F.col("text_hash"), F.col("host")).select(*keys, F.col("kept").alias("__kept"), F.col("gone").alias("__gone")).dropDuplicates(keys)
    out = mark(docs, F.xxhash64(text_of(text_col), F.lit(1)), F.col(host_col)).join(touched, keys, "left").where(F.coalesce("__kept", F.lit(True)))
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__gone"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
