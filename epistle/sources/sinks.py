"""Sinks for exported rows: CSV and JSON folders written by the executors, which return the rows written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import safe_cell
from ..operators.graph import ROWS, shared_out, staged


def write_csv(df: DataFrame, path: str) -> int:
    """Write ``df`` as CSV with headers, texts guarded against spreadsheet formulas; the number of rows written."""
    texts = {c: safe_cell(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"}
    return _counted(df.withColumns(texts), lambda w: w.option("header", True).option("escape", '"').csv(path))


def write_json(df: DataFrame, findings: DataFrame, path: str) -> int:
    """Write the open findings to ``path``/findings and the records to ``path``/records, a JSON object a line."""
    _counted(findings, lambda w: w.json(f"{path}/findings"))
    return _counted(df, lambda w: w.json(f"{path}/records"))


def write_markdown(items: DataFrame, path: str) -> int:
    """Write items (item_id, kind, occurred, subject) as Markdown, a folder a year and a heading a month, in order of time.

    Years and months are ranges of one sort, so no task holds more than its range; undated ones come last under their own heading.
    """
    month = F.coalesce(F.substring("occurred", 1, 7), F.lit("undated"))
    line = F.concat(F.lit("- "), F.coalesce(F.regexp_replace(F.substring("occurred", 1, 16), "T", " "), F.lit("?")), F.lit(" **"), "kind", F.lit("** "), F.coalesce("subject", F.lit("")))
    rows = items.select(month.alias("month"), F.col("occurred").alias("at"), "item_id", line.alias("value"))
    heads = rows.select("month").distinct().select("month", F.lit("").alias("at"), F.lit(-1).cast("long").alias("item_id"), F.concat(F.lit("## "), "month").alias("value"))
    every = rows.withColumn("at", F.coalesce("at", F.lit("~"))).union(heads).repartitionByRange("month", "at", "item_id").sortWithinPartitions("month", "at", "item_id")
    out = every.select("value", F.substring("month", 1, 4).alias("year"))
    return _counted(out, lambda w: w.partitionBy("year").text(path)) - heads.count()


def copied_names(attachments: DataFrame) -> DataFrame:
    """``attachments`` (attachment_id, filename) with ``copied``: safe names, repeats numbered by id as 'name (n).ext'."""
    safe = F.substring(F.regexp_replace(F.trim(F.coalesce("filename", F.lit(""))), r'[<>:"/\\\\|?*\x00-\x1f]', "_"), 1, 150)
    safe = F.when(safe == "", F.concat(F.lit("attachment-"), F.col("attachment_id").cast("string"))).otherwise(safe)
    key = F.lower("safe")
    # a name may be that of a great part of all rows: rows are numbered within ranges of (name, id), and ranges counted before
    n = attachments.count()
    ranged = attachments.withColumn("safe", safe).repartitionByRange(n // ROWS + 1, key, "attachment_id").withColumns({"key": key, "part": F.spark_partition_id()})
    ranged = staged(ranged, "names")
    sizes = ranged.groupBy("key", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("key", "part").orderBy("attachment_id"))
    rows = shared_out(ranged, n, "key", "part").withColumn("local", local).join(sizes.select("key", "part", before.alias("before")), ["key", "part"]).withColumn("n", F.col("before") + F.col("local"))
    numbered = F.concat(F.regexp_replace("safe", r"\.[^.]*$", ""), F.lit(" ("), F.col("n").cast("string"), F.lit(")"), F.regexp_extract("safe", r"(\.[^.]*)$", 1))
    return rows.select(*attachments.columns, F.when(F.col("n") > 1, numbered).otherwise(F.col("safe")).alias("copied"))


def blob_path(content_hash: Column, filename: Column) -> Column:
    """Place of a content in a store addressed by its hash: two folders of its first characters, then the hash and the extension."""
    h = F.lower(content_hash)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), h, F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[A-Za-z0-9]{1,10})$", 1)))


def _counted(df: DataFrame, write) -> int:
    """Rows written, counted in the writing job itself."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")).write)
    return seen.get["n"]
