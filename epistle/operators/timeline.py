"""Coverage census, gaps, coverage map and timelines over items (item_id, kind, occurred as ISO text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_YEAR = 1970
#: Months before one that are looked at, how many of them must have items, and the share of their median below which a month is thin.
TRAIL, NEED, THIN = 12, 6, 0.15


def plausible(occurred: Column, this_year: int, first_year: int = FIRST_YEAR) -> Column:
    return F.substring(occurred, 1, 4).cast("int").between(first_year, this_year + 1)


def months(span: DataFrame) -> DataFrame:
    """Every month ('yyyy-MM') between columns lo and hi of a one-row table."""
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    return span.where("lo is not null").select(F.explode(F.sequence(day(F.col("lo")), day(F.col("hi")), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def census(items: DataFrame, item_sources: DataFrame, this_year: int, first_year: int = FIRST_YEAR) -> DataFrame:
    """(month, kind, items, sources) for every month of the plausible span and every kind present, zeros kept."""
    dated = items.where(plausible(F.col("occurred"), this_year, first_year)).select("item_id", "kind", F.substring("occurred", 1, 7).alias("month"))
    counts = dated.groupBy("month", "kind").agg(F.countDistinct("item_id").alias("items"))
    found = dated.join(item_sources, "item_id").groupBy("month", "kind").agg(F.countDistinct("source_id").alias("sources"))
    spine = months(counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))).join(F.broadcast(counts.select("kind").distinct()))
    full = spine.join(counts, ["month", "kind"], "left").join(found, ["month", "kind"], "left")
    return full.select("month", "kind", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("sources", F.lit(0)).alias("sources"))


def classed(census_: DataFrame, thin: float = THIN) -> DataFrame:
    """(month, n, gap): hard_gap for empty months, soft_gap for thin ones (less than ``thin`` of the median before). One row a month, so one window is enough."""
    total = census_.groupBy("month").agg(F.sum("items").alias("n"))
    before = "over (order by month rows between 12 preceding and 1 preceding)"
    seen, median = F.expr(f"count(if(n > 0, 1, null)) {before}"), F.expr(f"percentile(if(n > 0, n, null), 0.5) {before}")
    gap = F.when(F.col("n") == 0, "hard_gap").when((seen >= NEED) & (F.col("n") < thin * median), "soft_gap")
    return total.select("month", "n", gap.alias("gap"))


def gap_runs(classed_: DataFrame) -> DataFrame:
    """Runs of equal gap class in neighbouring months: (gap, first_month, last_month, months)."""
    index = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    run = index - F.row_number().over(Window.partitionBy("gap").orderBy("month"))
    return classed_.where("gap is not null").withColumn("run", run).groupBy("gap", "run").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("months")).drop("run")


def coverage_map(classed_: DataFrame) -> DataFrame:
    """A row a year with the counts of its twelve months (null outside the span) and its class."""
    y = classed_.withColumns({"year": F.substring("month", 1, 4), "m": F.substring("month", 6, 2)})
    cells = [F.max(F.when(F.col("m") == f"{k:02d}", F.col("n"))).alias(f"m{k:02d}") for k in range(1, 13)]
    kind = F.when(F.sum("n") == 0, "hard_gap").when(F.count("gap") > 0, "partial").otherwise("none")
    return y.groupBy("year").agg(*cells, F.sum("n").alias("total"), kind.alias("class"))


def timeline(items: DataFrame, item_sources: DataFrame, chars: int, kinds: list[str]) -> DataFrame:
    """Counts by kind for each period of the first ``chars`` characters of the instant (4 year, 7 month, 10 day), with sources."""
    i = items.where("occurred is not null").withColumn("period", F.substring("occurred", 1, chars))
    counts = i.groupBy("period").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count("*").alias("total"))
    return counts.join(i.join(item_sources, "item_id").groupBy("period").agg(F.countDistinct("source_id").alias("sources")), "period", "left").fillna(0, ["sources"])


def dense(timeline_: DataFrame, unit: str) -> DataFrame:
    """A timeline with its empty periods: every ``unit`` (year, month or day) of the years from first to last."""
    chars = {"year": 4, "month": 7, "day": 10}[unit]
    year = lambda f, tail: F.to_date(F.concat(f(F.substring("period", 1, 4)), F.lit(tail)))
    span = timeline_.agg(year(F.min, "-01-01").alias("lo"), year(F.max, "-12-31").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("d")).select(F.substring(F.col("d").cast("string"), 1, chars).alias("period"))
    return spine.join(timeline_, "period", "left").fillna(0)


def facets(items: DataFrame, item_sources: DataFrame, top: int = 100) -> DataFrame:
    """(facet, value, n): kinds, subjects and the ``top`` sources by items."""
    one = lambda name, c: items.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
    sources = item_sources.groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(top)
    return one("kind", "kind").union(one("subject", "subject")).union(sources.select(F.lit("source"), F.col("source_id").cast("string"), "n"))
