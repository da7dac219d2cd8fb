"""All check families over an archive's tables, and the report of what they found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import checks, integrity, ledger, people, timeline
from ..operators.ledger import found
from ..settings import Settings


@dataclass
class Facts:
    """What checks look at; a family whose table is not there finds nothing.

    ``sources``: source_id, path, ext, size, head, year, readable, placeholder, copy_path, lock_error, state, parse_error, items, claimed, sampled, folders;
    ``items``: item_id, kind, occurred, tz_known, confidence, rule; ``replies``: source_id, orphan; ``persons``: person_id, name, org, domain;
    ``addresses``: person_id, address, address_type; ``sightings``: address, name; ``links``: person_id, other_id.
    """

    items: DataFrame
    item_sources: DataFrame
    sources: DataFrame | None = None
    profiles: DataFrame | None = None
    second_counts: DataFrame | None = None
    participations: DataFrame | None = None
    persons: DataFrame | None = None
    addresses: DataFrame | None = None
    sightings: DataFrame | None = None
    links: DataFrame | None = None
    own: DataFrame | None = None
    refused: DataFrame | None = None
    attachments: DataFrame | None = None
    blobs: DataFrame | None = None
    replies: DataFrame | None = None


def column(name: str) -> Column:
    return F.col(name)


def files(t: Facts, s: Settings) -> list[DataFrame]:
    """Files that contradict their names, are too small, do not open, failed, or belong to no profile."""
    own, at = t.sources, column("source_id")
    odd = checks.file_checks(own).join(own.select("path", "source_id"), "path")
    return [found(odd, column("code"), source_id=at, evidence=column("path")), *ledger.unreadable(own), *ledger.failed_parses(own), *ledger.orphaned(own, t.profiles)]


def counts(t: Facts, s: Settings) -> list[DataFrame]:
    """Sources that gave less than they claim (a sample aside), nothing at all, or another count to a second reader."""
    at = column("source_id")
    claims = t.sources.where("claimed > 0 and not coalesce(sampled, false)").select("source_id", "claimed")
    out = [
        found(integrity.partial_parse(claims, t.item_sources, s.doubts.read_whole), "partial_parse", source_id=at, loss=column("loss"), evidence=F.concat_ws(" of ", "got", "claimed")),
        found(checks.empty_tree(t.sources, t.item_sources), "empty_tree", source_id=at, evidence=F.concat(column("folders").cast("string"), F.lit(" folders"))),
    ]
    if t.second_counts is not None:
        first = t.item_sources.groupBy("source_id").agg(F.count("*").alias("n")).join(t.second_counts, "source_id", "left_semi")
        out.append(found(checks.backend_disagreement(first, t.second_counts), "backend_disagreement", source_id=at, evidence=F.concat_ws(" and ", "a", "b")))
    return out


def gaps(t: Facts, s: Settings, this_year: int) -> list[DataFrame]:
    """Empty and thin stretches of the census, years that a source lacks, an archive that begins long after its files."""
    classed = timeline.classed(timeline.census(t.items, t.item_sources, this_year, s.doubts.first_year), s.doubts.thin_month)
    runs = timeline.gap_runs(classed)
    year = lambda rows, severity: found(rows, "source_contradiction", severity, source_id=column("source_id"), period=F.concat(column("year").cast("string"), F.lit("-01")), period_end=F.concat(column("year").cast("string"), F.lit("-12")))
    inner = integrity.year_holes(t.items, t.item_sources)
    out = [found(runs, column("gap"), period=column("first_month"), period_end=column("last_month"), evidence=F.concat(column("months").cast("string"), F.lit(" months"))), year(inner, "high")]
    if t.sources is not None:
        named = checks.named_years(t.sources, t.items, t.item_sources).join(inner, ["source_id", "year"], "left_anti")
        out += [year(named, "medium"), found(checks.edge_truncation(t.items, t.sources.select("year"), this_year), "edge_truncation", period=F.concat(column("first_item").cast("string"), F.lit("-01")), evidence=column("oldest_file").cast("string"))]
    return out


def accounts(t: Facts, s: Settings) -> list[DataFrame]:
    """People who may be one or several, stores that are one, own addresses that nobody claimed, legacy names, mail from oneself to oneself."""
    of = lambda rows, code, **more: found(rows, code, period=column("person_id").cast("string"), **more)
    out = [found(people.source_overlap(t.item_sources, 10, s.doubts.same_store), "duplicate_account_store", source_id=column("a"), period=column("b").cast("string"), evidence=F.round("overlap", 4).cast("string"))]
    if t.sightings is not None:
        out.append(found(integrity.over_merged(t.sightings, s.persons.names_of_one_address, s.persons.shared_mailboxes), "over_merged_risk", period=column("address"), evidence=column("names").cast("string")))
    if t.persons is not None:
        queue = people.proposals(t.persons, t.addresses, t.links, s.persons)
        queue = queue if t.refused is None else queue.join(t.refused, ["a", "b"], "left_anti")
        out.append(found(queue, "under_merged", period=F.concat_ws(":", "a", "b"), evidence=column("confidence").cast("string")))
    if t.participations is not None:
        own = t.items.sparkSession.createDataFrame([], "person_id long") if t.own is None else t.own
        out += [of(checks.unclaimed_self(t.participations, own, s.doubts.frequent_sender), "self_identity_unclaimed", evidence=F.round("share", 4).cast("string")), found(checks.identity_conflict(t.participations, own, t.item_sources), "identity_conflict", source_id=column("source_id"), evidence=column("items").cast("string"))]
        if t.addresses is not None:
            out.append(of(checks.legacy_only(t.addresses, t.participations), "ambiguous_legacydn", evidence=column("items").cast("string")))
    return out


def quality(t: Facts, s: Settings, this_year: int) -> list[DataFrame]:
    """Records with doubts of their own, each code rolled up for sources with five of them or more, and replies and bytes that point at nothing."""
    i, at = t.items, column("item_id")
    dated = i.where("kind <> 'contact'")
    own = [
        found(dated.where("occurred is null"), "no_date", item_id=at),
        found(dated.where("occurred is not null and not tz_known"), "unknown_timezone", item_id=at),
        found(integrity.implausible(i, this_year, s.doubts.first_year), "implausible_date", item_id=at, evidence=column("occurred")),
        found(i.where("rule is not null"), "unresolved_recurrence", item_id=at, evidence=column("rule")),
        *ledger.guessed_text(i),
    ]
    every = reduce(DataFrame.unionByName, own)
    per = integrity.rollup(every.select("code", "item_id"), t.item_sources)
    out = [*own, found(per, F.concat("code", F.lit("_summary")), "medium", source_id=column("source_id"), evidence=column("items").cast("string"))]
    if t.replies is not None:
        out.append(found(checks.orphan_reply(t.replies).withColumnRenamed("severity", "own"), "orphan_reply", source_id=column("source_id"), evidence=F.concat_ws(" of ", "orphans", "replies")).drop("severity").join(checks.orphan_reply(t.replies).select("source_id", "severity"), "source_id"))
    if t.blobs is not None:
        out.append(found(checks.missing_blobs(t.attachments, t.blobs), "missing_blob", period=column("content_hash"), loss=column("attachments")))
    if t.attachments is not None:
        out.append(found(checks.unreadable_attachments(t.attachments, t.item_sources), "attachment_unreadable", source_id=column("source_id"), evidence=column("failed").cast("string")))
    return out


def families(t: Facts, this_year: int, s: Settings = Settings()) -> dict[str, Callable[[], list[DataFrame]]]:
    """The check families by name, for ``ledger.run_checks``: all codes of the ledger."""
    out = {"accounts": lambda: accounts(t, s), "gaps": lambda: gaps(t, s, this_year), "quality": lambda: quality(t, s, this_year)}
    if t.sources is not None:
        out |= {"counts": lambda: counts(t, s), "files": lambda: files(t, s)}
    return out


def report(findings: DataFrame, title: str = "Archive audit", worst: int = 20) -> DataFrame:
    """(place, line): the report of open findings as Markdown, a line a row, to be written in the order of ``place``.

    One pass over the findings gives totals, severities and codes (grouping sets), and the ``worst`` findings of each code by loss; the
    rows are some for each code, whatever the findings are.
    """
    f = findings.where(F.col("state").isin(integrity.OPEN)) if "state" in findings.columns else findings
    f = f.withColumns({"rank": ledger.rank(column("severity")), "class": ledger.class_of(F.regexp_replace("code", "_summary$", ""))})
    sums = f.groupingSets([[], [F.col("rank"), F.col("severity")], [F.col("rank"), F.col("severity"), F.col("class"), F.col("code")]], "rank", "severity", "class", "code").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum(F.when(F.col("loss") > 0, F.col("loss"))).alias("loss"), F.countDistinct(F.when(F.coalesce("source_id", F.lit(-1)) >= 0, F.col("source_id"))).alias("sources"),
    )
    n = column("n").cast("string")
    lost = F.when(column("loss") > 0, F.concat(F.lit(", about "), column("loss").cast("string"), F.lit(" records lost"))).otherwise("")
    some = F.concat(n, F.when(column("n") == 1, " finding").otherwise(" findings"))
    where = F.when(column("sources") > 0, F.concat(F.lit(" in "), column("sources").cast("string"), F.when(column("sources") == 1, " source").otherwise(" sources"))).otherwise("")
    whole = column("g") == 15
    line = F.when(whole, F.concat(some, lost, F.lit(".")))
    line = line.when(column("g") == 3, F.concat(F.lit("\n## "), F.initcap("severity"), F.lit(" ("), n, F.lit(")\n")))
    line = line.otherwise(F.concat(F.lit("### "), F.replace("code", F.lit("_"), F.lit(" ")), F.lit(" · "), F.replace("class", F.lit("_"), F.lit(" ")), F.lit("\n\n"), some, where, lost, F.lit(".\n")))
    place = lambda level, code, k: F.struct(F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"), code.alias("code"), F.lit(level).alias("level"), k.cast("int").alias("k"))
    heads = sums.select(place(0, F.coalesce(F.when(column("g") == 0, column("code")), F.lit("")), F.lit(0)).alias("place"), line.alias("line"))
    # the worst few of each code: window group limits keep a code's rows from meeting in one task
    order = Window.partitionBy("rank", "code").orderBy(F.col("loss").desc_nulls_last(), F.col("source_id").asc_nulls_last(), F.col("item_id").asc_nulls_last(), F.col("period").asc_nulls_first())
    few = f.withColumn("k", F.row_number().over(order)).where(column("k") <= worst)
    about = F.array_join(F.array_compact(F.array(
        F.when(F.coalesce("source_id", F.lit(-1)) >= 0, F.concat(F.lit("source "), column("source_id").cast("string"))), F.when(F.coalesce("item_id", F.lit(-1)) >= 0, F.concat(F.lit("item "), column("item_id").cast("string"))),
        F.when(F.coalesce("period", F.lit("")) != "", F.concat(column("period"), F.when(column("period_end") != column("period"), F.concat(F.lit(" to "), column("period_end"))).otherwise(""))), column("evidence"),
    )), ": ")
    rows = few.select(place(1, column("code"), column("k")).alias("place"), F.concat(F.lit("- "), about).alias("line"))
    top = findings.sparkSession.createDataFrame([(f"# {title}\n",)], "line string").select(F.struct(F.lit(-2).alias("rank"), F.lit("").alias("code"), F.lit(0).alias("level"), F.lit(0).alias("k")).alias("place"), "line")
    none = f.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.struct(F.lit(-1).alias("rank"), F.lit("").alias("code"), F.lit(0).alias("level"), F.lit(0).alias("k")).alias("place"), F.lit("Nothing is wrong in what has been read.").alias("line"))
    return top.union(none).union(heads).union(rows)


def write_report(lines: DataFrame, path: str, markdown: bool = True) -> None:
    """Write a report as one folder of text parts whose names are in order; as plain text the marks of headings are left out."""
    text = F.col("line") if markdown else F.regexp_replace("line", r"(?m)^#+ ", "")
    lines.select("place", text.alias("value")).repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
