"""Findings: checks that return rows, the ledger they are merged into, and counts that carry their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import SHARED_MAILBOXES

KEY = ["code", "source_id", "item_id", "period"]
OPEN = ["open", "acknowledged"]
# Codes of findings that qualify a count.
QUALIFYING = ["partial_parse", "read_failure", "needs_password", "empty_tree", "backend_disagreement", "hard_gap", "source_contradiction"]


def keyed(findings: DataFrame) -> DataFrame:
    """Null parts of the key as -1 or '', so that equal findings meet."""
    return findings.withColumns({"source_id": F.coalesce("source_id", F.lit(-1)), "item_id": F.coalesce("item_id", F.lit(-1)), "period": F.coalesce("period", F.lit(""))})


def upsert(ledger: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """The ledger after a check: new findings open, facts refreshed, resolved ones reopened, unseen open ones resolved.

    ``ledger`` has KEY, state, loss, first_seen, last_seen, resolved_at, note; ``seen`` has KEY and loss. Users' states and notes
    stay, and no row is ever removed.
    """
    old, new = keyed(ledger).alias("o"), keyed(seen).select(*KEY, F.col("loss").alias("new_loss"), F.lit(True).alias("here")).alias("n")
    j = old.join(new, KEY, "full_outer")
    here, known = F.coalesce("here", F.lit(False)), F.col("state").isNotNull()
    state = F.when(~known, "open").when(here & (F.col("state") == "resolved"), "open").when(~here & F.col("state").isin(OPEN), "resolved").otherwise(F.col("state"))
    resolved = F.when(here, F.when(F.col("state") != "resolved", F.col("resolved_at"))).when(F.col("state").isin(OPEN), F.lit(now)).otherwise(F.col("resolved_at"))
    return j.select(
        *KEY, state.alias("state"), F.when(here, F.col("new_loss")).otherwise(F.col("loss")).alias("loss"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(here, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"), resolved.alias("resolved_at"), "note",
    )


def qualifiers(findings: DataFrame, codes: list[str] = QUALIFYING) -> DataFrame:
    """(code, findings, estimated_missing): open findings that qualify a count; null where nothing gives an estimate."""
    return findings.where(F.col("code").isin(codes) & F.col("state").isin(OPEN)).groupBy("code").agg(F.count("*").alias("findings"), F.sum(F.when(F.col("loss") > 0, F.col("loss"))).alias("estimated_missing"))


def implausible(items: DataFrame, this_year: int, first_year: int = 1970) -> DataFrame:
    year = F.substring("occurred", 1, 4).cast("int")
    return items.where((year < first_year) | (year > this_year + 1)).select("item_id", "occurred")


def rollup(item_findings: DataFrame, item_sources: DataFrame, least: int = 5) -> DataFrame:
    """(code, source_id, items) where a source has findings of a code on at least ``least`` items."""
    j = item_findings.join(item_sources, "item_id").groupBy("code", "source_id").agg(F.countDistinct("item_id").alias("items"))
    return j.where(F.col("items") >= least)


def year_holes(items: DataFrame, item_sources: DataFrame) -> DataFrame:
    """(source_id, year): years without items strictly inside a source's own span."""
    years = item_sources.join(items.select("item_id", F.substring("occurred", 1, 4).cast("int").alias("year")), "item_id").select("source_id", "year").distinct()
    inner = years.groupBy("source_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.collect_set("year").alias("has"))
    return inner.where("hi - lo > 1").select("source_id", F.explode(F.array_except(F.sequence(F.col("lo") + 1, F.col("hi") - 1), "has")).alias("year"))


def partial_parse(claims: DataFrame, item_sources: DataFrame, least: float = 0.95) -> DataFrame:
    """(source_id, claimed, got, loss) of sources that gave less than that part of the items they claim."""
    got = item_sources.groupBy("source_id").agg(F.count("*").alias("got"))
    j = claims.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return j.where(F.col("got") < least * F.col("claimed")).select("source_id", "claimed", "got", (F.col("claimed") - F.col("got")).alias("loss"))


# Names that are nobody's own.
GENERIC = [
    "administrator", "admin", "support", "helpdesk", "help desk", "reception", "office", "accounts", "sales", "info", "enquiries", "webmaster",
    "postmaster", "mailer-daemon", "system", "noreply", "no-reply", "unknown", "undisclosed recipients", "recipients",
]


def over_merged(sightings: DataFrame, names: int = 8, shared: tuple[str, ...] = SHARED_MAILBOXES) -> DataFrame:
    """(address, names, role): addresses seen (address, name) under more names than that, of a shared mailbox, or under a name that is nobody's own."""
    role = F.split("address", "@")[0].isin(list(shared))
    generic = F.bool_or(F.lower(F.trim("name")).isin(GENERIC))
    g = sightings.where("name is not null").groupBy("address").agg(F.countDistinct("name").alias("names"), generic.alias("generic"))
    return g.withColumn("role", role).where((F.col("names") > names) | F.col("role") | F.col("generic")).drop("generic")


def summary(findings: DataFrame) -> DataFrame:
    """(code, findings, open, estimated_missing, sources) of a ledger, states of every kind counted."""
    open_ = F.col("state").isin(OPEN)
    return findings.groupBy("code").agg(
        F.count("*").alias("findings"), F.count_if(open_).alias("open"), F.sum(F.when(open_ & (F.col("loss") > 0), F.col("loss"))).alias("estimated_missing"),
        F.countDistinct(F.when(F.col("source_id") >= 0, F.col("source_id"))).alias("sources"),
    )


def statement(selection: DataFrame, item_sources: DataFrame, findings: DataFrame) -> DataFrame:
    """(code, findings, items): open findings of the sources that a selection's items (item_id) come from, with the items they may touch."""
    found = selection.select("item_id").distinct().join(item_sources, "item_id")
    touched = found.groupBy("source_id").agg(F.count("*").alias("items"))
    return findings.where(F.col("state").isin(OPEN)).join(touched, "source_id").groupBy("code").agg(F.count("*").alias("findings"), F.sum("items").alias("items"))
