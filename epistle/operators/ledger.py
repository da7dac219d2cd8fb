"""The ledger's side of checks: families that run apart, severities and classes, lists, qualified counts, the banner."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import staged
from .integrity import KEY, OPEN, QUALIFYING, keyed

# Severities from the worst on, those of the codes, the classes of codes, error texts that mean a password or another program's lock.
SEVERITIES = ["critical", "high", "medium", "info"]
SEVERITY = {
    "read_failure": "critical", "partial_parse": "critical", "needs_password": "high", "orphaned_ost": "high", "magic_mismatch": "high", "empty_tree": "high", "backend_disagreement": "high", "hard_gap": "high",
    "source_contradiction": "high", "over_merged_risk": "high", "identity_conflict": "high", "missing_blob": "high", "locked_but_read": "info", "soft_gap": "info", "under_merged": "info",
}
CLASSES = {
    "unreadable_files": [
        "read_failure", "locked_but_read", "partial_parse", "needs_password", "orphaned_ost", "zero_or_tiny", "empty_tree", "magic_mismatch", "backend_disagreement", "attachment_unreadable",
    ],
    "coverage_gaps": ["hard_gap", "soft_gap", "source_contradiction", "edge_truncation"],
    "duplicate_accounts": ["under_merged", "over_merged_risk", "duplicate_account_store", "self_identity_unclaimed", "ambiguous_legacydn", "identity_conflict"],
    "record_quality": ["no_date", "implausible_date", "unknown_timezone", "low_confidence_text", "orphan_reply", "missing_blob", "unresolved_recurrence"],
}
PASSWORD = ["password", "encrypt", "crypt", "not supported: compressible"]
LOCKED = ["PermissionError", "being used by another"]
LOST = ["read_failure", "partial_parse", "needs_password", "empty_tree"]
GAPS = ["hard_gap", "source_contradiction"]
PEOPLE = ["under_merged", "over_merged_risk", "self_identity_unclaimed"]
LOOK = ["magic_mismatch", "zero_or_tiny", "orphaned_ost"]

ROWS = "code string, severity string, source_id long, item_id long, period string, loss long, evidence string, period_end string"


def rank(severity: Column) -> Column:
    """0 for the worst severity; what is not known comes last."""
    return F.coalesce(*(F.when(severity == s, k) for k, s in enumerate(SEVERITIES)), F.lit(9))


def class_of(code: Column) -> Column:
    return F.coalesce(*(F.when(code.isin(codes), name) for name, codes in CLASSES.items()), F.lit("record_quality"))


def found(rows: DataFrame, code: str | Column, severity: str | None = None, **columns: Column) -> DataFrame:
    """Rows of a check as ledger rows (ROWS). A severity that is not given is the code's own, medium where it has none."""
    code = F.lit(code) if isinstance(code, str) else code
    own = F.coalesce(*(F.when(code == c, s) for c, s in SEVERITY.items()), F.lit("medium"))
    given = {"code": code, "severity": F.lit(severity) if severity else own} | columns
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = dict(x.split() for x in ROWS.split(", "))
    return rows.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names))


def run_checks(spark: SparkSession, families: dict[str, Callable[[], list[DataFrame]]], wanted: set[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Ledger rows of the check families, in order of their names, and how many each found.

    A family whose function or query fails counts -1 and costs the others nothing; its error goes into the row ``check_failed``
    of the result, whose evidence names it. Families that are not known raise.
    """
    if unknown := (wanted or set()) - set(families):
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}; there are {', '.join(sorted(families))}")
    parts, counts = [spark.createDataFrame([], ROWS)], {}
    for name in sorted(wanted or families):
        try:
            rows = staged(reduce(DataFrame.unionByName, families[name](), spark.createDataFrame([], ROWS)), f"check-{name}")
            counts[name] = rows.count()
            parts.append(rows)
        except Exception as e:  # one broken family never stops the rest
            counts[name] = -1
            parts.append(spark.createDataFrame([("check_failed", "medium", None, None, None, None, f"{name}: {type(e).__name__}: {e}"[:500], None)], ROWS))
    return reduce(DataFrame.unionByName, parts), counts


def reachable() -> Column:
    """Whether a file's bytes can be had: it has a copy here, or is local and readable."""
    return F.col("copy_path").isNotNull() | (~F.col("placeholder") & F.col("readable"))


def cloud_only() -> Column:
    return F.col("placeholder") & F.col("copy_path").isNull()


def locked() -> Column:
    """Whether the mail client itself seems to hold a file open."""
    return ~F.col("readable") & ~F.col("placeholder") & (F.lower("ext") == ".pst") & reduce(lambda a, b: a | b, (F.col("lock_error").contains(x) for x in LOCKED))


def unreadable(sources: DataFrame) -> list[DataFrame]:
    """``read_failure`` of files that do not open; ``locked_but_read`` where their records are here all the same."""
    shut = sources.where(~F.col("readable") & ~F.col("placeholder"))
    done = F.coalesce((F.col("state") == "done") & (F.col("items") > 0), F.lit(False))
    why = F.coalesce("lock_error", F.lit("no reason was recorded"))
    return [found(shut.where(done), "locked_but_read", source_id=F.col("source_id"), evidence=why), found(shut.where(~done), "read_failure", source_id=F.col("source_id"), evidence=why)]


def failed_parses(sources: DataFrame) -> list[DataFrame]:
    """``needs_password`` where a reader's error says so, else ``read_failure``; what the file claims to hold is lost."""
    bad = sources.where("state = 'failed'").withColumn("why", F.coalesce("parse_error", F.lit("no error was recorded")))
    secret = reduce(lambda a, b: a | b, (F.lower("why").contains(x) for x in PASSWORD))
    return [found(bad, F.when(secret, "needs_password").otherwise("read_failure"), source_id=F.col("source_id"), loss=F.col("claimed"), evidence=F.col("why"))]


def orphaned(sources: DataFrame, profiles: DataFrame | None) -> list[DataFrame]:
    """``orphaned_ost``: caches that no mail profile (path) names, by whole path or file name; nothing where profiles are not known."""
    if profiles is None:
        return []
    last = lambda c: F.element_at(F.split(F.regexp_replace(F.lower(c), r"\\", "/"), "/"), -1)
    names = profiles.select(last(F.col("path")).alias("name")).distinct()
    caches = sources.where(F.lower("ext") == ".ost").withColumn("name", last(F.col("path")))
    return [found(caches.join(names, "name", "left_anti"), "orphaned_ost", source_id=F.col("source_id"), evidence=F.col("path"))]


def guessed_text(items: DataFrame) -> list[DataFrame]:
    """``low_confidence_text`` of items whose charset had to be guessed (confidence under 1)."""
    return [found(items.where("confidence < 1"), "low_confidence_text", item_id=F.col("item_id"), evidence=F.col("confidence").cast("string"))]


def listed(findings: DataFrame, sources: DataFrame, items: DataFrame, state: str = "open", severity: str | None = None, code: str | None = None, klass: str | None = None, source_id: int | None = None) -> DataFrame:
    """Findings of these kinds with class, severity rank, the source's path and the item's subject, to be ordered by ``severity_rank, code``."""
    f = findings
    if state == "open":
        f = f.where(F.col("state").isin(OPEN))
    elif state != "all":
        f = f.where(F.col("state") == state)
    f = f.where(F.col("severity") == severity) if severity else f
    f = f.where(F.col("code") == code) if code else f
    if klass:
        if klass not in CLASSES:
            raise ValueError(f"{klass!r} is no class of findings; there are {', '.join(CLASSES)}")
        f = f.where(F.col("code").isin(CLASSES[klass]))
    f = f.where(F.col("source_id") == source_id) if source_id is not None else f
    j = f.join(sources.select("source_id", "path"), "source_id", "left").join(items.select("item_id", "subject"), "item_id", "left")
    return j.withColumns({"class": class_of(F.col("code")), "severity_rank": rank(F.col("severity"))})


def counted(findings: DataFrame) -> DataFrame:
    """(severity, code, class, findings) of open findings."""
    g = findings.where(F.col("state").isin(OPEN)).groupBy("severity", "code").agg(F.count("*").alias("findings"))
    return g.withColumn("class", class_of(F.col("code")))


def with_state(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Sources with their open findings: how many, the worst severity, the loss; and whether they can be reached."""
    worst = F.min(F.when(F.col("severity").isNotNull(), F.struct(rank(F.col("severity")).alias("r"), F.col("severity").alias("s"))))
    per = findings.where(F.col("state").isin(OPEN) & (F.col("source_id") >= 0)).groupBy("source_id").agg(F.count("*").alias("findings"), worst.alias("w"), F.sum("loss").alias("loss"))
    j = sources.join(per, "source_id", "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "worst_severity": F.col("w.s")}).drop("w")
    return j.withColumns({"reachable": reachable(), "cloud_only": cloud_only(), "locked": locked()})


def sources_where(sources: DataFrame, container: str | None = None, ext: str | None = None, state: str | None = None, duplicates: bool = False, placeholders: bool = False, copied: bool = False, problems: bool = False, like: str | None = None) -> DataFrame:
    """The filters of the sources' list, over ``with_state``; ``like`` is found anywhere in a path, in any case of ASCII letters."""
    s = sources
    s = s.where(F.col("container") == container) if container else s
    s = s.where(F.col("ext") == (ext if ext.startswith(".") else "." + ext)) if ext else s
    s = s.where(F.col("state") == state) if state else s
    s = s.where("duplicate_of is not null") if duplicates else s
    s = s.where(cloud_only()) if placeholders else s
    s = s.where("copy_path is not null") if copied else s
    s = s.where("findings > 0") if problems else s
    return s.where(F.contains(F.translate("path", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(like.lower()))) if like else s


def read_order(sources: DataFrame) -> list[Column]:
    """Smallest file first."""
    return [F.col("bytes").asc_nulls_last(), F.col("source_id")]


def per_drive(sources: DataFrame) -> DataFrame:
    """(drive, files, bytes) of files that are still in the cloud only."""
    drive = F.upper(F.regexp_extract("path", r"^([A-Za-z]:|/[^/]*)", 1))
    return sources.where(cloud_only()).groupBy(drive.alias("drive")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def qualifiers(findings: DataFrame, source_ids: list[int] | None = None, since: str | None = None, until: str | None = None, by_kind: bool = False) -> DataFrame:
    """(code, findings, loss, severity, severity_rank, ids, first, last): why a count over this slice may be short.

    A finding with a period counts where that and the months ``since`` to ``until`` overlap (a gap that begins before and reaches into
    them does); one without always does. Where the count is
    of one kind, the reasons stay and the estimate does not, as no loss can be divided by kinds. ids holds what tells the
    findings apart (source, item, period).
    """
    f = findings.where(F.col("code").isin(QUALIFYING) & F.col("state").isin(OPEN))
    f = f.where(F.col("source_id").isin(list(source_ids))) if source_ids else f
    dated = F.coalesce("period", F.lit("")) != ""
    last = F.coalesce("period_end", "period") if "period_end" in f.columns else F.col("period")
    f = f.where(~dated | (last >= since)) if since else f
    f = f.where(~dated | (F.col("period") <= until)) if until else f
    worst = F.min(F.struct(rank(F.col("severity")).alias("r"), F.col("severity").alias("s")))
    months = F.when(dated, F.col("period"))
    loss = F.lit(None).cast("long") if by_kind else F.nullif(F.sum(F.coalesce("loss", F.lit(0))), F.lit(0))
    g = f.groupBy("code").agg(F.count("*").alias("findings"), loss.alias("loss"), worst.alias("w"), F.array_sort(F.collect_set(F.struct("source_id", "item_id", "period"))).alias("ids"), F.min(months).alias("first"), F.max(F.when(dated, last)).alias("last"))
    return g.select("code", "findings", "loss", F.col("w.s").alias("severity"), F.col("w.r").alias("severity_rank"), "ids", "first", "last")


def honest_count(items: DataFrame, item_sources: DataFrame, findings: DataFrame, kind: str | None = None, source_ids: list[int] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row (value, qualified, estimated_missing, worst_severity, codes): an exact count, with what is known to be missing beside it, never in it."""
    rows = items.where(F.col("kind") == kind) if kind else items
    month = F.substring("occurred", 1, 7)
    rows = rows.where(month >= since) if since else rows
    rows = rows.where(month <= until) if until else rows
    rows = rows.join(item_sources.where(F.col("source_id").isin(list(source_ids))), "item_id", "left_semi") if source_ids else rows
    why = qualifiers(findings, source_ids, since, until, by_kind=kind is not None)
    worst = F.min(F.struct("severity_rank", "severity"))["severity"]
    about = why.agg(F.count("*").alias("n"), F.sum("loss").alias("estimated_missing"), worst.alias("worst_severity"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    value = rows.agg(F.count("*").alias("value"))  # one row each
    return value.join(F.broadcast(about)).select("value", (F.col("n") > 0).alias("qualified"), "estimated_missing", "worst_severity", "codes")


def banner(findings: DataFrame) -> DataFrame:
    """One row (files, gaps, people, records, look, loss, sentence) over the open findings."""
    f = findings.where(F.col("state").isin(OPEN))
    code = F.col("code")
    c = f.agg(
        F.countDistinct(F.when(code.isin(LOST) & (F.col("source_id") >= 0), F.col("source_id"))).alias("files"), F.count_if(code.isin(GAPS)).alias("gaps"), F.count_if(code.isin(PEOPLE)).alias("people"),
        F.count_if(class_of(code) == "record_quality").alias("records"), F.count_if(code.isin(LOOK)).alias("look"), F.coalesce(F.sum(F.when(F.col("loss") > 0, F.col("loss"))), F.lit(0)).alias("loss"),
    )
    say = lambda n, one, many: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(" "), F.when(F.col(n) == 1, one).otherwise(many)))
    parts = F.array_compact(F.array(
        say("files", "file not read in full", "files not read in full"), say("gaps", "unexplained gap", "unexplained gaps"), say("people", "person to confirm", "people to confirm"),
        say("records", "uncertain record", "uncertain records"), say("look", "file to look at", "files to look at"),
    ))
    lost = F.when(F.col("loss") > 0, F.concat(F.lit("; about "), F.col("loss").cast("string"), F.lit(" records could not be read"))).otherwise("")
    return c.withColumn("sentence", F.when(F.size(parts) == 0, "No problems found in what has been read.").otherwise(F.concat(F.array_join(parts, "; "), lost)))


def decided(ledger: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The ledger with users' ``decisions`` (KEY, new_state, new_note): to explain a finding takes a note, else it stays as it is."""
    d = keyed(decisions).where("new_state <> 'explained' or trim(coalesce(new_note, '')) <> ''").select(*KEY, "new_state", "new_note")
    j = keyed(ledger).join(d, KEY, "left")
    closing = F.col("new_state").isin("resolved", "explained", "wont_fix")
    resolved = F.when(closing, F.lit(now)).when(F.col("new_state").isNull(), F.col("resolved_at"))
    return j.withColumns({"resolved_at": resolved, "state": F.coalesce("new_state", "state"), "note": F.coalesce("new_note", "note")}).drop("new_state", "new_note")


def explained_months(census: DataFrame, ledger: DataFrame) -> DataFrame:
    """The census (month, ...) with ``explained``: every month of an explained gap, from ``period`` to ``period_end`` where that is set."""
    gaps = ledger.where(F.col("code").isin("hard_gap", "soft_gap") & (F.col("state") == "explained") & (F.col("period") != ""))
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    months = gaps.select(F.explode(F.sequence(day(F.col("period")), day(F.coalesce("period_end", "period")), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month")).distinct()
    return census.join(months.withColumn("explained", F.lit(True)), "month", "left").withColumn("explained", F.coalesce("explained", F.lit(False)))


def coverage_summary(classed: DataFrame) -> DataFrame:
    """One row (months, gap_months, explained, all_explained) of a census by months (month, gap, explained)."""
    gap = F.col("gap").isNotNull()
    m = classed.groupBy("month").agg(F.bool_or(gap).alias("gap"), F.bool_and(~gap | F.col("explained")).alias("fine"), F.bool_or(gap & F.col("explained")).alias("told"))
    return m.agg(F.count("*").alias("months"), F.count_if("gap").alias("gap_months"), F.count_if(F.col("gap") & F.col("told")).alias("explained"), F.bool_and("fine").alias("all_explained"))
