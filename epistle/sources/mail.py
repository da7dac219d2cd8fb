"""Readers of mail, calendar and card files: one row per message, event or card.

Container files are split by Spark's own text source at their separator, so that a large file is read by many
tasks; the bytes of a record reach Python only where the standard library's mail parser is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.exports import end_of

MESSAGE = (
    "path string, message_id string, in_reply_to string, refs array<string>, subject string, sender string, receivers array<string>, "
    "occurred string, tz_known boolean, body string, html string, attachments array<struct<name: string, mime: string, bytes: long>>, error string, "
    "people array<struct<role: string, name: string, address: string>>, date_header string"
)


COLUMNS = "path message_id in_reply_to refs subject sender receivers occurred tz_known body html attachments error people date_header".split()
# Forms of dates that are tried where the standard's is not met.
SALVAGE = ["%a, %d %b %y %H:%M:%S %z", "%d %b %y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%a %b %d %H:%M:%S %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"]
ROLES = ["from", "to", "cc", "bcc"]


#: What is said of a file that Spark does not read as a whole.
TOO_LARGE = "file of more than 2 GB"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import datetime
    import re
    from email import message_from_bytes, policy
    from email.utils import getaddresses, parsedate_to_datetime
    from functools import lru_cache

    parsed_header = lru_cache(maxsize=1024)(policy.default.header_fetch_parse)

    class ParseOnce(policy.EmailPolicy):
        """The default policy, which would parse a header anew on each access, with headers met lately kept."""

        def header_fetch_parse(self, name: str, value: str) -> str:
            return parsed_header(name, value)

    rules = ParseOnce()

    def salvaged(text: str) -> datetime.datetime | None:
        for form in SALVAGE:
            try:
                return datetime.datetime.strptime(text, form)
            except ValueError:
                continue
        return None

    def leaves(part) -> Iterator:
        """The parts of a mail that are not containers; an attached mail is one of them, and its own parts are not."""
        if part.get_content_type() == "message/rfc822":
            yield part
        elif part.is_multipart():
            for sub in part.iter_parts():
                yield from leaves(sub)
        else:
            yield part

    def weight(part) -> int:
        if part.get_content_type() == "message/rfc822":
            return sum(len(x.as_bytes()) for x in part.get_payload())
        return len(part.get_payload(decode=True) or b"")

    def when(header: str | None) -> tuple[str | None, bool]:
        try:
            t = parsedate_to_datetime(header)
        except (TypeError, ValueError, OverflowError):
            t = salvaged(re.sub(r"\([^)]*\)", "", header or "").strip())
        if t is None:
            return None, False
        known = t.tzinfo is not None
        t = t.astimezone(datetime.UTC) if known else t
        return t.strftime("%Y-%m-%dT%H:%M:%SZ"), known

    def one(path: str, raw: bytes | None) -> tuple:
        try:
            if raw is None:
                raise OverflowError(TOO_LARGE)
            m = message_from_bytes(raw, policy=rules)
            get = lambda name: str(m[name]).strip() if m[name] is not None else None
            plain, html, files = None, None, []
            for part in leaves(m):
                kind, name = part.get_content_type(), part.get_filename()
                if kind == "message/rfc822" and not name:
                    name = str(part.get_payload(0)["subject"] or "message").strip() + ".eml"
                if name or part.get_content_disposition() == "attachment":
                    files.append((name, kind, weight(part)))
                elif kind == "text/plain" and plain is None:
                    plain = part.get_content()
                elif kind == "text/html" and html is None:
                    html = part.get_content()
            people = [(role, name or None, a.lower()) for role in ROLES for name, a in getaddresses(list(map(str, m.get_all(role, [])))) if a]
            names = [a for role, _, a in people if role != "from"]
            sender = next((a for role, _, a in people if role == "from"), None)
            at, known = when(get("date"))
            return path, get("message-id"), get("in-reply-to"), (get("references") or "").split(), get("subject"), sender, names, at, known, plain, html, files, None, people, get("date")
        except Exception as e:  # a damaged message is a row with its error, never a failed job
            return (path, None, None, [], None, None, [], None, False, None, None, [], f"{type(e).__name__}: {e}", [], None)

    for b in batches:
        for lo in range(0, len(b), 500):  # a batch has thousands of messages
            part = b[lo : lo + 500]
            yield pd.DataFrame([one(p, None if r is None else bytes(r)) for p, r in zip(part["path"], part["raw"], strict=True)], columns=COLUMNS)


#: Names of mailboxes.
BOXES = "*.{mbox,mbx}"


def listed_path(c: Column) -> Column:
    """A file's path as Spark's file sources list it, from the form with escapes that its metadata has."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def read_eml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of ``.eml`` files under ``path``; undated ones have a null instant, unreadable ones an error.

    An empty file holds no message and gives no row, as Spark's file scan passes it over; a file inventory still lists it.
    """
    return raw_eml(spark, path).mapInPandas(_parsed, MESSAGE)


def records(spark: SparkSession, path: str | list[str], separator: str, glob: str) -> DataFrame:
    """(path, value): the text of files under ``path`` between occurrences of ``separator``, as unchanged bytes."""
    t = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return t.select(listed_path(F.col("_metadata.file_path")).alias("path"), "value")


def whole(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(path, raw): the bytes of each file; null for one that is larger than Spark reads as a whole (2 GB), which readers give as an error.

    The bound on sizes ends at the scan, so a large file is listed and never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))
    return files.where(F.col("length") <= most).select("path", F.col("content").alias("raw")).union(files.where(F.col("length") > most).select("path", F.lit(None).cast("binary")))


def raw_eml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, raw): the bytes of each ``.eml`` file, as ``whole`` gives them."""
    return whole(spark, path, "*.eml")


def raw_mbox(spark: SparkSession, path: str | list[str], glob: str = BOXES) -> DataFrame:
    """(path, raw): the bytes of each message of mailboxes, split at lines that begin with ``From ``; quoted ``>From `` lines are restored."""
    body = F.regexp_replace(F.regexp_replace("value", r"^(?:From )?[^\n]*\n", ""), r"(?m)^>(>*From )", "$1")
    # the record's first line is the rest of the separator line; bytes that are not UTF-8 stay as they are
    raw = F.when(F.is_valid_utf8("value"), body.cast("binary")).otherwise(F.expr("substring(cast(value as binary), locate('\n', value) + 1)"))
    return records(spark, path, "\nFrom ", glob).where(F.locate("\n", "value") > 0).select("path", raw.alias("raw"))


def claimed(spark: SparkSession, path: str | list[str], glob: str = BOXES) -> DataFrame:
    """(path, claimed): how many messages a mailbox holds by its separator lines, counted without reading any message.

    A separator is a line that begins with ``From `` and ends with a year; a line of a text that lost its quote mark is none.
    """
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(listed_path(F.col("_metadata.file_path")).alias("path"), "value")
    return t.where(F.col("value").rlike(r"^From \S+.*\b(19|20)\d\d\s*$")).groupBy("path").agg(F.count("*").alias("claimed"))


def read_mbox(spark: SparkSession, path: str | list[str], glob: str = BOXES) -> DataFrame:
    """Messages of ``.mbox`` files and text ``.mbx`` files, split at lines that begin with ``From ``; quoted ``>From `` lines are restored."""
    return raw_mbox(spark, path, glob).mapInPandas(_parsed, MESSAGE)


def _unfolded(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"\n[ \t]", "")


def _property(c: Column, name: str, group: int = 2) -> Column:
    """Value (group 2) or parameters (group 1) of a property line; null where it is missing."""
    at = rf"(?mi)^{name}((?:;[^:\n]*)?):([^\n]*)$"
    return F.when(c.rlike(at), F.regexp_extract(c, at, group))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")


def read_ics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of ``.ics`` files; rules are kept, not expanded, with the occurrences that they leave out and those that have events of their own.

    ``starts`` and ``ends`` are ISO text: UTC where the value says so, else the wall clock with ``tz`` of its parameter
    (null when floating). All-day events have a date only. Where a length stands for an end, the end follows from it.
    """
    # what reminders within an event say of lengths and times is not the event's
    text = F.regexp_replace(_unfolded(F.split("value", "END:VEVENT")[0]), r"(?s)BEGIN:VALARM.*?END:VALARM[^\n]*\n?", "")
    e = records(spark, path, "BEGIN:VEVENT", "*.ics").where(F.col("value").contains("END:VEVENT")).select("path", text.alias("v"))
    v = F.col("v")
    iso = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)", "$1-$2-$3"), r"T(\d\d)(\d\d)(\d\d)", "T$1:$2:$3")
    zone = F.regexp_extract(_property(v, "DTSTART", 1), r"(?i)TZID=\"?([^;:\"]+)", 1)
    start, length = _property(v, "DTSTART"), _property(v, "DURATION")
    at = iso(start)
    whole_days = F.date_format(F.date_add(F.to_date(at), F.regexp_extract(length, r"^\+?P(\d+)D$", 1).try_cast("int")), "yyyy-MM-dd")
    ends = F.coalesce(iso(_property(v, "DTEND")), F.when(F.length(start) == 8, whole_days).otherwise(end_of(at, length)))
    excluded = F.flatten(F.transform(F.regexp_extract_all(v, F.lit(r"(?mi)^EXDATE(?:;[^:\n]*)?:([^\n]*)$"), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda d: iso(F.trim(d)))))
    return e.select(
        "path", _property(v, "UID").alias("uid"), iso(_property(v, "RECURRENCE-ID")).alias("recurrence_id"), _property(v, "SEQUENCE").try_cast("int").alias("sequence"), _property(v, "STATUS").alias("status"), excluded.alias("exdates"),
        _plain(_property(v, "SUMMARY")).alias("subject"), _plain(_property(v, "LOCATION")).alias("location"), _plain(_property(v, "DESCRIPTION")).alias("body"),
        at.alias("starts"), ends.alias("ends"), F.when(start.endswith("Z"), "UTC").when(zone != "", zone).alias("tz"), (F.length(start) == 8).alias("all_day"),
        _property(v, "RRULE").alias("rule"), F.lower(F.regexp_replace(_property(v, "ORGANIZER"), "(?i)^mailto:", "")).alias("organizer"),
        F.transform(F.regexp_extract_all(v, F.lit(r"(?mi)^ATTENDEE(?:;[^:\n]*)?:(?:mailto:)?([^\n]*)$"), F.lit(1)), F.lower).alias("attendees"),
    )


@F.pandas_udf(T.StringType())
def _quoted(values: pd.Series) -> pd.Series:
    """Quoted-printable text, as UTF-8 where it is that, else as a western code page."""
    import quopri

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        raw = quopri.decodestring(v.encode())
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("cp1252", "replace")

    return values.map(one)


def read_vcs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of version 1.0 calendars (``.vcs``): quoted-printable texts, floating times, positional rules put as RFC 5545 ones.

    Rules with more than an interval, weekdays and a count stay as they are.
    """
    text = F.regexp_replace(_unfolded(F.regexp_replace(F.split("value", "END:VEVENT")[0], r"=\r?\n", "")), r"\r", "")
    e = records(spark, path, "BEGIN:VEVENT", "*.vcs").where(F.col("value").contains("END:VEVENT")).select("path", text.alias("v"))
    v, start = F.col("v"), _property(F.col("v"), "DTSTART")
    iso = lambda c: F.regexp_replace(F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d)", "$1-$2-$3"), r"T(\d\d)(\d\d)(\d\d)", "T$1:$2:$3")
    soft = lambda name: _plain(F.when(F.upper(_property(v, name, 1)).contains("QUOTED-PRINTABLE"), _quoted(_property(v, name))).otherwise(_property(v, name)))
    raw = F.trim(_property(v, "RRULE"))
    at = r"^(D|W)(\d+)((?: (?:MO|TU|WE|TH|FR|SA|SU))*)(?: #(\d+))?$"
    days = F.regexp_replace(F.trim(F.regexp_extract(raw, at, 3)), " ", ",")
    count = F.regexp_extract(raw, at, 4)
    rule = F.concat_ws(
        ";", F.concat(F.lit("FREQ="), F.when(F.regexp_extract(raw, at, 1) == "D", "DAILY").otherwise("WEEKLY")), F.concat(F.lit("INTERVAL="), F.regexp_extract(raw, at, 2)),
        F.when(days != "", F.concat(F.lit("BYDAY="), days)), F.when((count != "") & (count != "0"), F.concat(F.lit("COUNT="), count)),
    )
    return e.select(
        "path", _property(v, "UID").alias("uid"), soft("SUMMARY").alias("subject"), soft("LOCATION").alias("location"), soft("DESCRIPTION").alias("body"), iso(start).alias("starts"), iso(_property(v, "DTEND")).alias("ends"),
        F.when(start.endswith("Z"), "UTC").alias("tz"), (F.length(start) == 8).alias("all_day"), F.when(raw.rlike(at), rule).otherwise(raw).alias("rule"),
        F.lower(F.regexp_replace(_property(v, "ORGANIZER"), "(?i)^mailto:", "")).alias("organizer"),
        F.transform(F.regexp_extract_all(v, F.lit(r"(?mi)^ATTENDEE(?:;[^:\n]*)?:(?:mailto:)?([^\n]*)$"), F.lit(1)), F.lower).alias("attendees"),
    )


def _archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages of zipped XML archives; a member that is too large, swells too much or is broken gives a row with its error."""
    import io
    import zipfile
    from xml.etree import ElementTree

    empty = dict.fromkeys(COLUMNS) | {"refs": [], "receivers": [], "attachments": [], "tz_known": False}

    def message(m, path: str) -> dict | None:
        get = lambda tag: (m.findtext(f"OPFMessageCopy{tag}") or "").strip() or None
        addresses = lambda tag: [a.get("OPFContactEmailAddressAddress").lower() for a in m.iterfind(f"OPFMessageCopy{tag}/emailAddress") if a.get("OPFContactEmailAddressAddress")]
        at, body = get("SentTime") or get("ReceivedTime"), get("Body")
        sender = next(iter(addresses("FromAddresses") or addresses("SenderAddress")), None)
        if not (at or body or get("Subject") or sender):
            return None
        html = body if body and body.lstrip()[:1] == "<" else None
        files = [(a.get("OPFAttachmentName"), a.get("OPFAttachmentContentType"), int(a.get("OPFAttachmentContentFileSize") or 0)) for a in m.iterfind("OPFMessageCopyAttachmentList/messageAttachment")]
        receivers = addresses("ToAddresses") + addresses("CCAddresses") + addresses("BCCAddresses")
        return empty | {
            "path": path, "message_id": get("MessageID"), "in_reply_to": get("InReplyTo"), "refs": (get("References") or "").split(), "subject": get("Subject"), "sender": sender, "receivers": receivers,
            "occurred": at and at[:19] + "Z", "tz_known": bool(at), "body": None if html else body, "html": html, "attachments": files,
        }

    def rows(path: str, raw: bytes | None) -> Iterator[dict]:
        if raw is None:
            yield empty | {"path": path, "error": TOO_LARGE}
            return
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as e:
            yield empty | {"path": path, "error": f"BadZipFile: {e}"}
            return
        for i in z.infolist():
            if not i.filename.lower().endswith(".xml") or "message" not in i.filename.lower():
                continue
            if i.file_size > OLM_MEMBER_BYTES or i.file_size > OLM_SWELL * max(i.compress_size, 1):
                yield empty | {"path": path, "error": f"member too large: {i.filename}"}
                continue
            try:
                for _, m in ElementTree.iterparse(io.BytesIO(z.read(i))):
                    if m.tag == "email":
                        if found := message(m, path):
                            yield found
                        m.clear()
            except (ElementTree.ParseError, zipfile.BadZipFile, ValueError) as e:
                yield empty | {"path": path, "error": f"{i.filename}: {e}"}

    for b in batches:
        for p, r in zip(b["path"], b["raw"], strict=True):
            found = list(rows(p, None if r is None else bytes(r)))
            for k in range(0, len(found), 1000):
                yield pd.DataFrame(found[k : k + 1000], columns=COLUMNS)


#: Bytes of one archive member, and how many times its packed size it may unpack to.
OLM_MEMBER_BYTES, OLM_SWELL = 256 << 20, 200


def read_olm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Messages of zipped XML mail archives (``.olm``), a file to a task: a zip cannot be split, and Spark reads whole files up to 2 GB."""
    return whole(spark, path, "*.olm").mapInPandas(_archived, MESSAGE)


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    wide, mail = re.compile(rb"(?:[\x20-\x7e\xa0-\xff]\x00){3,}"), re.compile(r"^[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+$")

    def cards(path: str, raw: bytes) -> list[tuple]:
        found, seen, out = [m.group().decode("utf-16-le").strip() for m in wide.finditer(raw)], set(), []
        for k, text in enumerate(found):
            if mail.match(text) and text.lower() not in seen:
                seen.add(text.lower())
                before = (t for t in reversed(found[max(0, k - 4) : k]) if "@" not in t and re.search(r"[^\W\d_]{2}", t))
                out.append((path, next(before, None), None, None, [text.lower()], [], 0.5))
        return out

    for b in batches:
        yield pd.DataFrame([c for p, r in zip(b["path"], b["raw"], strict=True) for c in cards(p, bytes(r))], columns="path name org title emails phones confidence".split())


def read_wab(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Addresses saved from binary address books (``.wab``), each with the nearest name among the four texts before it; confidence 0.5."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wab").load(path)
    return files.select("path", F.col("content").alias("raw")).mapInPandas(_strings, "path string, name string, org string, title string, emails array<string>, phones array<string>, confidence double")


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cards of ``.vcf`` files: name, organisation, title, e-mail addresses and telephone numbers."""
    text = _unfolded(F.split("value", "END:VCARD")[0])
    v = F.col("v")
    c = records(spark, path, "BEGIN:VCARD", "*.vcf").where(F.col("value").contains("END:VCARD")).select("path", text.alias("v"))
    every = lambda name: F.regexp_extract_all(v, F.lit(rf"(?mi)^(?:item\d+\.)?{name}(?:;[^:\n]*)?:([^\n]*)$"), F.lit(1))
    family = F.split(_property(v, "N"), ";")
    joined = F.trim(F.concat_ws(" ", F.get(family, F.lit(1)), F.get(family, F.lit(0))))
    return c.select(
        "path", _plain(F.coalesce(_property(v, "FN"), joined)).alias("name"), _plain(F.split(_property(v, "ORG"), ";")[0]).alias("org"), _plain(_property(v, "TITLE")).alias("title"),
        F.transform(every("EMAIL"), F.lower).alias("emails"), every("TEL").alias("phones"),
    )
