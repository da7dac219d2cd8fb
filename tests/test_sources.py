"""Readers on small files written here."""

from email.message import EmailMessage

from pyspark.sql import functions as F

from epistle.operators import integrity, recurrence
from epistle.plans.ingest import dedup_key, read_all
from epistle.sources import attached
from epistle.sources.mail import claimed, raw_eml, raw_mbox, read_eml, read_ics, read_mbox, read_vcf
from epistle.sources.sinks import write_csv, write_json, write_markdown


def message(n, date="Tue, 02 Mar 2004 10:00:00 +0200"):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"] = f"Grüße {n}", "Ann <Ann@X.example>", "b@y.example, C <c@y.example>", f"<{n}@x>"
    if date:
        m["Date"] = date
    m.set_content(f"body {n}\n")
    return m


def test_eml(spark, tmp_path):
    m = message(1)
    m.add_attachment(b"abc", maintype="application", subtype="pdf", filename="é.pdf")
    (tmp_path / "a.eml").write_bytes(m.as_bytes())
    (tmp_path / "b.eml").write_bytes(message(2, None).as_bytes())
    (tmp_path / "c.eml").write_bytes(b"\x00\xffjunk")
    (tmp_path / "empty.eml").write_bytes(b"")
    rows = {r["message_id"]: r for r in read_eml(spark, str(tmp_path)).collect()}
    assert len(rows) == 3
    one = rows["<1@x>"]
    assert (one["subject"], one["sender"], one["receivers"], one["occurred"], one["tz_known"]) == ("Grüße 1", "ann@x.example", ["b@y.example", "c@y.example"], "2004-03-02T08:00:00Z", True)
    assert [tuple(a) for a in one["attachments"]] == [("é.pdf", "application/pdf", 3)]
    assert rows["<2@x>"]["occurred"] is None


def test_mbox(spark, tmp_path):
    text = b"".join(b"From x Tue Mar  2 10:00:00 2004\n" + message(n).as_bytes() + b">From here on\n\n" for n in range(5))
    (tmp_path / "a.mbox").write_bytes(text)
    rows = sorted(read_mbox(spark, str(tmp_path)).collect(), key=lambda r: r["message_id"])
    assert [r["message_id"] for r in rows] == [f"<{n}@x>" for n in range(5)]
    assert all(r["error"] is None and "From here on" in r["body"] and ">From" not in r["body"] for r in rows)


def test_ics_and_vcf(spark, tmp_path):
    (tmp_path / "a.ics").write_bytes(
        b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Lunch\\, with a lo\r\n ng name\r\nDTSTART;TZID=Europe/Berlin:20040302T120000\r\nDTEND:20040302T130000Z\r\nRRULE:FREQ=WEEKLY\r\n"
        b"ATTENDEE;CN=B:mailto:B@y.example\r\nATTENDEE:mailto:c@y.example\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20040305\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    )
    a, b = sorted(read_ics(spark, str(tmp_path)).collect(), key=lambda r: r["uid"])
    assert (a["subject"], a["starts"], a["ends"], a["tz"], a["all_day"], a["rule"]) == ("Lunch, with a long name", "2004-03-02T12:00:00", "2004-03-02T13:00:00Z", "Europe/Berlin", False, "FREQ=WEEKLY")
    assert a["attendees"] == ["b@y.example", "c@y.example"]
    assert (b["starts"], b["all_day"], b["tz"], b["subject"]) == ("2004-03-05", True, None, None)
    (tmp_path / "a.vcf").write_bytes(b"BEGIN:VCARD\nVERSION:3.0\nN:Lee;Ann\nORG:Org;Unit\nEMAIL;TYPE=WORK:Ann@X.example\nTEL:+1 2\nTEL:+1 3\nEND:VCARD\nBEGIN:VCARD\nFN:Bo\nEND:VCARD\n")
    rows = {r["name"]: r for r in read_vcf(spark, str(tmp_path)).collect()}
    assert rows["Ann Lee"]["emails"] == ["ann@x.example"] and rows["Ann Lee"]["phones"] == ["+1 2", "+1 3"] and rows["Ann Lee"]["org"] == "Org"
    assert rows["Bo"]["emails"] == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, 'a "b", c\nd'), (3, None)], "id long, t string")
    assert write_csv(df, f"{tmp_path}/csv") == 3
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert {r["t"] for r in back.collect()} == {"'=1+1", 'a "b", c\nd', None}
    assert write_json(df, df.limit(0), f"{tmp_path}/json") == 3
    assert spark.read.json(f"{tmp_path}/json/records").count() == 3


def test_markdown(spark, tmp_path):
    rows = [(1, "message", "1999-02-03T10:00:00Z", "b"), (2, "event", "1999-01-03T10:00:00Z", None), (3, "task", None, "u"), (4, "message", "2000-01-01T00:00:00Z", "c")]
    df = spark.createDataFrame(rows, "item_id long, kind string, occurred string, subject string")
    assert write_markdown(df, f"{tmp_path}/md") == 4
    lines = [x for p in sorted((tmp_path / "md").glob("year=*/part-*")) for x in p.read_text().splitlines()]
    assert lines == ["## 1999-01", "- 1999-01-03 10:00 **event** ", "## 1999-02", "- 1999-02-03 10:00 **message** b", "## 2000-01", "- 2000-01-01 00:00 **message** c", "## undated", "- ? **task** u"]


def event(uid, start, *more):
    return "\r\n".join(["BEGIN:VEVENT", f"UID:{uid}", f"DTSTART:{start}", *more, "END:VEVENT", ""])


def test_recurrence(spark, tmp_path):
    parts = [
        event("w", "20040301T090000Z", "DURATION:PT1H30M", "RRULE:FREQ=DAILY;COUNT=9", "EXDATE:20040304T090000Z,20040305T090000Z", "EXDATE;VALUE=DATE-TIME:20040306T090000Z", "BEGIN:VALARM", "DURATION:PT9H", "TRIGGER:-PT5M", "END:VALARM"),
        event("w", "20040302T110000Z", "RECURRENCE-ID:20040302T090000Z", "DTEND:20040302T120000Z"),
        event("w", "20040303T090000Z", "RECURRENCE-ID:20040303T090000Z", "STATUS:CANCELLED"),
        event("w", "20040306T100000Z", "RECURRENCE-ID:20040306T090000Z", "SEQUENCE:2"),
        event("w", "20040306T080000Z", "RECURRENCE-ID:20040306T090000Z", "SEQUENCE:1"),
        event("w", "20040307T090000Z", "RECURRENCE-ID:20040307T090000Z", "SUMMARY:other room"),
        event("lone", "20040307T090000Z", "RECURRENCE-ID:20040306T090000Z"),
        event("day", "20040307", "DURATION:P2D"),
    ]
    (tmp_path / "a.ics").write_bytes(("BEGIN:VCALENDAR\r\n" + "".join(parts) + "END:VCALENDAR\r\n").encode())
    e = read_ics(spark, str(tmp_path)).withColumn("item_id", F.xxhash64("uid", F.coalesce("recurrence_id", F.lit("")), "starts"))
    rows = {(r["uid"], r["recurrence_id"], r["starts"]): r for r in e.collect()}
    assert rows["w", None, "2004-03-01T09:00:00Z"]["ends"] == "2004-03-01T10:30:00Z" and rows["day", None, "2004-03-07"]["ends"] == "2004-03-09"
    got = sorted((r["series_id"] is not None, r["original"], r["what"], r["starts"]) for r in recurrence.exceptions(e).collect())
    assert got == [
        (False, "2004-03-06T09:00:00Z", "moved", "2004-03-07T09:00:00Z"), (True, "2004-03-02T09:00:00Z", "moved", "2004-03-02T11:00:00Z"), (True, "2004-03-03T09:00:00Z", "cancelled", None), (True, "2004-03-04T09:00:00Z", "cancelled", None),
        (True, "2004-03-05T09:00:00Z", "cancelled", None), (True, "2004-03-06T09:00:00Z", "moved", "2004-03-06T10:00:00Z"), (True, "2004-03-07T09:00:00Z", "changed", "2004-03-07T09:00:00Z"),
    ]
    m = recurrence.with_exceptions(e).collect()
    assert len(m) == 1 and [x[:10] for x in m[0]["cancelled"]] == ["2004-03-03", "2004-03-04", "2004-03-05"] and [x["starts"][11:13] for x in m[0]["moved"]] == ["11", "10"]
    keys = read_all(spark, str(tmp_path), ["event"]).select("recurrence_id", dedup_key(F.lit("event")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == 8 and sum(r["recurrence_id"] is not None for r in keys) == 6


def test_claims(spark, tmp_path):
    one = b"From a@x Mon Jan 04 10:00:00 1999\nSubject: s\nMessage-ID: <%d@x>\n\nbody\n\n"
    (tmp_path / "a.mbox").write_bytes(b"".join(one % n for n in range(6)) + b"From the editor\nnothing\n")
    (tmp_path / "b.mbox").write_bytes(one % 9)
    claims = claimed(spark, str(tmp_path))
    assert sorted((r["path"][-6:], r["claimed"]) for r in claims.collect()) == [("a.mbox", 6), ("b.mbox", 1)]
    got = read_mbox(spark, str(tmp_path)).where("message_id is not null and message_id <> '<3@x>' and message_id <> '<4@x>'").select(F.col("path").alias("source_id"), "message_id")
    lost = integrity.partial_parse(claims.withColumnRenamed("path", "source_id"), got).collect()
    assert [(r["source_id"][-6:], r["claimed"], r["got"], r["loss"]) for r in lost] == [("a.mbox", 6, 4, 2)]


def test_attachments_of_mails(spark, tmp_path):
    m, inner = message(1), message(2)
    m.add_attachment(b"hello there", maintype="text", subtype="plain", filename="n.txt")
    m.add_attachment(inner)
    (tmp_path / "a.eml").write_bytes(m.as_bytes())
    (tmp_path / "b.eml").write_bytes(b"\x00junk")
    (tmp_path / "c.mbox").write_bytes(b"From x\n" + message(3).as_bytes() + b"\nFrom x\n" + m.as_bytes())
    found = attached.of_messages(raw_eml(spark, str(tmp_path)).union(raw_mbox(spark, str(tmp_path))))
    rows = sorted((r["path"][-1], r["message_id"], r["place"], r["filename"], len(r["content_hash"])) for r in found.collect())
    assert rows == [(p, "<1@x>", n, f, 64) for p in "lx" for n, f in enumerate(["n.txt", "Grüße 2.eml"])]
    texts = attached.extracted(attached.parts(found.withColumn("attachment_id", F.xxhash64("content_hash")).dropDuplicates(["content_hash"]))).collect()
    assert {r["status"] for r in texts} == {"done"} and "hello there" in {r["text"] for r in texts}
