"""Text functions, checks that run apart, exports with their guard, and mail details, on small rows."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from epistle.functions import text as X
from epistle.operators import exports, ledger
from epistle.sources.files import scan
from epistle.sources.mail import read_eml


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_small_text_functions(spark):
    assert column(spark, [None, 0, 999, 1024, 10 * 1024, 5 << 20, 16 << 20, 3 << 30, 2 << 40], X.human_bytes, "long") == ["0 bytes", "0 bytes", "999 bytes", "1.0 KB", "10 KB", "5.0 MB", "16 MB", "3.0 GB", "2.0 TB"]
    bodies = ["Hi\nthere\n-- \nAnn\nOrg", "\n-- \nonly a signature", "Yes.\n\nOn 3 May 1999, Bo wrote:\n> x", "plain", None, "a\n-----Original Message-----\nb\n-- \nc", "Ok\nFrom: Bo\nSent: today\nold"]
    got = [tuple(r) for r in column(spark, bodies, X.without_signature)]
    assert got == [("Hi\nthere", "-- \nAnn\nOrg"), ("-- \nonly a signature", None), ("Yes.", "On 3 May 1999, Bo wrote:\n> x"), ("plain", None), ("", None), ("a", "-----Original Message-----\nb\n-- \nc"), ("Ok", "From: Bo\nSent: today\nold")]
    assert column(spark, ["a \n b", None, "x" * 301], exports.preview) == ["a b", "", "x" * 300 + "…"]
    assert column(spark, ["[1, 2, 30]", "[]", None], X.id_list) == [[1, 2, 30], [], None]
    start = F.lit("1999-12-31T23:30:00Z")
    assert column(spark, ["PT45M", "P1DT2H", "P2W", "-PT30M", "PT1H5M10S", "x", None], lambda d: exports.end_of(start, d)) == [
        "2000-01-01T00:15:00Z", "2000-01-02T01:30:00Z", "2000-01-14T23:30:00Z", "1999-12-31T23:00:00Z", "2000-01-01T00:35:10Z", None, None,
    ]
    assert column(spark, ["2000-01-01T00:15:00Z", "1999-12-31T23:00:00Z", None, "1999"], lambda e: exports.minutes(start, e)) == ["45", "", "", ""]


def test_banner_and_decisions(spark):
    led = spark.createDataFrame([("read_failure", "critical", 1, -1, "", 5, "open", None, None), ("hard_gap", "high", -1, -1, "1999-02", None, "open", None, None), ("no_date", "medium", -1, 7, "", None, "resolved", None, None)],
                                "code string, severity string, source_id long, item_id long, period string, loss long, state string, note string, resolved_at string")
    assert ledger.banner(led).first()["sentence"] == "1 file not read in full; 1 unexplained gap; about 5 records could not be read"
    assert ledger.banner(led.limit(0)).first()["sentence"] == "No problems found in what has been read."
    wish = lambda note: spark.createDataFrame([("hard_gap", None, None, "1999-02", "explained", note)], "code string, source_id long, item_id long, period string, new_state string, new_note string")
    state = lambda note: ledger.decided(led, wish(note), "now").where("code = 'hard_gap'").first()
    assert state(" ")["state"] == "open" and (state("moved")["state"], state("moved")["resolved_at"]) == ("explained", "now")
    q = ledger.qualifiers(led, since="1999-03")
    assert [(r["code"], r["loss"], r["severity"]) for r in q.collect()] == [("read_failure", 5, "critical")]
    with pytest.raises(ValueError):
        ledger.run_checks(spark, {"a": list}, {"b"})


def test_exports_by_kind_are_guarded(spark, tmp_path):
    items = spark.createDataFrame([(1, "message", "1999-01-02T03:04:05Z", "=s", "UTC", 1.0), (2, "task", None, "t", None, 0.5), (3, "event", "1999-01-02T03:04:05Z", "e", None, None), (4, "contact", None, "Ann", None, None), (5, "note", None, "n", None, None)],
                                  "item_id long, kind string, occurred string, subject string, tz string, confidence double")
    people = spark.createDataFrame([(1, "from", "Ann", "a@x"), (1, "to", None, "b@x"), (1, "to", "C", "a2@x"), (3, "attendee", "D", "d@x")], "item_id long, role string, name string, address string")
    sources = spark.createDataFrame([(1, "/b"), (1, "/a"), (2, "/a")], "item_id long, path string")
    found = spark.createDataFrame([("orphan_reply", "open", 1)], "code string, state string, item_id long")
    quality = exports.quality(items, found)
    one = exports.rows_of("message", items, people, sources, quality).first()
    assert (one["from_name"], one["to"], one["source_file"], one["time"], one["data_quality"]) == ("Ann", "C <a2@x>; b@x", "/a | /b", "03:04", "answers something that is not here")
    for kind, columns in exports.COLUMNS.items():
        assert exports.rows_of(kind, items, people, sources, quality).columns == columns
    assert [len(exports.COLUMNS[k]) for k in ("event", "message", "contact", "task", "note")] == [22, 15, 15, 9, 7]
    assert exports.export_kinds(items, people, sources, quality, f"{tmp_path}/all") == {"contact": 1, "event": 1, "message": 1, "note": 1, "task": 1}
    assert spark.read.option("header", True).csv(f"{tmp_path}/all/message").first()["subject"] == "'=s"
    assert exports.export_kinds(items, people, sources, quality, f"{tmp_path}/some", "json", items.where("item_id = 2")) == {"task": 1}
    with pytest.raises(RuntimeError):
        exports.run_export(items, f"{tmp_path}/short", "csv", 4)
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "A"), (4, "a"), (5, "")], "item_id long, subject string")
    assert [r["item_id"] for r in exports.ordered(rows, "subject").collect()] == [3, 4, 1, 2, 5]
    assert [r["item_id"] for r in exports.ordered(rows, "subject", True).collect()] == [1, 3, 4, 2, 5]


def test_attached_mail_roles_and_salvaged_dates(spark, tmp_path):
    inner = EmailMessage()
    inner["Subject"] = "inside"
    inner.set_content("INNER body")
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Cc"], m["Message-ID"] = "outer", "Ann Lee <A@x.example>", "b@x.example", "Cy <c@x.example>", "<1@x>"
    m.set_content("<p>OUTER</p>", subtype="html")
    m.add_attachment(inner)
    (tmp_path / "a.eml").write_bytes(m.as_bytes())
    for n, date in enumerate(["1999-02-03 04:05:06", "Wed Feb 3 04:05:06 1999", "3 Feb 99 04:05:06 +0100", "someday"]):
        (tmp_path / f"d{n}.eml").write_bytes(f"Subject: d{n}\nDate: {date}\n\nx\n".encode())
    rows = {r["subject"]: r for r in read_eml(spark, str(tmp_path)).collect()}
    one = rows["outer"]
    assert one["body"] is None and "OUTER" in one["html"] and [(a["name"], a["mime"]) for a in one["attachments"]] == [("inside.eml", "message/rfc822")]
    assert [tuple(p) for p in one["people"]] == [("from", "Ann Lee", "a@x.example"), ("to", None, "b@x.example"), ("cc", "Cy", "c@x.example")]
    assert [(rows[f"d{n}"]["occurred"], rows[f"d{n}"]["tz_known"]) for n in range(4)] == [("1999-02-03T04:05:06Z", False), ("1999-02-03T04:05:06Z", False), ("1999-02-03T03:05:06Z", True), (None, False)]
    assert rows["d3"]["date_header"] == "someday"


def test_scan_reads_heads_and_hashes(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(b"x" * (3 << 20))
    (tmp_path / "c.txt").write_bytes(b"short")
    rows = {r["name"]: r for r in scan(spark, [str(tmp_path)], hashed=True).collect()}
    import hashlib

    assert rows["a b.bin"]["content_hash"] == hashlib.sha256(b"x" * (3 << 20)).hexdigest() and bytes(rows["c.txt"]["head"]) == b"short"
    assert all(r["read_error"] is None for r in rows.values()) and bytes(rows["a b.bin"]["head"]) == b"x" * 32
