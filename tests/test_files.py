"""Inventory of files and the readers of older formats, on files written here."""

import zipfile

from epistle.operators.checks import file_checks
from epistle.sources import files
from epistle.sources.mail import read_mbox, read_olm, read_vcs, read_wab


def test_scan(spark, tmp_path):
    for name, data in {"a/x.ics": b"BEGIN:VCALENDAR\n", "a/y.vcf": b"BEGIN:VCALENDAR\n", "b/Trash/z.eml": b"x", "b/copy of x.ics": b"BEGIN:VCALENDAR\n", "b/s.pst": b"!BDN", "b/n.msg": b"junk" * 200, "b/e.eml": b"From: a\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    inv = files.scan(spark, [str(tmp_path), str(tmp_path / "a")], ["trash"], hashed=True)
    tail = lambda p: p.split("/")[-1]
    assert sorted(tail(r["path"]) for r in inv.collect()) == ["copy of x.ics", "e.eml", "n.msg", "s.pst", "x.ics", "y.vcf"]
    assert {(tail(r["path"]), r["code"]) for r in file_checks(inv).collect()} == {("y.vcf", "magic_mismatch"), ("s.pst", "zero_or_tiny"), ("n.msg", "magic_mismatch")}
    assert {(tail(r["path"]), tail(r["keeper"])) for r in files.copies(inv).collect()} == {("y.vcf", "x.ics"), ("copy of x.ics", "x.ics")}
    assert {tail(r["path"]) for r in files.declined(inv).collect()} == {"s.pst", "n.msg"}
    old = spark.createDataFrame([("p", 1, "mine", "done"), ("gone", 2, None, "done")], "path string, size int, note string, state string")
    now = files.listed(old, spark.createDataFrame([("p", 5), ("q", 6)], "path string, size int"))
    assert {tuple(r) for r in now.collect()} == {("p", 5, "mine", "done", True), ("q", 6, None, "new", True), ("gone", 2, None, "done", False)}


def test_walk(spark, tmp_path):
    """Loops of links end, two ways to one folder are one, roots are never excluded, what cannot be read is a row."""
    deep = tmp_path / "Trash" / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "x.eml").write_bytes(b"From: x\n")
    (tmp_path / "Trash" / "a" / "Temp").mkdir()
    (tmp_path / "Trash" / "a" / "Temp" / "gone.eml").write_bytes(b"x")
    (tmp_path / "Trash" / "y.eml").write_bytes(b"y" * 100)
    (deep / "back").symlink_to(tmp_path / "Trash", target_is_directory=True)
    (tmp_path / "Trash" / "second").symlink_to(deep, target_is_directory=True)
    (tmp_path / "Trash" / "nowhere").symlink_to(tmp_path / "missing")
    root, lost, one = str(tmp_path / "Trash"), str(tmp_path / "lost"), str(tmp_path / "one.eml")
    (tmp_path / "one.eml").write_bytes(b"1")
    (tmp_path / "empty").mkdir()
    tail = lambda p: p[len(str(tmp_path)) + 1 :]
    plain = files.walk(spark, [root, lost, one, str(tmp_path / "empty")], ["temp", "trash"]).collect()
    assert sorted((r["kind"], tail(r["path"])) for r in plain) == [("error", "lost"), ("file", "Trash/a/b/c/x.eml"), ("file", "Trash/y.eml"), ("file", "one.eml")]
    followed = files.walk(spark, [root], ["temp"], follow=True).collect()
    assert sorted((r["kind"], tail(r["path"])) for r in followed) == [("error", "Trash/nowhere"), ("file", "Trash/second/x.eml"), ("file", "Trash/y.eml")]
    got = {tail(r["path"]): (r["size"], r["content_hash"] is not None, r["read_error"]) for r in files.scan(spark, [root, lost], ["temp"], hashed=True, walked=True, most=50).collect()}
    assert got["Trash/a/b/c/x.eml"] == (8, True, None) and got["Trash/y.eml"] == (100, False, "not hashed: more than 50 bytes")
    assert got["lost"][:2] == (None, False) and "FileNotFoundError" in got["lost"][2] and len(got) == 3


def test_outermost():
    assert files.outermost(["/a/b", "/a", "/ab/", "/ab"]) == ["/a", "/ab"]


def test_vcs(spark, tmp_path):
    (tmp_path / "a.vcs").write_bytes(
        b"BEGIN:VCALENDAR\r\nVERSION:1.0\r\nBEGIN:VEVENT\r\nUID:7\r\nSUMMARY;ENCODING=QUOTED-PRINTABLE;CHARSET=UTF-8:Gr=C3=BC=\r\n=C3=9Fe\r\nDTSTART:19990104T090000\r\nDTEND:19990104T100000Z\r\n"
        b"RRULE:W1 MO WE #52\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:8\r\nSUMMARY:x\r\nDTSTART:19990104\r\nRRULE:MP1 1+ SU #0\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    )
    a, b = sorted(read_vcs(spark, str(tmp_path)).collect(), key=lambda r: r["uid"])
    assert (a["subject"], a["starts"], a["ends"], a["tz"], a["rule"]) == ("Grüße", "1999-01-04T09:00:00", "1999-01-04T10:00:00Z", None, "FREQ=WEEKLY;INTERVAL=1;BYDAY=MO,WE;COUNT=52")
    assert (b["all_day"], b["rule"]) == (True, "MP1 1+ SU #0")


def test_olm_mbx_wab(spark, tmp_path):
    mail = "<emails><email><OPFMessageCopySubject>Hi</OPFMessageCopySubject><OPFMessageCopySentTime>2010-05-06T07:08:09</OPFMessageCopySentTime><OPFMessageCopyBody>&lt;p&gt;x&lt;/p&gt;</OPFMessageCopyBody>"
    mail += '<OPFMessageCopyFromAddresses><emailAddress OPFContactEmailAddressAddress="A@x.example"/></OPFMessageCopyFromAddresses><OPFMessageCopyToAddresses><emailAddress OPFContactEmailAddressAddress="b@x.example"/></OPFMessageCopyToAddresses></email><email/></emails>'
    with zipfile.ZipFile(tmp_path / "a.olm", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Accounts/me/message_0.xml", mail)
        z.writestr("Accounts/me/message_1.xml", "<emails><broken>")
        z.writestr("Accounts/me/message_2.xml", "<a>" + " " * 2_000_000 + "</a>")
    (tmp_path / "broken.olm").write_bytes(b"no zip")
    rows = read_olm(spark, str(tmp_path)).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(rows) == 4 and len(good) == 1
    assert (good[0]["subject"], good[0]["sender"], good[0]["receivers"], good[0]["occurred"], good[0]["html"]) == ("Hi", "a@x.example", ["b@x.example"], "2010-05-06T07:08:09Z", "<p>x</p>")
    (tmp_path / "b.mbx").write_bytes(b"From ???@??? Mon Jan 04 10:00:00 1999\nSubject: one\nFrom: a@x\n\nbody\n\nFrom ???@??? Mon Jan 04 10:00:00 1999\nSubject: two\n\n")
    assert sorted(r["subject"] for r in read_mbox(spark, str(tmp_path)).collect()) == ["one", "two"]
    texts = ["Ann Lee", "noise 1", "ann@x.example", "ANN@x.example", "1", "22", "333", "4444", "bo@y.example"]
    (tmp_path / "c.wab").write_bytes(b"\x9c\xcb" + b"\x01\x02\x03".join(t.encode("utf-16-le") for t in texts))
    got = {r["emails"][0]: r["name"] for r in read_wab(spark, str(tmp_path)).collect()}
    assert got == {"ann@x.example": "noise 1", "bo@y.example": None}
