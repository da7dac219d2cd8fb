"""Files to tables, and the streamed index."""

from epistle.operators.search import postings
from epistle.plans.ingest import ingest
from epistle.streaming import index


def mail(n, subject, to, extra="", date="Date: Tue, 02 Mar 2004 10:00:00 +0000\n", mid=True):
    return f"From: Ann <ann+x@mail.example>\nTo: {to}\nSubject: {subject}\n{date}{f'Message-ID: <{n}@x>' if mid else 'X: y'}\n{extra}\nbody {n}\n".encode()


def test_ingest(spark, tmp_path):
    one, two, three = mail(1, "Budget plan", "b@y.example"), mail(2, "Re: other", "c@y.example", "In-Reply-To: <1@x>\n"), mail(3, "RE: Budget plan", "b@y.example")
    bare, undated = mail(4, "Lone", "b@y.example", mid=False), mail(5, "Stray", "d@y.example", date="")
    (tmp_path / "a.mbox").write_bytes(b"".join(b"From x\n" + m + b"\n" for m in (one, two, one)))
    (tmp_path / "b.mbox").write_bytes(b"".join(b"From x\n" + m + b"\n" for m in (one, three, bare)))
    (tmp_path / "c.eml").write_bytes(bare)
    (tmp_path / "d.eml").write_bytes(undated)
    event = b"BEGIN:VEVENT\nUID:e1\nSUMMARY:s\nDTSTART:20040302T120000\nRRULE:FREQ=DAILY\nORGANIZER:mailto:ann@mail.example\nEND:VEVENT\n"
    (tmp_path / "e.ics").write_bytes(b"BEGIN:VCALENDAR\n" + event + event + b"END:VCALENDAR\n")
    (tmp_path / "f.vcf").write_bytes(b"BEGIN:VCARD\nFN:B\nEMAIL:b@y.example\nEND:VCARD\nBEGIN:VCARD\nNOTE:x\nEND:VCARD\n")
    t = ingest(spark, str(tmp_path))
    tail = lambda p: p.split("/")[-1]
    items = {r["item_id"]: r for r in t.items.collect()}
    assert sorted((r["kind"], tail(r["path"])) for r in items.values()) == [
        ("contact", "f.vcf"), ("event", "e.ics"), ("message", "a.mbox"), ("message", "a.mbox"), ("message", "b.mbox"), ("message", "b.mbox"), ("message", "d.eml"),
    ]
    sights = {(items[r["item_id"]]["message_id"], tail(r["path"])): r["sightings"] for r in t.item_sources.collect() if items[r["item_id"]]["kind"] == "message"}
    assert sights == {("<1@x>", "a.mbox"): 2, ("<2@x>", "a.mbox"): 1, ("<1@x>", "b.mbox"): 1, ("<3@x>", "b.mbox"): 1, (None, "b.mbox"): 1, (None, "c.eml"): 1, ("<5@x>", "d.eml"): 1}
    people = {r["address"]: r for r in t.identities.collect()}
    assert set(people) == {"ann@mail.example", "b@y.example", "c@y.example", "d@y.example"} and people["ann@mail.example"]["uses"] == 6
    roles = {r["role"] for r in t.participations.collect()}
    assert roles == {"from", "to", "organizer", "card"}
    groups = {}
    for r in t.threads.collect():
        groups.setdefault(r["thread_id"], set()).add(items[r["item_id"]]["message_id"])
    assert sorted(map(len, groups.values())) == [1, 1, 3] and {"<1@x>", "<2@x>", "<3@x>"} in groups.values()
    assert sorted((r["code"], tail(r["path"])) for r in t.findings.collect()) == [("no_date", "d.eml"), ("read_failure", "f.vcf"), ("unknown_timezone", "e.ics"), ("unresolved_recurrence", "e.ics")]
    assert {tail(r["path"]): (r["records"], r["errors"], r["items"]) for r in t.outcomes.collect()}["f.vcf"] == (2, 1, 1)
    again = {r["dedup_key"] for r in ingest(spark, str(tmp_path)).items.collect()}
    assert again == {r["dedup_key"] for r in items.values()}


def test_ingest_of_text_and_binary_boxes(spark, tmp_path):
    import struct

    one = mail(1, "Framed", "b@y.example")
    record = b"JMF6" + struct.pack("<III", 16 + len(one), 1, 0) + one
    (tmp_path / "a.mbx").write_bytes((b"JMF9" + struct.pack("<II", 0, 1)).ljust(0x54, b"\0") + record)
    (tmp_path / "b.mbx").write_bytes(b"From x\n" + mail(2, "Plain", "b@y.example"))
    got = ingest(spark, str(tmp_path), ["message"]).items.collect()
    assert sorted((r["subject"], r["path"][-5:]) for r in got) == [("Framed", "a.mbx"), ("Plain", "b.mbx")]


def test_streamed_index(spark, tmp_path):
    docs = [(1, "a b"), (2, "c"), (2, "c")], [(2, "c"), (3, None), (4, "a")]
    for n, rows in enumerate(docs):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        index.fill(stream, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    every = spark.read.parquet(f"{tmp_path}/in")
    got = sorted((r["doc_id"], r["pos"], r["term"]) for r in index.indexed(every, f"{tmp_path}/index").collect())
    assert got == sorted(tuple(r) for r in postings(every.distinct()).collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (4, 0, "a")]
    assert index.missing(every, f"{tmp_path}/index").count() == 0
