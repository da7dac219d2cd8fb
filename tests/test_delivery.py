"""Deliveries: a store brought up to date file by file is the store of a full run."""

import os

import pytest

from epistle.operators.versions import Versions
from epistle.plans.delivery import Mailstore
from epistle.plans.ingest import ingest
from epistle.plans.queries import deliveries
from epistle.sources.mail import read_mbox
from epistle.streaming.delivery import follow


def mail(n, subject, to="b@y.example", extra="", day=2):
    return f"From: Ann <ann@mail.example>\nTo: {to}\nSubject: {subject}\nDate: Tue, {day:02d} Mar 2004 10:00:00 +0000\nMessage-ID: <{n}@x>\n{extra}\nbody {n}\n".encode()


def box(path, *mails):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(b"From x\n" + m + b"\n" for m in mails))


def plain(t):
    rows = lambda df, *c: sorted(map(str, (tuple(r) for r in df.select(*c).collect())))
    return {
        "items": rows(t.items, "item_id", "dedup_key", "path", "subject", "body"), "sources": rows(t.item_sources, "item_id", "path", "native_id", "sightings"),
        "identities": rows(t.identities, "person_id", "address", "address_type", "uses", "first_seen", "last_seen"), "participations": rows(t.participations, "item_id", "person_id", "role"),
        "threads": rows(t.threads, "item_id", "thread_id"), "findings": rows(t.findings, "code", "path", "item_id"), "outcomes": rows(t.outcomes, "path", "records", "errors", "items"),
    }


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "mail"
    box(at / "a.mbox", mail(1, "Budget plan"), mail(2, "Re: other", "c@y.example", "In-Reply-To: <1@x>\n"), mail(1, "Budget plan"))
    box(at / "sub [x] 1+1" / "b c.mbox", mail(1, "Budget plan, second copy"), mail(3, "RE: Budget plan"), mail(9, "Far away", "z@y.example"))
    (at / "d.eml").write_bytes(mail(5, "Stray", "d@y.example"))
    (at / "f.vcf").write_bytes(b"BEGIN:VCARD\nFN:B\nEMAIL:b@y.example\nEND:VCARD\nBEGIN:VCARD\nNOTE:x\nEND:VCARD\n")
    return at


def test_deliveries_equal_full_runs(spark, folder, tmp_path):
    store = Mailstore(spark, str(folder), str(tmp_path / "store"))
    assert store.refresh() == {"new": 4, "changed": 0, "gone": 0, "records": 9}
    assert plain(store.tables()) == plain(ingest(spark, str(folder)))
    assert store.refresh() == {"new": 0, "changed": 0, "gone": 0, "records": 0} and store.versions.version() == 1

    # a new box links two threads and repeats a message, a changed one loses a first record, a file goes
    box(folder / "n.mbox", mail(7, "bridge", "q@y.example", "In-Reply-To: <9@x>\nReferences: <3@x>\n"), mail(5, "Stray", "d@y.example"))
    box(folder / "a.mbox", mail(2, "Re: other", "c@y.example", "In-Reply-To: <1@x>\n"), mail(8, "Fresh"))
    (folder / "d.eml").unlink()
    before = plain(store.tables())
    for part in ("items", "threads", "manifest"):  # a run that is lost leaves the old version of all tables
        with pytest.raises(RuntimeError):
            store.refresh(stop_before=part)
        assert plain(Mailstore(spark, str(folder), str(tmp_path / "store")).tables()) == before
    assert store.refresh() == {"new": 1, "changed": 1, "gone": 1, "records": 4}
    after = plain(store.tables())
    assert after == plain(ingest(spark, str(folder))) and after != before
    assert plain(store.tables(1)) == before

    # what bridged two threads goes: they part again; then everything goes
    (folder / "n.mbox").unlink()
    assert store.refresh()["gone"] == 1 and plain(store.tables()) == plain(ingest(spark, str(folder)))
    store.versions.compact()
    assert store.versions.layers("items") == 1 and plain(store.tables()) == plain(ingest(spark, str(folder)))
    for f in (folder / "a.mbox", folder / "sub [x] 1+1" / "b c.mbox", folder / "f.vcf"):
        f.unlink()
    assert store.refresh()["gone"] == 3 and not any(plain(store.tables()).values())


def test_follow(spark, folder, tmp_path):
    store = Mailstore(spark, str(folder), str(tmp_path / "store"))
    follow(store, str(tmp_path / "state")).awaitTermination()
    first = store.versions.version()
    follow(store, str(tmp_path / "state")).awaitTermination()
    assert store.versions.version() == first == 1
    box(folder / "n.mbox", mail(7, "bridge", "q@y.example", "In-Reply-To: <9@x>\n"))
    os.utime(folder / "d.eml", (1, 1))
    follow(store, str(tmp_path / "state")).awaitTermination()
    assert plain(store.tables()) == plain(ingest(spark, str(folder)))


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, x string")
    rows = lambda *a: sorted(tuple(r) for r in v.table("t", *a).collect())
    assert v.version() == 0 and v.table("t") is None
    v.commit({"t": (make((1, "a"), (2, "b"), (2, "c")), "k", make())})
    v.commit({"t": (make((2, "d"), (3, "e")), "k", make((2, ""), (3, "")))})
    v.commit({"t": (make(), "k", make((1, "")))})
    assert rows() == [(2, "d"), (3, "e")] and rows(1) == [(1, "a"), (2, "b"), (2, "c")] and rows(2) == [(1, "a"), (2, "d"), (3, "e")]
    v.compact()
    v.commit({"t": (make((2, "f")), "k", make((2, ""))), "u": (make((9, "z")), "k", None)})
    assert rows() == [(2, "f"), (3, "e")] and v.layers("t") == 2 and v.table("u").count() == 1


def test_boxes_have_files_by_their_messages(spark, tmp_path, monkeypatch):
    """A box is not one file by one task, and the files of a box hold each of its messages once."""
    monkeypatch.setattr(deliveries, "MESSAGES", 10)
    docs = spark.range(100).selectExpr("id as doc_id", "0 as box", "'s' as subject", "'body' as text")
    deliveries.put_boxes(docs, str(tmp_path / "boxes"))
    read = read_mbox(spark, str(tmp_path / "boxes"), "*.txt").select("path", "message_id").collect()
    assert len({r.path for r in read}) > 3 and len(read) == len({r.message_id for r in read}) == 100
