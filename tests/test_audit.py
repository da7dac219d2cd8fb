"""All check families in one run, their report, overlaps of periods, and the log of merges."""

from pyspark.sql import functions as F

from epistle.operators import ledger, merges
from epistle.plans import audit
from epistle.settings import Settings


def facts(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    month = lambda k: f"{2000 + k // 12}-{k % 12 + 1:02d}"
    items = [(100 * k + n, "message", f"{month(k)}-05T10:00:00Z", True, 1.0, None) for k in range(40) if k not in (20, 21) for n in range(1 if k == 30 else 10)]
    items += [(9001 + n, "message", None, False, 1.0, None) for n in range(5)] + [(9010, "event", "2001-01-01T00:00:00", False, 0.5, "FREQ=DAILY"), (9011, "message", "1931-01-01T00:00:00Z", True, 1.0, None), (9012, "contact", None, False, 1.0, None)]
    links = [(i[0], 1) for i in items] + [(i[0], 2) for i in items[:12]] + [(items[0][0], 3), (items[-9][0], 3)] + [(9001, 4)]
    sources = [
        (1, "/a/1995-2003.mbox", ".mbox", 10_000, b"From ", 1996, True, False, None, None, "done", None, 5, 1000, False, 1),
        (2, "/a/copy.mbox", ".mbox", 10_000, b"BEGIN:VCARD", 2003, True, False, None, None, "done", None, 5, None, None, 1),
        (3, "/a/from 2000 2001 2003.pst", ".pst", 10, b"!BDN", 2003, False, False, None, "PermissionError", "done", None, 5, None, None, 1),
        (4, "/a/x.pst", ".pst", 300_000, b"!BDN", 2003, False, False, None, "bad disk", "new", None, 0, 10, True, 1),
        (5, "/a/y.ost", ".ost", 300_000, b"!BDN", 2003, True, False, None, None, "failed", "it is Encrypted", 0, 7, None, 2),
    ]
    kinds = "source_id long, path string, ext string, size long, head binary, year int, readable boolean, placeholder boolean, copy_path string, lock_error string, state string, parse_error string, items long, claimed long, sampled boolean, folders int"
    persons = [(1, "Ann Maria Lee", "o", "x.example"), (2, "Lee, Ann Maria", "o", "x.example"), (3, "Bo Berg", None, "y.example"), (4, "Desk", None, "y.example"), (5, "/O=X/CN=C", None, None)]
    return audit.Facts(
        make(items, "item_id long, kind string, occurred string, tz_known boolean, confidence double, rule string"), make(links, "item_id long, source_id long"), make(sources, kinds), make([("/z/other.ost",)], "path string"),
        make([(1, 10), (2, 12)], "source_id long, n long"), make([(0, 1, "from"), (0, 2, "to"), (1, 1, "from"), (2, 3, "from"), (3, 5, "from")], "item_id long, person_id long, role string"),
        make(persons, "person_id long, name string, org string, domain string"), make([(1, "ann@x.example", "smtp"), (3, "bo@y.example", "smtp"), (4, "info@y.example", "smtp"), (5, "/O=X/CN=C", "ex")], "person_id long, address string, address_type string"),
        make([("info@y.example", "Desk"), ("bo@y.example", "Bo")], "address string, name string"), None, make([(1,), (2,)], "person_id long"), None,
        make([(0, "failed", "aa"), (1, "done", "bb")], "item_id long, status string, content_hash string"), make([("bb",)], "content_hash string"), make([(1, True)] * 4 + [(1, False)] * 6, "source_id long, orphan boolean"),
    )


def test_all_codes_and_report(spark, tmp_path):
    rows, counts = ledger.run_checks(spark, audit.families(facts(spark), 2024))
    rows = rows.cache()
    errors = rows.where("code = 'check_failed'").select("evidence").collect()
    assert not errors, errors
    got = {(r["code"], r["severity"]) for r in rows.collect()}
    assert {c for c, _ in got if not c.endswith("_summary")} == {c for codes in ledger.CLASSES.values() for c in codes}
    assert {("no_date_summary", "medium"), ("orphan_reply", "high"), ("soft_gap", "info"), ("partial_parse", "critical")} <= got
    one = lambda code: sorted((r["source_id"], r["period"], r["period_end"], r["loss"]) for r in rows.where(F.col("code") == code).collect())
    assert one("hard_gap")[-1] == (None, "2001-09", "2001-10", None) and one("partial_parse")[0][3] > 500 and one("needs_password") == [(5, None, None, 7)]
    assert one("under_merged") == [(None, "1:2", None, None)] and one("over_merged_risk") == [(None, "info@y.example", None, None)]
    assert sum(counts.values()) == rows.count() and min(counts.values()) > 0
    strict = Settings().changed("doubts.thin_month", 0.0).changed("persons.shared_mailboxes", [])
    fewer = {r["code"] for r in ledger.run_checks(spark, audit.families(facts(spark), 2024, strict), {"gaps", "accounts"})[0].collect()}
    assert "soft_gap" not in fewer and "over_merged_risk" not in fewer and "hard_gap" in fewer
    # a gap that began before the months asked for reaches into them
    led = rows.withColumn("state", F.lit("open"))
    assert "hard_gap" in {r["code"] for r in ledger.qualifiers(led, since="2001-10", until="2001-10").collect()}
    assert "hard_gap" not in {r["code"] for r in ledger.qualifiers(led, since="2001-11", until="2001-12").collect()}

    audit.write_report(audit.report(led, worst=3), f"{tmp_path}/report")
    text = "\n".join(r["value"] for f in sorted((tmp_path / "report").glob("part-*")) for r in spark.read.option("wholetext", True).text(str(f)).collect())
    assert text.startswith("# Archive audit") and text.index("## Critical") < text.index("## High") < text.index("## Medium") < text.index("## Info")
    assert "### partial parse · unreadable files" in text and "- 2001-09 to 2001-10: 2 months" in text and text.count("- item 900") <= 3 + 3
    audit.write_report(audit.report(led.limit(0)), f"{tmp_path}/none", markdown=False)
    none = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/none").collect())
    assert "Nothing is wrong" in none and "#" not in none


def test_merge_log(spark, tmp_path):
    people = spark.createDataFrame([(i, f"n{i}", i == 3) for i in range(1, 8)], "person_id long, name string, is_self boolean")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 30), (4, 40), (5, 50), (9, 90)], "person_id long, item_id long")
    items = spark.createDataFrame([(k, f"200{k // 10}-01-01") for k in (10, 20, 30, 40, 50, 90)], "item_id long, occurred string")
    log = merges.MergeLog(spark, f"{tmp_path}/log")
    now = lambda upto=None: sorted(tuple(r) for r in merges.people_now(people, links, items, log.entries(), upto).collect())
    pair = lambda *p: spark.createDataFrame(list(p), "loser long, winner long")
    zero = now()
    assert zero[1] == (2, "n2", None, False, 2, "2001-01-01", "2002-01-01")
    log.merge(pair((2, 1)), "t1")
    first = log.last()
    log.merge(pair((1, 4), (5, 5)), "t2")
    second = log.last()
    log.merge(pair((3, 4)), "t3")
    assert now() == [(1, "n1", 4, False, 0, None, None), (2, "n2", 4, False, 0, None, None), (3, "n3", 4, True, 0, None, None), (4, "n4", None, True, 4, "2001-01-01", "2004-01-01"), (5, "n5", None, False, 1, "2005-01-01", "2005-01-01"), (6, "n6", None, False, 0, None, None), (7, "n7", None, False, 0, None, None)]
    assert now(0) == zero
    # taken back out of order: 2 stays with 1, who is apart from 4 again
    log.undo(spark.createDataFrame([(second,), (77,)], "entry long"), "t4")
    got = now()
    assert [r[2] for r in got] == [None, 1, 4, None, None, None, None] and got[0][4:] == (2, "2001-01-01", "2002-01-01") and got[3][3] is True
    log.undo(merges.in_force(log.entries()).select("entry"), "t5")
    assert now() == zero and now(first)[1][2] == 1 and merges.in_force(log.entries()).count() == 0
    # a circle has its smallest member
    log.merge(pair((6, 7), (7, 6)), "t6")
    assert {r[0]: r[2] for r in now()}[7] == 6
    moved = merges.repointed(links, merges.roots(log.entries(), first))
    assert sorted((r["original_id"], r["person_id"]) for r in moved.collect())[1:3] == [(2, 1), (2, 1)]
