"""The search index's generations, what is read next, edits, eras, rules for stores' records and settings."""

import pytest
from pyspark.sql import functions as F

from epistle.operators import people, search, state
from epistle.operators.index import SearchIndex
from epistle.operators.search import bm25, postings
from epistle.settings import SHARED_MAILBOXES, Settings, from_toml
from epistle.sources import stores


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark, *values):
    return spark.createDataFrame(list(values), "doc_id long, text string")


def test_index_generations(spark, tmp_path):
    i = SearchIndex(spark, f"{tmp_path}/i")
    i.build(docs(spark, (1, "a cat"), (2, "cats a a"), (3, None), (4, ""), (1, "a cat"), (None, "lost")))
    assert rows(i.documents().select("doc_id", "len")) == [(1, 2), (2, 3), (3, 0), (4, 0)]
    assert rows(i.postings("cat*")) == [(1, 1, "cat"), (2, 0, "cats")] and rows(i.postings("cat")) == [(1, 1, "cat")]
    i.update(docs(spark, (2, "a dog"), (5, "cat cat")), docs(spark, (1, None), (5, None), (9, None)))
    now = [(2, 0, "a"), (2, 1, "dog"), (5, 0, "cat"), (5, 1, "cat")]
    assert rows(i.postings("a", "c*", "dog")) == now and rows(i.documents().select("doc_id", "len")) == [(2, 2), (3, 0), (4, 0), (5, 2)]
    whole = i.compact(f"{tmp_path}/whole")
    assert rows(whole.postings("a", "c*", "dog")) == now and rows(whole.documents()) == [(2, 2, 0), (3, 0, 0), (4, 0, 0), (5, 2, 0)]
    # a document taken out comes back
    i.update(docs(spark, (1, "cat again")))
    assert rows(i.postings("cat")) == [(1, 0, "cat"), (5, 0, "cat"), (5, 1, "cat")]


def test_index_passes_over_a_generation_cut_short(spark, tmp_path):
    i = SearchIndex(spark, f"{tmp_path}/i")
    i.build(docs(spark, (1, "a"), (2, "b")))
    i._write_postings(postings(docs(spark, (1, "z"), (7, "a"))), 1)  # the writer was lost before it wrote the documents
    assert rows(i.postings("a", "z")) == [(1, 0, "a")]
    i.update(docs(spark, (2, "a")))
    assert rows(i.postings("a", "z", "b")) == [(1, 0, "a"), (2, 0, "a")]


def test_index_empty_and_pruned(spark, tmp_path):
    i = SearchIndex(spark, f"{tmp_path}/i")
    i.build(docs(spark))
    assert i.documents().count() == 0 and i.postings("a").count() == 0
    many = docs(spark, *((n, f"{chr(97 + n % 26)}{chr(97 + n // 26)}x word") for n in range(200)))
    i.update(many)
    assert i.postings("word").count() == 200
    plan = i.postings("word")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    terms = ["word", "aax"]
    assert rows(bm25(i.postings(*terms), terms, i.documents())) == rows(bm25(postings(many), terms))


def test_index_shuffles_no_posting(spark, tmp_path, monkeypatch):
    """Words are sorted where their texts are split, in shares by size: neither a share nor what is shuffled grows with the index."""
    plans, write = [], SearchIndex._write_postings
    monkeypatch.setattr(SearchIndex, "_write_postings", lambda self, posts, gen: plans.append(posts._jdf.queryExecution().executedPlan().toString()) or write(self, posts, gen))
    monkeypatch.setattr(search, "SHARE", 300)
    many = docs(spark, *((n, f"word w{n} word") for n in range(200)))
    i = SearchIndex(spark, f"{tmp_path}/i")
    i.build(many)
    files = spark.read.parquet(f"{tmp_path}/i/postings").select(F.input_file_name().alias("f"), "term", F.monotonically_increasing_id().alias("k"))
    shares = {r["f"].rsplit("/", 1)[1].split("-")[1] for r in files.select("f").distinct().collect()}
    assert len(shares) > 5 and files.where("term = 'word'").select("f").distinct().count() == len(shares)
    assert plans[0].count("Exchange hashpartitioning(doc_id") == 1 and plans[0].index("Exchange") > plans[0].index("Generate")
    assert i.postings("word").count() == 400 and i.statistics()[""]["words"] == 600
    i.update(docs(spark, (3, "word")), docs(spark, (4, None)))
    assert i.compact(f"{tmp_path}/w").postings("word").count() == 397 and "Exchange" not in plans[-1].replace("BroadcastExchange", "").split("BroadcastHashJoin")[0]


def test_terms_are_counted_within_shares(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARE", 20)
    some = docs(spark, (1, "Cats cat a"), (2, "cat"), (2, "a cat"), (None, "cat"), (3, None))
    assert rows(search.term_counts(some)) == [("a", 2, 2), ("cat", 2, 4), ("cats", 1, 1)]
    assert rows(search.term_counts(some, stem=True)) == [("a", 2, 2), ("cat", 2, 5)]
    plan = search.term_counts(some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2 and "hashpartitioning(doc_id#" in plan and "hashpartitioning(term#" in plan


def test_store_records(spark):
    one = lambda f, values, kind="string": [r[0] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]
    assert one(stores.kind_of, ["IPM.Note", None, "", "ipm.appointment.x", "IPM.Contact", "IPM.TaskRequest", "IPM.Activity", "REPORT.IPM.Note.NDR", "odd"]) == ["message"] * 3 + ["event", "contact", "task", "note", "message", "message"]
    assert one(stores.instant, [None, 0, -5, 125_911_584_000_000_000, 1, (1 << 63) - 1], "long") == [None, None, None, "2000-01-01T00:00:00Z", "1601-01-01T00:00:00Z", None]
    assert one(stores.cloud_reason, [None, 0, 0x20, 0x1000, 0x441020], "int") == [None, None, None, "offline", "offline, recall-on-data-access, recall-on-open"]
    at = lambda c: stores.container_of(c, ["C:/Cloud"], ["E:"], ["n:"])
    assert one(at, ["//s/x", "\\\\s\\x", "c:\\cloud\\a", "C:/Cloud2/a", "e:/x", "N:\\x", "/home/x"]) == ["network", "network", "onedrive", "local", "external", "network", "local"]


def test_readers_and_costs(spark):
    r = lambda *v: spark.createDataFrame(list(v), "source_id long, item string")
    assert rows(stores.first_that_reads(r((1, "a")), r((1, "b"), (2, "c")), r((2, "d"), (3, "e")))) == [(1, "a"), (2, "c"), (3, "e")]
    files = spark.createDataFrame([("C:/a", 5), ("c:\\b", None), ("D:/c", 2)], "path string, bytes long")
    assert rows(stores.download_cost(files)) == [("C:", 5), ("D:", 2)] and rows(stores.download_cost(files, "D:/copies")) == [("C:", 5), ("D:", 9)]


SOURCE = "source_id long, ext string, readable boolean, placeholder boolean, copy_path string, lock_error string, state string, items long, bytes long, parse_error string"


def test_what_is_read(spark):
    s = spark.createDataFrame(
        [(1, ".mbox", True, False, None, None, "parsing", 3, 50, None), (2, ".mbox", True, False, None, None, "done", 3, 5, None), (3, ".eml", True, True, None, None, "pending", 0, 1, None), (4, ".eml", True, True, "/c", None, "failed", 0, 9, "bad")], SOURCE
    )
    assert [r["source_id"] for r in state.to_read(s).collect()] == [4, 1] and [r["source_id"] for r in state.to_read(s, resume=False).collect()] == [2, 4, 1]
    assert [r["source_id"] for r in state.to_read(s, ids=[1]).collect()] == [1]
    items = spark.createDataFrame([(10, "1999"), (11, None), (12, "2001")], "item_id long, occurred string")
    links = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 12)], "source_id long, item_id long")
    read = spark.createDataFrame([(1, True), (4, False)], "source_id long, completed boolean")
    done = {r["source_id"]: r for r in state.finished(s, read, items, links).collect()}
    assert [(done[k]["state"], done[k]["items"], done[k]["first_item"], done[k]["parse_error"]) for k in (1, 2, 3, 4)] == [("done", 2, "1999", None), ("done", 3, None, None), ("pending", 0, None, None), ("parsing", 0, None, None)]
    assert rows(state.pending_again(s, [2]).select("source_id", "state", "items")) == [(1, "parsing", 3), (2, "pending", 0), (3, "pending", 0), (4, "failed", 0)]
    kept, rest = state.without_sources(items, links, [1])
    assert rows(kept.select("item_id")) == [(10,), (12,)] and rows(rest) == [(2, 10), (2, 12)]


def test_edits_and_eras(spark):
    p = spark.createDataFrame([(1, "a", None, False), (2, "b", "x", None)], "person_id long, name string, org string, confirmed boolean")
    e = spark.createDataFrame([(1, None, "o"), (2, None, None), (3, "z", "z")], "person_id long, name string, org string")
    assert [tuple(r) for r in state.edited(p, e, "person_id", "confirmed").orderBy("person_id").collect()] == [(1, "a", "o", True), (2, "b", "x", None)]
    assert [state.era_date(x) for x in ("1984", "1984-06", "1984-06-03T01:00", " ", None)] == ["1984-01-01", "1984-06-01", "1984-06-03", None, None]
    assert [state.era_date(x, True) for x in ("1984", "1984-02", "1999-02")] == ["1984-12-31", "1984-02-29", "1999-02-28"]
    for bad in ("84", "1984-13", "1984-02-30", "soon", "1984-1-1-1", "0000"):
        with pytest.raises(ValueError):
            state.era_date(bad)
    for bad in ((" ", "1984", None), ("x", "1985", "1984")):
        with pytest.raises(ValueError):
            state.era(*bad)
    assert [state.month_bound("2003"), state.month_bound("2003", True), state.month_bound("2003-05-06"), state.month_bound(None)] == ["2003-01", "2003-12", "2003-05", None]


def test_similar_names_have_a_ceiling_and_leave_offices_out(spark):
    p = spark.createDataFrame([(1, "Martha Jones"), (2, "Marhta Jones"), (3, "Martha Jonas")], "person_id long, name string")
    mail = spark.createDataFrame([(1, "m@x"), (2, "n@x"), (3, "INFO@x")], "person_id long, address string")
    links = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "person_id long, other_id long")
    some = people.without_role_mailboxes(p, mail, list(SHARED_MAILBOXES))
    assert rows(people.similar_names(some, links, 0.92, 0.85)) == [(1, 2, 0.85)]


def test_settings():
    s = from_toml('[folders]\nendings = ["EML", " ", ".Ics"]\n[persons]\nown_addresses = [" Ann@X.example "]\nalike = 1\n')
    assert s.folders.endings == (".eml", ".ics") and s.persons.own_addresses == ("ann@x.example",) and s.persons.alike == 1.0 and s.doubts == Settings().doubts
    for bad in ('[fold]\nx = 1', '[folders]\nends = []', '[folders]\nendings = "x"', "[persons]\nnames_of_one_address = 0", "[persons]\nnames_of_one_address = 1.5", "[doubts]\nthin_month = 2", "[doubts]\nfirst_year = true", "folders = 3"):
        with pytest.raises(ValueError):
            from_toml(bad)
