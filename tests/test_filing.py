"""Folders, tags, attachments, facets and sort keys, on small tables; people of large items and similar names against all pairs."""

import itertools
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from epistle.operators import exports, filing, people, search
from epistle.sources.mail import TOO_LARGE, read_eml, read_olm


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filed_facets_and_sorting(spark):
    items = spark.createDataFrame([(1, "message", "1999-01-01T00:00:00Z"), (2, "message", None), (3, "task", "2000-01-01T00:00:00Z"), (4, "note", "1999-01-01T00:00:00Z")], "item_id long, kind string, occurred string")
    folders = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (3, None)], "item_id long, folder string")
    tags = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (3, "x")], "item_id long, tag string")
    files = spark.createDataFrame([(1, 2, "two"), (1, 1, "One"), (2, 3, None), (3, 4, "")], "item_id long, attachment_id long, filename string")
    f = filing.filed(items, folders, tags, files)
    assert rows(f.select("item_id", "folder", "category", "attachment_names", "has_attachments")) == [
        (1, "a", "x; y", "One; two", True), (2, "b", None, None, True), (3, None, "x", None, True), (4, None, None, None, False),
    ]
    assert rows(search.selected(f, attached=False).select("item_id")) == [(4,)] and rows(search.selected(f, folder="b").select("item_id")) == [(2,)]
    assert rows(search.selected(f, tags=tags.where("tag = 'x'"), kinds=["task"]).select("item_id")) == [(3,)]
    links = spark.createDataFrame([(1, 7, "to"), (1, 7, "cc"), (2, 8, "to"), (2, 7, "to")], "item_id long, person_id long, role string")
    sources = spark.createDataFrame([(1, 5), (2, 5), (4, 6)], "item_id long, source_id long")
    got = filing.facets(items, links, sources, folders, tags)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("kind", "message", 2), ("kind", "task", 1), ("kind", "note", 1), ("person", "7", 2), ("person", "8", 1), ("source", "5", 2), ("source", "6", 1), ("folder", "b", 2), ("folder", "a", 1),
        ("tag", "x", 2), ("tag", "y", 1), ("first", "1999-01-01T00:00:00Z", 2), ("last", "2000-01-01T00:00:00Z", 1), ("undated", None, 1),
    ], key=str)
    none = filing.facets(items, links, sources, folders, tags, items.where("false"))
    assert rows(none) == [("undated", None, 0)]
    order = lambda key, down=False: [r["item_id"] for r in exports.ordered(f, key, down).collect()]
    assert order("folder") == [1, 2, 3, 4] and order("folder", True) == [2, 1, 3, 4] and order("attachment_names", True) == [1, 2, 3, 4]
    for bad in ("to", "nothing"):
        with pytest.raises(ValueError):
            exports.ordered(f.withColumnRenamed("category", "to"), bad)


def all_partners(links, top):
    of, out = defaultdict(set), []
    for item, who in links:
        of[item].add(who)
    shared = defaultdict(Counter)
    for who in of.values():
        for a, b in itertools.permutations(who, 2):
            shared[a][b] += 1
    for a, c in shared.items():
        out += [(a, b, n, k + 1) for k, (b, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_partners_of_large_items(spark, seed):
    r = random.Random(seed)
    links = [(i, p) for i in range(60) for p in r.sample(range(40), r.choice([1, 2, 3, 5, 18, 30]))] + [(99, p) for p in range(45)] * 2
    df = spark.createDataFrame([(i, p, "to") for i, p in links], "item_id long, person_id long, role string")
    for top, crowd in ((1, 4), (3, 10), (5, 10), (50, 4), (5, 1000)):
        assert rows(people.partners(df, top, crowd)) == all_partners(links, top), (top, crowd)
    assert rows(people.partners(df.where("false"), 3)) == []


def test_a_letter_to_everybody_is_not_expanded(spark):
    """Twenty thousand people of one item have 400 million pairs; a task of the plan sees rows in proportion to people."""
    df = spark.range(20_000).selectExpr("1L as item_id", "id as person_id", "'to' as role")
    got = people.partners(df, 2)
    assert got.count() == 40_000 and rows(got.where("person_id < 2")) == [(0, 1, 1, 1), (0, 2, 1, 2), (1, 0, 1, 1), (1, 2, 1, 2)]


def test_similar_names_meet_once(spark):
    who = [(k, n) for k, n in enumerate(["Ann Leeson", "Anne Leeson", "Ann Leeson", "Bob Stone", "Bob Stonne", None, "Zoe"])]
    links = [(k, 100) for k in range(7)] + [(0, 101), (1, 101), (3, 102)]
    got = people.similar_names(spark.createDataFrame(who, "person_id long, name string"), spark.createDataFrame(links, "person_id long, other_id long"), 0.9)
    assert rows(got.select("a", "b")) == [(0, 1), (1, 2), (3, 4)]


def test_pairs_of_names_are_scored_once(spark, monkeypatch):
    """However many correspondents two names share, and however many people bear them, Python does not get the pair for each meeting."""
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([0.95] * len(a))

    monkeypatch.setattr(people, "jaro_winkler", score)
    who = spark.createDataFrame([(k, "Ann Leeson" if k % 2 else "Anne Leeson") for k in range(6)], "person_id long, name string")
    links = spark.range(200).withColumnRenamed("id", "other_id").join(who.select("person_id"))
    found = people.similar_names(who, links, 0.9).count()
    assert found == 9 and scored.value <= 2  # for the filter and for the column, not for 200 meetings


def test_large_files_are_errors(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Subject: small\n\nx\n")
    (tmp_path / "b.eml").write_bytes(b"Subject: large\n\n" + b"x" * 500)
    (tmp_path / "c.olm").write_bytes(b"x" * 500)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        got = {r["path"].split("/")[-1]: (r["subject"], r["error"]) for r in read_eml(spark, str(tmp_path)).union(read_olm(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"a.eml": ("small", None), "b.eml": (None, f"OverflowError: {TOO_LARGE}"), "c.olm": (None, TOO_LARGE)}
