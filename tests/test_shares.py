"""Groupings whose shares have a number of rows, not a number of tasks; frames of many attachments."""

import pytest
from pyspark.sql import functions as F

from epistle.operators import graph, people
from epistle.sources import attached, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def parts_of(df):
    """Numbers of tasks that the plan deals rows to by a counted number."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(x.split(")")[0].rsplit(", ", 1)[1]) for x in plan.split("hashpartitioning(")[1:] if "REPARTITION_BY_NUM" in x.split("\n")[0]]


@pytest.fixture
def mail(spark):
    """Item n goes from person n % 3 to 10, 11 and 12, the last two only in even items."""
    links = [(n, n % 3, "from") for n in range(60)] + [(n, p, "to") for n in range(60) for p in (10, 11, 12) if p == 10 or n % 2 == 0]
    return spark.createDataFrame(links + links[-5:], "item_id long, person_id long, role string")


def test_pairs_are_dealt_in_shares_by_rows(mail, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    got = people.correspondents(mail, 2)
    assert rows(got) == sorted((p, q, n, r) for p in range(3) for q, n, r in ((10, 20, 1), (11, 10, 2)))
    assert min(parts_of(got)) > 10  # 180 rows, whatever the session's number of tasks is
    all_ = people.partners(mail, 2)
    assert [r for r in rows(all_) if r[0] in (0, 10)] == [(0, 10, 20, 1), (0, 11, 10, 2), (10, 11, 30, 1), (10, 12, 30, 2)]
    assert min(parts_of(all_)) > 10
    sources = mail.select("item_id", F.col("person_id").alias("source_id")).distinct()
    got = people.source_overlap(sources, 10, 0.9)
    assert (10, 11, 30, 1.0) in rows(got) and min(parts_of(got)) > 10


def test_names_are_numbered_in_shares_by_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    monkeypatch.setattr(sinks, "ROWS", 10)
    got = sinks.copied_names(spark.range(60).selectExpr("id as attachment_id", "'a.txt' as filename"))
    assert [r["copied"] for r in got.orderBy("attachment_id").collect()] == ["a.txt"] + [f"a ({n}).txt" for n in range(2, 61)]
    assert min(parts_of(got)) == 7


def test_small_attachments_share_a_frame(spark, monkeypatch):
    """The parts of a batch of rows are one frame, up to a bound of characters."""
    files = spark.range(0, 50, 1, 1).selectExpr("id as attachment_id", "'a.txt' as filename", "cast('some text' as binary) as data")
    made = spark.sparkContext.accumulator(0)
    frame = attached.pd.DataFrame

    class Counted:
        Series = attached.pd.Series

        @staticmethod
        def DataFrame(*a, **k):
            made.add(1)
            return frame(*a, **k)

    slim = {}
    monkeypatch.setattr(type(files), "mapInPandas", lambda self, f, schema, **k: slim.update(f=f) or self)
    attached.parts(files)
    monkeypatch.setattr(attached, "pd", Counted)
    batch = frame({"id": range(50), "name": ["a.txt"] * 50, "data": [b"some text"] * 50})
    out = list(slim["f"](iter([batch])))
    assert len(out) == 1 and len(out[0]) == 50 and made.value == 1
    monkeypatch.setattr(attached, "FRAME", 100)
    assert [len(x) for x in slim["f"](iter([batch]))] == [12, 12, 12, 12, 2]
