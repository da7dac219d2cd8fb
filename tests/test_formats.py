"""The data source of mail files: ranges, filters that reach the planning, limits that end the reading."""

import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from epistle.sources import formats, mail


def letter(n, body=""):
    return f"From x{n}\nFrom: p{n}@x.example\nSubject: s{n}\nMessage-ID: <{n}@x>\n\n{body or 'body'}\n".encode()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    rnd = random.Random(1)
    for k in range(3):
        (tmp_path / "sub" / f"{k}.mbox").write_bytes(b"\n".join(letter(100 * k + i, "x" * rnd.randrange(300) + "\n>From here\n\n") for i in range(40)))
    (tmp_path / "one.eml").write_bytes(letter(900)[len("From x900\n") :])
    (tmp_path / "skip.txt").write_bytes(b"no mail")
    (tmp_path / "empty.mbox").write_bytes(b"")
    (tmp_path / "cut.mbx").write_bytes(letter(901) + b"\nFrom y")
    return tmp_path


def test_ranges_give_each_message_once():
    rnd = random.Random(2)
    for _ in range(60):
        text = b"".join(rnd.choice([b"\n", b"From ", b"\nFrom a\n", b"ab", b"\n\nFrom x\nSubject: s\n\n", b"Fro"]) for _ in range(rnd.randrange(1, 60)))
        pieces = (b"\n" + text).split(formats.SEPARATOR)
        want = [p.split(b"\n", 1)[1] for p in pieces[1:] if b"\n" in p]
        step, formats_chunk = rnd.randrange(1, 50), formats.CHUNK
        formats.CHUNK = rnd.randrange(1, 20)
        try:
            got = [(o, m) for at in range(0, len(text), step) for o, m in formats.between_separators(io.BytesIO(text), formats.Range("p", ".mbox", at, min(len(text), at + step), len(text)))]
        finally:
            formats.CHUNK = formats_chunk
        assert [m for _, m in got] == want and all(text[o : o + 5] == b"From " for o, _ in got)


def test_formats_equal_the_readers(spark, folder):
    formats.register(spark)
    got = spark.read.format("mailfiles").option("range", 700).load(str(folder))
    assert got.rdd.getNumPartitions() > 20
    plain = lambda df: sorted(map(str, df.select("path", "message_id", "subject", "sender", F.trim("body").alias("b"), "error").collect()))
    assert plain(got) == plain(mail.read_mbox(spark, str(folder)).union(mail.read_eml(spark, str(folder))))
    assert got.where("kind = 'message' and ext = '.eml'").count() == 1 and got.where("kind = 'event'").count() == 0
    assert spark.read.format("mbox").load(str(folder)).where("length(body) > 0").count() == 121 and spark.read.format("eml").load(str(folder / "one.eml")).count() == 1
    few = spark.read.format("mbox").option("limit", 2).load(str(folder)).groupBy("path").count().collect()
    assert sorted(r["count"] for r in few) == [1, 2, 2, 2]


def test_filters_and_limits_end_the_reading(folder, monkeypatch):
    read = []
    real = formats.opened

    class Watched(io.BytesIO):
        def read(self, *a):
            out = super().read(*a)
            read.append(len(out))
            return out

    class Fs:
        def open_input_file(self, place):
            with open(place, "rb") as f:
                return Watched(f.read())

    reader = lambda filters, **o: (r := formats.MailReader(list(formats.FORMS), {"path": str(folder)} | o), list(r.pushFilters(filters)))
    r, left = reader([EqualTo(("kind",), "event"), EqualTo(("subject",), "s1")])
    assert r.partitions() == [] and left == [EqualTo(("subject",), "s1")]
    r, left = reader([In(("ext",), (".mbox", ".eml")), EqualTo(("path",), f"file:{folder}/sub/1.mbox")])
    assert [p.path for p in r.partitions()] == [f"file:{folder}/sub/1.mbox"] and left == []
    monkeypatch.setattr(formats, "CHUNK", 256)
    r, _ = reader([], limit="2")
    parts = r.partitions()
    monkeypatch.setattr(formats, "opened", lambda path: (Fs(), real(path)[1]))
    assert len(list(r.read(next(p for p in parts if p.path.endswith("0.mbox"))))) == 2
    assert sum(read) < 2000 < (folder / "sub" / "0.mbox").stat().st_size
    gone = formats.Range("file:/no/such.mbox", ".mbox", 0, 9, 9)
    monkeypatch.undo()
    assert "FileNotFoundError" in list(r.read(gone))[0][3 + mail.COLUMNS.index("error")]
