"""Binary mailboxes: ranges give each record once, damage costs one record."""

import random
import struct

from pyspark.sql import functions as F

from epistle.operators import integrity
from epistle.sources import boxes, mail


def letter(n, rnd):
    return f"From: p{n}@x.example\nSubject: s{n}\nMessage-ID: <{n}@x>\n\n".encode() + b"body JMF6 " + b"x" * rnd.randrange(60) + b"\n"


def store(letters):
    body, at = b"", []
    for n, m in enumerate(letters):
        at.append(boxes.FIRST_AT + len(body))
        body += boxes.RECORD_MARK + struct.pack("<III", boxes.HEAD + len(m), n, 0) + m
    head = boxes.FILE_MARK + struct.pack("<II", boxes.FIRST_AT + len(body), len(letters))
    return head + b"\0" * (boxes.FIRST_AT - len(head)) + body, at


def test_ranges_and_damage(tmp_path):
    rnd = random.Random(5)
    letters = [letter(n, rnd) for n in range(25)]
    data, at = store(letters)
    path = tmp_path / "a.mbx"

    def read(raw, step):
        path.write_bytes(raw)
        found = [x for s in range(0, len(raw), step) for x in boxes.records_of(str(path), s, min(len(raw), s + step), len(raw))]
        assert [o for o, _, _ in found] == sorted(o for o, _, _ in found)
        return [m for _, m, _ in found if m is not None], sum(lost for _, _, lost in found)

    for step in (7, 40, 100, 333, 1 << 20):
        assert read(data, step) == (letters, 0)
    for hurt, new in ((at[7], b"XXXX"), (at[7] + 4, struct.pack("<I", 5)), (at[7] + 4, struct.pack("<I", 40_000)), (at[7] + 4, struct.pack("<I", 2**31))):
        raw = data[:hurt] + new + data[hurt + 4 :]
        for step in (60, 500, 1 << 20):
            got, lost = read(raw, step)
            assert got == letters[:7] + letters[8:]
        assert lost == at[8] - at[7]  # of the last step, which reads the file as one range
    assert read(data[: at[24] + 20], 1 << 20)[0] == letters[:24] and read(data[:50], 16) == ([], 0) and read(b"From x\nSubject: y\n\n", 9) == ([], 0)


def test_read_mbx(spark, tmp_path):
    rnd = random.Random(6)
    data, at = store([letter(n, rnd) for n in range(12)])
    (tmp_path / "a.mbx").write_bytes(data[: at[3]] + b"?" + data[at[3] + 1 :])
    (tmp_path / "text.mbx").write_bytes(b"From x\nSubject: one\n\nbody\n")
    (tmp_path / "empty.mbx").write_bytes(b"")
    rows = boxes.read_mbx(spark, str(tmp_path), 100).collect()
    assert sorted(r["subject"] for r in rows if r["error"] is None) == sorted(f"s{n}" for n in range(12) if n != 3)
    assert [r["error"].endswith(f"at {at[3]} hold no record that can be read") for r in rows if r["error"]] == [True] * sum(r["error"] is not None for r in rows)
    claims = boxes.claimed(spark, str(tmp_path)).withColumnRenamed("path", "source_id")
    got = boxes.read_mbx(spark, str(tmp_path)).where("error is null").select(F.col("path").alias("source_id"))
    assert [(r["claimed"], r["got"], r["loss"]) for r in integrity.partial_parse(claims, got).collect()] == [(12, 11, 1)]
    assert [r["subject"] for r in mail.read_mbox(spark, str(tmp_path)).where("path like '%text.mbx'").collect()] == ["one"]
