"""Mailboxes of records framed by their own lengths (``.mbx`` of the binary kind), found again after damage.

A file is cut into byte ranges; a record belongs to the range that its mark begins in, and a task reads on to the end of its last one.
Where a head cannot be right, what follows is searched for the next that can, so damage costs the record it lies in and no other;
the bytes passed over are a row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mail
from .formats import opened

# Marks of a file and of a record, where a file's count of messages and its first record stand, the bytes of a record's head, its greatest length.
FILE_MARK, RECORD_MARK = b"JMF9", b"JMF6"
COUNT_AT, FIRST_AT, HEAD, MOST = 0x08, 0x54, 16, 64 << 20
#: Bytes that a task reads.
RANGE = 64 << 20


def end_of(data: bytes, at: int) -> int | None:
    """Where the record ends whose mark begins at ``at``, as its head says; null where there is no mark or the length cannot be right."""
    if data[at : at + 4] != RECORD_MARK or at + HEAD > len(data):
        return None
    length = struct.unpack_from("<I", data, at + 4)[0]
    return at + length if HEAD < length <= MOST else None


def next_record(data: bytes, at: int, stop: int) -> int:
    """The place of the next head from ``at`` on that can be right; ``stop`` if there is none before."""
    at = data.find(RECORD_MARK, at, stop + 3)
    while at >= 0 and end_of(data, at) is None:
        at = data.find(RECORD_MARK, at + 1, stop + 3)
    return stop if at < 0 else at


def framed(data: bytes, n: int) -> Iterator[tuple[int, bytes | None, int]]:
    """(offset, message, bytes passed over) for the records that begin in the first ``n`` bytes of ``data``; the message or the number is empty.

    A record that another sound head lies in, or that the file ends in, is damaged: it is passed over as far as to there.
    """
    at = 0
    while at < n:
        end = end_of(data, at)
        if end is None:
            after = next_record(data, at + 1, n)
            yield at, None, after - at
        else:
            after = next_record(data, at + HEAD, min(end, len(data)))
            whole = after == end <= len(data)
            yield at, data[at + HEAD : end] if whole else None, 0 if whole else after - at
        at = after


def records_of(path: str, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes | None, int]]:
    """``framed`` of a file's range; bytes before a range's first sound head are of the range before."""
    fs, place = opened(path)
    with fs.open_input_file(place) as f:
        if start == 0 and f.read(4) != FILE_MARK:
            return
        start = max(start, FIRST_AT)
        if start >= stop:
            return
        f.seek(start)
        n = stop - start
        data = f.read(n + HEAD)
        last = data.rfind(RECORD_MARK, 0, n + 3)
        while last >= 0 and end_of(data, last) is None:
            last = data.rfind(RECORD_MARK, 0, last + 3)
        end = end_of(data, last) if last >= 0 else None
        if end is not None and end > len(data):
            data += f.read(end - len(data))
    first = 0 if start == FIRST_AT else next_record(data, 0, n)
    for offset, message, lost in framed(data[first:], n - first):
        yield start + first + offset, message, lost


def files_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mbx").load(path).select("path", F.col("length").alias("size")).where("size > 0")


def read_mbx(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """Messages of binary ``.mbx`` files under ``path``, in the columns of ``mail.read_mbox``, which reads text ones; damaged stretches are rows with an error.

    A file may be of any size and is read by as many tasks as it has ranges.
    """
    cuts = files_of(spark, path).select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def failed(path: str, error: str) -> tuple:
        row = dict.fromkeys(mail.COLUMNS) | {"path": path, "refs": [], "receivers": [], "attachments": [], "people": [], "tz_known": False, "error": error[:300]}
        return tuple(row[c] for c in mail.COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, size, start in zip(b["path"], b["size"], b["start"], strict=True):
                good, bad = [], []
                try:
                    with opened(p)[0].open_input_file(opened(p)[1]) as f:
                        binary = f.read(4) == FILE_MARK
                    for offset, raw, lost in records_of(p, int(start), min(int(start) + range_bytes, int(size)), int(size)) if binary else ():
                        if raw is None:
                            bad.append(failed(p, f"{lost} bytes at {offset} hold no record that can be read"))
                        else:
                            good.append(raw)
                except OSError as e:
                    bad.append(failed(p, f"{type(e).__name__}: {e}"))
                if good:
                    yield from mail._parsed(iter([pd.DataFrame({"path": [p] * len(good), "raw": good})]))
                if bad:
                    yield pd.DataFrame(bad, columns=mail.COLUMNS)

    return cuts.repartition("path", "start").select("path", "size", "start").mapInPandas(run, mail.MESSAGE)


def claimed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, claimed): how many messages the head of each binary ``.mbx`` file says it holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with opened(p)[0].open_input_file(opened(p)[1]) as f:
                        head = f.read(COUNT_AT + 4)
                except OSError:
                    continue
                if head[:4] == FILE_MARK and len(head) == COUNT_AT + 4:
                    rows.append((p, struct.unpack_from("<I", head, COUNT_AT)[0]))
            yield pd.DataFrame(rows, columns=["path", "claimed"])

    return files_of(spark, path).select("path").mapInPandas(run, "path string, claimed long")
