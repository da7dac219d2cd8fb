"""Substring dedup over a log-structured fingerprint index.

A run of windows that share their least gram (winnowing) makes one index entry: that gram's hash as fingerprint,
and a hash of all the words that these windows span. A batch of documents becomes a sorted run of packed entries,
dealt by ranges of fingerprints; each share is merge-joined with the same share of all older runs:

* an entry whose span occurs in an earlier document is removed whole (fingerprint and span are 48 bits each);
* entries of equal fingerprint but different spans agree in some windows at most: only for these, windows are
  hashed one by one from the texts and compared (verification);
* all other entries hold no repeated window.

The entries that are new become an immutable run; where FANOUT runs of a level have gathered they are merged into
one of the next level, which keeps the earliest document of each span. Runs and the manifest that names them lie in a folder,
so an index is opened again for the next batch. Ranges halve as the index grows; older runs, dealt
by wider ones, are cut where they are read.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged
from .hashing import Hashes, anchors, heads, ranges

WINDOW = 13
GRAM = 4
FANOUT = 2
#: Characters of text for each share of the index; some 250,000 entries.
SHARE_CHARS = 8_000_000
LOW48 = np.uint64((1 << 48) - 1)

OUT = "share int, run binary, id long, entry int, span long, old boolean, sure boolean"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def entries(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, fingerprint and span hash (48 bits each) of each entry of a text."""
    first, last, print_ = anchors(h, window, gram)
    return first, last, print_ & LOW48, ranges(h, first, last + window) & LOW48


def packed(prints: np.ndarray, spans: np.ndarray, ids: np.ndarray, at: np.ndarray) -> bytes:
    """Entries as byte planes, whose high ones are nearly constant and compress away."""
    raw = np.empty((len(prints), 24), np.uint8)
    for k, (x, n) in enumerate(((prints, 6), (spans, 6), (ids.astype(np.int64), 8), (at.astype(np.int32), 4))):
        raw[:, (0, 6, 12, 20)[k] : (6, 12, 20, 24)[k]] = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :n]
    return raw.T.tobytes()


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(run, np.uint8).reshape(24, -1).T
    wide = lambda a, b, n: np.ascontiguousarray(np.pad(raw[:, a:b], ((0, 0), (0, n - b + a))))
    return wide(0, 6, 8).view(np.uint64).ravel(), wide(6, 12, 8).view(np.uint64).ravel(), wide(12, 20, 8).view(np.int64).ravel(), wide(20, 24, 4).view(np.int32).ravel()


def frame(**columns) -> pd.DataFrame:
    df = pd.DataFrame(columns)
    for c in COLUMNS:
        if c not in df:
            df[c] = None
    return df[COLUMNS].astype({"share": "Int32", "id": "Int64", "entry": "Int32", "span": "Int64", "old": "boolean", "sure": "boolean"})


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # fingerprints, spans, ids, entries, from an older run


def sort_keys(p: np.ndarray, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Byte strings in order of (fingerprint, span, id)."""
    raw = np.empty((len(p), 20), np.uint8)
    wide = lambda x: x.astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, :6], raw[:, 6:12], raw[:, 12:] = wide(p)[:, 2:], wide(s)[:, 2:], wide(ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    return raw.view("S20").ravel()


def merged_runs(runs: list[Run]) -> Run:
    """One sorted run of sorted runs: the two shortest are merged, the shorter one's places found in the longer one, until one is left."""
    heap = [(len(r[0]), k, sort_keys(*r[:3]), r) for k, r in enumerate(runs)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        n, _, kb, b = heapq.heappop(heap)
        m, _, ka, a = heapq.heappop(heap)
        at = np.searchsorted(ka, kb, side="right") + np.arange(n)
        rest = np.ones(n + m, bool)
        rest[at] = False
        out = []
        for x, y in zip((ka, *a), (kb, *b), strict=True):
            z = np.empty(n + m, x.dtype)
            z[at], z[rest] = y, x
            out.append(z)
        heapq.heappush(heap, (n + m, tick, out[0], tuple(out[1:])))
        tick += 1
    return heap[0][3]


def by_share(p: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The stretches of sorted fingerprints that each of 2 ** ``bits`` ranges holds."""
    share = (p >> np.uint64(48 - bits)).astype(np.int32)
    cuts = np.flatnonzero(heads(share))
    return [(int(share[i]), slice(i, j)) for i, j in zip(cuts, [*cuts[1:], len(p)], strict=True)]


class SubstringIndex:
    """Runs of entries of all documents added so far, in a folder; add batches in order of ascending ids.

    ``create`` begins an index, ``open`` goes on with one, in this session or a later one. The manifest is appended to after a run
    is written, so a batch that fails leaves the index as it was.
    """

    MANIFEST = "version long, level int, name string, bits int, chars long, window int, gram int"

    def __init__(self, spark: SparkSession, path: str, version: int, runs: list[tuple[int, str, int]], chars: int, window: int, gram: int):
        self.spark, self.path, self.version, self.runs, self.chars, self.window, self.gram = spark, path, version, runs, chars, window, gram

    @classmethod
    def create(cls, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM) -> SubstringIndex:
        index = cls(spark, path, 0, [], 0, window, gram)
        index.save([], 0)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SubstringIndex:
        rows = spark.read.schema(cls.MANIFEST).json(f"{path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == last).collect()  # one row a run
        runs = sorted((r["level"], r["name"], r["bits"]) for r in found if r["name"])
        return cls(spark, path, last, runs, found[0]["chars"], found[0]["window"], found[0]["gram"])

    def save(self, runs: list[tuple[int, str, int]], chars: int) -> None:
        rows = [(self.version + 1, *r, chars, self.window, self.gram) for r in runs or [(None, None, None)]]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.version, self.runs, self.chars = self.version + 1, runs, chars

    def read(self, run: tuple[int, str, int], bits: int) -> DataFrame:
        """A run's rows (share, run), dealt by ``bits``."""
        rows = self.spark.read.schema("share int, run binary").parquet(f"{self.path}/runs/{run[1]}").where("run is not null")
        if run[2] == bits:
            return rows

        def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b["run"]:
                    parts = unpacked(r)
                    own = by_share(parts[0], bits)
                    yield pd.DataFrame({"share": [k for k, _ in own], "run": [packed(*(x[at] for x in parts)) for _, at in own]})

        return rows.mapInPandas(cut_up, "share int, run binary")

    def write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex[:12]
        rows.write.parquet(f"{self.path}/runs/{name}")
        return name

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Merge the documents (id, text) of ``batch`` with all runs.

        Returns (id, entry, span) of entries to remove whole, and (id, entry) whose windows need comparing, of
        older documents too.
        """
        window, gram = self.window, self.gram
        chars = self.chars + (batch.agg(F.sum(F.length("text"))).first()[0] or 0)
        bits = max(3, (chars // SHARE_CHARS).bit_length())

        def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = Hashes()
            for b in batches:
                found = []
                for doc, text in zip(b["id"], b["text"], strict=True):
                    first, _, p, s = entries(hashes.of(words(text)), window, gram)
                    if len(first):
                        found.append((p, s, np.full(len(p), doc, np.int64), np.arange(len(p), dtype=np.int32)))
                if not found:
                    continue
                p, s, ids, at = map(np.concatenate, zip(*found, strict=True))
                order = np.lexsort((ids, s, p))
                p, s, ids, at = p[order], s[order], ids[order], at[order]
                new = heads(p, s)
                least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                late = ids > least  # an earlier document of this very batch has the span
                if late.any():
                    # spread by id, away from the shares: a hot fingerprint's would all meet in one
                    yield frame(share=(-1 - ids[late] % 4096).astype(np.int32), id=ids[late], entry=at[late], span=s[late].view(np.int64), sure=True)
                p, s, ids, at = p[~late], s[~late], ids[~late], at[~late]
                rows = [(k, packed(p[x], s[x], ids[x], at[x])) for k, x in by_share(p, bits)]
                yield frame(share=[r[0] for r in rows], run=[r[1] for r in rows])

        both = batch.select("id", "text").where("id is not null").mapInPandas(prints, OUT).withColumn("old", F.lit(False))
        for r in self.runs:
            both = both.unionByName(self.read(r, bits).withColumn("old", F.lit(True)), allowMissingColumns=True)

        def merge(df: pd.DataFrame) -> pd.DataFrame:
            known = df[df["run"].isna()]  # settled within the batch
            df = df[df["run"].notna()]
            if not len(df):
                return known[COLUMNS]
            parts = [unpacked(r) for r in df["run"]]
            p, s, ids, at, was = merged_runs([(*x, np.full(len(x[0]), old)) for x, old in zip(parts, df["old"].to_numpy(bool), strict=True)])
            new = heads(p, s)
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            sure = (ids > ids[start][group]) & ~was
            rep = ids == ids[start][group]
            # fingerprints with several spans, the earliest of which is in an earlier document than a new one
            begin = np.flatnonzero(heads(p))
            of = np.cumsum(heads(p)) - 1
            several = np.add.reduceat(new.astype(np.int64), begin) > 1
            lowest = np.minimum.reduceat(ids, begin)
            wanted = np.maximum.reduceat(np.where(rep & ~was & (ids > lowest[of]), 1, 0), begin) > 0
            open_ = rep & (several & wanted)[of]
            run = start[~was[start]]
            out = [frame(id=ids[m], entry=at[m], span=s[m].view(np.int64), sure=x) for m, x in ((sure, True), (open_, False)) if m.any()]
            if len(run):
                out.append(frame(share=[int(df["share"].iloc[0])], run=[packed(p[run], s[run], ids[run], at[run])]))
            return pd.concat([x for x in (known[COLUMNS], *out) if len(x)] or [known[COLUMNS]])

        name = self.write(both.groupBy("share").applyInPandas(merge, OUT))  # the new run, and the marks beside it
        done = self.spark.read.schema(OUT).parquet(f"{self.path}/runs/{name}")
        self.save(self.compacted([*self.runs, (0, name, bits)], bits), chars)
        marks = lambda df, sure: df.where(F.col("sure") == sure).select("id", "entry", "span")
        return marks(done, True), marks(done, False).select("id", "entry")

    def compacted(self, runs: list[tuple[int, str, int]], bits: int) -> list[tuple[int, str, int]]:
        """``runs`` with FANOUT of a level merged into one of the next, for as long as there are so many."""

        def merge(df: pd.DataFrame) -> pd.DataFrame:
            p, s, ids, at, _ = merged_runs([(*x, np.zeros(len(x[0]), bool)) for x in map(unpacked, df["run"])])
            first = heads(p, s)
            return pd.DataFrame({"share": df["share"].iloc[:1], "run": [packed(p[first], s[first], ids[first], at[first])]})

        level = 0
        while level <= max(r[0] for r in runs):
            own = [r for r in runs if r[0] == level]
            if len(own) >= FANOUT:
                rows = self.read(own[0], bits)
                for r in own[1:]:
                    rows = rows.union(self.read(r, bits))
                name = self.write(rows.groupBy("share").applyInPandas(merge, "share int, run binary"))
                runs = [r for r in runs if r[0] != level] + [(level + 1, name, bits)]
            level += 1
        return runs


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` (id, text) joined with the arrays of ``marks`` by id, in a shuffle at every size: marks grow with the corpus."""
    return docs.join(marks, "id", how)


def repeated_windows(docs: DataFrame, open_: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, start, hash) of windows of open entries whose words also start in an earlier document."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            out = []
            for doc, text, at in zip(b["id"], b["text"], b["at"], strict=True):
                h = hashes.of(words(text))
                first, last, _, _ = entries(h, window, gram)
                at = np.unique(at[at < len(first)])
                start = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[i], last[i] + 1) for i in at)])
                out.append((np.full(len(start), doc, np.int64), start, ranges(h, start, start + window).view(np.int64)))
            if out:
                yield pd.DataFrame(dict(zip(("id", "start", "hash"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    each = with_marks(docs, open_.groupBy("id").agg(F.collect_set("entry").alias("at")), "inner")
    seen = staged(each.select("id", "text", "at").mapInPandas(hashed, "id long, start int, hash long"), "windows")
    first = seen.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("hash", "lo")
    return seen.join(first, "hash").where("id > lo").select("id", "start", "hash")


def cut(docs: DataFrame, sure: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """Remove marked words; every mark is held against the words at its place before it counts."""
    a = sure.select("id", F.struct(F.col("entry").alias("at"), F.col("span").alias("h")).alias("e"), F.lit(None).cast("struct<at:int,h:bigint>").alias("w"))
    b = windows.select("id", F.lit(None).cast("struct<at:int,h:bigint>").alias("e"), F.struct(F.col("start").alias("at"), F.col("hash").alias("h")).alias("w"))
    marks = a.union(b).groupBy("id").agg(*(F.collect_list(f"{c}.{f}").alias(c + f) for c in "ew" for f in ("at", "h")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for doc, text, eat, eh, wat, wh in zip(*(batch[c] for c in ("id", "text", "eat", "eh", "wat", "wh")), strict=True):
                w = words(text)
                gone = np.zeros(len(w) + 1, np.int64)
                if eat is not None:
                    h = hashes.of(w)
                    first, last, _, span = entries(h, window, gram)
                    eh, eat = eh[eat < len(first)], eat[eat < len(first)]
                    eat = eat[span[eat].view(np.int64) == eh]
                    wh, wat = wh[wat <= len(w) - window], wat[wat <= len(w) - window]
                    wat = wat[ranges(h, wat, wat + window).view(np.int64) == wh]
                    np.add.at(gone, np.concatenate([first[eat], wat]), 1)
                    np.add.at(gone, np.concatenate([last[eat], wat]) + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = [x for x, k in zip(w, keep, strict=True) if k]
                out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"id": "Int64"})

    return with_marks(docs, marks, "left").mapInPandas(rows, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes when a window that covers it also starts in a document with a smaller id, in the texts as given.
    Null texts have no words. Rows without an id are returned whole and count for no other; rows that share an
    id remove nothing from each other. Other columns are ignored; an empty table gives no rows. Documents enter the index in
    ``batches`` of ascending ids, as they would arrive over time; the result does not depend on their number.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = [k / batches for k in range(1, batches)]
    ends = docs.agg(F.percentile_approx("id", F.lit(cuts) if cuts else F.lit([1.0]), 10_000)).first()[0]
    ends = sorted({int(x) for x in ends or []})[: len(cuts)]
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/epistle/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex[:12]}"
    SubstringIndex.create(spark, path, window, gram)
    sure = open_ = None
    for lo, hi in zip([None, *ends], [*ends, None], strict=True):
        part = docs.where("id is not null")
        part = part if lo is None else part.where(F.col("id") > lo)
        part = part if hi is None else part.where(F.col("id") <= hi)
        whole, some = SubstringIndex.open(spark, path).add(part)
        sure = whole if sure is None else sure.union(whole)
        open_ = some if open_ is None else open_.union(some)
    windows = repeated_windows(docs, open_, window, gram)
    return cut(docs, sure, windows, window, gram).withColumnRenamed("id", id_col)
