"""Best-fit-decreasing packing of tokenised documents into sequences of at most CAPACITY tokens.

Documents are tokenised where they are read, and the ids stay in the files written there; only lengths and places move. Lengths are whole
numbers from 1 to CAPACITY, so best-fit decreasing over *all* pieces is decided on their histogram (CAPACITY
numbers, whatever the corpus): for each length from the longest, a segment tree over remaining capacities
finds the tightest open capacity in logarithmic time, and all bins of that capacity are filled at once. The
outcome is a list of runs "pieces rank_lo... of length L go to bins bin_lo..., per_bin to each", which tasks apply to
their pieces by rank. It equals what document-by-document best-fit decreasing gives, at any corpus size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BROADCAST_ROWS, staged

CAPACITY = 1024
END = 2
#: Bytes of ids that a tokenising task hands over at once.
HANDED = 1 << 23
#: How a byte-level tokenizer splits text before it merges bytes.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of other characters go to the tokenizer itself, since libraries may class rare characters differently.
USUAL = regex.compile(r"[\x00-\x1b\x20-\x84\xa0-ɏΆ-ώЀ-ҁ‐-‧€一-龥]*")
#: So do long blanks, at which a backtracking split may give up.
BLANK_RUN = re.compile(r"\s{1000}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """A faster encoder of equal ids for a plain byte-level BPE file whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or spec.get("normalizer"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(made):
        return None
    to_byte, special = byte_of(), {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer file gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = ranked(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.ranked is None or not USUAL.fullmatch(text) or BLANK_RUN.search(text):
            return self.whole(text)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, part, nth); ids are little-endian 32-bit, nth counts a task's pieces of equal length."""
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen, part = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    rows.append((doc, k, start, stop - start, ids[4 * start : 4 * stop], part, seen[stop - start]))
                    seen[stop - start] += 1
                held += len(ids)
                if held > HANDED:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


class Capacities:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, at: int, value: bool) -> None:
        at += self.size
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open bin."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram: runs (length, rank_lo, bin_lo, per_bin, offset)."""
    tree, runs, bins = Capacities(capacity), [], 0
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            open_[left].append((first, n))
            tree.put(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = open_[left].pop()
                tree.put(left, bool(open_[left]))
            each = left // length  # the bin just used stays the tightest while it has room
            full = min(n, todo // each)
            runs.append((length, rank, first, each, capacity - left))
            rank, todo = rank + full * each, todo - full * each
            put(left - each * length, first, full)
            if full < n and todo:  # the last ones do not fill a bin
                if full:
                    runs.append((length, rank, first + full, each, capacity - left))
                put(left - todo * length, first + full, 1)
                full, todo = full + 1, 0
            put(left, first + full, n - full)
    return runs


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian 32-bit).

    A document is its ids and END; only one longer than ``capacity`` is cut, its first piece being the short one,
    so the rest fill sequences alone. Null and empty texts are one piece of END. Repeated rows are documents
    of their own; ids may be null; other columns are ignored; an empty table gives no rows.
    """
    # Each range of parts has few enough offsets for a broadcast, so the ids never go through a shuffle; its pieces lie in a
    # folder of their own, so that however many ranges there are, each file is read once.
    width = max(1, BROADCAST_ROWS // capacity)
    found = pieces(docs, tokenizer, id_col, text_col, capacity)
    cut = staged(found.withColumn("parts", F.floor(F.col("part") / width).cast("int")), "pieces", by="parts")
    counts = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    runs = np.array(best_fit(totals, capacity) or [(0, 0, 0, 1, 0)], np.int64)
    key = (runs[:, 0] << 44) + runs[:, 1]
    order = np.argsort(key, kind="stable")
    key, runs = key[order], runs[order]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        nth = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * length})

    last = counts.agg(F.max("part")).first()[0] or 0
    ranked = None
    for k in range(last // width + 1):
        some = cut.where(F.col("parts") == k).join(F.broadcast(offsets.where(F.col("part").between(k * width, (k + 1) * width - 1))), ["length", "part"])
        ranked = some if ranked is None else ranked.union(some)
    out = ranked.withColumn("at", place("length", F.col("before") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "at.sequence_id", "at.offset", "ids")


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence of ``packed``: sequence_id, length, ids (little-endian 32-bit), and its pieces (offset, length, doc_id, piece) in order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    rows = placed.groupBy("sequence_id").agg(own.alias("own"))
    ids = F.unhex(F.array_join(F.transform("own", lambda x: F.hex(x["ids"])), ""))
    slim = F.transform("own", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece")))
    return rows.select("sequence_id", (F.octet_length(ids) / 4).cast("long").alias("length"), ids.alias("ids"), slim.alias("pieces"))
