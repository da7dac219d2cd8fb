"""Suffix-array dedup: a common-prefix-aware distributed merge sort of text suffixes.

Every window of WINDOW bytes that repeats is found from a sparse suffix array. Its suffixes start at anchors: the
least gram of each window, so equal windows have their anchor at the same place in them. Grams whose hash occurs once in
all texts cannot stand in a repeated window and are left out; every other suffix takes part in the sort.

Suffixes are sorted in runs where they are read. Equal ones with equal bytes before the anchor are folded into one with
its places; runs are front-coded (length of the prefix shared with the one before, then the rest), exchanged by gram,
and combined by a loser tree whose players carry the length of the prefix they share with the last winner, so known
prefixes are never compared again. The merged order comes with those lengths; together with the bytes before the
anchors they tell which windows are equal. Bytes decide, never hashes.

A gram with more than HOT different surroundings would gather too much in one task. It is split by further bytes of
its suffixes: windows are dealt to anchors STEP bytes apart, so that those which meet share all but STEP - 1 of
their bytes, and where that is still too common each window is a suffix of its own, which folds with its equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .hashing import BASE, INVERSE, heads, mixed, powers, ranges

WINDOW = 400
GRAM = 32
HOT = 20_000
#: Bytes between the anchors that a hot gram is split to.
STEP = 25
SHARE_CHARS = 16_000_000
#: A text is worked on in slices of so many windows, to bound memory; entries may break there.
SLICE = 1 << 21
#: Bytes of suffixes that a task holds before it hands over sorted runs, and entries that it lists at a time.
HELD, LISTED = 64 << 20, 500_000
#: Groups of up to so many suffixes are compared in pairs, larger ones by classes.
PAIRS = 10
NO_ID = -(1 << 63)


def grams(x: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all runs of ``gram`` bytes."""
    n = len(x) - gram + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, len(x)), dtype=np.uint64)])
    return mixed((total[gram:] - total[:-gram]) * powers(INVERSE, n))


def windowed_least(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of each ``width`` values (40 bits of them), from minima of blocks."""
    place = np.uint64((1 << 24) - 1)
    n = len(g) - width + 1
    key = (g & ~place) | np.arange(len(g), dtype=np.uint64)
    pad = -len(g) % width
    key = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)


def entries(text: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window, anchor, gram hash, span hash and repeats of each entry of a text.

    Neighbouring entries that are alike (equal hashes and shape, as in a text of short period) are one with so many repeats,
    each as many windows behind the one before as an entry has.
    """
    out = []
    for lo in range(0, max(0, len(text) - window + 1), SLICE):
        x = np.frombuffer(text[lo : lo + SLICE + window - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        g = grams(x, gram)
        at = windowed_least(g, window - gram + 1)
        first = np.flatnonzero(heads(at))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        one = (first + lo, last + lo, at[first] + lo, g[at[first]].view(np.int64), ranges(x, first, last + window).view(np.int64))
        begin = np.flatnonzero(heads(one[3], one[4], last - first, at[first] - first))
        out.append((*(v[begin] for v in one), np.diff(np.concatenate([begin, [len(first)]]))))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 6


def periodic(text: bytes, lo: int, hi: int, stride: int) -> bool:
    """Whether the bytes from ``lo`` to ``hi`` repeat every ``stride``."""
    view = memoryview(text)
    return view[lo : hi - stride] == view[lo + stride : hi]


def encoded(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def shared_prefix(a: bytes, b: bytes, k: int = 0) -> int:
    m = min(len(a), len(b))
    if a[k:m] == b[k:m]:
        return m
    x = int.from_bytes(a[k:m], "big") ^ int.from_bytes(b[k:m], "big")
    return k + (8 * (m - k) - x.bit_length()) // 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """For sorted suffixes: (shared prefix, length) of each, and the bytes that are not shared."""
    shape, rest, before = np.zeros((len(suffixes), 2), np.int32), [], b""
    for i, s in enumerate(suffixes):
        k = shared_prefix(before, s)
        shape[i] = k, len(s)
        rest.append(s[k:])
        before = s
    return shape, b"".join(rest)


def decoded(shape: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    at, s = 0, b""
    for k, n in shape.tolist():
        s = s[:k] + rest[at : at + n - k]
        at += n - k
        yield k, s


def merged(runs: list[tuple[np.ndarray, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge front-coded runs with a loser tree: (shared prefix with the one before, run, place in it, suffix).

    ``known[r]`` is the prefix that run r's front suffix shares with the last winner. Of two players the one
    that shares more comes first; only where they share equally are bytes compared, from there on, and the loser keeps
    what it shares with the winner.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    streams = [decoded(*r) for r in runs]
    front: list[bytes | None] = [None] * k
    known, place = [0] * k, [-1] * k

    def advance(r: int) -> None:
        step = next(streams[r], None) if r < len(streams) else None
        known[r], front[r] = step if step else (0, None)
        place[r] += 1

    def first_wins(a: int, b: int) -> bool:
        x, y = front[a], front[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        n = shared_prefix(x, y, known[a])
        wins = x[n:] <= y[n:]
        known[b if wins else a] = n
        return wins

    for r in range(k):
        advance(r)
    losers, level = [0] * k, list(range(k))
    base = k
    while len(level) > 1:  # the first round, from the leaves up
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            win, lose = (a, b) if first_wins(a, b) else (b, a)
            losers[base + i // 2] = lose
            up.append(win)
        level = up
    win = level[0]
    while front[win] is not None:
        yield known[win], win, place[win], front[win]
        advance(win)
        node = (win + k) // 2
        while node:
            if not first_wins(win, losers[node]):
                win, losers[node] = losers[node], win
            node //= 2


def equal_windows(shared: list[int], left: list[bytes], low: list[int], high: list[int], window: int, gram: int) -> list[list[tuple[int, int]]]:
    """For suffixes with one gram, in sorted order: ranges of offsets before the anchor at which each has a repeated window.

    ``shared[i]`` is the prefix that suffix i shares with i - 1; ``left`` what stands before the anchors; low and high bound
    the offsets of each one's windows. Windows at offset o are equal if o bytes before and window - o from the anchor on are.
    """
    n = len(left)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= PAIRS:
        for i in range(n):
            right = 1 << 30
            for j in range(i + 1, n):
                right = min(right, shared[j])
                if right < gram:
                    break
                a, b = left[i][::-1], left[j][::-1]
                lo, hi = max(low[i], low[j], window - right), min(high[i], high[j], shared_prefix(a, b))
                if lo <= hi:
                    out[i].append((lo, hi))
                    out[j].append((lo, hi))
        return out
    lows, highs, right = np.array(low), np.array(high), np.array(shared)
    width = int(highs.max())
    before = np.full((n, width + 1), 256, np.int64)
    for i, b in enumerate(left):
        before[i, 1 : 1 + len(b)] = np.frombuffer(b[::-1], np.uint8)
    same = np.zeros(n, np.int64)  # equal numbers: the same bytes before the anchor, up to the offset
    for o in range(width + 1):
        if o:
            same = np.unique(same * 257 + before[:, o], return_inverse=True)[1]
        on = np.flatnonzero((lows <= o) & (o <= highs))
        if len(on) < 2:
            continue
        key = np.cumsum(right < window - o)[on] * n + same[on]
        order = np.argsort(key, kind="stable")
        new = heads(key[order])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(on)]]))
        for i in on[order[np.repeat(size, size) > 1]]:
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], o)
            else:
                out[i].append((o, o))
    return out


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    from .substring_dedup import with_marks as joined

    return joined(docs, marks, how)


#: Windows start to stop, and ``repeats`` - 1 times the same, each ``stride`` further on; the hash is that of the bytes of the first.
RANGES = "id long, start int, stop int, hash long, repeats int, stride int"


def pieces(first: int, last: int, at: int, part: int, step: int) -> Iterator[tuple[int, int, int]]:
    """Windows first to last of an entry as (anchor, first, last) for anchors ``step`` bytes apart; those of part ``part`` alone, if not negative."""
    for j in range((at - last) // step, (at - first) // step + 1):
        if part < 0 or j * step // STEP == part:
            anchor = at - j * step
            yield anchor, max(first, anchor - step + 1), min(last, anchor)


def suffix_ranges(docs: DataFrame, open_: DataFrame, shares: int, window: int, gram: int, step: int | None = None) -> DataFrame:
    """Ranges of repeated windows (RANGES) of the open entries (id, entry, part), by the merge sort.

    Suffixes start at the entries' own anchors, or at those ``step`` bytes apart.
    """
    common = gram if step is None else window - step + 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["share", "shape", "rest", "before", "places", "begin"]
        found: dict[int, dict[tuple[bytes, bytes], list[tuple]]] = {}
        held = 0

        def handed() -> pd.DataFrame:
            rows = []
            for share, own in found.items():
                keys = sorted(own)
                shape, rest = front_coded([k[0] for k in keys])
                counts = np.cumsum([0] + [len(own[k]) for k in keys[:-1]]).astype(np.int32)
                where = np.array([x for k in keys for x in own[k]], np.int64)
                rows.append((share, shape.tobytes(), rest, b"".join(k[1] for k in keys), where.tobytes(), counts.tobytes()))
            found.clear()
            return pd.DataFrame(rows, columns=names)

        for b in batches:
            for doc, text, marked, parts in zip(b["id"], encoded(b["text"]), b["entry"], b["part"], strict=True):
                first, last, at, g, _, repeats = entries(text, window, gram)
                wanted = np.unique(np.stack([marked, parts], axis=1).astype(np.int64), axis=0)
                for i, part in wanted[wanted[:, 0] < len(first)].tolist():
                    s1, s2, p, n = int(first[i]), int(last[i]), int(at[i]), int(repeats[i])
                    stride = s2 - s1 + 1
                    # the repeats are alike by hashes; bytes decide, and if they differ each is an entry of its own
                    whole = n == 1 or periodic(text, s1, s2 + (n - 1) * stride + window, stride)
                    key = int(g[i].view(np.uint64))
                    for k in range(1 if whole else n):
                        off = k * stride
                        for p_, lo, hi in [(p, s1, s2)] if step is None else pieces(s1, s2, p, part, step):
                            p_, lo, hi = p_ + off, lo + off, hi + off
                            key = key if step is None else checksum(text[p_ : p_ + common])
                            own = found.setdefault(key % shares, {})
                            suffix, before = text[p_ : hi + window], text[lo:p_]
                            if (places := own.get((suffix, before))) is None:
                                places = own[suffix, before] = []
                                held += len(suffix) + len(before)
                            places.append((int(doc), lo, p_, hi, n if whole else 1, stride))
                            held += 160
                    if held > HELD:
                        yield handed()
                        held = 0
        yield handed()

    def combine(df: pd.DataFrame) -> pd.DataFrame:
        shapes = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in df["shape"]]
        places = [np.frombuffer(x, np.int64).reshape(-1, 6) for x in df["places"]]
        folded = [[*np.frombuffer(x, np.int32).tolist(), len(p)] for x, p in zip(df["begin"], places, strict=True)]  # where each suffix's places begin
        begins = [np.concatenate([[0], np.cumsum((p[:, 2] - p[:, 1])[f[:-1]])]).tolist() for p, f in zip(places, folded, strict=True)]
        before, rests = list(df["before"]), list(df["rest"])
        out: list[tuple[int, int, int, int, int, int]] = []
        group: list[tuple[int, int, int, bytes]] = []

        def settle() -> None:
            shared, left, suffix, where = [], [], [], []
            seen: dict[tuple[bytes, bytes], int] = {}
            least_ = 1 << 30
            for known, r, i, s in group:
                b = before[r][begins[r][i] : begins[r][i + 1]]
                least_ = min(least_, known)
                own = places[r][folded[r][i] : folded[r][i + 1]].tolist()
                if (k := seen.get((b, s))) is not None:
                    where[k] += own
                    continue
                seen[b, s] = len(left)
                shared.append(least_)  # with the one before that is not folded into another
                least_ = 1 << 30
                left.append(b)
                suffix.append(s)
                where.append(own)
            several = [k for k, x in enumerate(where) if len(x) > 1 or x[0][4] > 1]
            for k in several:
                check = checksum(left[k] + suffix[k])
                out.extend((doc, lo, hi, check, n, stride) for doc, lo, _, hi, n, stride in where[k])
            if len(left) < 2 or len(several) == len(left):
                return
            spans = equal_windows(shared, left, [x[0][2] - x[0][3] for x in where], [x[0][2] - x[0][1] for x in where], window, common)
            for x, l, s, own in zip(where, left, suffix, spans, strict=True):
                if len(x) == 1 and x[0][4] == 1:
                    doc, s1, p = x[0][:3]
                    out.extend((doc, p - hi, p - lo, checksum(l[p - hi - s1 :] + s[: window - lo]), 1, 1) for lo, hi in own)

        for got in merged(list(zip(shapes, rests, strict=True))):
            if got[0] < common:
                settle()
                group = []
            group.append(got)
        settle()
        return pd.DataFrame(out, columns=["id", "start", "stop", "hash", "repeats", "stride"])

    each = with_marks(docs, open_.groupBy("id").agg(F.collect_list("entry").alias("entry"), F.collect_list("part").alias("part")), "inner")
    sorted_runs = each.select("id", "text", "entry", "part").mapInPandas(runs, "share int, shape binary, rest binary, before binary, places binary, begin binary")
    return sorted_runs.groupBy("share").applyInPandas(combine, RANGES)


def checksum(covered: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(covered, digest_size=8).digest(), "little", signed=True)


def split_parts(docs: DataFrame, open_: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, entry, part, c): the parts of hot entries, and how many parts (repeats apart) have the same bytes from their anchor on."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, marked in zip(b["id"], encoded(b["text"]), b["entry"], strict=True):
                first, last, at, _, _, repeats = entries(text, window, gram)
                for i in np.unique(marked[marked < len(first)]).tolist():
                    for p, _, _ in pieces(int(first[i]), int(last[i]), int(at[i]), -1, STEP):
                        out.append((doc, i, (int(at[i]) - p) // STEP, checksum(text[p : p + window - STEP + 1]), int(repeats[i])))
            yield pd.DataFrame(out, columns=["id", "entry", "part", "key", "n"])

    each = with_marks(docs, open_.groupBy("id").agg(F.collect_set("entry").alias("entry")), "inner")
    found = staged(each.select("id", "text", "entry").mapInPandas(keyed, "id long, entry int, part int, key long, n int"), "parts")
    return found.join(found.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("all")).where("all > 1"), "key").select("id", "entry", "part", "c")


def cut(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    marks = found.groupBy("id").agg(*(F.collect_list(c).alias(c) for c in ("start", "stop", "hash", "repeats", "stride")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, *marks_ in zip(batch["id"], encoded(batch["text"]), *(batch[c] for c in ("start", "stop", "hash", "repeats", "stride")), strict=True):
                gone = np.zeros(len(text) + 1, np.int32)
                if marks_[0] is not None:
                    for s, e, x, n, stride in zip(*(m.tolist() for m in marks_), strict=True):
                        # rows may share an id: a mark is for the bytes that it was made from
                        if checksum(text[s : e + window]) != x:
                            continue
                        if n == 1:
                            gone[s] += 1
                            gone[e + window] -= 1
                        elif periodic(text, s, e + (n - 1) * stride + window, stride):
                            gone[s + stride * np.arange(n)] += 1
                            gone[e + window + stride * np.arange(n)] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = np.frombuffer(text, np.uint8)[keep].tobytes()
                runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                out.append((doc, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_marks(docs, marks, "left").mapInPandas(rows, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Every byte in a ``window``-byte string that also starts anywhere else goes, in the same document too; strings are
    judged on the texts as given and never cross documents. Null texts are empty; texts below ``window`` bytes lose
    nothing. Repeated rows are copies of each other, also without an id. Other columns are ignored; an empty table gives
    no rows.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        table = lambda: pd.DataFrame(dict(zip(("id", "entry", "gram", "span", "n"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
        for b in batches:
            for doc, text in zip(b["id"], encoded(b["text"]), strict=True):
                first, _, _, g, span, repeats = entries(text, window, gram)
                found.append((np.full(len(first), doc, np.int64), np.arange(len(first), dtype=np.int32), g, span, repeats))
                held += len(first) + 1
                if held > LISTED:
                    yield table()
                    found, held = [], 0
        if found:
            yield table()

    every = staged(docs.mapInPandas(listed, "id long, entry int, gram long, span long, n long"), "entries")
    spans = every.groupBy("gram", "span").agg(F.sum("n").alias("n"))
    # staged, so that a hot gram's entries meet it in a shuffle of their own, which adaptive execution splits
    common = staged(spans.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("n > 1").select("gram", "c"), "common")
    open_ = staged(every.drop("span", "n").join(common, "gram").select("id", "entry", F.lit(-1).alias("part"), "c"), "open")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(8, -(-chars // SHARE_CHARS))
    found = suffix_ranges(docs, open_.where(F.col("c") <= hot), shares, window, gram)
    if open_.where(F.col("c") > hot).take(1):
        parts = staged(split_parts(docs, open_.where(F.col("c") > hot), window, gram), "split")
        found = found.union(suffix_ranges(docs, parts.where(F.col("c") <= hot), shares, window, gram, STEP))
        found = found.union(suffix_ranges(docs, parts.where(F.col("c") > hot), shares, window, gram, 1))
    out = cut(docs, staged(found, "ranges"), window)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
