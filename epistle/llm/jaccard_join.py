"""N-gram Jaccard join: size-aware heavy-light join on word shingles, exact at its threshold.

Sets that are equal are one class and take part once. Two sets with Jaccard similarity of 0.9 or more (the default;
the threshold is a parameter) differ in at most 2/19 of the larger size on either side together.

Light: sets up to a boundary emit all subsets that leave out as many elements as a partner may lack. Linked sets
meet in the subset that is their intersection; there each set is held against the smallest one only. If two
sets of the group are linked, both are linked to it, so a star keeps the component whole.

Heavy: larger sets are cut by hash range into one block more than partners may differ in elements, so linked sets agree on
a whole block. At lower thresholds blocks are small and some are empty or hold one element; then some more blocks are
cut than that, so that linked sets agree on several, and each set leaves out one fewer than these: for components its
most frequent ones, after a count of all blocks over all sets, so a set that shares a passage with others, but has
enough of its own, is in no list; for all pairs its smallest ones. Blocks without elements are the most frequent, so a
set that may leave out all of its own names none of them. The sets of a block are a candidate group, however large, and first each is held against the
group's hub alone, its smallest id: that joins a cluster of near copies by as many comparisons as it has members.
(A set is in many blocks: for components those of one hub are one group.) Sets that the hub does not link stay open. Jaccard distance is a metric, so an open set can be linked to one that the hub
links only if their distances from the hub differ by no more than linked sets may be apart; just those stay with
the open ones. Sets near their hub, as copies with edits are, are held against each other by the elements in which they
differ from it alone: these are few, and few sets share one. Sets far from it stay a group: linked sets are both near
or both far, as the two ranges of distances overlap. What stays of a group and fits in one task has its inverted lists scanned there. What does not goes through a hub
again, at first as it is, then dealt by the elements of the sets' prefixes (linked sets share one; not below 0.9, where prefixes are long). Groups that are still too
large after ROUNDS of this are cut into chunks, and each two chunks meet in a task: the exact way for the rest.

``linked`` needs components only, so it keeps stars and spanning forests. ``links`` gives every linked pair of classes:
in the light groups each two sets are paired that leave out nothing in common, which is so in the subset equal to
their intersection alone, and in the heavy groups inverted lists are scanned and intersections counted in full, a
pair being given in the least block that it agrees on.

The boundary minimises the counted rows and list reads of both ways over the histogram of small sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, if_small, staged
from .hashing import M1, Hashes, mixed, runs

SHINGLE = 3
#: Similarity in per cent where no other is asked for.
PERCENT = 90
#: Sets up to this size may be enumerated; the boundary lies at or below it.
SMALL = 48
#: Shingles that one scanning task takes at once.
SHARE = 1_000_000
#: Shingles of members that one task holds against a hub.
HELD = 1 << 15
#: Distance from their hub up to which sets are held against each other by how they differ from it.
NEAR = 0.5
#: Sets that one task holds against each other so.
MET = 20_000
#: Sets of a light group that one task pairs with each other.
PAIRED = 1000
#: How often a group that is too large for one task goes through a hub before it is cut into chunks.
ROUNDS = 4
#: Keys of blocks that are counted: the band from bit 48 on, a bit for blocks without elements, a signature.
BAND, EMPTY = 48, 47
#: Bits for each id that is looked for, and bits of one bitmap as Spark builds them.
BITS, BITMAP = 16, 1 << 15


def differ(a: int, percent: int = PERCENT) -> int:
    """Most elements in which a set of ``a`` and a linked one of at most ``a`` elements differ."""
    return 2 * a * (100 - percent) // (100 + percent)


def spare(d: int, percent: int) -> int:
    """Blocks more than needed for sets that differ in ``d`` elements; as many may be left out."""
    return d // 2 if percent < PERCENT else 0


def size_classes(top: int, percent: int = PERCENT, step: int = 1) -> list[int]:
    """Upper ends of size classes, each so many ``step`` as wide as sizes of linked sets are apart; a linked partner is in the same class or the next."""
    ends = [1]
    while ends[-1] < top:
        ends.append((ends[-1] + 1) * 100 // percent)
        for _ in range(step - 1):
            ends[-1] = (ends[-1] + 1) * 100 // percent
    return ends


def shingles(text: str | None, hashes: Hashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer than k words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(runs(hashes.of(words), min(k, len(words)))) if words else np.zeros(0, np.uint64)


def bands(n: int, ends: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """The size class of a set of ``n`` elements and the next: its number, in how many two linked sets of it differ at most, and in how many this set and its partner."""
    c, out = int(np.searchsorted(ends, n)), []
    for at in (c, c + 1):
        d = differ(int(ends[at]), percent)
        if d + 1 + spare(d, percent) < 2 or at > c and n * 100 // percent <= ends[c]:
            continue  # only equal sets could be linked
        largest = min(int(ends[at]), n * 100 // percent)
        out.append((at, d, (n + largest) * (100 - percent) // (100 + percent)))
    return out


def blocks(s: np.ndarray, ends: np.ndarray, percent: int = PERCENT, every: bool = False) -> list[np.ndarray]:
    """Signatures of a set's blocks for each of its ``bands``; without ``every`` the smallest spare ones are left out, with it they are keys below BAND."""
    out, total = [], np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s), dtype=np.uint64)])
    for _, d, _ in bands(len(s), ends, percent):
        m = d + 1 + spare(d, percent)
        cuts = np.searchsorted(s, (np.arange(m + 1, dtype=np.float64) * (2.0**64 / m)).clip(0, 2.0**64 - 2048).astype(np.uint64))
        cuts[-1] = len(s)
        tag = np.arange(m, dtype=np.uint64) + np.uint64(m << 32)
        marks = mixed((total[cuts[1:]] - total[cuts[:-1]]) ^ (tag * M1))
        size = cuts[1:] - cuts[:-1]
        out.append(marks & np.uint64((1 << EMPTY) - 1) | (size == 0).astype(np.uint64) << np.uint64(EMPTY) if every else marks[np.lexsort((marks, size))[spare(d, percent) :]])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def counted(marks: np.ndarray, at: int, own: int) -> dict:
    """The keys of a set's blocks in band ``at``, and how many of them, less one, a set agrees on that differs in ``own`` elements at most.

    Empty blocks come last in the order of ``rare_marks``; they go where those that may be left out are as many.
    """
    keys = np.unique(marks)
    sure, empty = len(keys) - 1 - own, int((keys >> EMPTY).sum())
    if empty <= sure:
        keys, sure = keys[: len(keys) - empty], sure - empty
    return {"band": at, "sure": sure, "keys": keys | at << BAND}


def profiles(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, every: bool = False) -> DataFrame:
    """(id, n, digest, blocks, small): set size, hash of the set, block signatures, the set itself if small.

    With ``every``, ``blocks`` has the ``counted`` keys of each band instead, of signatures that are cut short, as that
    halves what is shuffled. Classes are twice as wide then, so fewer sets are in two bands.
    """
    ends = np.array(size_classes(1 << 40, percent, 2 if every else 1), np.int64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for doc, text in zip(b["id"][lo : lo + 500], b["text"][lo : lo + 500], strict=True):
                    s = shingles(text, hashes, k)
                    n = len(s)
                    marks = [_signed(x) for x in blocks(s, ends, percent, every)] if n else []
                    if every:
                        marks = [counted(x, at, own) for x, (at, _, own) in zip(marks, bands(n, ends, percent) if n else [], strict=True)]
                    elif marks:
                        marks = np.concatenate(marks)
                    out.append((doc, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), marks, _signed(s) if 0 < n <= SMALL else None))
                yield pd.DataFrame(out, columns=["id", "n", "digest", "blocks", "small"]).astype({"id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(rows, f"id long, n long, digest binary, blocks {'array<struct<band:int,sure:int,keys:array<long>>>' if every else 'array<long>'}, small array<long>")


def subset_rows(n: int, boundary: int, percent: int) -> int:
    return sum(math.comb(n, j) for j in range(differ(min(boundary, n * 100 // percent), percent) + 1))


def cost_of(histogram: dict[int, int], percent: int) -> Callable[[int], int]:
    """What a boundary costs: rows of subsets, and rows of blocks and list reads."""
    ends = size_classes(1 << 20, percent)
    lists = {n: 2 * differ(ends[np.searchsorted(ends, n) + 1], percent) + 2 + 2 * n for n in histogram}

    def cost(boundary: int) -> int:
        return sum(c * subset_rows(n, boundary, percent) for n, c in histogram.items() if n <= boundary) + sum(c * lists[n] for n, c in histogram.items() if n * 100 >= percent * (boundary + 1))

    return cost


def boundary_of(cost: Callable[[int], int]) -> int:
    """The size up to which enumerating costs least."""
    return min(range(SMALL + 1), key=lambda b: (cost(b), b))


def subsets_of(sets: DataFrame, boundary: int, percent: int, gone_too: bool) -> DataFrame:
    """Rows (sig, s, id, n, gone): the subsets of ``sets`` (id, n, small) and, if asked, the elements that each leaves out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, n, small in zip(b["id"], b["n"], b["small"], strict=True):
                small = np.asarray(small, np.int64)
                m = mixed(small.view(np.uint64))
                total = m.sum(dtype=np.uint64)
                for j in range(differ(min(boundary, int(n) * 100 // percent), percent) + 1):
                    left = [list(c) for c in combinations(range(n), j)]
                    gone = np.array([m[c].sum(dtype=np.uint64) for c in left], np.uint64)
                    out += [(int(x), n - j, doc, n, small[c] if gone_too else None) for x, c in zip(_signed(mixed((total - gone) ^ (np.full(1, n - j, np.uint64) * M1))), left, strict=True)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["sig", "s", "id", "n", "gone"])
                    out = []
            yield pd.DataFrame(out, columns=["sig", "s", "id", "n", "gone"])

    return sets.mapInPandas(rows, "sig long, s long, id long, n long, gone array<long>")


def met_in(subsets: DataFrame, percent: int) -> DataFrame:
    """The members of each subset's group that are linked to its smallest set, that one (``hub``) included."""
    hubs = staged(subsets.groupBy("sig", "s").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("c")).where("c > 1"), "hubs")
    linked = 100 * F.col("s") >= percent * (F.col("n") + F.col("hub.n") - F.col("s"))
    return subsets.join(hubs, ["sig", "s"]).where(linked)


def light_edges(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Star edges between linked sets of at most ``boundary`` elements. ``sets``: id, n, small."""
    met = met_in(staged(subsets_of(sets, boundary, percent, False).drop("gone"), "subsets"), percent).where(F.col("id") != F.col("hub.id"))
    return met.select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def light_pairs(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """All linked pairs (a < b) of sets of at most ``boundary`` elements; each two chunks of a group meet in a task."""
    met = met_in(staged(subsets_of(sets, boundary, percent, True), "subsets"), percent).withColumn("chunks", F.ceil(F.col("c") / PAIRED).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("sig", "s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "gone")
    one, two = (met.select("sig", "s", "i", "j", *(F.col(c).alias(f"{c}_{x}") for c in ("own", "id", "n", "gone"))) for x in "ab")
    meet = (F.col("id_a") < F.col("id_b")) & ((F.col("i") == F.col("j")) | (F.col("own_a") != F.col("own_b")))
    linked = 100 * F.col("s") >= percent * (F.col("n_a") + F.col("n_b") - F.col("s"))
    both = one.join(two, ["sig", "s", "i", "j"]).where(meet & linked & ~F.arrays_overlap("gone_a", "gone_b"))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


class Group:
    """The sets of a candidate group (sorted arrays of shingles), with their inverted lists."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.wide = percent, 2 * percent - 100  # sets linked to a common one are at least ``wide`` similar
        self.size = np.array([len(s) for s in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.item, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        owner = np.repeat(np.arange(len(sets)), self.size)
        rarest = np.lexsort((self.item, often[self.item], owner))  # each set's own items, rare ones first
        rank = np.arange(len(owner)) - np.repeat(self.begin[:-1], self.size)
        prefix = rarest[rank < (self.size + np.minimum(0, self.wide * self.size // -100) + 1)[owner]]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner[prefix], minlength=len(sets)))])
        self.prefix = self.item[prefix]
        by_item = np.argsort(self.prefix, kind="stable")
        self.lists = owner[prefix][by_item]
        self.list_begin = np.searchsorted(self.prefix[by_item], np.arange(len(often) + 1))
        self.mark = np.zeros(len(often), bool)

    @staticmethod
    def gathered(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The places of the stretches of ``n`` places from ``begin`` on."""
        return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many items set i shares with each of ``others``."""
        own = self.item[self.begin[i] : self.begin[i + 1]]
        self.mark[own] = True
        n = self.size[others]
        hit = self.mark[self.item[self.gathered(self.begin[others], n)]]
        self.mark[own] = False
        return np.bincount(np.repeat(np.arange(len(others)), n), hit, len(others)).astype(np.int64)

    def similar(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        both = self.shared(i, others)
        return 100 * both >= percent * (self.size[i] + self.size[others] - both)

    def around(self, i: int) -> np.ndarray:
        """The other sets that are at least ``wide`` similar to set i."""
        if self.wide <= 0:
            return np.delete(np.arange(len(self.size)), i)
        items = self.prefix[self.first[i] : self.first[i + 1]]
        found = np.unique(self.lists[self.gathered(self.list_begin[items], self.list_begin[items + 1] - self.list_begin[items])])
        found = found[found != i]
        return found[self.similar(i, found, self.wide)]


def spanning(ids: list[int], sets: list[np.ndarray], pre: list[bool], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked sets of a group; those with ``pre`` are connected already.

    Each set that no earlier pivot is linked to becomes a pivot and is held against all that inverted lists of rare
    items show to be near. Links between sets of different pivots that are not connected yet can only be between those
    which are near to each other's pivot.
    """
    g, root = Group(sets, percent), list(range(len(sets)))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))

    known = np.flatnonzero(pre).tolist()
    for i in known[1:]:
        root[find(i)] = find(known[0])
    pivot = np.full(len(sets), -1)
    near: dict[int, np.ndarray] = {}
    for i in range(len(sets)):
        if pivot[i] >= 0:
            continue
        found = g.around(i)
        hit = g.similar(i, found, percent)
        linked, near[i] = found[hit], found[~hit].astype(np.int32)
        for j in linked.tolist():
            join(i, j)
        pivot[linked[pivot[linked] < 0]] = i
        pivot[i] = i
    for q, found in near.items():
        for p in np.unique(pivot[found]).tolist():
            if p >= q or find(p) == find(q):
                continue
            # links of p's own sets to q's own: the former are near to q (or are p), the latter near to p (or are q)
            xs, ys = found[pivot[found] == p], near[p][pivot[near[p]] == q].astype(np.int64)
            for x in xs.tolist() if len(ys) else []:
                if len(hit := ys[g.similar(x, ys, percent)]):
                    join(x, int(hit[0]))
                    break
    return out


def joined(ids: list[int], size: np.ndarray, unlike: list[np.ndarray], pre: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all linked sets of a group, from the elements in which each differs from one common set; those with ``pre`` are connected already.

    Two sets differ in the elements in which just one of them differs from the common set. Where more than half of all differ,
    the element is turned round for all: that changes the common set, not what two sets differ in.
    """
    m, out = len(ids), []
    item, often = np.unique(np.concatenate(unlike), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(m), [len(x) for x in unlike])
    turned = 2 * often > m
    if turned.any():
        have, flip = np.zeros((turned.sum(), m), bool), turned[item]
        have[(np.cumsum(turned) - 1)[item[flip]], owner[flip]] = True
        one, lacks = np.nonzero(~have)
        item, owner = np.concatenate([item[~flip], np.flatnonzero(turned)[one]]), np.concatenate([owner[~flip], lacks])
    differs = np.bincount(owner, minlength=m)
    shared = np.bincount(item, minlength=len(often))[item] > 1  # the others meet nothing
    item, owner = item[shared], owner[shared]
    by_item, by_owner = np.argsort(item, kind="stable"), np.argsort(owner, kind="stable")
    lists, begin = owner[by_item], np.searchsorted(item[by_item], np.arange(len(often) + 1))
    own, first = item[by_owner], np.searchsorted(owner[by_owner], np.arange(m + 1))
    label = np.arange(m)
    label[pre] = m
    for i in np.flatnonzero(~pre).tolist():
        items = own[first[i] : first[i + 1]]
        both = np.bincount(lists[Group.gathered(begin[items], begin[items + 1] - begin[items])], minlength=m)
        apart, total = differs[i] + differs - 2 * both, size[i] + size
        found = np.flatnonzero((100 * (total - apart) >= percent * (total + apart)) & (label != label[i]))
        if len(found):
            labels, at = np.unique(label[found], return_index=True)
            out += [(ids[i], ids[j]) for j in found[at].tolist()]
            label[np.isin(label, labels)] = label[i]
    return out


def pairs(ids: list[int], sets: list[np.ndarray], percent: int, wanted: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """All linked pairs of places (i, j) for which ``wanted`` holds, from counts over inverted lists."""
    g = Group(sets, percent)
    for i in range(1, len(sets)):
        near = g.around(i)
        near = near[near < i]
        found = near[g.similar(i, near, percent)]
        for j in found[wanted(i, found)].tolist():
            yield ids[i], ids[j]


def perhaps_among(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """``docs`` without most rows whose id is not among the ``rows`` values of ``ids``: a broadcast bitmap of hashes, two bytes an id, lets one in sixteen others pass."""
    buckets = BITS * rows // BITMAP + 1
    h = F.xxhash64("id")
    bucket, place = F.pmod(h, F.lit(buckets)).alias("bucket"), F.shiftright(h, 40).bitwiseAND(F.lit(BITMAP - 1)).alias("place")
    maps = ids.select(bucket, place).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (F.col("place") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0
    return docs.select("*", bucket, place).join(F.broadcast(maps), "bucket").where(found).select(docs.columns)


def with_sets(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``rows`` (id and others), each with the set of its document as ``elements``."""
    kept = [c for c in rows.columns if c != "id"]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, elements = Hashes(), None, b""
        for b in batches:
            for lo in range(0, len(b), 500):
                out = []
                for t in b["text"][lo : lo + 500]:
                    if t is not last and t != last:  # rows of a document stand together
                        last, elements = t, shingles(t, hashes, k).tobytes()
                    out.append(elements)
                yield b[["id", *kept]][lo : lo + 500].assign(elements=out)

    per = staged(rows.groupBy("id").agg(F.collect_set(F.struct(*kept)).alias("rest")), "wanted")
    # a join shuffles the texts of both sides' other ids too, so most of these are left out before
    text = perhaps_among(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), per, per.count()).join(per, "id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "id")
    return text.select("id", "text", F.inline("rest")).select("id", *kept, "text").mapInPandas(sets, f"id long, {schema}, elements binary")


def hubs_of(groups: DataFrame) -> DataFrame:
    return staged(groups.groupBy("key").agg(F.min("id").alias("hub")), "hubs")


def held_against_hubs(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The sets of each member of ``groups`` (key, id, n) against their group's hub: rows (hub, id, n, pre, d, unlike).

    ``pre``: the two are linked; ``d``: their distance; ``unlike``: the elements in which they differ, of sets near a hub
    that is one set. A hub with many members has its set copied to as many tasks as they fill.
    """
    reach = NEAR + 1 - percent / 100 + 1e-9
    met = staged(groups.join(hubs_of(groups), "key").where("id <> hub").groupBy("hub", "id").agg(F.max("n").alias("n")), "met")
    load = staged(met.groupBy("hub").agg(F.least(F.count("*"), F.greatest(F.lit(1), F.ceil(F.sum("n") / HELD))).cast("int").alias("tasks")), "load")
    members = met.join(load, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("side"))
    centres = load.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("side"))
    sets = with_sets(docs, members.union(centres), id_col, text_col, k)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, centre, out = None, [], []
        columns = ["hub", "id", "n", "pre", "d", "unlike"]
        for b in batches:
            for doc, e, hub, task, side in zip(b["id"], b["elements"], b["hub"], b["task"], b["side"], strict=True):
                s = np.frombuffer(e, np.uint64)
                if (hub, task) != at:
                    at, centre = (hub, task), []
                if side == 0:
                    centre.append(s)
                    continue
                for c in centre:
                    x = np.sort(np.concatenate([c, s]), kind="stable")
                    once = np.concatenate([[True], x[1:] != x[:-1], [True]])
                    x = x[once[1:] & once[:-1]]
                    both = (len(c) + len(s) - len(x)) // 2
                    union = both + len(x)
                    d = 1 - both / max(1, union)
                    out.append((hub, doc, len(s), 100 * both >= percent * union, d, x.tobytes() if len(centre) == 1 and d <= reach else None))
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    dealt = sets.repartition(F.col("hub"), F.col("task")).sortWithinPartitions("hub", "task", "side").select("id", "elements", "hub", "task", "side")
    return dealt.mapInPandas(compared, "hub long, id long, n long, pre boolean, d double, unlike binary")


def summed(met: DataFrame) -> DataFrame:
    """``met``, by hub and id: rows (hub, id, pre, open, near, far).

    ``pre``: some text of the id is linked to the hub; ``open``: not every one is. ``near`` and ``far`` are of texts that are
    not near the hub: the least distance of one that is not linked to it, and the largest of any.
    """
    away = F.col("unlike").isNull() | (F.col("d") >= NEAR)
    return met.groupBy("hub", "id").agg(F.max("pre").alias("pre"), F.max(~F.col("pre")).alias("open"), F.min(F.when(~F.col("pre") & away, F.col("d"))).alias("near"), F.max(F.when(away, F.col("d"))).alias("far"))


def near_edges(met: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all linked sets near the same hub, from how they differ from it; each two chunks of a hub's sets in a task."""
    near = met.where("unlike is not null")
    limits = near.where("not pre").groupBy("hub").agg((F.min("d") - F.lit(1 - percent / 100 + 1e-9)).alias("least"))
    near = near.join(staged(limits, "limits"), "hub").where("not pre or d >= least").drop("d", "least")
    chunks = F.greatest(F.ceil(F.sum(F.length("unlike")) / (8 * SHARE)), F.ceil(F.count("*") / MET)).cast("int")
    near = near.join(staged(near.groupBy("hub").agg(chunks.alias("chunks"), F.count("*").alias("c")).where("c > 1").drop("c"), "sizes"), "hub")
    rows = near.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "pre", "unlike")

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def settled() -> pd.DataFrame:
            ids, n, pre, unlike = zip(*held, strict=True) if held else [()] * 4
            edges = joined(ids, np.array(n, np.int64), [np.frombuffer(x, np.uint64) for x in unlike], np.array(pre, bool), percent) if len(ids) > 1 else []
            return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

        for b in batches:
            for this, *row in zip(zip(b["hub"], b["i"], b["j"], strict=True), b["id"], b["n"], b["pre"], b["unlike"], strict=True):
                if this != key:
                    yield settled()
                    key, held = this, []
                held.append(row)
        yield settled()

    dealt = rows.repartition(F.col("hub"), F.col("i"), F.col("j")).sortWithinPartitions("hub", "i", "j", "id")
    return dealt.mapInPandas(tasks, "a long, b long")


def still_open(groups: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """What stays of ``groups`` (key, id, n) that is not near its hub: rows (key, id, n, pre) of groups with an open set."""
    apart = 1 - percent / 100 + 1e-9
    hubs = staged(hubs_of(groups).join(held.where("near is not null").select("hub").distinct(), "hub"), "hubs")
    members = staged(groups.join(hubs, "key").join(held.where("far is not null"), ["hub", "id"]).select("key", "id", "n", "pre", "near", "far"), "members")
    limits = staged(members.groupBy("key").agg(F.min("near").alias("least")).where("least is not null"), "limits")
    stay = members.join(limits, "key").where(F.col("far") >= F.col("least") - F.lit(apart))
    return stay.select("key", "id", "n", "pre")


def scanned(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, k: int, percent: int, above: int | None = None) -> DataFrame:
    """Edges of spanning forests of linked sets within ``groups`` (key, id, n, pre, chunks), each two chunks of a group in a task.

    With ``above``, all linked pairs of which a set is larger than that, once each; ``key`` is a block then.
    """
    ends = np.array(size_classes(1 << 40, percent), np.int64)
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    rows = groups.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("id", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "pre")
    sets = with_sets(docs, rows, id_col, text_col, k)

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, own, pre, held = None, [], [], [], []
        edges: list[tuple[int, int]] = []

        def settle() -> None:
            if len(ids) < 2:
                return
            if above is None:
                edges.extend(spanning(ids, held, pre, percent))
                return
            chunk, large = np.array(own), np.array([len(s) > above for s in held])
            marks = [np.sort(np.concatenate(blocks(s, ends, percent))) for s in held]
            block = np.array(key[0], np.int64).astype(np.uint64)
            least_ = lambda i, j: np.intersect1d(marks[i], marks[j], assume_unique=False)[:1] == block
            once = key[1] == key[2]  # two sets of one chunk are paired where it meets itself
            wanted = lambda i, js: (large[js] | large[i]) & (once | (chunk[js] != chunk[i])) & np.array([bool(least_(i, j).all()) for j in js], bool)
            edges.extend(pairs(ids, held, percent, wanted))

        for b in batches:
            for doc, e, this, mine, was in zip(b["id"], b["elements"], zip(b["key"], b["i"], b["j"], strict=True), b["own"], b["pre"], strict=True):
                if this != key:
                    settle()
                    key, ids, own, pre, held = this, [], [], [], []
                ids.append(int(doc))
                own.append(mine)
                pre.append(bool(was))
                held.append(np.frombuffer(e, np.uint64))
            while len(edges) > 100_000:
                yield pd.DataFrame(edges[:100_000], columns=["a", "b"])
                del edges[:100_000]
        settle()
        yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    dealt = sets.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "id")
    return dealt.select("id", "elements", "key", "i", "j", "own", "pre").mapInPandas(tasks, "a long, b long")


def by_prefix(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``groups`` (key, id, n) dealt anew by the elements of prefixes: linked sets share one of the n - ceil(n * percent / 100) + 1 least."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, e, key in zip(b["id"], b["elements"], b["key"], strict=True):
                s = np.sort(mixed(np.frombuffer(e, np.uint64)))
                top = s[: len(s) - -(-percent * len(s) // 100) + 1]
                out += [(x, doc, len(s)) for x in _signed(mixed(top ^ np.array(key, np.int64).astype(np.uint64))).tolist()]
            yield pd.DataFrame(out, columns=["key", "id", "n"])

    return with_sets(docs, groups.select("id", "key"), id_col, text_col, k).mapInPandas(dealt, "key long, id long, n long")


def several(groups: DataFrame) -> DataFrame:
    """``groups`` without groups of one id."""
    return groups.join(staged(groups.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"), "keys"), "key")


def heavy_edges(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Edges that connect all linked sets of candidate groups. ``groups``: key, id, n."""
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(ROUNDS + 1):
        groups = staged(several(groups), "groups")
        if not groups.take(1):
            break
        met = staged(held_against_hubs(docs, groups, id_col, text_col, k, percent), "against")
        held = staged(summed(met), "held")
        edges = edges.union(held.where("pre").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        if not held.where("open").take(1):
            break
        edges = edges.union(near_edges(met, percent))
        left = staged(still_open(groups, held, percent), "open")
        sizes = staged(left.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SHARE)).cast("int").alias("chunks"), F.count("*").alias("c")).where("c > 1").drop("c"), "sizes")
        left = staged(left.join(sizes, "key"), "sized")
        fits = left if turn == ROUNDS else left.where("chunks = 1")
        edges = edges.union(scanned(docs, fits, id_col, text_col, k, percent))
        rest = left.where("chunks > 1").select("key", "id", "n")
        if turn == ROUNDS or not rest.take(1):
            break
        groups = by_prefix(docs, rest, id_col, text_col, k, percent) if turn == 1 and percent >= PERCENT else rest
    return edges


def several_texts(base: DataFrame) -> DataFrame:
    """(id) of the ids that stand for sets that differ."""
    own = base.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return staged(own.where("lo <> hi").select("id"), "double")


def rare_marks(sets: DataFrame, double: DataFrame) -> DataFrame:
    """Rows (key, id, n): the blocks of ``sets`` (id, n, blocks) by which linked ones are sure to meet.

    Linked sets agree on more than ``sure`` blocks of a band, so they meet in one that is not among either's ``sure`` last
    ones in the order of (sets that hold the block, block), blocks without elements last of all. Blocks that one set alone holds come first in that order and
    meet nothing: only sets with more than ``sure`` shared blocks give rows. An id that stands for ``double`` sets gives all.
    """
    slots = sets.select("id", "n", F.explode("blocks").alias("b"))
    each = slots.select(F.explode("b.keys").alias("key"), "id")
    empty = F.shiftright("key", EMPTY).bitwiseAND(F.lit(1)) == 1
    often = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("c", F.when(empty, F.lit(1 << 62)).otherwise(F.col("c")))
    shared = each.join(staged(often, "often"), "key").groupBy("id", F.shiftright("key", BAND).cast("int").alias("band")).agg(F.collect_set(F.struct("c", "key")).alias("found"))
    known = slots.groupBy("id", "b.band").agg(F.max("n").alias("n"), F.min("b.sure").alias("sure"))
    marked = shared.join(known, ["id", "band"]).join(if_small(double.withColumn("all", F.lit(True)), double.count()), "id", "left")
    most = F.size("found") - F.when(F.col("all"), 0).otherwise(F.col("sure"))
    return marked.withColumn("most", most).where("most > 0").select("id", "n", F.explode(F.expr("slice(sort_array(found), 1, most)")).alias("f")).select("f.key", "id", "n")


def by_hub(marks: DataFrame) -> DataFrame:
    """Groups (key, id, n): the sets of all blocks (key, id, n) whose smallest id is ``key``. Sets that share a block share its hub."""
    hubs = staged(marks.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("hi")).where("hub < hi").select("key", "hub"), "hubs")
    return marks.join(hubs, "key").groupBy(F.col("hub").alias("key"), "id").agg(F.max("n").alias("n"))


def prepared(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, hubs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Profiles, classes (digest, class_id, n), ids of several sets, the light sets, the candidate groups (key, id, n) of the heavy ones, by blocks or their hubs, and the boundary."""
    rare = hubs and percent < PERCENT
    base = staged(profiles(docs, id_col, text_col, k, percent, every=rare), "profiles")
    classes = staged(base.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.first("n").alias("n"), F.count("*").alias("rows")), "classes")
    histogram = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * SMALL).groupBy("n").count().collect()}  # at most 2 * SMALL rows
    boundary = boundary_of(cost_of(histogram, percent))
    # only classes of several rows are joined: where they are broadcast, no blocks are shuffled
    repeated = classes.where("rows > 1").select("digest", "class_id")
    one = base.where("n > 0 and id is not null").join(if_small(repeated, repeated.count()), "digest", "left").where("class_id is null or id = class_id")
    small = one.where(F.col("n") <= boundary).select("id", "n", "small")
    heavy = one.where(100 * F.col("n") >= percent * (boundary + 1))
    double = several_texts(base)
    # at 0.9 and above blocks are large and few; below, a set shares some with very many others
    marks = staged(rare_marks(heavy, double), "marks") if rare else heavy.select(F.explode("blocks").alias("key"), "id", "n")
    return base, classes, double, small, staged(by_hub(marks), "meeting") if hubs else marks, boundary


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every linked pair of classes once: rows (a, b), a < b, their ``class_id`` in ``linked``.

    Documents of one class are linked to each other and to all documents of the classes linked to it, so links per
    document are sums over class sizes. An id with several texts stands for each class that it is the smallest id of.
    """
    _, _, _, small, marks, boundary = prepared(docs, id_col, text_col, k, percent, hubs=False)
    groups = staged(several(marks), "groups")
    sizes = staged(groups.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SHARE)).cast("int").alias("chunks")), "sizes")
    heavy = scanned(docs, groups.join(sizes, "key").withColumn("pre", F.lit(False)), id_col, text_col, k, percent, boundary)
    both = light_pairs(small, boundary, percent).union(heavy)
    return both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same set), component_id.

    Words are lower-cased in A-Z only. Null and empty texts have empty sets, link nothing and are their own
    component. Rows that share an id are one node, linked by either text; rows without an id link nothing and have a null
    component. Whole texts are used whatever their length; other columns are ignored; an empty table gives no rows.
    """
    base, classes, double, small, marks, boundary = prepared(docs, id_col, text_col, k, percent)
    slim = base.select("id", "n", "digest")
    edges = light_edges(small, boundary, percent).union(heavy_edges(docs, marks, id_col, text_col, k, percent))

    # an id with several texts is one node: its classes meet in it
    same = slim.where("n > 0 and id is not null").join(classes.select("digest", "class_id"), "digest").where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    edges = edges.union(same.join(double.withColumnRenamed("id", "a"), "a", "left_semi"))

    roots = staged(components(edges), "roots")
    named = classes.select("digest", "class_id").join(if_small(roots.withColumnRenamed("id", "class_id"), roots.count()), "class_id", "left").select("digest", "class_id", F.coalesce("root", "class_id").alias("root"))
    out = slim.join(named, "digest", "left")
    none = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(none, F.col("id")).otherwise(F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all its columns) with one document of each component, the one with the smallest id."""
    found = linked(docs, id_col, text_col, k, percent).where(F.col(id_col).isNotNull())
    drop = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti")
