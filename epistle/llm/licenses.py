"""License scans: ordered signature rules behind a keyword prefilter.

Texts become lower-case words with one blank between them. An automaton of all keywords goes over them once; only stretches around
a keyword are held against the regexes that need it. Detections that lie within another of higher priority (of equal priority:
longer, then of the earlier rule) are suppressed; those that overlap otherwise stay. Documents are scanned where they are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN
from .license_rules import Rule, rules

#: Fixed phrases and their labels; their places stay whatever the rules find.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What a base phrase adds to a score.
BASE_CONFIDENCE = 0.9
#: Characters that a regex may match at most on either side of a keyword (rules repeat nothing without a bound).
SPAN = 800
#: Characters that the automaton reads at a time.
CHUNK = 1 << 22

FOUND = "array<struct<label:string,rule:int,first:long,last:long,priority:int,confidence:double>>"
SCHEMA = f"id long, n_words long, base array<struct<label:string,first:long>>, found {FOUND}"


@cache
def prepared() -> tuple[list[Rule], ahocorasick.Automaton]:
    """The rules, and an automaton that names for each keyword the rules behind it."""
    known, by_word = rules(), {}
    for r in known:
        for word in r.keywords:
            by_word.setdefault(word, []).append(r.number)
    automaton = ahocorasick.Automaton()
    for word, numbers in by_word.items():
        automaton.add_word(word, (len(word), numbers))
    automaton.make_automaton()
    return known, automaton


def plain(text: bytes) -> str:
    """Lower-case words with blanks between and around them, one character a byte; '' without words."""
    words = re.sub(rb" {2,}", b" ", text.translate(PLAIN)).strip(b" ")
    return f" {words.decode('latin-1')} " if words else ""


def stretches(words: str) -> dict[int, list[tuple[int, int]]]:
    """By rule, the stretches of ``words`` around its keywords, joined where they touch."""
    _, automaton = prepared()
    out: dict[int, list[list[int]]] = {}
    at = 0
    while at < len(words) - 1:
        end = words.find(" ", min(at + CHUNK, len(words) - 1))  # the text ends with a blank; no keyword holds one
        for last, (size, numbers) in automaton.iter(words[at:end]):
            lo, hi = max(0, at + last - size - SPAN), min(len(words), at + last + SPAN)
            for number in numbers:
                own = out.setdefault(number, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = hi
                else:
                    own.append([lo, hi])
        at = end
    return {n: [(lo, hi) for lo, hi in own] for n, own in out.items()}


def detected(words: str) -> list[tuple[int, int, Rule]]:
    """(first character, last character, rule) of all matches."""
    known, _ = prepared()
    return [(m.start(), m.end(), known[n]) for n, own in stretches(words).items() for lo, hi in own for m in known[n].pattern.finditer(words, lo, hi + 1)]


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Those that lie within no other that goes before them."""
    starts: list[int] = []  # of kept stretches none of which lies within another; their ends rise with them
    ends: list[int] = []
    kept = []
    for lo, hi, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[2].number, x[0])):
        i = bisect_right(starts, lo)
        if i and ends[i - 1] >= hi:
            continue
        kept.append((lo, hi, rule))
        j = i - 1 if i and starts[i - 1] == lo else i
        k = j
        while k < len(ends) and ends[k] <= hi:
            k += 1
        starts[j:k], ends[j:k] = [lo], [hi]
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


class Places:
    """Word numbers of rising places in a text, counted once."""

    def __init__(self, words: str) -> None:
        self.words, self.at, self.n = words, 0, 0

    def __call__(self, place: int) -> int:
        if place < self.at:
            self.at = self.n = 0
        self.n += self.words.count(" ", self.at, place)
        self.at = place
        return self.n


def base_places(words: str) -> list[tuple[int, str]]:
    """(first word, label) of all places of the base phrases, in order."""
    out = []
    for phrase, label in BASE.items():
        place, at = Places(words), words.find(f" {phrase} ")
        while at >= 0:
            out.append((place(at), label))
            at = words.find(f" {phrase} ", at + 1)
    return sorted(out)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, base (places of the base phrases), found (what the rules found: label, rule, first and last word, priority, confidence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))]
        kinds.append(pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())])))
        for batch in batches:
            counts, bases, founds = [], [], []
            for text in batch.column(1):
                words = plain(text.as_py() or b"")
                place = Places(words)
                found = []
                for lo, hi, rule in unsuppressed(detected(words)):
                    first = place(lo)
                    found.append({"label": rule.label, "rule": rule.number, "first": first, "last": first + words.count(" ", lo + 1, hi), "priority": rule.priority, "confidence": rule.confidence})
                counts.append(max(0, words.count(" ") - 1))
                bases.append([{"label": label, "first": at} for at, label in base_places(words)])
                founds.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((counts, bases, founds), kinds[1:]))], names=["id", "n_words", "base", "found"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, SCHEMA)


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    The score is 1 minus the product, over labels, of 1 minus the highest confidence found for the label: 0 without any. Null and
    empty texts have no words, no labels ('') and score 0; texts are read whole, however long. Repeated rows are scanned alike, ids
    may be null, other columns are ignored, an empty table gives no rows.
    """
    one = detections(docs, id_col, text_col)
    labels = F.concat(F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"]))
    sure = F.concat(
        F.transform("base", lambda x: F.struct(x["label"].alias("label"), F.lit(BASE_CONFIDENCE).alias("c"))),
        F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("c"))),
    )
    best = lambda label: F.array_max(F.transform(F.filter(F.col("sure"), lambda x: x["label"] == label), lambda x: x["c"]))
    rest = F.aggregate(F.array_sort(F.array_distinct(F.col("all"))), F.lit(1.0), lambda left, label: left * (1 - best(label)))
    return one.withColumns({"all": labels, "sure": F.array_distinct(sure)}).select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        joined(F.transform("base", lambda x: x["label"])).alias("base_labels"), joined(F.col("all")).alias("labels"),
        (1 - rest).alias("score"), "found",
    )
