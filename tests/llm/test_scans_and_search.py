"""License scans, whitening and ranked search against plain Python on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import math
import random
import re

import numpy as np
import pytest

from epistle.llm import lexical_search, license_rules, licenses, whitening

SCHEMA = "doc_id long, text string, lang string, source string, base string, found string, row long, doc long, tf long"
MORE = ("en", "s", "b", "f", 1, 2, 3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def license_texts():
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice("the of Apache ein licence cc by public été general with MIT x2 2".split()) for _ in range(n))
    notices = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc sa 3.0", "CC BY NC SA 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later", "All rights reserved.", "tous droits réservés",
        "under the mit license under the MIT  licensee under_the_mit_license", "SPDX-License-Identifier: GPL-2.0-or-later", "Mozilla Public License, v. 2.0", "lapachelle licensed", "BSD 3-Clause License",
    ]
    texts = [None, "", " .,;!? ", "mit", *notices]
    for _ in range(40):
        texts.append(filler(rnd.randint(0, 60)) + " " + rnd.choice(notices) + " " + filler(rnd.randint(0, 9)) + "\n" + rnd.choice(notices) + filler(rnd.randint(0, 900)))
    return [*texts, filler(30000) + notices[2], "x" * 100_000 + " " + notices[0], (notices[5] + " ") * 3000, texts[5]]


def plain_scan(text):
    """Every rule over the whole text, and containment pair by pair."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text))
    line = "".join(f" {w}" for w in words).encode().decode("latin-1") + " " if words else ""
    at = lambda place: line.count(" ", 0, place)
    base = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), r) for r in license_rules.rules() for m in r.pattern.finditer(line)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[2].number, x[0]))
    kept = []
    for f in found:
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept[-4000:]):
            kept.append(f)
    sure = collections.defaultdict(float)
    for label, c in [(x[1], licenses.BASE_CONFIDENCE) for x in base] + [(r.label, r.confidence) for _, _, r in kept]:
        sure[label] = max(sure[label], c)
    places = [i for i, _ in base]
    spans = sorted((at(lo), at(lo) + line.count(" ", lo + 1, hi), r.label) for lo, hi, r in kept)
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(sure)), 1 - math.prod(1 - c for c in sure.values()), spans


def test_rules_hold_their_keywords():
    known = license_rules.rules()
    assert len(known) > 200 and len({r.number for r in known}) == len(known)
    with pytest.raises(ValueError):
        license_rules.rules("90 0.9 x mit mit .* license")


def test_licenses(spark):
    rows = [(i, t, *MORE) for i, t in enumerate(license_texts())] + [(None, "under the MIT license", *MORE)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = licenses.scanned(docs).collect()
    assert len(got) == len(rows)
    by_id = dict(zip([r[0] for r in rows], [r[1] for r in rows]))
    for r in got:
        n, n_base, first, last, base, labels, score, spans = plain_scan(by_id[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n, n_base, first, last, base, labels), by_id[r.doc_id]
        assert r.score == pytest.approx(score) and 0 <= r.score <= 1
        assert sorted((x.first, x.last, x.label) for x in r.found) == spans
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3.0", "all-rights-reserved"} <= {x for r in got for x in r.labels.split(",")}
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_stretches_and_chunks(monkeypatch):
    texts = [t for t in license_texts() if t]
    whole = [licenses.detected(licenses.plain(t.encode())) for t in texts]
    monkeypatch.setattr(licenses, "CHUNK", 50)
    assert [sorted(licenses.detected(licenses.plain(t.encode())), key=str) for t in texts[:30]] == [sorted(x, key=str) for x in whole[:30]]


def test_suppression():
    rnd = random.Random(2)
    known = license_rules.rules()
    for _ in range(300):
        found = [(lo := rnd.randrange(30), lo + rnd.randrange(1, 12), rnd.choice(known)) for _ in range(rnd.randrange(14))]
        kept = []
        for f in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[2].number, x[0])):
            if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
                kept.append(f)
        assert licenses.unsuppressed(found) == sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


VECTORS = "vec_id long, embedding array<float>, component int, n long, whitened double, v int"


def vectors(kind, n=300, d=20, seed=1):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, d)) * (np.r_[np.geomspace(3, 1, 6), np.full(d - 6, 1e-4)] if kind == "steep" else 0.2)
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["flat", "steep"])
def test_whitening(spark, kind):
    x = vectors(kind)
    rows = [(i, v.tolist(), 1, 2, 3.0, 4) for i, v in enumerate(x)]
    bad = [(900, None, 1, 2, 3.0, 4), (901, [None] * 20, 1, 2, 3.0, 4), (902, [float("nan")] * 20, 1, 2, 3.0, 4), (903, [float("inf")] + [0.0] * 19, 1, 2, 3.0, 4), (904, [], 1, 2, 3.0, 4), (905, [1.0] * 7, 1, 2, 3.0, 4)]
    twice = [rows[3], rows[3], (None, rows[4][1], 1, 2, 3.0, 4)]
    got = whitening.whitened(spark.createDataFrame(rows + bad + twice, VECTORS).repartition(3)).collect()
    fit = np.floor(1024 * np.vstack([x, x[3], x[3], x[4]]).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.vec_id for r in got} == {*range(300), None}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    sign = {}
    for r in got:
        i = 4 if r.vec_id is None else r.vec_id
        k = r.component - 1
        assert r.deviation == int(((n * fit[i] - sums) ** 2).sum()) and r.explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
        want = c[i] @ v[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-3:
            assert sign.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6)


def test_range_finder(spark):
    """A covariance of low rank needs no widening, a flat one does, and both agree with the plain eigenvectors."""
    for low in (True, False):
        x = np.round(vectors("flat", d=64) * 64)
        if low:
            x = np.round(vectors("flat", d=5, seed=2) * np.array([90, 70, 50, 40, 30])) @ np.round(4 * np.random.default_rng(1).standard_normal((5, 64)))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
        n, sums = whitening._sums(df, 64)
        e, v, trace, widened = whitening.components(df, 64, n, sums)
        z = np.floor(1024 * x) + 100_000
        cov = np.cov(z.T, bias=True)
        want = np.linalg.eigvalsh(cov)[::-1]
        assert widened is not low
        assert np.allclose(e[:5], want[:5], rtol=1e-9) and trace == pytest.approx(np.trace(cov)) and np.allclose(cov @ v[:, :5], v[:, :5] * e[:5], atol=1e-8 * e[0])


def test_whitening_edges(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(i, v, 1, 2, 3.0, 4) for i, v in rows], VECTORS))
    assert make([]).count() == 0 and make([(1, None), (2, [])]).count() == 0
    assert make([(i, [0.5, 0.25]) for i in range(5)]).count() == 0  # no variance
    two = make([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])]).collect()
    assert {r.component for r in two} == {1} and len(two) == 3
    huge = make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]).collect()
    assert any(r.deviation is None for r in huge)


def search_rows():
    rnd = random.Random(4)
    vocab = [a + b for a in ("re", "ta", "É", "ni", "mo", "x9") for b in ("", "n", "s", "ka", "ß", "7")]
    weights = [1 / (1 + i) for i in range(len(vocab))]
    text = lambda n: " ".join(rnd.choices(vocab, weights, k=n))
    docs = [None, "", " ... ", "re", "RE re-ta", *[text(rnd.randint(1, 80)) for _ in range(300)], text(20000), "x" * 70_000 + " re"]
    docs += [docs[20]] * 15  # ties
    rows = [(i, t, *MORE) for i, t in enumerate(docs)] + [(30, docs[30], *MORE), (None, docs[31], *MORE)]
    items = [(i, text(rnd.randint(1, 30)), *MORE) for i in range(25)] + [(30, docs[20], *MORE), (31, None, *MORE), (32, "", *MORE), (33, "nothing like it", *MORE), (34, "re", *MORE), (34, "re", *MORE), (None, "x9ß ta", *MORE)]
    return rows, items


def plain_ranked(rows, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(i, collections.Counter(term.findall(lower(t)))) for i, t, *_ in rows]
    found = [(i, c) for i, c in found if c]
    n_docs, n_words = len(found), sum(c.total() for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for q, text, *_ in items:
        scores = []
        for at, (i, c) in enumerate(found):
            m = 100 - 90 + (90 * c.total() * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(term.findall(lower(text))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranked(spark, monkeypatch, k):
    rows, items = search_rows()
    if k == 3:  # terms of the items are not handed to the tasks, and nothing is broadcast
        monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lexical_search, "CHUNK", 7)
        monkeypatch.setattr(lexical_search, "if_small", lambda df, rows: df)
    docs, asked = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, SCHEMA).withColumnRenamed("doc_id", "item_id")
    got = [tuple(r) for r in lexical_search.ranked(docs, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(got, key=key) == sorted(plain_ranked(rows, items, k), key=key)


def test_ranked_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows, items = search_rows()
    some, asked = spark.createDataFrame(rows[:9], SCHEMA), spark.createDataFrame(items[:3], SCHEMA).withColumnRenamed("doc_id", "item_id")
    assert lexical_search.ranked(none, asked).count() == 0
    assert lexical_search.ranked(some, none.withColumnRenamed("doc_id", "item_id")).count() == 0
