"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import datetime
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epistle.llm import chat_format, exact_dedup, jaccard_join, mixing, packing, pseudonyms, quality_rules, substring_dedup, suffix_dedup, toxicity
from epistle.llm.common import components, staged
from epistle.operators import graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, size long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed: int = 5) -> list[str | None]:
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("re", "ta", "mo", "É", "ni", "lu") for b in ("n", "s", "", "ka", "ß")]
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, line = sentence(60), "all rights reserved by the owner of this page and its friends"
    texts: list[str | None] = [None, "", " \t\n ", "one", "one two", "One two", "one two three", "a\x0bb\x0cc\rd", "\x1c\x85  odd   blanks", "<|endoftext|> text"]
    for _ in range(12):
        base = sentence(rnd.randint(12, 150))
        w = base.split()
        w[len(w) // 2] = "changed"
        texts += [base, base, base.upper(), base.replace(" ", "\n"), " ".join(w), sentence(9) + " " + passage + "\n" + line + "\n" + line + "\n" + sentence(20)]
    texts += [sentence(4000), "x" * 5000, "ab " * 900, "word " * 3000 + passage]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, 3) for i, t in enumerate(some_texts())]
    return [*out, out[12], out[12], out[0]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got} and all(find(x) == x for x in root if x not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(docs, rows, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append((-len(r[1] or ""), r[0]))
    want = sorted((r[0], min(groups[norm(r[1])])[1], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    got = exact_dedup.decisions(docs).withColumn("h", F.lower(F.hex("digest"))).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.h) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns and sorted(norm(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.decisions(none).count() == exact_dedup.keep_one(none).count() == 0


def test_exact_dedup_without_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "ab"), (3, "ab"), (None, None)], "doc_id long, text string")
    got = exact_dedup.decisions(df).collect()
    assert sum(r.kept for r in got) == 2 and exact_dedup.keep_one(df).count() == 2


def plain_quality(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(docs, rows, none):
    got = quality_rules.verdicts(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((r[0], *plain_quality(r[1])) for r in rows)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in got)
    assert quality_rules.verdicts(none).count() == quality_rules.keep_good(none).count() == 0


def test_quality_line_frequency(spark):
    rnd = random.Random(2)
    fresh = lambda: " ".join(str(rnd.random()) for _ in range(12))
    note = "this  Line is the same on every page of the host and says nothing"
    pages = [(i, f"{fresh()}\n{note}", "h") for i in range(60)] + [(100, note, "h"), (101, f"{note}\n{note.upper()}", "h"), (102, note, "other")]
    copies = [(200 + i, "ten words of a good page that many people have copied from", "h") for i in range(50)]
    got = {r.doc_id: r for r in quality_rules.verdicts(spark.createDataFrame(pages + copies, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in got.items() if not r.kept} == {100, 101}
    assert got[101].n_line_words == 28 and not got[100].base_failed


def test_quality_removes_common_lines(spark):
    rnd = random.Random(3)
    fresh = lambda: " ".join(str(rnd.random()) for _ in range(12))
    note = "this  Line is on ÉVERY page"
    own = {i: (fresh(), fresh()) for i in range(60)}
    pages = [(i, f"{a}\n \n{note.upper() if i % 2 else note}\t\n{b}\n", "h", 7) for i, (a, b) in own.items()]
    pages += [(100, note, "h", 7), (101, f"{fresh()}\n{note}", None, 7), (None, pages[0][1], "h", 7), (0, pages[0][1], "h", 7)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string, n_chars long")
    got = quality_rules.keep_good(df).collect()
    want = [(i, f"{a}\n \n{b}\n") for i, (a, b) in [*own.items(), (None, own[0]), (0, own[0])]]
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got) == sorted([(str(i), t, len(t)) for i, t in want] + [("101", pages[61][1], 7)])


def test_mixing(docs, rows, none, spark):
    got = mixing.mixture(docs).collect()
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size, mine = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, capped, total = {}, set(), sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        mine[r.source].append(r)
    for s, own in mine.items():
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own) / 2 + 1e-6
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixture(none).count() == mixing.mixed(none).count() == 0
    odd = spark.createDataFrame([(None, None, None), (None, "a b", None), (1, "", "x")], "doc_id long, text string, source string")
    assert sorted((r.size, r.taken) for r in mixing.mixture(odd).collect()) == [(0, 0), (0, 0), (2, 2)]


def test_mixing_is_unbiased_and_bounded(spark):
    many = spark.range(4000).selectExpr("id doc_id", "repeat('w ', 1 + cast(id % 9 as int)) text", "if(id % 5 = 0, 'a', 'b') source")
    got = mixing.mixture(many, seed=3).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.avg("copies").alias("c"), (F.first("target") / F.first("source_size")).alias("r")).collect()
    assert all(abs(r.t - r.g) <= 5 and r.c == pytest.approx(r.r, abs=0.05) for r in got)


def test_mixing_ends_on_a_short_document(spark):
    """Where a source has a few very long documents, its words still come near the target."""
    rnd = random.Random(4)
    sizes = [(i, 3000 if i % 40 == 0 else 20 + rnd.randrange(60), "abcd"[i % 4]) for i in range(4000)]
    many = spark.createDataFrame(sizes, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) text", "source")
    got = mixing.mixture(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(got) == 4 and all(abs(r.t - r.g) <= 100 for r in got)


def test_mixing_targets_over_many_sources(spark):
    sizes = [(f"s{i:04d}", (i * 37) % 500) for i in range(700)] + [(None, 90)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: (1, 2, 3)[k % 3] for k, (s, _) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0])))}
    size, capped = dict(sizes), set()
    while True:
        rest, free = sum(size.values()) - sum(3 * size[s] for s in capped), [s for s in size if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert all(got[s].target == pytest.approx(3 * size[s] if s in capped else share[s]) and got[s].weight == weight[s] for s in size)


def plain_substring(pairs, n=13):
    first = {}
    for i, t in pairs:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in pairs:
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, rows, none, batches):
    got = substring_dedup.deduplicated(docs, batches=batches).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_substring([r[:2] for r in rows])
    if batches == 3:
        assert substring_dedup.deduplicated(none).count() == 0


def test_substring_index_is_opened_again_and_compacts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    substring_dedup.SubstringIndex.create(spark, path)
    text = " ".join(f"w{i}" for i in range(40))
    for k in range(5):
        monkeypatch.setattr(substring_dedup, "SHARE_CHARS", 1 << (12 - 2 * k))  # ranges halve, older runs are cut
        index = substring_dedup.SubstringIndex.open(spark, path)
        own = " ".join(f"own{k}x{i}" for i in range(30))
        sure, _ = index.add(spark.createDataFrame([(k, f"{text} {own}"), (None, text)], "id long, text string"))
        assert {r.id for r in sure.collect()} == ({k} if k else set())
    again = substring_dedup.SubstringIndex.open(spark, path)
    assert [r[0] for r in sorted(again.runs)] == [0, 2] and again.version == 6


def test_merged_runs_are_sorted():
    rnd = np.random.default_rng(3)
    runs = []
    for n in (0, 1, 7, 40, 3):
        p, s, ids = rnd.integers(0, 5, n).astype(np.uint64) << np.uint64(40), rnd.integers(0, 300, n).astype(np.uint64), rnd.integers(-9, 9, n)
        order = np.lexsort((ids, s, p))
        runs.append((p[order], s[order], ids[order], np.arange(n, dtype=np.int32), np.full(n, n == 7)))
    got = substring_dedup.merged_runs(runs)
    want = sorted(zip(*(np.concatenate(x).tolist() for x in list(zip(*runs))[:3])))
    assert list(zip(*(x.tolist() for x in got[:3]))) == want and got[4].sum() == 7


def plain_suffix(pairs, n):
    c = collections.Counter(t[k : k + n] for _, t in pairs for k in range(len(t) - n + 1))
    out = []
    for i, t in pairs:
        gone = {k + j for k in range(len(t) - n + 1) if c[t[k : k + n]] > 1 for j in range(n)}
        kept = bytes(x for k, x in enumerate(t) if k not in gone)
        out.append((i, len(t), len(gone), sum(k in gone and k - 1 not in gone for k in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_suffix_dedup(docs, rows, none, hot):
    want = plain_suffix([(r[0], (r[1] or "").encode()) for r in rows], 120)
    got = suffix_dedup.deduplicated(docs, window=120, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    if hot > 3:
        assert suffix_dedup.deduplicated(none).count() == 0


def test_suffix_dedup_at_its_own_window(spark):
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    shared, just, short = prose(120), "".join(rnd.choice("xyz") for _ in range(400)), "".join(rnd.choice("uvw") for _ in range(399))
    texts = [prose(80) + shared + prose(60), prose(3) + shared, prose(200), "q" * 900, just + prose(50), prose(50) + just, short + prose(9), prose(9) + short]
    pairs = [*enumerate(texts), (100, texts[2]), (None, shared), (None, shared)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = plain_suffix([(-1 if i is None else i, t.encode()) for i, t in pairs], 400)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (6, 7)} == {6: 0, 7: 0} and sorted(map(key, got))


def test_equal_rows_without_id_are_dealt(spark):
    """100,000 equal rows without an id: no task numbers more than MANY, every copy is counted once and the mix holds."""
    many = spark.range(0, 100_000, 1, 8).selectExpr("cast(null as long) as doc_id", "'same few words here' as text", "'s1' as source", "id as extra")
    some = spark.range(0, 300, 1, 2).selectExpr("id as doc_id", "concat('text of words ', repeat('w ', cast(id % 50 as int))) as text", "concat('s', id % 3) as source", "id as extra")
    both = many.union(some)
    keys = ["doc_id", "source", "text"]
    out = mixing.numbered(both, keys, "n")
    assert out.groupBy(*keys).agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("c <> d or lo <> 1 or hi <> c").count() == 0
    assert out.count() == both.count() and out.columns == [*both.columns, "n"]
    kept = mixing.mixed(both)
    taken = mixing.mixture(both).groupBy("source").agg(F.sum("copies").alias("c")).collect()
    assert {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()} == {r["source"]: r["c"] for r in taken}
    assert exact_dedup.keep_one(both).where("doc_id is null").count() == 1


def test_pieces_are_read_once(spark, monkeypatch):
    """Many ranges of parts: each has its own folder, which alone its branch of the plan reads."""
    docs = spark.range(0, 200, 1, 40).selectExpr("id as doc_id", "repeat('some words ', cast(id % 30 as int)) as text")
    whole = sorted(map(tuple, packing.packed(docs, TOKENIZER).select("doc_id", "piece", "length", "ids_crc32").collect()))
    monkeypatch.setattr(packing, "BROADCAST_ROWS", packing.CAPACITY * 3)
    few = packing.packed(docs, TOKENIZER)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(parts") >= 14
    rows = few.collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == whole
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def peak_mb(spark):
    """The most memory that any Python worker has held so far."""

    def own(batches):
        import resource

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    return spark.range(0, 64, 1, 16).mapInPandas(own, "mb double").agg(F.max("mb")).first()[0]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_of_short_periods(spark, monkeypatch, hot):
    texts = ["-" * 700, "-" * 160 + "a", "abcdefg" * 90, "x" + "abcdefg" * 40 + "y", "ab" * 61, "q" * 120, "q" * 119 + "r", "q" * 119 + "s", "01234" * 24, "01234" * 24 + "0", "z" * 121]
    pairs = [*enumerate(texts), (50, texts[2][3:]), (51, texts[4] + texts[0])]
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    monkeypatch.setattr(suffix_dedup, "HELD", 500)
    monkeypatch.setattr(suffix_dedup, "LISTED", 3)
    got = suffix_dedup.deduplicated(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3), window=120, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_suffix([(i, t.encode()) for i, t in pairs], 120)


def test_suffix_dedup_of_long_texts_of_short_period(spark):
    texts = ["-" * 10_000_000, "abcdefg" * 1_400_000 + "end", "0" * 5_000_000 + "1" * 399]
    got = suffix_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("kept").collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got} == {0: (10_000_000, 1), 1: (9_800_000, 1), 2: (5_000_000, 1)}
    assert peak_mb(spark) < 1000


def test_suffix_marks_come_through_the_merge(docs, monkeypatch):
    empty = lambda docs, open_, *a: docs.sparkSession.createDataFrame([], suffix_dedup.RANGES)
    monkeypatch.setattr(suffix_dedup, "suffix_ranges", empty)
    assert suffix_dedup.deduplicated(docs, window=120).agg(F.sum("n_removed")).first()[0] == 0


def test_suffix_groups_by_classes_equal_pairs(monkeypatch):
    rnd = random.Random(4)
    gram = bytes(rnd.randrange(97, 123) for _ in range(32))
    tails = [gram + bytes(rnd.choice(b"ab") for _ in range(70)) for _ in range(3)]
    heads_ = [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(4)]
    items = sorted((rnd.choice(tails)[: rnd.randint(85, 102)], rnd.choice(heads_)[-rnd.randint(20, 60) :]) for _ in range(9))
    shared = [suffix_dedup.shared_prefix(items[i - 1][0], items[i][0]) if i else 0 for i in range(9)]
    args = (shared, [l for _, l in items], [max(0, 100 - len(s)) for s, _ in items], [len(l) for _, l in items], 100, 32)
    flat = lambda out: [sorted({o for a, b in x for o in range(a, b + 1)}) for x in out]
    by_pairs = flat(suffix_dedup.equal_windows(*args))
    monkeypatch.setattr(suffix_dedup, "PAIRS", 0)
    assert flat(suffix_dedup.equal_windows(*args)) == by_pairs and any(by_pairs)


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(3)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 20))) for _ in range(k)]
        out = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in runs]))
        flat = [x[3] for x in out]
        assert flat == sorted(x for r in runs for x in r) and all(runs[r][i] == s for _, r, i, s in out)
        assert all(out[i][0] == suffix_dedup.shared_prefix(flat[i - 1], flat[i]) for i in range(1, len(out)))


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def plain_links(pairs):
    sets = {i: shingle_set(t) for i, t in pairs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i, _ in pairs)


def near_copies(seed=9):
    rnd = random.Random(seed)
    out = []
    for n in (11, 12, 14, 20, 21, 25, 33, 60, 120, 300):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, n // 40))):
                w[rnd.choice((0, -1, rnd.randrange(len(w))))] = f"v{rnd.randrange(10**6)}"
            out.append(" ".join(w[rnd.randint(0, 1) :] + [f"t{rnd.randrange(50)}"] * rnd.randint(0, 1)))
    return out


@pytest.mark.parametrize("share", [2_000_000, 700])
def test_jaccard_join(spark, docs, rows, none, share, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHARE", share)
    near = list(enumerate(near_copies(), 1000))
    pairs = [r[:2] for r in rows] + near
    df = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = jaccard_join.linked(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_links(pairs)
    if share > 700:
        assert jaccard_join.linked(none).count() == 0
        left = jaccard_join.keep_one(docs)
        assert left.columns == docs.columns


@pytest.mark.parametrize("boundary", [0, 9, 18, 28])
def test_light_and_heavy_agree(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: boundary)
    near = [(i, t) for i, t in enumerate(near_copies(3)) if len(t.split()) < 70]
    got = jaccard_join.linked(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_links(near)


@pytest.mark.parametrize("rounds", [0, 4])
def test_jaccard_groups_too_large_for_a_task(spark, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: 0)
    monkeypatch.setattr(jaccard_join, "SHARE", 150)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    near = list(enumerate(t for t in near_copies(12) if len(t.split()) > 13))
    got = jaccard_join.linked(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_links(near)


def test_jaccard_sets_of_one_hub_meet_once(spark, monkeypatch):
    """Sets that share many blocks with a hub and are not linked to it have their elements sent once for a hub and not for each block."""
    monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: 0)
    base = [f"b{j}" for j in range(400)]
    near = [(i, " ".join(w if j % 20 or not i else f"x{i}y{j}" for j, w in enumerate(base))) for i in range(12)]
    counted, with_sets = [], jaccard_join.with_sets

    def counting(docs, rows, *a):
        counted.append(rows.count())
        return with_sets(docs, rows, *a)

    monkeypatch.setattr(jaccard_join, "with_sets", counting)
    got = jaccard_join.linked(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_links(near)
    assert len(counted) == 2 and max(counted) < len(near) ** 2 / 2


def test_jaccard_large_group_near_its_hub_is_not_dealt_anew(spark, monkeypatch):
    """Edited copies that are more than a task takes, most of them not linked to their hub: elements are sent to the hub alone, however large the group."""
    monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: 0)
    monkeypatch.setattr(jaccard_join, "SHARE", 1500)
    rnd = random.Random(11)
    base = [f"b{j}" for j in range(300)]
    near = [(0, " ".join(base))]
    for i in range(40):
        w = [x if rnd.random() > (0.02, 0.05)[i % 2] else f"x{rnd.randrange(10**6)}" for x in base]
        near += [(3 * i + 1, " ".join(w)), (3 * i + 2, " ".join([*w[:150], "y", *w[150:]])), (3 * i + 3, " ".join(w[:-2]))]
    counted, with_sets = [], jaccard_join.with_sets

    def counting(docs, rows, *a):
        counted.append(rows)
        return with_sets(docs, rows, *a)

    monkeypatch.setattr(jaccard_join, "with_sets", counting)
    want = plain_links(near)
    assert 10 < len({c for _, _, c in want}) < len(near)
    got = jaccard_join.linked(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len(counted) == 2 and counted[1].count() == 0


@pytest.mark.parametrize("percent", [45, 80, 90])
def test_joined_by_what_sets_differ_in(percent):
    """The components are those of all pairs, whatever set the differences are from."""
    rnd = random.Random(percent)
    base = set(range(1, 200))
    sets = [frozenset(base)]
    for _ in range(150):
        s = set(rnd.choice(sets))
        s -= set(rnd.sample(sorted(s), rnd.randint(0, 14)))
        sets.append(frozenset(s | {rnd.randrange(1, 10**6) for _ in range(rnd.randint(0, 14))}))
    for centre in (base, set(range(100, 400)), set()):
        pre = np.array([100 * len(s & centre) >= percent * len(s | centre) for s in sets])
        unlike = [np.array(sorted(s ^ centre), np.uint64) for s in sets]
        edges = jaccard_join.joined(list(range(len(sets))), np.array([len(s) for s in sets]), unlike, pre, percent)
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        assert set(map(frozenset, edges)) <= set(map(frozenset, linked))
        known = [(int(i), int(np.flatnonzero(pre)[0])) for i in np.flatnonzero(pre)]

        def parts(pairs):
            root = list(range(len(sets)))
            for _ in sets:
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert parts(edges + known) == parts(linked + known)


def test_jaccard_bitmap_of_ids(spark):
    """No id that is looked for is lost, negative and very large ones included, and most others' texts are left out before the join."""
    wanted = [-5, 0, 7, 2**62, *range(100_000, 105_000)]
    docs = spark.createDataFrame([(i, "t") for i in [*wanted, *range(200_000, 220_000)]] + [(None, "t")], "id long, text string")
    left = jaccard_join.perhaps_among(docs, spark.createDataFrame([(i,) for i in wanted], "id long"), len(wanted))
    ids = [r.id for r in left.collect()]
    assert left.columns == ["id", "text"] and set(wanted) <= set(ids) and len(ids) - len(wanted) < 2_000


def test_jaccard_block_of_many_sets(spark, monkeypatch):
    """One block that 10,000 unlinked sets agree on costs rows in proportion to them."""
    monkeypatch.setattr(jaccard_join, "SHARE", 20_000)
    rows = [(i, 40, 7) for i in range(10_000)]
    groups = spark.createDataFrame(rows, "id long, n long, key long").repartition(4)
    docs = spark.createDataFrame([(i, " ".join(["same"] * 3 + [f"w{i}x{j}" for j in range(20)])) for i in range(10_000)], "doc_id long, text string").repartition(4)
    counted = []
    with_sets = jaccard_join.with_sets

    def counting(docs, rows, *a):
        counted.append(rows.count())
        return with_sets(docs, rows, *a)

    monkeypatch.setattr(jaccard_join, "with_sets", counting)
    edges = jaccard_join.heavy_edges(docs, groups, "doc_id", "text", 3, 90)
    assert edges.count() == 0 and sum(counted) < 6 * 10_000


@pytest.mark.parametrize("percent", [45, 80, 90])
def test_spanning_forest_of_a_group(percent):
    rnd = random.Random(percent)
    for _ in range(60):
        base = [rnd.sample(range(400), rnd.randint(8, 40)) for _ in range(rnd.randint(1, 4))]
        sets = []
        for _ in range(rnd.randint(2, 25)):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                s.discard(rnd.choice(sorted(s)))
                s.add(rnd.randrange(400))
            sets.append(np.array(sorted(s), np.uint64))
        n = len(sets)
        hits = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]

        def parts(edges):
            root = list(range(n))
            for _ in range(n):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        got = jaccard_join.spanning(list(range(n)), sets, [False] * n, percent)
        assert parts(got) == parts(hits) and len(got) == n - len(set(parts(hits)))
        if percent > 50:
            every = jaccard_join.pairs(list(range(n)), sets, percent, lambda i, js: np.ones(len(js), bool))
            assert sorted(every) == sorted(hits)


def plain_pairs(pairs, sets_of, percent):
    first = {}
    for i, t in sorted(pairs):
        if s := sets_of(t):
            first.setdefault(s, i)
    sets = [(i, s) for s, i in first.items()]
    return sorted((i, j) for i, s in sets for j, u in sets if i < j and 100 * len(s & u) >= percent * len(s | u))


@pytest.mark.parametrize(("boundary", "share"), [(0, 700), (24, 700), (24, 2_000_000)])
def test_jaccard_links_are_all_pairs(spark, boundary, share, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: boundary)
    monkeypatch.setattr(jaccard_join, "SHARE", share)
    monkeypatch.setattr(jaccard_join, "PAIRED", 2)
    base = [f"c{i}" for i in range(22)]
    near = near_copies(4)[:80] + [" ".join([*base, f"end{i}"]) for i in range(7)]  # all seven are linked to each other
    near = list(enumerate([*near, *near[:5], "", None]))
    got = jaccard_join.links(spark.createDataFrame(near, "doc_id long, text string").repartition(3)).collect()
    want = plain_pairs(near, shingle_set, 90)
    assert sorted((r.a, r.b) for r in got) == want and sum(80 <= a < b < 87 for a, b in want) == 21


def five_words(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("boundary", [0, 12, None])
def test_jaccard_at_lower_similarity(spark, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: boundary)
    rnd, texts = random.Random(11), near_copies(6)
    for n in (30, 60, 90, 200, 300, 500):  # one-word edits about the threshold
        base = [f"u{rnd.randrange(10**6)}" for _ in range(n)]
        for _ in range(10):
            w = list(base)
            for at in rnd.sample(range(n), n // 50 + rnd.randint(0, 1)):
                w[at] = f"u{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    near = list(enumerate(texts))
    want = plain_pairs(near, five_words, 80)
    got = jaccard_join.links(spark.createDataFrame(near, "doc_id long, text string"), k=5, percent=80).collect()
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 100


@pytest.mark.parametrize("boundary", [0, 12, None])
def test_jaccard_components_at_lower_similarity(spark, boundary, monkeypatch):
    """Clusters about the threshold, sets that are mostly a passage of all of them, and ids that stand for several texts."""
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "boundary_of", lambda _: boundary)
    rnd, texts = random.Random(17), near_copies(8)
    passage = [f"p{i}" for i in range(60)]
    for n in (12, 25, 60, 150, 400):
        base = [f"u{rnd.randrange(10**6)}" for _ in range(n)] + passage[: rnd.choice((0, 30, 60))]
        for _ in range(12):
            w = list(base)
            for at in rnd.sample(range(len(w)), len(w) // 45 + rnd.randint(0, 1)):
                w[at] = f"u{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [" ".join(passage + [f"e{i}x{j}" for j in range(rnd.randint(1, 20))]) for i in range(40)]
    ids = list(range(len(texts)))
    near = list(zip(ids, texts, strict=True)) + [(3, texts[-1]), (7, texts[20]), (7, texts[7]), (len(ids), ""), (len(ids) + 1, None)]
    got = jaccard_join.linked(spark.createDataFrame(near, "doc_id long, text string").repartition(3), k=5, percent=80).collect()
    root = {i: i for i, _ in near}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, five_words(t)) for i, t in near]
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_passage_of_many_sets_at_lower_similarity(spark, monkeypatch):
    """A passage that 4,000 unlike sets hold makes groups of few of them, and a cluster among them a few rows for each member."""
    passage = " ".join(f"p{i}" for i in range(40))
    unlike = [(i, f"{' '.join(f'w{i}x{j}' for j in range(40))} {passage} {' '.join(f'v{i}x{j}' for j in range(20))}") for i in range(4000)]
    base = [f"c{j}" for j in range(200)]
    cluster = [(5000 + i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) + " " + passage) for i in range(100)]
    docs = spark.createDataFrame(unlike + cluster, "doc_id long, text string").repartition(4)
    marks = jaccard_join.prepared(docs, "doc_id", "text", 5, 80)[4].collect()
    assert len({r.id for r in marks if r.id < 4000}) < 80 and {r.id for r in marks if r.id >= 5000} == {i for i, _ in cluster}
    assert sum(r.id >= 5000 for r in marks) < 10 * len(cluster)
    got = jaccard_join.linked(docs, k=5, percent=80).where("doc_id <> component_id").collect()
    assert len(got) == 99 and {r.component_id for r in got} == {5000}


def test_jaccard_blocks_named_at_lower_similarity(spark):
    """Few keys for each shingle, none of blocks without elements where these may be left out, and more shared ones than a set may leave out."""
    rnd, texts = random.Random(5), []
    for n in (40, 70, 110, 160, 230, 320, 450, 640, 900):
        words = [f"u{rnd.randrange(10**6)}" for _ in range(n)]
        for edits in (0, n // 60, n // 50):
            w = list(words)
            for at in rnd.sample(range(n), edits):
                w[at] = f"u{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
        texts.append(" ".join(words[: n * 5 // 6]))
    near = list(enumerate(texts))
    rows = jaccard_join.profiles(spark.createDataFrame(near, "doc_id long, text string"), "doc_id", "text", 5, 80, every=True).collect()
    assert sum(len(b["keys"]) for r in rows for b in r.blocks) < 0.68 * sum(r.n for r in rows)
    assert not any(k >> jaccard_join.EMPTY & 1 for r in rows for b in r.blocks for k in b["keys"])
    own = {r.id: {b.band: b for b in r.blocks} for r in rows}
    linked = plain_pairs(near, five_words, 80)
    assert len(linked) > 20
    for i, j in linked:
        both = [(x, own[j][band]) for band, x in own[i].items() if band in own[j]]
        assert any(len(set(x["keys"]) & set(y["keys"])) > max(x.sure, y.sure) for x, y in both) or set(five_words(texts[i])) == set(five_words(texts[j]))


def test_jaccard_empty_blocks_stay_where_few_may_be_left_out():
    """A set whose empty blocks are more than it may leave out names all of them, last in the order."""
    marks = np.array([5, 3, 9, 1 << jaccard_join.EMPTY | 4, 1 << jaccard_join.EMPTY | 2], np.uint64)
    signed = marks.view(np.int64)
    assert jaccard_join.counted(signed, 0, 3)["keys"].tolist() == sorted(signed.tolist()) and jaccard_join.counted(signed, 0, 3)["sure"] == 1
    some = jaccard_join.counted(signed, 0, 2)
    assert some["keys"].tolist() == [3, 5, 9] and some["sure"] == 0


def test_staged_tables_leave_no_shuffle_files(spark):
    """What is staged is read from the shared folder alone: the files of its shuffles go with the query that wrote it."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    table = staged(spark.range(200_000).selectExpr("id % 50000 k").groupBy("k").count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 50_000 and spark.conf.get(graph.CLEANUP, "false") == "false"


def test_pipeline_drops_copies_with_scattered_edits(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(300)]
    edited = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(base)]  # 0.82 on five words, 0.89 on three
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[::-1]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()) == [1, 3]


def test_packing(docs, rows, none):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = collections.defaultdict(list)
    for r in rows:
        want[r[0]].append([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2])
    got = packing.packed(docs, TOKENIZER).collect()
    for doc, own in want.items():
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        ids = own[0]
        assert sum(r.length for r in pieces) == len(ids) * len(own)
        for r in pieces:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.length == 1024 or r.piece == 0
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = sorted((r.length for r in got), reverse=True)
    left = []
    for n in lengths:
        fit = min((x for x in left if x >= n), default=None)
        if fit is not None:
            left.remove(fit)
        left.append((1024 if fit is None else fit) - n)
    assert len(bins) == len(left)
    assert packing.packed(none, TOKENIZER).count() == 0


def test_packing_keeps_ids(docs, rows, none, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 1024)  # a join for each part
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    placed = packing.packed(docs, TOKENIZER)
    ids = lambda x: np.frombuffer(bytes(x), "<u4").tolist()
    texts = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = placed.collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert all(ids(r.ids) == texts[r.doc_id][r.start : r.start + r.length] for r in got)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert set(whole) == {r.sequence_id for r in got} and sum(r.length for r in whole.values()) == sum(len(texts[r[0]]) for r in rows)
    for r in got:
        assert ids(whole[r.sequence_id].ids)[r.offset : r.offset + r.length] == ids(r.ids)
    assert packing.sequences(packing.packed(none, TOKENIZER)).count() == 0


def test_best_fit_equals_one_by_one():
    rnd = random.Random(6)
    for _ in range(60):
        lengths = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(0, 80))), reverse=True)
        runs = packing.best_fit(collections.Counter(lengths), 30)
        left = []
        for n in lengths:
            fit = min((x for x in left if x >= n), default=None)
            if fit is not None:
                left.remove(fit)
            left.append((30 if fit is None else fit) - n)
        bins = collections.defaultdict(list)
        for n, c in collections.Counter(lengths).items():
            own = sorted(r for r in runs if r[0] == n)
            for rank in range(c):
                _, lo, first, per, offset = [r for r in own if r[1] <= rank][-1]
                bins[first + (rank - lo) // per].append((offset + (rank - lo) % per * n, n))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 30
        assert len(bins) == len(left)


def test_encoder_equals_tokenizer(rows):
    tok, encode = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    tok.encode_special_tokens = True
    for t in [r[1] or "" for r in rows] + ["it's  we'll\n\n x", "  ", " \n a", "１２ ½ ª", "\U0001f600 á ẞ", "<|endoftext|>"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi \\ </turn> ### there"), (2, 0, "user", "hello"), (2, 1, "assistant", "other\\"), (2, 2, "user", None),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi \\ </turn> ### there"), (4, 5, "sys\ntem", ""), (4, None, "assistant", "née   \U0001f600"),
    (5, 0, None, "x" * 30000), (5, 1, "assistant", "\\### Assistant: </turn> ok"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "assistant", "no id"), (None, 1, "user", "nor this"),
]


def test_chat_format(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in CHATS], "conv_id long, turn long, role string, text string, i long, path long").repartition(3)
    nodes = chat_format.trees(df, TOKENIZER)
    want = []
    lone = [(r,) for r in CHATS if r[0] is None]
    for conv, of in [(c, [r for r in CHATS if r[0] == c]) for c in {r[0] for r in CHATS} - {None}] + [(None, list(x)) for x in lone]:
        own = sorted(of, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        want.append((str(conv), len(own), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    got = chat_format.read_back(nodes, TOKENIZER).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted(want)
    assert chat_format.trees(df.limit(0), TOKENIZER).count() == 0


def test_chat_shares_turns_once(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        nodes = chat_format.trees(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"), TOKENIZER).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    written = [r for r in nodes if not r.ended]
    assert len(written) == len(CHATS) - 3  # "hello" twice and the reply once are shared
    assert sum(r.ended for r in nodes) == len({r[0] for r in CHATS}) + 1  # two rows have no id
    for r in written:  # ancestors fill the positions before a turn
        assert sum(s.stop - s.start for s in r.ancestors) == r.position and all(s.stop <= r.start for s in r.ancestors)


def test_chat_shares_turns_of_long_conversations(spark):
    turns = lambda conv, own: [(conv, i, "user", f"turn {i}" if i < 16 else f"{own} {i}") for i in range(24)]
    df = spark.createDataFrame(turns(1, "a") + turns(2, "b") + turns(3, "a"), "conv_id long, turn long, role string, text string")
    nodes = chat_format.trees(df.repartition(3), TOKENIZER).collect()
    parts = len({r.pack >> 32 for r in nodes})
    assert parts > 1 or sum(not r.ended for r in nodes) == 32
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sum(not r.ended for r in chat_format.trees(df, TOKENIZER).collect()) == 32
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chat_packs_of_equal_conversations_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "MOST", 5)
    df = spark.createDataFrame([(i, j, "user", "same") for i in range(40) for j in range(2)], "conv_id long, turn long, role string, text string")
    nodes = chat_format.trees(df, TOKENIZER)
    assert max(r["count"] for r in nodes.where("ended").groupBy("pack").count().collect()) <= 5
    assert len({r.turns_sha256 for r in chat_format.read_back(nodes, TOKENIZER).collect()}) == 1


def test_pseudonyms(spark, docs, rows, none):
    p = pseudonyms.Pseudonyms(b"k")
    assert sorted(p.permute(x, 1000, "t") for x in range(1000)) == list(range(1000)) and p.permute(0, 1, "t") == 0
    cases = {
        "card 4111 1111 1111 1111.": "n_card", "born 1987-03-31": "n_date", "on 31/12/1999": "n_date", "am 1.2.2020 da": "n_date", "mail jo.e-Doe42@mail.example.com now": "n_email",
        "ip 10.0.255.1": "n_ip", "call +1 (017) 555-7713 or": "n_phone", "ssn 123-45-6789": "n_ssn", "iban GB82 WEST 1234 5698 7654 32 end": "n_iban",
    }
    clean = ["4111 1111 1111 1112", "1987-02-30", "32/13/1999", "300.1.2.3", "666-45-6789", "GB82 WEST 1234 5698 7654 33", "version 1.2.3", "1234567 items"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*cases, *cases, *clean])] + [(None, None), (99, "")], "doc_id long, text string")
    got = pseudonyms.pseudonymised(df, b"k").collect()
    by = {r.doc_id: r for r in got}
    for k, (text, kind) in enumerate(cases.items()):
        r = by[k]
        assert r[kind] == 1 and r.text != text and r.text == by[k + len(cases)].text and len(r.text.split()) == len(text.split())
        assert re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", text) or kind in ("n_email", "n_ip", "n_date")
    for k, text in enumerate(clean, 2 * len(cases)):
        assert by[k].text == text
    assert by[None].text is None and by[99].text == ""
    assert pseudonyms.luhn("".join(re.findall(r"\d", by[0].text))) == 0 and pseudonyms.mod97(by[8].text[5:32].replace(" ", "")) == 1
    datetime.date.fromisoformat(by[1].text[5:])
    assert pseudonyms.pseudonymised(docs, b"k").count() == len(rows) and pseudonyms.pseudonymised(none, b"k").count() == 0


def test_pseudonyms_inside_failed_matches():
    names = pseudonyms.Pseudonyms(b"k")
    card, iban = "4111 1111 1111 1111", "ES9121000418450200051332"
    alone = {x: names.replace(x)[0] for x in (card, iban, "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "555-123-4567")}
    assert all(a != b for a, b in alone.items())
    for before, x, after, kind in [
        ("", card, " 123", "card"), ("no ", card, " 12/27", "card"), ("", card, " 7.", "card"), ("123 ", card, "", "card"), ("", iban, " BIC", "iban"), ("at ", iban, " 77 x", "iban"),
        ("", "GB82 WEST 1234 5698 7654 32", " ABCD", "iban"), ("", "NO93 8601 1117 947", " ABC", "iban"), ("", "555-123-4567", " 124", "phone"),
    ]:
        assert names.replace(before + x + after) == (before + alone[x] + after, {kind: 1}), (before, x, after)
    for text in ("4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33", "1234567 items", "300.1.2.3"):
        assert names.replace(text) == (text, {})


def labelled(insults: list[str], seed: int = 8, first: int = 0) -> tuple[list, list]:
    rnd = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(first, first + 900):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(8, 60))]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(insults))
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return data, labels


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity(spark, docs, none):
    data, labels = labelled(["you " + x for x in ("idiot", "m0ron", "stupid", "l*o*s*e*r", "clown")])
    long = "word1 " * 50_000
    data += [(None, None), (5000, ""), (5001, long), (5002, long), (7, data[7][1])]  # the last row is repeated
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, label string, fold int").repartition(3)
    rows = toxicity.scored(df, known).collect()
    got = {r.doc_id: r for r in rows}
    assert sorted(r.doc_id or -1 for r in rows) == sorted(i or -1 for i, _ in data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert got[5001].score == got[5002].score and len({r.score for r in rows if r.doc_id == 7}) == 1
    assert all(r.held_out == held(i) for i, r in got.items() if i is not None)
    right = [got[i].predicted == y for i, y in labels if got[i].held_out]
    assert sum(right) / len(right) > 0.95
    wrong = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.scored(df, wrong).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels are never read
    assert toxicity.scored(none, known).count() == 0 and {r.score for r in toxicity.scored(docs, known.limit(0)).collect()} == {0.0}


def test_toxicity_learns_words_of_an_unknown_language(spark):
    data, labels = labelled([f"grmbl{x}" for x in ("", "ak", "ok", "uk", "ek", "ifu", "oza")])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(spark.createDataFrame(data, "doc_id long, text string"), known).collect()}
    right = [got[i] == y for i, y in labels if held(i)]
    assert sum(right) / len(right) > 0.95


def test_toxicity_lexicons_leave_their_fold_out(spark):
    rows = [(i, "fine plain text", 0.0, i % 4) for i in range(80)] + [(100 + i, f"grmbl{i % 4}", 1.0, i % 4) for i in range(80)]
    found = toxicity.lexicons_of(spark.createDataFrame(rows, "id long, text string, label double, fold int"))
    for k in range(3):
        assert {f"grmbl{j}" for j in range(3) if j != k} <= set(found[k]) and f"grmbl{k}" not in found[k]
    assert {"grmbl0", "grmbl1", "grmbl2", "grmb-"} <= set(found[3]) and "grmbl3" not in found[3]
