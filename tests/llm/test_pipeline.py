"""run() of the corpus pipeline against plain Python, on nulls, empty texts, repeated rows and clashing columns."""

import collections
import random
import re

import numpy as np
import public_tokenizers
from test_operators import five_words, plain_quality, words
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, size long, h long, n int"


def some_rows():
    rnd = random.Random(21)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))
    note = "Read  more about this host and its many friends on the next page"
    out = [(i, f"{prose(60)}\n{note}\n{prose(15)}" if i < 30 else prose(80), "h") for i in range(40)]
    out += [(40, f"{note}\n{note.upper()}\na few more words", "h"), (41, note, "other"), (42, None, "h"), (43, "", None), (44, "too short", "h"), (45, "again and " * 40, "h")]
    base = prose(400).split()
    edited = list(base)
    edited[100] = edited[300] = "edited"
    out += [(50, " ".join(base), "x"), (51, "\n".join(base), "x"), (52, " ".join(base) + " ", None), (53, " ".join(edited), None), (54, prose(3000), None)]
    out += [(None, prose(50), "h"), (60, prose(50), "x"), out[3], out[3]]  # without an id; repeated rows
    return [(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5) for i, t, s in out]


def plain_stages(rows):
    """(doc_id, text, source) of what the first three stages keep."""
    norm = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x.lower()).strip(" ")
    docs, texts = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        docs[r[3]].add(r[1] or "")
        for x in (r[1] or "").split("\n"):
            texts[r[3], norm(x)].add(r[1] or "")
    common = {k for k, v in texts.items() if k[1] and len(v) > 20 and len(v) > 0.1 * len(docs[k[0]])}
    good = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if (r[3], norm(x)) not in common]
        lost = sum(len(norm(x).split(" ")) for x in lines if (r[3], norm(x)) in common)
        if not plain_quality(r[1])[-1] and len(words(r[1])) - lost >= 10:
            good.append((r[0], "\n".join(stay), r[3]))
    groups = collections.defaultdict(list)
    for r in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    one = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    out = []
    for r in sorted(one, key=lambda r: (r[0] is None, r[0] or 0)):
        s = five_words(r[1])
        if not any(k[0] is not None and 100 * len(s & five_words(k[1])) >= 80 * len(s | five_words(k[1])) for k in out):
            out.append(r)
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_stages(rows)
    assert {r[0] for r in want} >= {0, 29, 39, 54, 60, None} and not {r[0] for r in want} & {40, 42, 43, 44, 45, 51, 53}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*tok.encode(r[1], add_special_tokens=False).ids, 2] for r in want}
    size = collections.Counter()
    for _, t, s in want:
        size[s] += len(words(t))
    taken = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) <= set(ids)
    for _, t, s in want:
        own = pieces.get(_, [])
        copies = sum(r.piece == 0 for r in own)
        assert copies <= 3 and all(n == copies for n in collections.Counter(r.piece for r in own).values())
        first = {r.piece: r for r in own}
        assert not own or [x for k in sorted(first) for x in np.frombuffer(first[k].ids, "<u4").tolist()] == ids[_]
        taken[s] += copies * len(words(t))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    capped = set()
    while True:
        free = [s for s in size if s not in capped]
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in size}
        if not (over := {s for s in free if target[s] > 3 * size[s]}):
            break
        capped |= over
    for s in size:
        assert abs(taken[s] - target[s]) <= max(len(words(t)) for _, t, x in want if x == s)
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for own in full.values():  # gapless from 0, 1024 tokens at most
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_columns_and_take_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    docs = spark.createDataFrame(some_rows(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").columns == docs.columns, name
        assert stage(spark, none, "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
