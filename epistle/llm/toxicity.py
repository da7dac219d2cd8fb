"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features are rates and counts of the text alone: densities of a fixed and of a learnt lexicon (plain, and after folding of
disguised letters), how near lexicon words stand to second-person words, capitals, punctuation and obfuscation rates.

The learnt lexicon holds words and word beginnings that toxic texts have far more often than others, whatever their
language: smoothed log-odds over the labelled rows that may be learnt from. It is cross-fitted. Of four folds by id
hash, three grow the trees, each with features under the lexicon of the other two; the fourth meets the lexicon of
all three and calibrates, by isotonic regression, trees that never saw it. Scores use the lexicon of the three.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# Insults in English, German, French and Spanish; second-person words; letter disguises.
INSULTS = """
arsehole asshole bastard bitch bonehead brainless bullshit clown coward creep crap cretin degenerate despicable
disgusting dimwit douchebag dumb dumbass fool freak fuck fucking garbage hateful idiot idiotic ignorant imbecile jackass
jerk liar loser lunatic maggot moron moronic nasty pathetic pig prick psycho rat repulsive retard revolting scum
scumbag shit shithead shut sick slob stupid subhuman sucker trash twat ugly useless vermin vile whore worthless wretch
abschaum arschloch bloed dreck dumm dummkopf idioten mistkerl scheisse schwein trottel versager widerlich wichser
abruti connard connasse cretine debile degoutant imbeciles merde minable nul ordure pourriture salaud stupide
asqueroso basura cabron cretino escoria estupido idiota imbecil inutil mierda patetico payaso pendejo tonto
""".split()
SECOND_PERSON = "you your yours yourself u ur thou du dein deine dich dir ihr euch sie tu toi ton ta tes vous votre vos te usted ustedes tus vosotros".split()
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
DROPPED = "*_~^"
ENDINGS = ("", "s", "es", "e", "en", "er")

_FORMS = {w + e: w for w in INSULTS for e in ENDINGS}
#: What a form looks like with one letter starred out.
_STARRED = {w[:i] + w[i + 1 :] for w in _FORMS if len(w) > 3 for i in range(1, len(w) - 1)}
_SECOND = set(SECOND_PERSON)
_TERM = re.compile(r"\w+")
_EDGES = ".,;:!?\"'()[]{}<>-"
_FOLD = str.maketrans(DISGUISES | dict.fromkeys(DROPPED, ""))
_NEAR = 8  #: words between a lexicon word and a second-person word that count as near

FEATURES = [
    "insults", "insult_rate", "folded", "folded_rate", "kinds", "near", "near_rate", "second_rate", "learnt", "learnt_rate", "learnt_root", "learnt_kinds", "learnt_top", "learnt_sum",
    "learnt_near", "capital_rate", "shouted_rate", "exclaim_rate", "punct_rate", "mixed_rate", "log_words",
]

#: Labelled rows that the model may learn from: those of the smallest id hashes, lexicon, trees and calibration together.
MAX_TRAIN = 20_000
#: Lengths of word beginnings that are terms besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Toxic texts that a term needs in the folds that its weight comes from.
SUPPORT = 5
#: Terms whose weights are considered, those in most toxic texts first, and terms that a lexicon keeps.
CANDIDATES, LEXICON = 20_000, 4_000
#: Log-odds that a term needs (some 4.5 times as frequent in toxic texts).
LEAST_WEIGHT = 1.5
FOLDS = 4
THRESHOLD = 0.7


def terms_of(words: Counter | set) -> set[str]:
    """Words, and their beginnings with a mark behind."""
    return {t for w in words if len(w) < 64 for t in (w, *(w[:k] + "-" for k in BEGINNINGS if len(w) >= k))}


class Weights(dict):
    """Word -> the largest weight of it and its beginnings; emptied when it holds very many words."""

    MOST = 1 << 19

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > self.MOST:
            self.clear()
        get = self.lexicon.get
        value = max(get(word, 0.0), *(get(word[:k] + "-", 0.0) for k in BEGINNINGS)) if self.lexicon else 0.0
        if len(word) < 64:
            self[word] = value
        return value


def nearby(at: list[int], second: list[int]) -> int:
    """Places in ``at`` with a place of ``second`` within _NEAR words."""
    n = 0
    for i in at:
        k = bisect_left(second, i)
        n += any(abs(s - i) <= _NEAR for s in second[max(0, k - 1) : k + 1])
    return n


def features(text: str, weights: Weights) -> tuple[float, ...]:
    words = _TERM.findall(text.lower())
    counts = Counter(words)
    plain = {w: c for w, c in counts.items() if w in _FORMS}
    heavy = {w: c for w, c in counts.items() if weights[w] > 0}
    whole = text.split()
    odd = [w.strip(_EDGES) for w in whole if not w.isalpha()]
    odd = [w.lower() for w in odd if not w.isalpha() and any(map(str.isalpha, w))]
    plainly = lambda w: any(x in _FORMS or weights[x] > 0 for x in _TERM.findall(w))
    bare = [(w, w.translate(_FOLD)) for w in odd if not plainly(w)]
    folded = sum(f in _FORMS or weights[f] > 0 or ("*" in w and f in _STARRED) for w, f in bare)
    insults, learnt, total = sum(plain.values()), sum(heavy.values()), sum(c * weights[w] for w, c in heavy.items())
    second = [i for i, w in enumerate(words) if w in _SECOND] if insults or learnt else []
    seconds = len(second) if second else sum(counts[w] for w in _SECOND if w in counts)
    near = nearby([i for i, w in enumerate(words) if w in plain], second) if plain and second else 0
    near_learnt = nearby([i for i, w in enumerate(words) if w in heavy], second) if heavy and second else 0
    n, chars = max(1, len(words)), max(1, len(text))
    upper = 0 if text.islower() else sum(len(x) for x in re.findall(r"[A-Z]+", text))
    shouted = sum(map(len, re.findall(r"[A-Z]{3,}", text))) if upper else 0
    spaces = len(text) - sum(map(len, whole))
    punct = len(text) - spaces - sum(len(w) * c for w, c in counts.items())
    return (
        insults, insults / n, insults + folded, (insults + folded) / n, len({_FORMS[w] for w in plain}), near, near / n, seconds / n,
        learnt, learnt / n, learnt / math.sqrt(n), len(heavy), max((weights[w] for w in heavy), default=0.0), total / math.sqrt(n),
        near_learnt, upper / chars, shouted / chars, text.count("!") / chars, punct / chars, len(bare) / n, math.log1p(n),
    )


def featured(docs: DataFrame, lexicons: dict[int, dict[str, float]]) -> DataFrame:
    """FEATURES of each row of ``docs`` (id, text, which, further columns), under the lexicon that ``which`` names."""
    slim = docs.select(*(c for c in docs.columns if c != "text"), "text")
    kept = [c for c in slim.columns if c != "text"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {k: Weights(v) for k, v in lexicons.items()}
        for b in batches:
            out = pd.DataFrame([features(t or "", tables[k]) for t, k in zip(b["text"], b["which"], strict=True)], columns=FEATURES, dtype="float64")
            yield pd.concat([b[kept].reset_index(drop=True).astype({"id": "Int64"}), out], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInPandas(rows, schema + ", " + ", ".join(f"{c} double" for c in FEATURES))


def counted(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(term, fold, n): in how many of ``texts`` (text, fold) each term stands, of all terms or of ``wanted``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[tuple[str, int], int] = {}
            for text, fold in zip(b["text"], b["fold"], strict=True):
                found = terms_of(set(_TERM.findall((text or "").lower())))
                for t in found if wanted is None else found & wanted:
                    n[t, fold] = n.get((t, fold), 0) + 1
            yield pd.DataFrame([(t, f, c) for (t, f), c in n.items()], columns=["term", "fold", "n"])

    return texts.select("text", "fold").mapInPandas(rows, "term string, fold int, n long").groupBy("term", "fold").agg(F.sum("n").alias("n"))


def lexicons_of(train: DataFrame) -> dict[int, dict[str, float]]:
    """Lexicons (term -> weight) from ``train`` (text, label, fold): for each fold but the last, that of the others without the last; the last has all of them.

    Candidates are the terms of at least SUPPORT toxic texts, CANDIDATES at most; their counts, so many rows for each fold
    and class at most, are all that reaches the driver.
    """
    last = FOLDS - 1
    open_ = train.where(F.col("fold") < last)
    toxic, clean = open_.where("label = 1"), open_.where("label = 0")
    many = counted(toxic, None)
    top = staged(many.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "term").limit(CANDIDATES), "candidates")
    wanted = {r["term"] for r in top.collect()}
    texts = np.zeros((2, FOLDS))
    for r in open_.groupBy("label", "fold").count().collect():
        texts[int(r["label"]), r["fold"]] = r["count"]
    names = {t: i for i, t in enumerate(sorted(wanted))}
    n = np.zeros((2, FOLDS, len(names)))
    for y, df in ((1, toxic), (0, clean)):
        for r in counted(df, wanted).collect() if wanted else []:
            n[y, r["fold"], names[r["term"]]] = r["n"]
    order, out = list(names), {}
    for k in range(FOLDS):
        use = [f for f in range(last) if f != k or k == last]
        a, b = n[1][use].sum(0), n[0][use].sum(0)
        w = np.log((a + 0.5) / (texts[1, use].sum() + 1)) - np.log((b + 0.5) / (texts[0, use].sum() + 1))
        good = [i for i in np.lexsort((np.arange(len(w)), -w * np.sqrt(a))) if a[i] >= SUPPORT and w[i] >= LEAST_WEIGHT][:LEXICON]
        out[k] = {order[i]: round(float(w[i]), 6) for i in good}
    return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def trained(train: DataFrame) -> tuple[dict[int, dict[str, float]], Callable[[DataFrame], DataFrame]]:
    """The lexicons, and what adds a column ``score`` to a table of FEATURES. ``train``: id, text, label, fold, of both classes."""
    lexicons = lexicons_of(train)
    known = staged(featured(train.withColumn("which", F.col("fold")), lexicons), "known")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fit = known.where(F.col("fold") < FOLDS - 1)
    if fit.agg(F.countDistinct("label")).first()[0] < 2:
        fit = known
    model = GBTClassifier(labelCol="label", maxIter=30, maxDepth=4, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=1).fit(vector.transform(fit))

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(vector.transform(df)).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    rest = known.where(F.col("fold") == FOLDS - 1)
    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw(rest if rest.agg(F.countDistinct("label")).first()[0] == 2 else known))

    def score(df: DataFrame) -> DataFrame:
        level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))
        # ties that the calibration makes keep the trees' order within a hundredth of a point
        return iso.transform(raw(df)).withColumn("score", 0.9999 * level + 0.0001 * F.col("raw"))

    return lexicons, score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Null text counts as empty and is scored like any other; texts are read whole, whatever their length. A document with
    several labels counts as toxic if one says so; null labels are ignored. Rows without an id are scored and never learnt
    from. Where the labels to learn from have one class only, or are missing, every score is that class's rate (0
    without labels). Repeated rows and rows of equal text get equal scores; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = staged(known.where(~held_out("id")).join(slim.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_train), "chosen")
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    train = staged(slim.join(F.broadcast(chosen), "id").select("id", "text", "label", fold).repartition(12, "id"), "train")
    parts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    if set(parts) < {0.0, 1.0}:
        out = slim.select("id", F.lit(float(parts.get(1.0, 0) > 0)).alias("score"))
    else:
        lexicons, score = trained(train)
        last = FOLDS - 1
        out = score(staged(featured(slim.withColumn("which", F.lit(last)), {last: lexicons[last]}), "features"))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
