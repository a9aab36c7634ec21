"""Toxicity by a counterfactual-regularised classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import classify
from corpusmill.llm.base import long_texts, released

Groups = tuple[tuple[str, ...], ...]

#: Groups of identity terms known beforehand: within a group any may stand for any other.
IDENTITIES: Groups = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
#: Weight of the penalty on score changes; swapped copies of a sentence.
PENALTY, COPIES = 4.0, 2
#: Groups found in the sample: a term is in at least MENTIONS texts that aren't toxic, in no more than COMMON of all texts, and at
#: most half of its texts are toxic, so that a slur is none. Of such terms the TERMS that lean most to toxic texts are grouped
#: with others of like neighbours (cosine of NEIGHBOURS hashed counts at least LIKE), GROUP at most.
MENTIONS, COMMON, TERMS, GROUP, NEIGHBOURS, LIKE = 8, 0.05, 48, 6, 64, 0.25

_sentences = re.compile(r"(?<=[.!?\n])").split
_words = re.compile(r"[^\W\d_]+")


def found_groups(rows: DataFrame, counts: DataFrame, size: np.ndarray) -> Groups:
    """Identity terms of the sample that the list beforehand doesn't know: terms that clean texts mention too and that stand in one
    another's places. rows: (text, label 0 or 1); counts, size: of classify.counted."""
    n, toxic = float(size.sum()), float(size[1] / max(1.0, size.sum()))
    lean = (F.col("n1") - F.col("n") * toxic) / F.sqrt(F.col("n") * (toxic * (1 - toxic) + 1e-6))
    able = counts.where(F.startswith("feature", F.lit("=")) & (F.col("n0") >= MENTIONS) & (F.col("n") <= COMMON * n) & (F.col("n1") <= F.col("n0")))
    terms = [r["feature"][1:] for r in able.orderBy(F.desc(lean), "feature").limit(TERMS).collect()]
    if len(terms) < 2:
        return ()

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = set(terms), Counter()
        for batch in batches:
            for text in batch["text"]:
                words = ["", *classify.words_of(text), ""]
                for k, word in enumerate(words):
                    if word in wanted:
                        total.update((word, side * NEIGHBOURS + zlib.crc32(x.encode("utf-8", "surrogatepass")) % NEIGHBOURS) for side, x in enumerate((words[k - 1], words[k + 1])))
        yield pd.DataFrame([(*x, m) for x, m in total.items()], columns=["word", "place", "n"])

    got = rows.mapInPandas(profile, "word string, place int, n long").groupBy("word", "place").agg(F.sum("n").alias("n")).toPandas()
    number = {x: k for k, x in enumerate(terms)}
    beside = np.zeros((len(terms), 2 * NEIGHBOURS))
    beside[got["word"].map(number).to_numpy(int), got["place"].to_numpy(int)] = np.sqrt(got["n"].to_numpy(float))
    beside /= np.maximum(np.linalg.norm(beside, axis=1, keepdims=True), 1e-300)
    like, left, groups = beside @ beside.T, list(range(len(terms))), []
    while left:
        first = left.pop(0)
        near = sorted((k for k in left if like[first, k] >= LIKE), key=lambda k: (-like[first, k], k))[: GROUP - 1]
        left = [k for k in left if k not in near]
        if near:
            groups.append(tuple(terms[k] for k in (first, *near)))
    return tuple(groups)


def swapped(text: str, identities: Groups = IDENTITIES, copies: int = COPIES) -> list[tuple[str, str]]:
    """Each sentence of text that holds identity terms beside its counterfactuals: each term replaced by the next of its group, then
    by the one after that, and so on for as many copies as the largest of its groups has others. The first letter keeps its case."""
    next_of = {x: group for group in identities for x in group}
    if next_of.keys().isdisjoint(map(str.lower, _words.findall(text))):
        return []
    out = []
    for sentence in _sentences(text):
        held = [next_of[x] for x in map(str.lower, _words.findall(sentence)) if x in next_of]

        def other(match: re.Match) -> str:
            group = next_of.get(match[0].lower())
            new = group[(group.index(match[0].lower()) + step) % len(group)] if group else match[0]
            return new.capitalize() if group and match[0][0].isupper() else new

        for step in range(1, min(copies, max(map(len, held), default=1) - 1) + 1):
            out.append((sentence, _words.sub(other, sentence)))
    return out


def fit_weights(found: pd.Series, label: np.ndarray, pair_a: pd.Series, pair_b: pd.Series, features: int, penalty: float = PENALTY, steps: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights and, last, the bias: log loss + penalty * mean (score(a) - score(b))^2 over pairs of a sentence and its
    counterfactual + ridge; Adagrad over batches of the sample and of the pairs."""
    weights, seen = np.zeros(features + 1), np.full(features + 1, 1e-8)
    score = lambda r, c, n: 1 / (1 + np.exp(-np.clip(np.bincount(r, weights[c], n) + weights[-1], -30, 30)))
    sides = zip(classify.batches(pair_a, steps), classify.batches(pair_b, steps))  # of one length, so in one order
    for some, row, col in classify.batches(found, steps):
        error = (score(row, col, len(some)) - label[some]) / len(some)
        slope = np.append(np.bincount(col, error[row], features), error.sum()) + ridge * weights
        if penalty and (both := next(sides, None)):
            (these, row_a, col_a), (_, row_b, col_b) = both
            a, b = score(row_a, col_a, len(these)), score(row_b, col_b, len(these))
            apart = 2 * penalty * (a - b) / len(these)
            slope[:-1] += np.bincount(col_a, (apart * a * (1 - a))[row_a], features) - np.bincount(col_b, (apart * b * (1 - b))[row_b], features)
            slope[-1] += (apart * (a * (1 - a) - b * (1 - b))).sum()
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", identities: Groups = IDENTITIES, find: bool = True, penalty: float = PENALTY, limit: int = classify.FIT_ROWS) -> tuple[list[str], np.ndarray, Groups, int]:
    """Feature names, weights, the identity groups (those given and, if find, those found in the sample) and the number of pairs.
    labels: (id_col, label int 0 or 1), those to learn from only. Fitted on at most limit labelled rows; features of identity
    terms are among the features, so that the penalty can level them."""
    rows = classify.sample(docs, labels, id_col, text_col, limit).persist()
    counts, size = classify.counted(rows, 2, shape=False)
    names = classify.best_features(counts, size)
    known = {x for group in identities for x in group}
    groups = identities + tuple(g for group in (found_groups(rows, counts, size) if find else ()) if len(g := tuple(x for x in group if x not in known)) > 1)
    counts.unpersist()
    names = list(dict.fromkeys([*names, *(x for group in groups for word in group for x in classify.word_features(word))]))

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = classify.Features(names, False)
        for batch in batches:
            found = [(made.numbers(a), made.numbers(b)) for text in batch["text"] for a, b in swapped(text, groups)]
            yield pd.DataFrame(found, columns=["a", "b"])
        released()

    table = classify.numbered(rows, names, shape=False)
    pairs = rows.mapInPandas(pair, "a array<int>, b array<int>").orderBy("a", "b").toPandas()
    rows.unpersist()
    return names, fit_weights(table["found"], table["label"].to_numpy(float), pairs["a"], pairs["b"], len(names), penalty), groups, len(pairs)


def score(text: Column, names: list[str], weights: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = classify.Features(names, False)
        for batch in batches:
            sums = np.array([weights[made.numbers(x)].sum() if x else 0.0 for x in batch]) + weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))
        released()

    return of(text)


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", identities: Groups = IDENTITIES, find: bool = True, penalty: float = PENALTY, into: str = "__score") -> DataFrame:
    """docs with a column `into` (0 to 1, higher: likelier toxic), which replaces one of that name; all others stay. The score of
    null and empty texts is that of a text without features; repeated rows score alike; null labels and ids teach nothing;
    without labels every score is 0.5; an empty table gives an empty result. Whole texts are read; ids and other columns never
    enter a score."""
    long_texts(docs.sparkSession)
    names, weights, _, _ = fit(docs, labels, id_col, text_col, identities, find, penalty)
    return docs.withColumn(into, score(F.col(text_col), names, weights))
