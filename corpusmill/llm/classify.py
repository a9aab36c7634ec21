"""A text classifier: present words, their beginnings and the text's shape; selected features; logistic or softmax weights."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import released

#: Labelled rows that a classifier is fitted on and features that it keeps, at most.
FIT_ROWS, FEATURES = 12_000, 4096
#: Rows that a step of the fit looks at.
BATCH = 1024
#: Characters that a word's beginning may have.
BEGINNINGS = (4, 5, 6)

_LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))
_SPACED = bytes(x if x in _LETTERS else 32 for x in range(256))
_COUNTED = [bytes(x for x in range(256) if x not in kept) for kept in (_LETTERS, range(65, 91), b"!%$&#*|<>{}", b"0123456789")]


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; every character outside ASCII counts as one."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).decode("utf-8", "surrogatepass").split()


def word_features(word: str) -> tuple[str, ...]:
    return (f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n))


def shape_features(text: str, words: int, distinct: int) -> list[str]:
    """Coarse steps of how varied the words are, and of the shares of letters, capitals, marks and digits."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    letters, upper, marks, digits = (len(raw.translate(None, others)) for others in _COUNTED)
    varied = distinct / max(1, words) * min(1.0, words**0.25 / 4)
    return [f"#empty{not words}", f"#varied{int(varied * 10)}", f"#upper{int(upper / max(1, letters) * 5)}", f"#letters{int(letters / n * 10)}", f"#marks{int(min(marks / n, 0.2) * 50)}", f"#digits{int(min(digits / n, 0.2) * 20)}"]


class Features:
    """text -> the numbers of the features it has: whole sets of words and of their beginnings meet the few that count, so the cost
    of a word that has never been seen before is that of any other."""

    def __init__(self, names: list[str] | None, shape: bool) -> None:
        self.number, self.shape = {x: k for k, x in enumerate(names or ())}, shape
        whole = {x[1:]: k for x, k in self.number.items() if x[0] == "="}
        begin = {n: {x[1:]: k for x, k in self.number.items() if x[0] == "^" and len(x) == n + 1} for n in BEGINNINGS}
        self.of_word: dict[str, tuple[str, ...]] = {}
        self.sets = [(None, frozenset(whole), whole), *((n, frozenset(x), x) for n, x in begin.items() if x)]

    def names(self, text: str) -> set[str]:
        words = words_of(text)
        distinct = set(words)
        for word in distinct.difference(self.of_word):
            self.of_word[word] = word_features(word)
        found = set().union(*map(self.of_word.__getitem__, distinct))
        return found.union(shape_features(text, len(words), len(distinct))) if self.shape else found

    def numbers(self, text: str) -> list[int]:
        words = words_of(text)
        distinct = set(words)
        found = []
        for n, known, number in self.sets:
            found += [number[x] for x in known.intersection(distinct if n is None else {x[:n] for x in distinct if len(x) > n})]
        if self.shape:
            found += [self.number[x] for x in shape_features(text, len(words), len(distinct)) if x in self.number]
        return sorted(found)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most limit labelled rows, chosen by a hash of the id; labels: (id_col, label). Null texts and labels
    take no part. The chosen labels are few enough by their limit to be sent to every executor. An id that documents repeat
    counts once with each of its labels, by the text of least hash, so that the limit holds whatever ids are repeated."""
    some = labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__label_of"), F.col("label").cast("int").alias("__label")).distinct()
    some = some.orderBy(F.xxhash64(F.lit("fit"), "__label_of"), "__label_of", "__label").limit(limit)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(some), F.col("__id") == F.col("__label_of"))
    once = met.groupBy("__id", F.col("__label").alias("label")).agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    return once.select("text", "label")


def counted(rows: DataFrame, classes: int, shape: bool) -> tuple[DataFrame, np.ndarray]:
    """(feature, n, n0, n1, ...): the sample's texts that have a feature, all and of each class, kept until it is unpersisted; and
    the number of rows of each class."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, total = Features(None, shape), {}  # no more than the bounded sample's features
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                total.setdefault(label, Counter()).update(["", *made.names(text)])
        for label, found in total.items():
            yield pd.DataFrame({"feature": list(found), "label": label, "n": list(found.values())})
        released()

    each = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)]
    found = rows.mapInPandas(count, "feature string, label int, n long").groupBy("feature").agg(F.sum("n").alias("n"), *each).persist()
    first = found.where("feature = ''").first()
    return found, np.array([first[f"n{k}"] if first else 0 for k in range(classes)], float)


def best_features(found: DataFrame, size: np.ndarray, limit: int = FEATURES, least: int = 4) -> list[str]:
    """The features that part the classes best: in at least `least` texts, by the largest deviation of a class's count from its
    share, in standard deviations."""
    share = size / max(1.0, size.sum())
    apart = [F.abs(F.col(f"n{k}") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p) + 1e-6)) for k, p in enumerate(share.tolist())]
    best = found.where((F.col("feature") != "") & (F.col("n") >= least)).select("feature", F.greatest(*apart, F.lit(0.0)).alias("z")).where("z > 3").orderBy(F.desc("z"), "feature").limit(limit).collect()
    return [r["feature"] for r in best]


def numbered(rows: DataFrame, names: list[str], shape: bool) -> pd.DataFrame:
    """(label, found) of the bounded sample, on the driver, in an order that doesn't depend on how tasks ended."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Features(names, shape)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "found": [made.numbers(x) for x in batch["text"]]})

    got = rows.mapInPandas(number, "label int, found array<int>").toPandas()
    order = sorted(range(len(got)), key=lambda k: (got["label"].iat[k], np.asarray(got["found"].iat[k], np.int32).tobytes()))
    return got.iloc[order].reset_index(drop=True)


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def batches(found: pd.Series, steps: int, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step the numbers of some rows, the place among them and the number of each feature that they have. The rows are
    taken in turn, in one random order, all of them again and again."""
    order = np.random.default_rng(1).permutation(len(found))
    lists = [np.asarray(found.iloc[k], np.int64) for k in order]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat, starts, at = np.concatenate([*lists, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum(sizes))), 0
    for _ in range(steps if len(lists) else 0):
        to = min(at + size, len(lists))
        yield order[at:to], np.repeat(np.arange(to - at), sizes[at:to]), flat[starts[at] : starts[to]]
        at = to % len(lists)


def fit_softmax(found: pd.Series, label: np.ndarray, features: int, classes: int, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights (features + 1, classes), the last row the bias; Adagrad over batches of the sample."""
    weights, seen = np.zeros((features + 1, classes)), np.full((features + 1, classes), 1e-8)
    want = np.eye(classes)[label]
    for some, row, col in batches(found, steps):
        score = np.stack([np.bincount(row, weights[col, k], len(some)) for k in range(classes)], axis=1) + weights[-1]
        error = (softmax(score) - want[some]) / len(some)
        slope = np.stack([np.append(np.bincount(col, error[row, k], features), error[:, k].sum()) for k in range(classes)], axis=1) + ridge * weights
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
    return weights
