"""Mixing documents to target weights through soft domain memberships and projected-gradient least squares."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import classify
from corpusmill.llm.base import free, long_texts, released, stored

#: Passes of the projected gradient at most. It ends where every domain's total is within NEAR of its own target (of a target under
#: LEAST of all tokens: within NEAR of that), or where for PATIENCE passes nothing has come nearer by a thousandth. Weight of the
#: Gram matrix of all documents beside that of those with a rate over 0; the least part of a step that is tried.
PASSES, NEAR, LEAST, PATIENCE, ALL, SHORTEST = 100, 0.005, 0.002, 8, 0.02, 1 / 64
#: The columns that mix() adds.
ADDED = ("__tokens", "__posterior", "__rate")


def memberships(text: Column, names: list[str], weights: np.ndarray, domains: list[str]) -> Column:
    """struct(tokens, one posterior for each domain): tokens are words outside ASCII white space."""
    columns = [f"p{k}" for k in range(len(domains))]

    @F.pandas_udf("tokens long, " + ", ".join(f"{c} double" for c in columns))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = classify.Features(names, True)
        for batch in batches:
            scores = np.stack([weights[made.numbers(x or "")].sum(axis=0) + weights[-1] for x in batch]) if len(batch) else np.zeros((0, len(domains)))
            out = pd.DataFrame(classify.softmax(scores), columns=columns)
            out.insert(0, "tokens", [len(x.encode("utf-8", "surrogatepass").split()) if x else 0 for x in batch])
            yield out
        released()

    return of(text)


def rates(posteriors: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """A document's rate after the steps so far, and where the next step is judged. Each step is (the slope for each domain, the
    momentum after it); rates start at 1 and are never negative."""
    now = ahead = np.ones(len(posteriors))
    for slope, momentum in steps:
        then = np.maximum(0.0, ahead - posteriors @ slope)
        now, ahead = then, then + momentum * (then - now)
    return now, ahead


def _rates_column(posteriors: Column, steps: list[tuple[np.ndarray, float]]) -> Column:
    @F.pandas_udf("double")
    def of(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(rates(batch.to_numpy(float), steps)[0])

    return of(posteriors)


@dataclass
class Fit:
    """The steps; the token totals of the domains that were wanted and that the last step's rates reach; whether they agree."""

    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    want: np.ndarray = field(default_factory=lambda: np.zeros(0))
    have: np.ndarray = field(default_factory=lambda: np.zeros(0))
    settled: bool = True

    @property
    def reached(self) -> np.ndarray:
        return self.have / max(self.have.sum(), 1e-300)


def fit_rates(scored: DataFrame, columns: list[str], targets: np.ndarray, total: float | None = None) -> Fit:
    """The projected gradient for least squares between the domains' expected token totals A r and T, the targets' shares of total
    (default: all tokens there are), over nonnegative rates r. scored: (tokens, posteriors).

    A step weighs the misses by the inverse of the domains' Gram matrix over the documents whose rates aren't held at 0, with a
    little of that over all: as long as none is held, one step is the solution, and a rare or poorly parted domain converges
    as fast as the others. Directions in which the posteriors hardly differ (under a 1e-9th of the largest) are left alone. A
    step that would make the miss larger is taken back, momentum starts anew and the next is half as long. Each is one pass
    that returns a few numbers a task; a rate is a function of the few steps and the document's own posteriors, so nothing
    else is kept between passes."""
    d = len(columns)

    def totals(steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((d + 2, d))
            for batch in batches:
                p, n = batch[columns].to_numpy(float), batch["tokens"].to_numpy(float)
                now, ahead = rates(p, steps)
                free = n * (now > 0)
                sums += np.vstack(((n * now) @ p, (n * ahead) @ p, (p * free[:, None]).T @ p))
            yield pd.DataFrame({"k": np.arange(d + 2), **{f"c{j}": sums[:, j] for j in range(d)}})

        sums = [F.sum(f"c{j}").alias(f"c{j}") for j in range(d)]
        found = scored.mapInPandas(add, "k int, " + ", ".join(f"c{j} double" for j in range(d))).groupBy("k").agg(*sums)
        return found.toPandas().sort_values("k")[[f"c{j}" for j in range(d)]].to_numpy(float)

    def inverse(square: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(square)
        return (vectors * np.where(values > 1e-9 * values.max(), 1 / np.maximum(values, 1e-300), 0.0)) @ vectors.T

    sums = totals([])
    if not len(sums) or sums[0].sum() <= 0:
        return Fit()
    everything, whole = sums[0].sum(), sums[2:]
    want = targets * (everything if total is None else total)
    allowed = NEAR * np.maximum(want, LEAST * everything)
    metric = inverse(whole) + np.eye(d) / everything
    miss = lambda x: float((x - want) @ metric @ (x - want))
    (have, seen), square, steps, speed, part = sums[:2], whole, [], 1.0, 1.0
    least, best, passes = miss(have), 0, 0
    while np.any(np.abs(have - want) > allowed) and passes < PASSES and passes - best < PATIENCE:
        faster, passes = (1 + np.sqrt(1 + 4 * speed * speed)) / 2, passes + 1
        trial = [*steps, (part * inverse(square + ALL * whole) @ (seen - want), (speed - 1) / faster)]
        sums = totals(trial)
        if miss(sums[0]) > miss(have):
            if steps:
                steps[-1] = (steps[-1][0], 0.0)
            seen, speed, part = have, 1.0, max(part / 2, SHORTEST)
            continue
        (have, seen), square, steps, speed, part = sums[:2], sums[2:], trial, faster, min(1.0, 1.5 * part)
        if miss(have) < least * (1 - 1e-3):
            least, best = miss(have), passes
    return Fit(steps, want, have, not np.any(np.abs(have - want) > allowed))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, total: float | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """docs with __tokens, __posterior (map from domain to probability) and __rate: the expected number of times that the document
    should be read so that the domains' expected shares of tokens are the targets', of as many tokens as total (default: as
    docs have). names: other names for these three; columns that have them are replaced, all others stay.

    labels: (id_col, label string), a domain each; domains are the targets' keys, other and null labels teach nothing. A
    classifier fitted on a bounded sample of labelled rows gives each document's posterior; a document counts towards every
    domain by it. Without labels all posteriors are equal. Where no nonnegative rates reach the targets, the nearest totals
    are taken (nearest by the inverse Gram matrix that steps are scaled by, not by plain squares) and a warning names the shares
    reached. Null and empty texts have no tokens; repeated rows have equal rates; an
    empty table gives an empty result.
    """
    long_texts(docs.sparkSession)
    domains = sorted(targets)
    aim = np.array([targets[x] for x in domains], float)
    number = F.create_map(*(F.lit(x) for pair in zip(domains, range(len(domains))) for x in pair))
    rows = classify.sample(docs, labels.select(id_col, number[F.col("label")].alias("label")), id_col, text_col).persist()
    counts, size = classify.counted(rows, len(domains), shape=True)
    features = classify.best_features(counts, size)
    counts.unpersist()
    table = classify.numbered(rows, features, shape=True)
    rows.unpersist()
    weights = classify.fit_softmax(table["found"], table["label"].to_numpy(int), len(features), len(domains))
    del table
    released()
    columns = [f"p{k}" for k in range(len(domains))]
    (made,) = free(docs, "__m")
    found = docs.withColumn(made, memberships(F.col(text_col), features, weights, domains))
    found = stored(found if keep_text else found.drop(text_col), "memberships")
    fit = fit_rates(found.select(f"{made}.tokens", *(f"{made}.{c}" for c in columns)), columns, aim / aim.sum(), total)
    if not fit.settled:
        warnings.warn("targets out of reach; shares reached: " + ", ".join(f"{x} {share:.4f}" for x, share in zip(domains, fit.reached)), stacklevel=2)
    posterior = F.create_map(*(x for name, c in zip(domains, columns) for x in (F.lit(name), F.col(f"{made}.{c}"))))
    rate = _rates_column(F.struct(*(f"{made}.{c}" for c in columns)), fit.steps)
    made_of = dict(zip(ADDED, (F.col(f"{made}.tokens"), posterior, rate)))
    return found.withColumns({(names or {}).get(x, x): c for x, c in made_of.items()}).drop(made)


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of times whose expectation over documents is rate: the fraction is rounded by a hash of the key."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label): toxic rows, and of the others those of high and of low quality; null where a mark is missing."""
    return labels.select(id_col, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("label"))
