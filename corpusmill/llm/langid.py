"""Language identification of documents that may mix languages: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import long_texts, released

#: Hashed byte trigrams; labelled rows per language that a model is fitted on, at most on average; smoothing.
BUCKETS, ROWS_EACH, SMOOTH = 1 << 16, 3000, 0.2
#: Languages that a model may have: it takes 0.8 MB for each while it is fitted.
LANGUAGES = 200
#: A language joins the set if it raises the log-likelihood by PENALTY times the logarithm of the text's trigrams.
PENALTY, STEPS, SETTLED = 4.0, 60, 1e-4

_FOLD = bytes(x if chr(x).isalpha() or x >= 128 else 32 for x in range(256))


def trigrams(text: str) -> np.ndarray:
    """The hashed byte trigrams of lower-cased whole text, its marks and digits taken as spaces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    codes = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    blank = (raw[:-2] == 32) & (raw[1:-1] == 32)
    return (codes[~blank] >> 16).astype(np.uint16)


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes, kind="stable")
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, rows_each: int = ROWS_EACH) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigrams' log-probabilities, from rows whose text and lang are not null. A language with more
    than rows_each rows is represented by about so many, chosen by a hash of the id. Trigram counts are summed on the
    executors; the driver gets one number for each language and bucket, so over LANGUAGES languages are an error."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = {r["lang"]: min(1.0, rows_each / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(share) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages: the model holds {BUCKETS} numbers for each")
    if not share:
        return [], np.zeros((0, BUCKETS), np.float32)
    chosen = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                at, n = _counts(trigrams(text))
                total[lang][at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})
        released()

    part = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) < chosen * (1 << 20))
    got = part.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(share)
    table = np.zeros((len(names), BUCKETS))
    table[got["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    table += SMOOTH
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(codes: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The proportion of each language in a text. The set of languages starts from the likeliest and grows while the gain in
    log-likelihood pays the penalty; the log-likelihood is concave in the proportions, so the slope towards a language bounds
    what it can gain and most texts need no iteration."""
    at, n = _counts(codes)
    logs, total = model[:, at].astype(np.float64), int(n.sum())
    single = logs @ n
    first = int(np.argmax(single))
    prob, chosen, weight, value = np.exp(logs), [first], np.ones(1), float(single[first])
    price = penalty * np.log(total + 1.0)
    out = np.zeros(len(model))
    while len(chosen) < len(model):
        slope = prob @ (n / (weight @ prob[chosen])) / total
        slope[chosen] = -1
        new = int(np.argmax(slope))
        if total * (slope[new] - 1) <= price:
            break
        trial, part = [*chosen, new], prob[[*chosen, new]]
        now = np.append(weight * 0.8, 0.2)
        for _ in range(STEPS):
            drawn = now[:, None] * part
            then = (drawn / drawn.sum(axis=0)) @ n / total
            moved, now = np.abs(then - now).max(), then
            if moved < SETTLED:
                break
        gained = float(np.log(now @ part) @ n)
        if gained - value <= price:
            break
        chosen, weight, value = trial, now, gained
    out[chosen] = weight
    return out


def predict(text: Column, names: list[str], model: np.ndarray, penalty: float = PENALTY) -> Column:
    """struct(lang_pred, score, mixture): the language with the largest proportion (of equal ones the first by name), that
    proportion, and all proportions over 0, largest first. A null text and one without a letter: und, 0, none."""

    @F.pandas_udf("lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                if not names or text is None or not any(map(str.isalpha, text)):
                    rows.append(("und", 0.0, []))
                    continue
                share = mixture(trigrams(text), model, penalty)
                order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                rows.append((names[order[0]], min(1.0, float(share[order[0]])), [{"lang": names[k], "share": float(share[k])} for k in order]))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])
        released()

    return of(text)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, into: str = "__lang") -> DataFrame:
    """docs with a column `into`: struct(lang_pred, score, mixture), which replaces one of that name; all others stay. Learns from
    rows that aren't held out (a null held_out holds out); id, lang and other columns never enter a prediction. Repeated rows
    get equal predictions; without labelled rows, and for null or letterless texts, und with score 0; over LANGUAGES learned
    languages are an error; an empty table gives an empty result. Whole texts are read, one at a time."""
    long_texts(docs.sparkSession)
    names, model = fit(docs.where(~held_out), text_col, lang_col, id_col)
    return docs.withColumn(into, predict(F.col(text_col), names, model, penalty))
