"""From raw documents to training sequences: each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage decides
takes effect in its result. All stages but the last return the columns of documents, whatever others these have besides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import langid, mixing, packing, simhash, substrings
from corpusmill.llm.base import crc_fold, free, stored, table
from corpusmill.llm.queries import TARGETS


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts. A document that mixes learned languages stays, however
    its proportions are; very long texts are read whole; repeated rows are judged alike; an empty table stays empty, and one
    without a labelled row loses every document, as no language is known."""
    (found,) = free(docs, "__lang")
    return langid.identify(docs, crc_fold("doc_id", 3) == 1, into=found).where(F.col(f"{found}.lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: texts whose five-word shingles are alike at 0.8 or more, and what they
    link. Of a group stays the smallest id (null behind all others), of rows that share it one with the least hash of its
    text, so of rows that repeat one stays. Null, empty and blank texts are one group; a text under five words is one
    shingle; very long texts are compared whole; an empty table stays empty."""
    return simhash.one_of_each(docs, shingle=5, exact=True)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that occur more than once out of the texts that have any; other texts stay as they are, null, empty and short
    ones included. Every document keeps its row, with an empty text if all of it goes; repeated rows lose all that they
    repeat; n_chars, where docs have it, follows the text; an empty table stays empty."""
    (kept,) = free(docs, "__kept")
    found = substrings.without_repeats(docs, into=kept)
    changed = {"text": F.when(F.col(f"{kept}.n_removed") > 0, F.col(f"{kept}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(f"{kept}.n_removed") > 0, F.length(f"{kept}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that their domains' expected shares of tokens meet the targets, at as many tokens as there
    are: the rate's whole part is the number of copies, its fraction the chance of one more, by a hash of id and text.
    Repeated rows have equal numbers of copies; null and empty texts have the rate of their posterior; very long texts count
    by all their tokens; an empty table stays empty."""
    fresh = dict(zip(mixing.ADDED, free(docs, *mixing.ADDED)))
    found = mixing.mix(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), TARGETS, names=fresh)
    times = mixing.copies(F.col(fresh["__rate"]), F.col("doc_id"), F.col("text"))
    (copy,) = free(found, "__copy")
    return found.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens. Null and empty texts are one piece of the closing id; very long ones are cut into full pieces;
    repeated rows keep their pieces; other columns are ignored; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("sequences", sequences)]

#: Hashing, fitted models and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
