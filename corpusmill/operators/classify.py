"""Document category and regulatory tags by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import any_in, count_in


def category(content: Column, filename: Column) -> Column:
    """The category with the most keywords in content or file name, both in lower case; of equals the first; general if none occurs."""
    scored = F.array(*(F.struct(count_in([content, filename], words).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, words) in enumerate(rules.CATEGORY_KEYWORDS.items())))
    return F.transform(F.array(F.array_max(scored)), lambda best: F.when(best["score"] > 0, best["name"]).otherwise(F.lit(rules.DEFAULT_CATEGORY)))[0]


def tags(content: Column) -> Column:
    """The regulations that content, in lower case, mentions, in their order."""
    return F.array_compact(F.array(*(F.when(any_in(content, words), F.lit(name)) for name, words in rules.TAG_KEYWORDS.items())))


def classified(docs: DataFrame, content: str = "content", filename: str = "source_file", override: str | None = None) -> DataFrame:
    """docs with document_category and regulatory_tags. A text is put in lower case once for all keywords."""
    lower = F.transform(F.array(F.struct(F.lower(content).alias("c"), F.lower(filename).alias("f"))), lambda x: F.struct(category(x["c"], x["f"]).alias("category"), tags(x["c"]).alias("tags")))[0]
    return docs.withColumn("__found", lower).withColumns({"document_category": F.coalesce(F.lit(override), F.col("__found.category")), "regulatory_tags": F.col("__found.tags")}).drop("__found")
