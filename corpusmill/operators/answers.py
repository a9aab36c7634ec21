"""Context and prompt building, citations, groundedness, answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import any_in, basename, held, holds, let, strings, strip, words, words_held

#: Characters of a context: 6000 tokens of 4.
CONTEXT_CHARS = 24_000
# fixed value: the context of a question that nothing was found for
NOTHING_FOUND = "No relevant documentation found."


def source_block(ordinal: Column, source: Column, category: Column, tags: Column, score: Column, section: Column, content: Column) -> Column:
    # fixed value: the header's form
    head = F.format_string("[SOURCE %d] %s | Category: %s | Regulatory: %s | Relevance: %.2f\n", ordinal, F.coalesce(F.nullif(basename(source), F.lit("")), F.lit("Unknown")), category, F.coalesce(F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit("General")), score)
    return F.concat(head, F.coalesce(F.concat(F.lit("Section: "), section, F.lit("\n")), F.lit("")), F.lit("---\n"), content, F.lit("\n"))


def within_budget(ranked: DataFrame, block_col: str, query_id: str = "query_id", rank_col: str = "rank", chars: int = CONTEXT_CHARS) -> DataFrame:
    """The leading rows of each query whose blocks fit the budget together: everything from the first that doesn't fit is left out."""
    so_far = F.sum(F.length(block_col)).over(Window.partitionBy(query_id).orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used_chars", so_far).where(F.col("used_chars") <= chars)


def contexts(ranked: DataFrame, block_col: str, query_id: str = "query_id", rank_col: str = "rank") -> DataFrame:
    """One row a query: the blocks in rank order. Groups are as small as a query's context budget."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("rank"), F.col(block_col).alias("block"))))
    return ranked.groupBy(query_id).agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("n_sources"))


def last_turns(conversations: DataFrame, n: int = 6, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return conversations.withColumn("from_end", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("from_end") <= n)


def citations(text: Column) -> Column:
    """Distinct cited sources, sorted."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in rules.CITATION_PATTERNS))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def grounded_score(answer: Column, context: Column) -> Column:
    """Of the first five sentences over 20 characters, the share with two fifths or more of their key words in the context. Sentences
    with fewer than three key words count as not grounded."""
    sentences = F.slice(F.filter(F.transform(F.split(answer, r"\."), strip), lambda s: F.length(s) > 20), 1, 5)

    def grounded(s: Column, lower: Column) -> Column:
        keys = F.array_except(F.array_distinct(words(F.lower(s))), strings(rules.GROUNDING_STOP))
        return let(keys, lambda k: (F.size(k) >= 3) & (F.size(F.filter(k, lambda w: F.contains(lower, w))) / F.size(k) >= 0.4))

    both = F.struct(sentences.alias("s"), F.lower(context).alias("c"))
    return let(both, lambda x: F.size(F.filter(x["s"], lambda s: grounded(s, x["c"]))) / F.greatest(F.size(x["s"]), F.lit(1)))


def sentence_keys(answer: Column) -> Column:
    """array<array<string>>: the key words of the sentences that grounded_score judges."""
    sentences = F.slice(F.filter(F.transform(F.split(answer, r"\."), strip), lambda s: F.length(s) > 20), 1, 5)
    return F.transform(sentences, lambda s: F.array_except(F.array_distinct(words(F.lower(s))), strings(rules.GROUNDING_STOP)))


def score_of_counts(keys: Column, found: Column) -> Column:
    """grounded_score, of sentence_keys and how many of each sentence's words the context has."""
    grounded = F.zip_with(keys, found, lambda k, n: F.when(F.size(k) >= 3, n / F.size(k) >= 0.4).otherwise(F.lit(False)))
    return F.size(F.filter(grounded, lambda x: x)) / F.greatest(F.size(keys), F.lit(1))


def is_grounded(answer: Column, context: Column, score: Column | None = None) -> Column:
    """score: the answer's grounded_score, where it is a column already."""
    return ((grounded_score(answer, context) if score is None else score) >= 0.3) | any_in(F.lower(answer), rules.UNCERTAIN)


def admits_uncertainty(answer: Column) -> Column:
    return any_in(F.lower(answer), rules.ADMITS)


def cost_usd(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.round(prompt_tokens / 1e6 * rules.PROMPT_PRICE + completion_tokens / 1e6 * rules.COMPLETION_PRICE, 6)


def source_citation(path: Column, score: Column, content: Column) -> Column:
    preview = F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(content)
    return F.struct(basename(path).alias("source"), F.round(score, 3).alias("score"), preview.alias("preview"))


def _share(held: str, scale: float) -> Column:
    return F.when(F.col(f"{held}.n") > 0, F.least(F.col(f"{held}.found") / F.col(f"{held}.n") * scale, F.lit(1.0)))


def _overlap(of: Column, stop: list[str], text: Column, scale: float) -> Column:
    both = F.struct(F.array_except(F.array_distinct(words(of)), strings(stop)).alias("k"), text.alias("t"))
    share = lambda x: F.size(F.filter(x["k"], lambda w: F.contains(x["t"], w))) / F.size(x["k"])
    return let(both, lambda x: F.when(F.size(x["k"]) > 0, F.least(share(x) * scale, F.lit(1.0))))


def faithfulness(answer: Column, context: Column) -> Column:
    """Null where the answer has no key words: such rows don't count."""
    return _overlap(F.lower(answer), rules.ANSWER_STOP, F.lower(context), 1.2)


def relevancy(question: Column, answer: Column) -> Column:
    return _overlap(F.lower(question), rules.QUESTION_STOP, F.lower(answer), 1.3)


def cites(answer: Column) -> Column:
    return F.contains(answer, F.lit("[Source:")) | F.contains(answer, F.lit("[source:")) | F.contains(answer, F.lit("According to"))


def mentions_any(expected: Column, answer: Column) -> Column:
    """Whether the first ten characters of an expected citation occur in the answer."""
    return let(F.lower(answer), lambda a: F.exists(expected, lambda c: F.contains(a, F.lower(F.left(c, F.lit(10))))))


def p95(rows: DataFrame, value: str, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """The value at place floor(0.95 n) from 0 in sorted order; nulls don't count. Approximate percentiles, which err by n / accuracy
    places at most, bracket it ten times as wide. What lies below is counted, what lies within is counted by value, both
    before the shuffle: no group, however large, is sorted."""
    known, wide = rows.where(F.col(value).isNotNull()), 10 / accuracy
    marks = known.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, [0.95 - wide, 0.95 + wide], accuracy).alias("marks"))
    near = known.join(marks, by).where(F.col(value) <= F.col("marks")[1])
    counted = near.groupBy(*by, "n", F.when(F.col(value) >= F.col("marks")[0], F.col(value)).alias("v")).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.least(F.floor(F.col("n") * 0.95) + 1, F.col("n"))
    return counted.withColumn("upto", upto).where(F.col("upto") >= place).groupBy(*by).agg(F.min("v").alias("p95"))


def with_previous(rows: DataFrame, by: str, id_col: str, span: int = 4096) -> DataFrame:
    """rows with previous: the next smaller id in the same group of by, null for a group's least. Ids are whole numbers. Ranges of
    span ids are ordered apart, and only their last ids meet their group's, so a group of any size is spread over many tasks."""
    at = rows.withColumn("range", F.floor(F.col(id_col) / span))
    ends = at.groupBy(F.col(by).alias("of"), F.col("range").alias("of_range")).agg(F.max(id_col).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("of").orderBy("of_range"))).drop("last")
    found = at.withColumn("previous", F.lag(id_col).over(Window.partitionBy(by, "range").orderBy(id_col)))
    found = found.join(ends, F.col(by).eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    return found.withColumn("previous", F.coalesce("previous", "before")).select(*rows.columns, "previous")


def overall(f: Column, r: Column, p: Column, rc: Column, c: Column) -> Column:
    return F.round(0.30 * f + 0.25 * r + 0.15 * p + 0.15 * rc + 0.15 * c, 4)


def passes_bar(metric: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, bar in rules.QUALITY_BAR.items():
        out = out & (metric[name] <= bar if name.endswith(("leak_rate", "hallucination_rate")) else metric[name] >= bar)
    return out


def evaluate(samples: DataFrame, responses: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of by. samples: sample_id, question, regulatory_citations; responses: sample_id, answer, context. Joined by
    id, never by position. Heuristic figures cover all rows; rates those with an answer."""
    from corpusmill.operators import guardrails

    a, c = F.col("answer"), F.col("context")
    rows = samples.join(responses, "sample_id").withColumn("has", F.coalesce(a, F.lit("")) != "")
    # words are looked up in one pass of Arrow batches, which also tells which patterns can match
    rows = rows.withColumns({"said": F.lower(a), "known": F.lower(c), "asked": F.lower("question"), "s_keys": sentence_keys(a)})
    rows = rows.withColumns({"f": words_held(F.col("said"), rules.ANSWER_STOP, F.col("known")), "r": words_held(F.col("asked"), rules.QUESTION_STOP, F.col("said")), "s": held(F.col("s_keys"), F.col("known")), "may": holds(F.col("said"), [*rules.COMPLIANCE_NEEDS, rules.UNCERTAIN])})
    grounded = (score_of_counts(F.col("s_keys"), F.col("s")) >= 0.3) | F.element_at("may", -1)
    # each figure is computed once a row, in a projection, and only those that need an answer where there is one
    where = lambda figure: F.when(F.col("has"), figure)
    rows = rows.select(
        *by, "has", _share("f", 1.2).alias("f"), _share("r", 1.3).alias("r"), where(guardrails.breaks(a, F.col("may"))).alias("blocked"),
        where(guardrails.leaks(a)).alias("leaks"), where((c != "") & ~grounded).alias("invents"), where(cites(a)).alias("names"), (F.size("regulatory_citations") > 0).alias("expected"),
        where((F.size("regulatory_citations") > 0) & mentions_any(F.col("regulatory_citations"), a)).alias("meets"),
    )
    n = F.greatest(F.count_if("has"), F.lit(1))
    rate = lambda cond: F.round(F.count_if(cond) / n, 6)
    return rows.groupBy(*by).agg(
        F.round(F.coalesce(F.avg("f"), F.lit(0.0)), 6).alias("faithfulness"),
        F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 6).alias("answer_relevancy"),
        F.lit(rules.HEURISTIC_PRECISION).alias("context_precision"),
        F.lit(rules.HEURISTIC_RECALL).alias("context_recall"),
        rate(~F.col("blocked")).alias("compliance_pass_rate"),
        rate(F.col("leaks")).alias("pii_leak_rate"),
        rate(F.col("invents")).alias("hallucination_rate"),
        rate(F.col("names")).alias("citation_rate"),
        F.round(F.count_if("meets") / F.greatest(F.count_if("expected"), F.lit(1)), 6).alias("regulatory_accuracy"),
        F.count("*").alias("n_samples"),
    )


QUESTION_CHARS, COMMENT_CHARS, HISTORY = (5, 1000), 500, 6


def sound_question(question: Column, history: Column | None = None) -> Column:
    """Length before stripping within bounds, and no more history than allowed."""
    out = F.length(question).between(*QUESTION_CHARS)
    return out if history is None else out & (F.coalesce(F.size(history), F.lit(0)) <= HISTORY)


def cleaned_question(question: Column) -> Column:
    return F.replace(strip(question), F.lit("\0"), F.lit(""))


def sound_feedback(rating: Column, comment: Column) -> Column:
    return rating.between(1, 5) & (F.coalesce(F.length(comment), F.lit(0)) <= COMMENT_CHARS)


def user_message(question: Column, context: Column) -> Column:
    """The message that asks a model to answer from the context only, with sources."""
    rest = "\n\nAnswer from the documentation above only, name the source of each statement as [Source: file], and say so where it holds no answer."
    return F.concat(F.lit("DOCUMENTATION:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit(rest))


def messages(history: Column, question: Column, context: Column) -> Column:
    """The last turns of history, array<struct(role, text)>, then the user's message."""
    asked = F.struct(F.lit("user").alias("role"), user_message(question, context).alias("text"))
    turns = F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>"))
    return F.array_append(F.slice(turns, F.greatest(F.size(turns) - HISTORY + 1, F.lit(1)), HISTORY), asked)


def system_prompt(role: Column) -> Column:
    """What a model is told first, by the reader's role; unknown roles are customers."""
    out = F.lit(f"{rules.SYSTEM} {rules.TONE['customer']}")
    for name, tone in rules.TONE.items():
        out = F.when(role == name, F.lit(f"{rules.SYSTEM} {tone}")).otherwise(out)
    return out


def found_or_first(found: Column, chunks: Column, n: int = 20) -> Column:
    """What retrieval found; where that is nothing, the document's first chunks."""
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.slice(found, 1, n)).otherwise(F.slice(chunks, 1, n))


def report(metric: dict[str, Column]) -> Column:
    """A line for each figure with its bar, then the verdict."""
    lines = []
    for name, bar in rules.QUALITY_BAR.items():
        low = name.endswith(("leak_rate", "hallucination_rate"))
        good = metric[name] <= bar if low else metric[name] >= bar
        lines.append(F.concat(F.lit(f"{name}: "), F.format_string("%.4f", metric[name].cast("double")), F.lit(f" ({'at most' if low else 'at least'} {bar}) "), F.when(good, "ok").otherwise("missed")))
    return F.concat_ws("\n", *lines, F.when(passes_bar(metric), "PASS").otherwise("FAIL"))


SAMPLE = "sample_id string, question string, regulatory_citations array<string>, category string, relevant_doc_ids array<string>, ground_truth_answer string, expected_loan_type string"


def eval_samples(spark, n: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """An evaluation set, or its first n by id: rows (sample_id, question and any of SAMPLE's other columns, null where they lack), or the
    built-in samples."""
    if rows is None:
        rows = spark.createDataFrame(rules.EVAL_SAMPLES, "sample_id string, question string, regulatory_citations array<string>, category string, relevant_doc_ids array<string>")
    kinds = (x.split(" ") for x in SAMPLE.split(", "))
    rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
    return rows if n is None else rows.orderBy("sample_id").limit(n)


def write_report(evaluated: DataFrame, folder: str) -> bool:
    """Writes the figures as JSON and the reports as text below folder; returns whether every row meets the bar (the gate of a run)."""
    metric = {name: F.col(name) for name in rules.QUALITY_BAR}
    evaluated.write.mode("overwrite").json(f"{folder}/figures")
    evaluated.select(report(metric).alias("value")).write.mode("overwrite").text(f"{folder}/reports")
    return evaluated.where(~passes_bar(metric)).limit(1).count() == 0
