"""The answering pipeline over a table of questions: guard, retrieve, rerank, build the context, generate, guard, account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import answers, classify, guardrails, metrics, retrieval


def extractive(question: Column, context: Column) -> Column:
    """Offline stand-in of a generating model: the context's first sentence with its source."""
    return F.when(context == answers.NOTHING_FOUND, F.lit("This is not in the documentation. Please contact your loan officer.")).otherwise(
        F.concat(F.lit("According to [Source: "), F.regexp_extract(context, r"\[SOURCE 1\] ([^|\n]*) \|", 1), F.lit("]: "), F.regexp_extract(context, r"(?s)---\n([^.]{0,300})", 1), F.lit("."))
    )


#: What stands in for an answer that breaks a rule.
WITHHELD = "This question cannot be answered in full here. Please contact your loan officer."


def guarded(rows: DataFrame, text_col: str = "answer") -> DataFrame:
    """rows with the output's guards: violations, should_block, disclaimer_added, pii_types, and final: the withheld note where the text
    breaks a rule, else the text without personal data, else the text with its disclaimer, else the text."""
    out = guardrails.checked(rows, text_col).withColumn("masked", guardrails.redaction(F.col(text_col)))
    final = F.when(F.col("should_block"), F.lit(WITHHELD)).when(F.col("masked.was_modified"), F.col("masked.redacted")).otherwise(F.coalesce("modified_text", text_col))
    return out.withColumns({"pii_types": F.array_distinct(F.transform("masked.entities", lambda e: e["entity_type"])), "final": F.when(F.col(text_col).isNotNull(), final)}).drop("masked")


def answer(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 10, generate: Callable[[Column, Column], Column] = extractive, bound: DataFrame | None = None, model: str = "stand-in") -> DataFrame:
    """One row a question. queries: query_id, question, user_role, query_vector; docs: doc_id, content, source_file, access_level
    and, if they are known, document_category and regulatory_tags; vectors: vec_id (= doc_id), embedding. Personal data is masked in
    questions before they are used, and in answers. Blocked questions keep their row, with block_reason, and cost no retrieval.
    Access levels filter both lists; BM25 statistics are the whole corpus's. bound: a table whose size bounds the questions',
    if the engine can't tell."""
    asked = retrieval.with_role(queries).withColumn("asked", guardrails.redaction(F.col("question")))
    entities, found = guardrails.should_block_pii(F.col("question")), guardrails.violations(F.col("question"))
    asked = asked.withColumn("block_reason", F.when(entities, "pii").when(guardrails.blocks(found), "compliance"))
    asked = asked.withColumns({"question": F.col("asked.redacted"), "question_pii": F.array_distinct(F.transform("asked.entities", lambda e: e["entity_type"]))}).drop("asked")
    open_ = asked.where(F.col("block_reason").isNull())
    levels = open_.select("query_id", "access_levels", "max_chunks", "question")
    dense, sparse = retrieval.visible_lists(open_, docs, vectors, 2 * k, bound)
    fused = retrieval.hybrid(dense, sparse, k, "doc_id")
    found = docs.join(retrieval.small(fused, bound), "doc_id")
    # where docs aren't classified yet, only what is found is
    rows = (found if "document_category" in docs.columns else classify.classified(found)).join(retrieval.small(levels, bound), "query_id")
    best = retrieval.rerank(rows, k, "doc_id").where(F.col("rerank_rank") <= F.col("max_chunks"))
    block = answers.source_block(F.col("rerank_rank"), F.col("source_file"), F.col("document_category"), F.col("regulatory_tags"), F.col("rerank_score"), F.lit(None).cast("string"), F.col("content"))
    context = answers.contexts(answers.within_budget(best.withColumn("block", block), "block", rank_col="rerank_rank"), "block", rank_col="rerank_rank")
    ranked = F.array_sort(F.collect_list(F.struct("rerank_rank", "rerank_score", "document_category", "doc_id")))
    used = best.groupBy("query_id").agg(ranked.alias("used"))

    out = asked.select("query_id", "question", "user_role", "block_reason", "question_pii").join(context, "query_id", "left").join(used, "query_id", "left")
    ran = F.col("block_reason").isNull()
    out = out.withColumn("context", F.when(ran, F.coalesce("context", F.lit(answers.NOTHING_FOUND))))
    out = guarded(out.withColumn("answer", F.when(ran, generate(F.col("question"), F.col("context")))))
    out = out.withColumn("block_reason", F.coalesce("block_reason", F.when(F.col("should_block"), "output_compliance")))
    prompt, completion = retrieval.tokens_of(F.concat_ws("", "question", "context")), retrieval.tokens_of(F.col("answer"))
    tokens = {"prompt_tokens": F.when(ran, prompt).otherwise(0), "completion_tokens": F.when(ran, completion).otherwise(0)}
    out = out.withColumns({**tokens, "document_ids": F.coalesce(F.transform("used", lambda x: x["doc_id"]), F.array().cast("array<bigint>")), "retrieval_scores": F.coalesce(F.transform("used", lambda x: x["rerank_score"]), F.array().cast("array<double>"))})
    return out.select(
        "query_id", "question", "user_role", "block_reason", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.col("final").alias("answer"), F.coalesce("disclaimer_added", F.lit(False)).alias("disclaimer_added"),
        F.when(ran, F.round(answers.grounded_score(F.col("answer"), F.col("context")), 6)).alias("grounded_score"), F.when(ran, answers.is_grounded(F.col("answer"), F.col("context"))).alias("is_grounded"),
        "question_pii", "pii_types", F.transform("violations", lambda v: v["violation_type"]).alias("violation_types"), "document_ids", "retrieval_scores", F.coalesce(F.get("used", F.lit(0))["document_category"], F.lit("general")).alias("document_category"),
        "prompt_tokens", "completion_tokens", answers.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost_usd"), F.lit(model).alias("model"),
    )


def audit_rows(answered: DataFrame, key: bytes, at: str | None = None) -> DataFrame:
    """The signed audit rows of answered questions: blocked or processed, with previews, documents, tokens and cost."""
    rows = answered.withColumn("user_id", F.col("user_role"))
    events = metrics.query_events(rows).join(rows.select("query_id", "user_role", "document_ids", "question_pii", "violation_types", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens_used"), "cost_usd"), "query_id")
    return metrics.signed(metrics.stamped(events, at, ["query_id", "user_role"]), key)


def metric_rows(answered: DataFrame) -> DataFrame:
    """(metric, labels, value) of answered questions and of those that guards have stopped."""
    done = answered.where("block_reason IS NULL OR block_reason = 'output_compliance'").select("user_role", "document_category", F.lit(True).alias("success"), F.col("prompt_tokens").alias("tokens_input"), F.col("completion_tokens").alias("tokens_output"), "model", "cost_usd", "retrieval_scores", F.lit(False).alias("cache_hit"))
    watched = answered.select(F.col("question_pii").alias("pii_types"), F.coalesce("violation_types", F.array().cast("array<string>")).alias("violation_types"), "block_reason")
    return metrics.observations(done).union(metrics.security_observations(watched))
