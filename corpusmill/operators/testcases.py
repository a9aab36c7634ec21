"""Test cases: parsing model output, review, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions.text import strip

STEP = "struct<step_number:int,action:string,expected:string>"
CASE = f"struct<title:string,test_type:string,priority:string,preconditions:array<string>,steps:array<{STEP}>,expected_result:string,linked_requirement:string,tags:array<string>>"
# fixed value: the gap that stands for output which can't be read
UNPARSED = "LLM returned unparseable output"


def _list(text: Column) -> Column:
    """The items of a JSON array as text; null if it isn't one."""
    return F.from_json(text, "array<string>")


def parsed(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """outputs with cases (array) and coverage_gaps: code fences go; from the first line that starts with {"coverage_gaps" on, the rest is
    the gaps; before it stands an array of cases, or the longest [...] of it does. Cases with an unknown type or priority, or
    steps without number, action and expected, are dropped."""
    text = strip(F.regexp_replace(raw, "```[a-z]*", ""))
    trailer = r'(?s)(?:^|\n)[ \t]*(\{ ?"coverage_gaps".*)$'
    gaps = F.from_json(F.nullif(F.regexp_extract(text, trailer, 1), F.lit("")), "coverage_gaps array<string>")["coverage_gaps"]
    main = F.regexp_replace(text, trailer, "")
    items = F.coalesce(_list(main), _list(F.nullif(F.regexp_extract(main, r"(?s)\[.*\]", 0), F.lit(""))))
    cases = F.transform(items, lambda x: F.from_json(x, CASE))
    whole = lambda c: F.struct(
        F.coalesce(c["title"], F.lit("Untitled")).alias("title"), F.coalesce(c["test_type"], F.lit("functional")).alias("test_type"), F.coalesce(c["priority"], F.lit("P2 - Medium")).alias("priority"),
        F.coalesce(c["preconditions"], F.array().cast("array<string>")).alias("preconditions"), F.coalesce(c["steps"], F.array().cast(f"array<{STEP}>")).alias("steps"),
        F.coalesce(c["expected_result"], F.lit("")).alias("expected_result"), F.coalesce(c["linked_requirement"], F.lit("")).alias("linked_requirement"), F.coalesce(c["tags"], F.array().cast("array<string>")).alias("tags"),
    )
    sound = lambda c: c["test_type"].isin(rules.TEST_TYPES) & c["priority"].isin(list(rules.PRIORITIES)) & F.forall(c["steps"], lambda s: s["step_number"].isNotNull() & s["action"].isNotNull() & s["expected"].isNotNull())
    kept = F.filter(F.transform(F.filter(cases, lambda c: c.isNotNull()), whole), sound)
    nothing = F.array().cast("array<string>")
    return outputs.withColumns({"cases": F.coalesce(kept, F.array().cast(f"array<{CASE}>")), "coverage_gaps": F.when(items.isNull(), F.array(F.lit(UNPARSED))).otherwise(F.coalesce(gaps, nothing))})


def prompts(requests: DataFrame, most: int = rules.PROMPT_CASES) -> DataFrame:
    """requests (chunks array, test_types array) with prompt: the first chunks, the types wanted, an example for each type that has one,
    and how many cases are wished for, which nothing enforces."""
    table = F.create_map(*(F.lit(x) for pair in rules.EXAMPLES.items() for x in pair))
    shown = F.transform(F.filter("test_types", lambda t: t.isin(list(rules.EXAMPLES))), lambda t: F.element_at(table, t))
    text = F.concat(
        F.lit("REQUIREMENTS:\n"), F.array_join(F.slice("chunks", 1, rules.PROMPT_CHUNKS), "\n\n---\n\n"),
        F.lit(f"\n\nWrite up to {most} test cases of these types: "), F.array_join("test_types", ", "),
        F.lit(".\nEach names the requirement it tests. After the JSON array, on a line of its own: {\"coverage_gaps\": [...]}.\n\nEXAMPLES:\n"), F.array_join(shown, "\n"),
    )
    return requests.withColumn("prompt", text)


def generated(requests: DataFrame, generate, most: int = rules.PROMPT_CASES) -> DataFrame:
    """requests with prompt, raw, cases and coverage_gaps: generate is a function from a prompt column to a model's output."""
    return parsed(prompts(requests, most).withColumn("raw", generate(F.col("prompt"))))


def outcomes(requests: DataFrame, cases: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """requests (key, format) with outcome: unknown format, not found (no such document), no cases, or ready; and the number of cases."""
    known = documents.select(key).distinct().withColumn("known", F.lit(True))
    counted = cases.groupBy(key).agg(F.count("*").alias("cases"))
    rows = requests.join(known, key, "left").join(counted, key, "left").withColumn("cases", F.coalesce("cases", F.lit(0)))
    outcome = F.when(~F.col("format").isin(list(EXPORTS)), "unknown format").when(F.col("known").isNull(), "not found").when(F.col("cases") == 0, "no cases").otherwise("ready")
    return rows.withColumn("outcome", outcome).drop("known")


def reviewed(cases: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    """approve and reject set the status; edit with an edited title replaces it and approves; anything else changes nothing. One review
    a case."""
    r = reviews.select(F.col(key).alias("__key"), "action", "edited_title")
    out = cases.join(r, F.col(key) == F.col("__key"), "left")
    edit = (F.col("action") == "edit") & F.col("edited_title").isNotNull()
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").when(edit, "approved").otherwise(F.col("status"))
    return out.withColumns({"status": status, "title": F.when(edit, F.col("edited_title")).otherwise(F.col("title"))}).drop("__key", "action", "edited_title")


def csv_rows(cases: DataFrame) -> DataFrame:
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["step_number"].cast("string"), F.lit(". "), s["action"], F.lit(" → "), s["expected"])), " | ")
    return cases.select(
        F.col("id").alias("Test ID"), F.col("title").alias("Title"), F.col("test_type").alias("Type"), F.col("priority").alias("Priority"), F.array_join("preconditions", "; ").alias("Preconditions"),
        steps.alias("Steps"), F.col("expected_result").alias("Expected Result"), F.col("linked_requirement").alias("Linked Requirement"), F.array_join("tags", ", ").alias("Tags"), F.col("status").alias("Status"),
    )


def jira_rows(cases: DataFrame) -> DataFrame:
    priority = F.create_map(*(F.lit(x) for pair in rules.PRIORITIES.items() for x in pair))
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("<b>Step "), s["step_number"].cast("string"), F.lit(":</b> "), s["action"], F.lit(" — <i>Expected: "), s["expected"], F.lit("</i>"))), "<br/>")
    text = F.concat(F.lit("<b>Preconditions:</b> "), F.array_join("preconditions", "; "), F.lit("<br/><b>Steps:</b><br/>"), steps, F.lit("<br/><b>Expected Result:</b> "), F.col("expected_result"))
    return cases.select(
        F.concat(F.lit("["), "id", F.lit("] "), "title").alias("Summary"), F.lit("Test").alias("Issue Type"), F.coalesce(F.try_element_at(priority, F.col("priority")), F.lit("Medium")).alias("Priority"),
        text.alias("Description"), F.array_join("tags", " ").alias("Labels"), F.col("linked_requirement").alias("Custom Field (Linked Req)"),
    )


def json_rows(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.to_json(F.struct("id", "title", "test_type", "priority", "preconditions", "steps", "expected_result", "linked_requirement", "tags", "status")).alias("json"))


EXPORTS = {"csv": csv_rows, "json": json_rows, "jira": jira_rows}


def export(cases: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """The rows of an export; with a path they are written there too, by every executor its part."""
    if kind not in EXPORTS:
        raise ValueError(f"format must be one of {', '.join(EXPORTS)}")
    rows = EXPORTS[kind](cases)
    if path:
        rows.write.mode("overwrite").text(path) if kind == "text" else rows.write.mode("overwrite").csv(path, header=True) if kind != "json" else rows.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
    return rows
