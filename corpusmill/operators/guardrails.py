"""Personal data and compliance rules over text columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import rules


def pii_counts(text: Column, min_confidence: float = rules.MIN_CONFIDENCE, threshold: str = rules.RISK_THRESHOLD) -> dict[str, Column]:
    """For each rule that applies, the number of its matches; overlaps between rules count for both."""
    least = rules.RISKS.index(threshold)
    return {kind: F.regexp_count(text, F.lit(pattern)) for kind, risk, sure, pattern, _ in rules.PII_RULES if sure >= min_confidence and rules.RISKS.index(risk) >= least}


def pii_count_struct(text: Column, min_confidence: float = rules.MIN_CONFIDENCE, threshold: str = rules.RISK_THRESHOLD) -> Column:
    """The counts as one struct, so that several figures can be drawn from one scan of the text."""
    return F.struct(*(n.alias(kind) for kind, n in pii_counts(text, min_confidence, threshold).items()))


def high_risk_count(text: Column) -> Column:
    risk_of = {kind: risk for kind, risk, *_ in rules.PII_RULES}
    return sum((n for kind, n in pii_counts(text).items() if risk_of[kind] == "high"), F.lit(0))


def leaks(text: Column) -> Column:
    """Whether a high-risk rule matches: high_risk_count(text) > 0, without counting."""
    out = F.lit(False)
    for kind, risk, sure, pattern, _ in rules.PII_RULES:
        if risk == "high" and sure >= rules.MIN_CONFIDENCE:
            out = out | text.rlike(pattern)
    return F.when(text.rlike(rules.HIGH_PII_NEEDS), out).otherwise(F.lit(False))


def should_block_pii(text: Column) -> Column:
    return high_risk_count(text) >= rules.BLOCK_HIGH_ENTITIES


@cache
def _compiled() -> list[tuple[str, str, float, re.Pattern, str]]:
    return [(kind, risk, sure, re.compile(pattern), mask) for kind, risk, sure, pattern, mask in rules.PII_RULES]


def find_entities(text: str, min_confidence: float = rules.MIN_CONFIDENCE, threshold: str = rules.RISK_THRESHOLD) -> list[tuple]:
    """(entity_type, value, start, end, confidence, risk_level), by start and rule order."""
    least, found = rules.RISKS.index(threshold), []
    for order, (kind, risk, sure, pattern, _) in enumerate(_compiled()):
        if sure >= min_confidence and rules.RISKS.index(risk) >= least:
            found += [(m.start(), order, kind, m[0], m.end(), sure, risk) for m in pattern.finditer(text)]
    return [(kind, value, start, end, sure, risk) for start, _, kind, value, end, sure, risk in sorted(found)]


def redact_text(text: str, entities: list[tuple]) -> str:
    """Each span replaced by its mask; of overlapping spans the first stays and the others are dropped, so no fragment is left."""
    mask = {kind: put for kind, *_, put in rules.PII_RULES}
    out, at = [], 0
    for kind, _, start, end, _, _ in entities:
        if start >= at:
            out += [text[at:start], mask[kind]]
            at = end
    return "".join([*out, text[at:]])


def redaction(text: Column) -> Column:
    """struct(entities, redacted, risk_level, was_modified); spans need the matches' places, so this part runs on Arrow batches."""
    kind = "entities array<struct<entity_type:string,value:string,start:int,end:int,confidence:double,risk_level:string>>, redacted string, risk_level string, was_modified boolean"

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fields = ("entity_type", "value", "start", "end", "confidence", "risk_level")
        for batch in batches:
            rows = []
            for text in batch:
                found = find_entities(text) if text else []
                risk = max((x[5] for x in found), key=rules.RISKS.index, default="low")
                rows.append(([dict(zip(fields, x)) for x in found], redact_text(text, found) if text is not None else None, risk, bool(found)))
            yield pd.DataFrame(rows, columns=["entities", "redacted", "risk_level", "was_modified"])

    return of(text)


def without_overlaps(spans: DataFrame, fixed: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """spans (key, start, end) that overlap none of the fixed ones of their key: those that, of all fixed ones that start before the span
    ends, no end lies behind the span's start. A sweep in the order of those places carries the greatest end along, so a key with many
    of both costs their sorting and never their pairs. Ranges of `width` places are swept apart and only their greatest ends meet
    in a key's order, so that a key that a third of all rows share is spread over many tasks. A null key overlaps nothing."""
    rows = spans.select(F.struct(*spans.columns).alias("row"), F.col(key).alias("k"), F.col("end").cast("long").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("reach"))
    ends = fixed.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col("start").cast("long").alias("at"), F.lit(1).alias("turn"), F.col("end").cast("long").alias("reach"))
    both = rows.union(ends.where("k IS NOT NULL")).withColumn("range", F.floor(F.col("at") / width))
    before = Window.partitionBy("of").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy(F.col("k").alias("of"), F.col("range").alias("of_range")).agg(F.max("reach").alias("most")).withColumn("earlier", F.max("most").over(before)).drop("most")
    within = Window.partitionBy("k", "range").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("here", F.max("reach").over(within)).where("turn = 0")
    swept = swept.join(ranges, F.col("k").eqNullSafe(F.col("of")) & F.col("range").eqNullSafe(F.col("of_range")))
    free = ~(F.coalesce(F.greatest("here", "earlier") > F.col("row.start"), F.lit(False)))
    return swept.where(F.col("k").isNull() | free).select("row.*")


def violations(text: Column, table: list = rules.COMPLIANCE_RULES) -> Column:
    """array<struct(violation_type, severity, regulation, matched_text)>: the first match of each pattern of a rule table (type,
    severity, regulation, patterns), in its order."""
    found = []
    for kind, severity, regulation, patterns in table:
        for pattern in patterns:
            match = F.regexp_extract(text, f"(?i){pattern}", 0)
            found.append(F.when(match != "", F.struct(F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"), F.lit(regulation).alias("regulation"), match.alias("matched_text"))))
    return F.array_compact(F.array(*found))


def blocks(found: Column, at: str = "high") -> Column:
    strong = rules.SEVERITIES[rules.SEVERITIES.index(at) :]
    return F.exists(found, lambda v: v["severity"].isin(strong))


def breaks(text: Column, may: Column, at: str = "high") -> Column:
    """blocks(violations(text), at), where may says of each pattern in turn whether text holds what its matches need."""
    strong = rules.SEVERITIES[rules.SEVERITIES.index(at) :]
    each = [(severity, pattern) for _, severity, _, patterns in rules.COMPLIANCE_RULES for pattern in patterns]
    out = F.lit(False)
    for k, (severity, pattern) in enumerate(each):
        if severity in strong:
            out = out | F.when(may[k], text.rlike(f"(?i){pattern}")).otherwise(F.lit(False))
    return out


def of_severity(found: Column, severity: str) -> Column:
    """The violations of one severity."""
    return F.filter(found, lambda v: v["severity"] == severity)


def disclaimer(text: Column) -> Column:
    """The first disclaimer whose pattern occurs and that text doesn't hold yet."""
    return F.coalesce(*(F.when((F.regexp_extract(text, pattern, 0) != "") & ~F.contains(text, F.lit(note)), F.lit(note)) for pattern, note in rules.DISCLAIMERS))


def checked(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with violations, should_block, is_compliant, disclaimer_added and modified_text (null where nothing is added)."""
    out = rows.withColumn("violations", violations(F.col(text_col)))
    out = out.withColumns({"should_block": blocks(F.col("violations")), "is_compliant": F.size("violations") == 0})
    note = F.when(~F.col("should_block"), disclaimer(F.col(text_col)))
    return out.withColumns({"disclaimer_added": note.isNotNull(), "modified_text": F.concat(F.col(text_col), note)})
