"""Chunking by its stated behaviour, redaction beside a plain version, readers, ingest runs, reports, models that fail, readiness."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.operators import access, answers, chunking, guardrails, metrics, retrieval, testcases
from corpusmill.plans import answering, catalogue, ingest
from corpusmill.sources import loaders
from corpusmill.sources.store import ChunkStore

SF = "/root/testdata/sf0.001"


# ---- chunks


@pytest.mark.parametrize(
    "text, size, overlap, want",
    [
        ("short", 10, 2, ["short"]),
        ("  \n ", 10, 2, []),
        ("aa bb cc dd", 6, 0, ["aa bb", "cc dd"]),  # words joined while they and their spaces fit
        ("aa bb cc dd", 6, 2, ["aa bb", "bb cc", "cc dd"]),  # each opens with the last two characters of the one before
        ("aa. bb cc dd. ee", 8, 0, ["aa", "bb cc dd", "ee"]),  # the coarser separator first; a piece as long as size stays whole
        ("aa\n\nbb bb bb b\n\ncc", 8, 0, ["aa", "bb bb", "bb b\n\ncc"]),  # a long piece's last part goes on with what follows
        ("abcdefgh", 3, 0, ["abc", "def", "gh"]),  # no separator: characters
        ("a\n\n\n \n\n\nb c d", 5, 0, ["a", "b c d"]),  # blank pieces are left out
    ],
)
def test_chunks_by_hand(text, size, overlap, want):
    assert chunking.split_recursive(text, size, overlap) == want


def test_chunks_hold_the_text_in_order():
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 80))]
        text = "".join(w + rng.choice(["\n\n\n", "\n\n", "\n", ". ", "? ", "; ", ", ", " "]) for w in words)
        size = rng.randint(20, 120)
        found = chunking.split_recursive(text, size, 0)
        squeeze = lambda x: re.sub(r"[^a-f]", "", x)
        assert squeeze("".join(found)) == squeeze(text) and all(len(x) <= size + 3 for x in found)
        over = chunking.split_recursive(text, size, 10)
        assert all(len(x) <= size + 10 + 3 for x in over)
        spans = chunking.located(text, found, 0)
        assert all(a <= b for (a, _), (b, _) in zip(spans, spans[1:]))


def test_custom_separators_and_lengths(spark):
    docs = spark.createDataFrame([(1, "one|two|three|four")], "id long, text string")
    rows = chunking.recursive_chunks(docs, "id", "text", size=2, overlap=0, least=1, separators=["|"], length=lambda x: x.count("|") + 1).collect()
    assert [r["content"] for r in rows] == ["one", "two", "three", "four"]


def test_chunk_query_beside_the_splitter(spark):
    rows = catalogue.chunk_recursive(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_index"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {k for k, t in texts.items() if any(len(x) >= 50 for x in chunking.split_recursive(t or ""))}
    for k, found in by_doc.items():
        want = [x for x in chunking.split_recursive(texts[k]) if len(x.strip()) >= 50]
        assert [r["content"] for r in found] == want and {r["total_chunks"] for r in found} == {len(want)}
        assert [(r["char_start"], r["char_end"]) for r in found] == chunking.located(texts[k], want)
    stats = {r["access_level"]: r for r in catalogue.chunk_stats(spark, SF).collect()}
    for level, r in stats.items():
        mine = [x for x in rows if x["access_level"] == level]
        assert (r["chunks"], r["documents"], r["mean_chars"]) == (len(mine), len({x["doc_id"] for x in mine}), sum(len(x["content"]) for x in mine) // len(mine))


def test_redaction_query_beside_a_plain_version(spark):
    """All spans of all rules by start and rule; from the left, each that begins behind the one before is masked."""
    got = {r["doc_id"]: r for r in catalogue.pii_redact(spark, SF).collect()}
    import hashlib

    seen = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        spans = sorted((m.start(), k, m.end(), mask, risk) for k, (_, risk, sure, pattern, mask) in enumerate(rules.PII_RULES) if sure >= 0.75 and risk != "low" for m in re.finditer(pattern, r["text"]))
        text, shift, end = r["text"], 0, 0
        for a, _, b, mask, _ in spans:
            if a >= end:
                text = text[: a + shift] + mask + text[b + shift :]
                shift, end = shift + len(mask) - (b - a), b
        seen += len(spans)
        risk = "high" if any(x[4] == "high" for x in spans) else "medium" if spans else "low"
        one = got[r["doc_id"]]
        assert (one["n_entities"], one["redacted_md5"], one["risk_level"], one["was_modified"]) == (len(spans), hashlib.md5(text.encode()).hexdigest(), risk, bool(spans))
    assert seen > 10


# ---- readers


def test_plain_readers_and_sheets():
    assert loaders.plain_html(b"<p>One <b>two</b></p>\n<script>x=1</script>") == ("One\ntwo\nx=1", 1)
    assert loaders.plain_pdf(b"%PDF no pages \xff here")[0].startswith("%PDF no pages")
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/first.xml"/><Relationship Id="r2" Target="/xl/worksheets/second.xml"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1"><v>1</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/second.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert loaders.read_xlsx(out.getvalue()) == ("[Sheet: B]\n | 7\n[Sheet: A]\n1 |  | x", 1)
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    assert loaders.plain_docx(out.getvalue()) == ("One\nTwo", 1)


# ---- ingest


def test_ingest_run(spark, tmp_path):
    text = "Loans need documents. " * 40
    docs = spark.createDataFrame([(1, text, "a", "public"), (2, text * 2, "b", "internal"), (3, " ", "a", "public")], "doc_id long, content string, document_category string, access_level string")
    keep = ["document_category", "access_level"]
    dry, groups, rate = ingest.ingest(docs, None, keep, dry_run=True)
    n = {k: len([x for x in chunking.split_recursive(text * k) if len(x) >= 50]) for k in (1, 2)}
    assert tuple(dry.first()) == (3, 1, n[1] + n[2], 0) and rate == 0
    assert [tuple(r) for r in groups.select("document_category", "chunks").collect()] == [("b", n[2]), ("a", n[1])]
    schema = "chunk_id string, doc_id long, document_category string, access_level string, content string, chunk_index int, total_chunks int, char_start int, char_end int, token_estimate int, section_title string, vector array<float>"
    store = ChunkStore(spark, f"file://{tmp_path}/s", schema, settings={"dimension": 64})
    for _ in range(2):  # again: the same keys, replaced
        found, _, rate = ingest.ingest(docs, store, keep)
        assert tuple(found.first()) == (3, 1, n[1] + n[2], n[1] + n[2]) and rate > 0 and store.read().count() == n[1] + n[2]


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    text = "Loans need documents. " * 40
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "a.txt").write_text(text)
    (folder / "b.mp4").write_bytes(b"x")
    (folder / "c.docx").write_bytes(b"no zip")
    n = len([x for x in chunking.split_recursive(text) if len(x) >= 50])
    run = lambda state: ingest.ingest_stream(spark, str(folder), out, f"{tmp_path}/{state}").awaitTermination()
    run("state")
    assert tuple(ingest.taken_in(spark, out).first()) == (1, 1, 1, n, 1)
    run("state")  # nothing new
    assert tuple(ingest.taken_in(spark, out).first()) == (1, 1, 1, n, 1)
    (folder / "d.txt").write_text(text + "And more of them, this time.")
    run("state")
    first = ingest.taken_in(spark, out).first()
    assert tuple(first)[:3] == (2, 1, 1) and first["stored"] > n and first["documents"] == 2
    offsets = sorted((tmp_path / "state/commits").glob("[0-9]*"))
    offsets[-1].unlink()  # as if the last batch had been written, but not known to be
    for x in (tmp_path / "state/commits").glob(f".{offsets[-1].name}.crc"):
        x.unlink()
    run("state")
    assert tuple(ingest.taken_in(spark, out).first()) == tuple(first)
    held = spark.read.parquet(f"{out}/chunks")
    assert held.count() == held.select("doc_id", "chunk_index").distinct().count() and held.where("size(vector) = 64").count() == held.count()


def test_models_are_asked_again_and_in_batches():
    asked = []

    def model(texts):
        asked.append(len(texts))
        if len(asked) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert retrieval.retried(model, 3, 0.001)(["a", "b"]) == [[1.0], [1.0]] and asked == [2, 2, 2]
    asked.clear()
    with pytest.raises(OSError):
        retrieval.retried(model, 2, 0.001)(["a"])


def test_embedding_asks_for_each_new_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "known")], "id long, text string")
    cached = spark.createDataFrame([("known", [9.0])], "text string, vector array<float>").select(retrieval.cache_key("m", F.col("text")).alias("key"), "vector")
    found = {r["id"]: r for r in retrieval.embedded(docs, cached, "m", retrieval.hashed_terms(4), 4, batch=1).collect()}
    assert found[4]["vector"] == [9.0] and found[4]["cached"] and found[4]["tokens"] == 0
    assert found[1]["vector"] == found[2]["vector"] and len(found[3]["vector"]) == 4 and found[1]["tokens"] == 1


# ---- reports, access


def test_report_files_and_gate(spark, tmp_path):
    good = {name: bar for name, bar in rules.QUALITY_BAR.items()}
    rows = spark.createDataFrame([("r1", *good.values())], "run string, " + ", ".join(f"{x} double" for x in good))
    assert answers.write_report(rows, f"file://{tmp_path}/a")
    assert not answers.write_report(rows.withColumn("faithfulness", F.lit(0.1)), f"file://{tmp_path}/b")
    written = lambda folder: "".join(x.read_text() for x in (tmp_path / folder).glob("part-*"))
    assert json.loads(written("a/figures"))["run"] == "r1"
    assert "PASS" in written("a/reports") and "FAIL" in written("b/reports")


def test_readiness_is_that_of_all_parts():
    assert access.ready({"a": lambda: True, "b": lambda: True}) == (True, {"a": True, "b": True})
    assert access.ready({"a": lambda: True, "b": lambda: 1 / 0}) == (False, {"a": True, "b": False})


def test_samples_and_random_stamps(spark):
    assert answers.eval_samples(spark).count() == 5 and [r[0] for r in answers.eval_samples(spark, 2).select("sample_id").collect()] == ["eval_001", "eval_002"]
    rows = metrics.stamped(spark.range(3)).collect()
    assert len({r["event_id"] for r in rows}) == 3 and all(re.fullmatch(r"\d{4}-\d\d-\d\dT.*\+00:00", r["ts"]) for r in rows)
    with pytest.raises(ValueError):
        metrics.labelled("queries_total", user_role=F.lit("x"))
    assert len(rules.COUNTERS) == 11 and len(rules.BUCKETS) == 10 and len(rules.GAUGES) == 4


def test_percentiles_of_hot_and_small_groups(spark):
    rng = random.Random(6)
    rows = [("hot", float(rng.choice([1, 2, 3]) if k % 2 else rng.random() * 100)) for k in range(5000)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("null", None)] + [(f"n{n}", float(k)) for n in range(3, 45) for k in range(n)]
    found = dict(map(tuple, answers.p95(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()))
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert found == {g: sorted(v)[min(int(len(v) * 0.95), len(v) - 1)] for g, v in groups.items()}


def test_previous_ids_over_ranges(spark):
    rng = random.Random(7)
    ids = rng.sample(range(-500, 5000), 400)
    rows = [(k, rng.choice(["a", "a", "b", None])) for k in ids]
    found = {r["id"]: r["previous"] for r in answers.with_previous(spark.createDataFrame(rows, "id long, g string"), "g", "id", span=64).collect()}
    for k, g in rows:
        assert found[k] == max((x for x, h in rows if h == g and x < k), default=None)


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    catalogue.hybrid_topk(spark, SF)
    catalogue.knn_topk(spark, SF)
    jobs = tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a Parquet file's schema is a job of its own
    assert len(jobs) <= 12


def test_tag_filter_and_least_rank_score(spark):
    rows = spark.createDataFrame([(1, ["TILA"]), (2, []), (3, ["RESPA", "TILA"])], "id long, tags array<string>")
    assert {r["id"] for r in rows.where(retrieval.matches(tags=["TILA"], tag=F.col("tags"))).collect()} == {1, 3}
    dense = spark.createDataFrame([(1, k, 1 - k / 10, k) for k in range(1, 6)], "query_id long, doc_id long, score double, rank int")
    assert retrieval.hybrid(dense, dense.limit(0), 10, "doc_id", least=0.0111).count() == 3
    failed = spark.createDataFrame([(1, k, k, "q", "c") for k in (1, 2, 3)], "query_id long, doc_id long, rank int, question string, content string")
    got = retrieval.rerank(failed, 2, "doc_id", score=F.when(F.col("doc_id") == 3, 0.5)).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rerank_rank"])] == [3, 1]  # rows that the model fails on keep their order behind the rest


def test_generated_cases_and_rule_tables(spark):
    rows = spark.createDataFrame([(["a requirement"], ["performance", "uat"])], "chunks array<string>, test_types array<string>")
    got = testcases.generated(rows, lambda p: F.lit('[{"title": "T"}]')).first()
    assert got["cases"][0]["title"] == "T" and "a requirement" in got["prompt"] and '"performance"' in got["prompt"] and got["coverage_gaps"] == []
    own = [("kind", "high", "R", [r"\bforbidden\b"])]
    found = spark.createDataFrame([("a Forbidden word",)], "t string").select(guardrails.violations(F.col("t"), own).alias("v")).first()["v"]
    assert [(v["violation_type"], v["matched_text"]) for v in found] == [("kind", "Forbidden")]


def test_output_guards(spark):
    said = [
        (1, "Scores of 580 qualify. I can guarantee you a rate. Contact us at loans@bank.com."),
        (2, "Write to loans@bank.com about the rate."),
        (3, "The interest rate moves."),
        (4, "Nothing to note."),
        (5, None),
    ]
    found = {r["query_id"]: r for r in answering.guarded(spark.createDataFrame(said, "query_id long, answer string")).collect()}
    assert found[1]["should_block"] and found[1]["final"] == answering.WITHHELD and found[1]["pii_types"] == ["email"]
    assert found[2]["final"] == "Write to [REDACTED-EMAIL] about the rate." and found[3]["final"].startswith("The interest rate moves.\n\n*Rates are subject")
    assert found[4]["final"] == "Nothing to note." and found[5]["final"] is None


def test_questions_through_the_whole_pipeline(spark):
    docs = spark.createDataFrame([(k, f"Loan {k} needs a score of {600 + k}. It is fixed.", f"d{k}.pdf", "loan_product", ["TILA"], ["public", "restricted"][k % 2]) for k in range(12)], "doc_id long, content string, source_file string, document_category string, regulatory_tags array<string>, access_level string")
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(12)], "vec_id long, embedding array<double>")
    asks = [(1, "What score does loan 4 need? Mail a@b.com", "customer", [1.0, 0.4]), (2, "123-45-6789 and 4111111111111111 and 12-3456789", "customer", [1.0, 0.0]), (3, "score of loan 5", "admin", [1.0, 0.5])]
    out = answering.answer(spark.createDataFrame(asks, "query_id long, question string, user_role string, query_vector array<double>"), docs, vectors).cache()
    rows = {r["query_id"]: r for r in out.collect()}
    assert rows[2]["block_reason"] == "pii" and rows[2]["answer"] is None and rows[2]["prompt_tokens"] == 0 and "123-45" not in rows[2]["question"]
    assert rows[1]["block_reason"] is None and "a@b.com" not in rows[1]["question"] and rows[1]["n_sources"] == 3 and all(k % 2 == 0 for k in rows[1]["document_ids"])
    assert rows[3]["n_sources"] == 5 and rows[3]["document_category"] == "loan_product" and rows[3]["cost_usd"] > 0
    audit = {r["query_id"]: r for r in answering.audit_rows(out, b"k", "2024-01-01").collect()}
    assert audit[2]["event_type"] == "QUERY_BLOCKED" and audit[1]["event_type"] == "QUERY_PROCESSED" and len({r["hmac_signature"] for r in audit.values()}) == 3
    seen = {(r["metric"], r["labels"]): r["v"] for r in answering.metric_rows(out).groupBy("metric", "labels").agg(F.sum("value").alias("v")).collect()}
    assert seen["queries_total", 'user_role="customer",document_category="loan_product",success="true"'] == 1 and seen["blocked_queries_total", 'block_reason="pii"'] == 1
    assert seen["pii_detections_total", 'pii_type="email",location="query"'] == 1
