"""Guardrails, chunking, loading, parsing and limits against hand-checked values and plain versions."""

import hashlib
import random
import hmac
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import hmac_sha256, strip, words
from corpusmill.operators import answers, chunking, classify, guardrails, metrics, testcases
from corpusmill.sources import loaders
from corpusmill.sources import format as files_format
from corpusmill.sources.store import ChunkStore
from corpusmill.streaming import limits

PII = [
    ("My SSN is 123-45-6789", {"ssn"}),
    ("Card: 4111111111111111", {"credit_card", "account_number"}),
    ("Contact john.doe@example.com", {"email"}),
    ("Call 555-234-5678", {"phone"}),
    ("What is the minimum credit score?", set()),
    ("SSN 987-65-4320, phone 555-123-4567, mail a@b.com", {"email"}),  # 9xx numbers and exchanges from 1 aren't matched
    ("Loan # AB1234567 is open", {"loan_number"}),
    ("EIN 12-3456789", {"tax_id"}),
    ("DOB: 01/02/1980", {"date_of_birth"}),
]


@pytest.mark.parametrize("text,kinds", PII)
def test_pii_entities(text, kinds):
    assert {x[0] for x in guardrails.find_entities(text)} == kinds


def test_redaction_leaves_no_fragment(spark):
    texts = ["My SSN is 123-45-6789.", "Account 123456789 and 234567890", "mail a@b.com or 4111111111111111", "clean", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").select("id", guardrails.redaction(F.col("text")).alias("m")).orderBy("id").collect()
    assert rows[0]["m"]["redacted"] == "My SSN is [REDACTED-SSN]." and rows[0]["m"]["risk_level"] == "high"
    for r in rows[:3]:
        assert not guardrails.find_entities(r["m"]["redacted"]) and r["m"]["was_modified"]
    assert rows[3]["m"]["redacted"] == "clean" and not rows[3]["m"]["was_modified"] and rows[5]["m"]["redacted"] is None


def test_three_high_entities_block(spark):
    rows = spark.createDataFrame([("123-45-6789 and 4111111111111111 and 12-3456789",), ("123-45-6789",)], "t string")
    assert [r[0] for r in rows.select(guardrails.should_block_pii(F.col("t"))).collect()] == [True, False]


COMPLIANCE = [
    ("The minimum score is 620.", None, False),
    ("Your rate is definitely 3.5%", "rate_guarantee", True),
    ("You will be approved", "approval_guarantee", True),
    ("No hidden fees ever", "udaap_deceptive", True),
    ("We do not lend to religion groups", "ecoa_discrimination", True),
    ("You should file for bankruptcy", "unauthorized_advice", False),
    ("guarantee you a 6.5% interest rate", None, False),  # the number between defeats the rules
]


def test_compliance_rules(spark):
    rows = guardrails.checked(spark.createDataFrame([(t,) for t, _, _ in COMPLIANCE], "text string"), "text").collect()
    got = {r["text"]: ([v["violation_type"] for v in r["violations"]], r["should_block"]) for r in rows}
    for text, kind, block in COMPLIANCE:
        assert got[text] == ([kind] if kind else [], block)
    note = guardrails.checked(spark.createDataFrame([("The rate moves.",), ("Your rate is exactly 3 %",)], "text string"), "text").collect()
    assert "subject to change" in note[0]["modified_text"] and note[1]["modified_text"] is None


def test_overlapping_spans_are_left_out(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 3)], "t int, start int, end int")
    b = spark.createDataFrame([(1, 4, 6), (2, 3, 4)], "t int, start int, end int")
    assert sorted(map(tuple, guardrails.without_overlaps(a, b, "t").collect())) == [(2, 0, 3)]
    assert guardrails.without_overlaps(a, b.where("t = 9"), "t").count() == 3
    rng = random.Random(4)
    some = lambda n: [(rng.choice([1, 2, None]), x, x + rng.choice([0, 1, 30, 3000]), k) for k in range(n) for x in [rng.randrange(20_000)]]
    spans, fixed = some(400), some(60)
    want = sorted(s[3] for s in spans if s[0] is None or not any(f[0] == s[0] and f[1] < s[2] and s[1] < f[2] for f in fixed))
    frame = lambda rows: spark.createDataFrame(rows, "t long, start int, end int, here int")
    for width in (100, 1 << 16):
        assert sorted(r["here"] for r in guardrails.without_overlaps(frame(spans), frame(fixed), "t", width).collect()) == want
    one = spark.range(100_000).selectExpr("7L AS t", "cast(id * 3 AS int) AS start", "cast(id * 3 + 1 AS int) AS end")  # many spans of one text
    assert guardrails.without_overlaps(one, one.selectExpr("t", "start + 2 AS start", "end + 2 AS end").where("start % 2 = 0"), "t").count() == 100_000


@pytest.mark.parametrize("text,name,want", [("Current interest rate and APR", "rates.pdf", "rate_sheet"), ("RESPA and TILA compliance", "policy.pdf", "compliance_policy"), ("credit score and DTI for underwriting", "g.pdf", "underwriting_guideline"), ("nothing", "x", "general")])
def test_categories(spark, text, name, want):
    found = classify.classified(spark.createDataFrame([(text, name)], "content string, source_file string")).first()
    assert found["document_category"] == want
    assert ("TILA" in found["regulatory_tags"]) == ("TILA" in text)


def test_recursive_chunks(spark):
    text = "\n\n".join(f"Paragraph {k} about loans. " + "Words follow here, and more; they end. " * (k % 5) for k in range(19)) + "\n\n" + "A" * 1300
    found = chunking.split_recursive(text)
    assert len(found) > 1 and all(len(x) <= 512 + 50 + 3 for x in found) and all(x == x.strip() for x in found)
    rows = chunking.recursive_chunks(spark.createDataFrame([(7, text), (8, " "), (9, None), (10, "short")], "id long, text string"), "id", "text").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["doc_id"] for r in rows} == {7}
    assert len({r["chunk_id"] for r in rows}) == len(rows) == rows[0]["total_chunks"] and rows[0]["chunk_id"] == "7_chunk_0000"
    assert all(len(r["content"]) >= 50 and r["char_start"] <= r["char_end"] for r in rows)
    assert chunking.split_recursive("abc") == ["abc"] and chunking.split_recursive(" \n") == []


def test_paragraph_chunks(spark):
    text = "# One\na b c\n\n\nd e f\n# Two\ng h"
    cut = lambda n: spark.createDataFrame([(text,)], "t string").select(chunking.paragraph_chunks(F.col("t"), n)).first()[0]
    assert cut(7) == ["# One\na b c", "d e f\n\n# Two\ng h"]  # segments of 5, 3 and 4 words
    assert cut(8) == ["# One\na b c\n\nd e f", "# Two\ng h"] and cut(3) == ["# One\na b c", "d e f", "# Two\ng h"]
    long = " ".join(["w"] * 20)
    assert spark.createDataFrame([(f"a\n\n{long}\n\nb",)], "t string").select(chunking.paragraph_chunks(F.col("t"), 6)).first()[0] == ["a", long, "b"]


def test_text_helpers(spark):
    row = spark.createDataFrame([("  \ta b c\n",)], "t string").select(strip(F.col("t")), words(F.col("t"))).first()
    assert row[0] == "a b c" and row[1] == ["a", "b", "c"]
    got = spark.createDataFrame([("e|t|u|k",)], "m string").select(hmac_sha256(b"key", F.col("m"))).first()[0]
    assert got == hmac.new(b"key", b"e|t|u|k", hashlib.sha256).hexdigest()


def test_signed_audit(spark):
    row = metrics.signed(spark.createDataFrame([("e1", "2024-01-01", None, "LOGIN_FAILURE", "low")], "event_id string, ts string, user_id string, event_type string, severity string"), b"k")
    assert row.first()["hmac_signature"] == hmac.new(b"k", b"e1|2024-01-01||LOGIN_FAILURE", hashlib.sha256).hexdigest()
    assert metrics.alerts(row).count() == 1


def test_groundedness_and_citations(spark):
    rows = [("The minimum down payment is three percent. Borrowers must document income.", "minimum down payment three percent; borrowers document income"), ("Unrelated sentence about gardening in spring.", "loans"), ("This is not available here at the moment.", "")]
    got = spark.createDataFrame(rows, "a string, c string").select(answers.is_grounded(F.col("a"), F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, True]
    text = "[Source: b.pdf] (source: a.txt) According to c.docx, yes [Source: b.pdf]"
    assert spark.createDataFrame([(text,)], "t string").select(answers.citations(F.col("t"))).first()[0] == ["a.txt", "b.pdf", "c.docx"]


def docx(paragraphs, table):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_loading_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "policy.txt").write_text("RESPA COMPLIANCE\n\nText.")
    (tmp_path / "sub" / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "blank.txt").write_text("   ")
    (tmp_path / "clip.mp4").write_bytes(b"x")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "good.docx").write_bytes(docx(["One", "  ", "Two"], [["a", "b"]]))
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    found = {r["source_file"]: r for r in loaders.load(loaders.files(spark, str(tmp_path)), most=1000).collect()}
    assert found["policy.txt"]["document_category"] == "compliance_policy" and found["policy.txt"]["doc_id"] == "doc_" + hashlib.sha256(b"RESPA COMPLIANCE\n\nText.").hexdigest()[:16]
    assert found["latin.txt"]["content"] == "café" and found["good.docx"]["content"] == "One\n\nTwo\n\n[TABLES]\n\na | b" and found["t.csv"]["content"] == "a | b\n1 | 2"
    assert {k: r["status"] for k, r in found.items() if r["status"] != "loaded"} == {"blank.txt": "failed", "clip.mp4": "skipped", "broken.docx": "failed"}
    assert tuple(loaders.ingest_counts(loaders.load(loaders.files(spark, str(tmp_path)), most=5)).first())[0] == 1


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", "chunk_id string, doc_id long, content string, access_level string", settings={"dimension": 2})
    rows = lambda *x: spark.createDataFrame(x, store.schema)
    assert not store.healthy() and store.read().count() == 0
    assert store.create() and not store.create() and store.healthy()
    store.append(rows(("a", 1, "x", "public"), ("b", 2, "y", "internal")))
    store.append(rows(("c", 2, "z", "public")))
    internal = sorted(p.name for p in (tmp_path / "store/data/access_level=internal").iterdir())
    store.upsert(rows(("a", 1, "new", "public"), ("a", 1, "newer", "public"), ("d", 3, "w", "public")))
    assert {r["chunk_id"]: r["content"] for r in store.read().collect()} == {"a": "newer", "b": "y", "c": "z", "d": "w"} and store.read().count() == 4
    assert sorted(p.name for p in (tmp_path / "store/data/access_level=internal").iterdir()) == internal  # not touched, not rewritten
    store.upsert(rows(("b", 2, "moved", "public")))
    assert {(r["chunk_id"], r["access_level"]) for r in store.find(2).collect()} == {("b", "public"), ("c", "public")}
    assert store.read().where("access_level = 'internal'").count() == 0  # a partition that lost all its rows
    store.delete(2)
    store.delete(99)
    assert tuple(store.stats().first())[:2] == (2, 2) and store.find(2).count() == 0
    for _ in range(2):  # a change that is made again changes nothing
        store.upsert(rows(("n", 7, "no level", None), ("a", 1, "last", "public")))
        assert {(r["chunk_id"], r["content"], r["access_level"]) for r in store.read().collect()} == {("a", "last", "public"), ("d", "w", "public"), ("n", "no level", None)}
    with pytest.raises(ValueError, match="without a key"):
        store.append(rows((None, 1, "x", "public")))
    sized = ChunkStore(spark, f"file://{tmp_path}/sized", "chunk_id string, doc_id long, vector array<float>, access_level string", settings={"dimension": 2})
    with pytest.raises(ValueError, match="2 components"):
        sized.append(spark.createDataFrame([("a", 1, [1.0], "public")], sized.schema))
    assert not sized.healthy()


def test_parsing_cases(spark):
    raw = '```json\n[{"title": "A", "steps": [{"step_number": 1, "action": "x", "expected": "y"}]}, {"test_type": "odd"}, {"priority": "P9"}]\n```\n{"coverage_gaps": ["g"]}'
    row = testcases.parsed(spark.createDataFrame([(raw,)], "raw string")).first()
    assert [(c["title"], c["test_type"], c["priority"], len(c["steps"])) for c in row["cases"]] == [("A", "functional", "P2 - Medium", 1)] and row["coverage_gaps"] == ["g"]
    assert testcases.parsed(spark.createDataFrame([("junk",)], "raw string")).first()["coverage_gaps"] == [testcases.UNPARSED]
    with pytest.raises(ValueError):
        testcases.export(None, "pdf")


def test_rate_limits_batch_and_stream(spark, tmp_path):
    rows = [(k, f"u{k % 3}", f"2024-01-01 00:{k // 4:02d}:{k % 4 * 13:02d}") for k in range(120)]
    requests = spark.createDataFrame(rows, "event_id long, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    want, passed = {}, {}
    for k, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):  # a request passes if none of its user's passed in the minute before
        at = int(ts[14:16]) * 60 + int(ts[17:19])
        want[k] = (not any(at - 60 < x <= at for x in passed.setdefault(user, [])), 0)
        passed[user] += [at] * want[k][0]
    assert {r["event_id"]: (r["allowed"], r["remaining"]) for r in limits.limited(requests, 1).collect()} == want
    assert {x for x, _ in want.values()} == {True, False}
    requests.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limits.limited_stream(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in").select("key", "ts", "event_id"), 1)
    run = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(120)
    assert {r["event_id"]: (r["allowed"], r["remaining"]) for r in spark.table("limited").collect()} == want


def test_audit_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024", "u", "LOGOUT")], "event_id long, ts string, user_id string, event_type string").write.parquet(f"{tmp_path}/in")
    limits.audit_sink(spark.readStream.schema("event_id long, ts string, user_id string, event_type string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", b"k").awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/out").first()["hmac_signature"]


def test_files_as_a_format(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("RESPA COMPLIANCE\n\nText.")
    (tmp_path / "deep/b.csv").write_text("a,b\n1,2\n")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "clip.mp4").write_bytes(b"\0")
    (tmp_path / "large.txt").write_text("x" * 500)
    for x in ("clip.mp4", "large.txt"):
        (tmp_path / x).chmod(0)
    through = files_format.load(spark, str(tmp_path), most="400")
    got = {r["source_file"]: r.asDict() for r in through.collect()}
    for x in ("clip.mp4", "large.txt"):
        (tmp_path / x).chmod(0o600)
    want = {r["source_file"]: r.asDict() for r in loaders.load(loaders.files(spark, str(tmp_path)), most=400).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for name, row in want.items():
        if row["error"] in ("unsupported file type", "too large"):
            row |= {"doc_id": None, "sha256_hash": None}
        assert got[name] == row, name
    rows = spark.read.format("documents").load(str(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in rows.where("length < 10 AND path LIKE '%.csv'").collect()} == {"b.csv"}
    reader = files_format.DocumentReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([files_format.LessThan(("length",), 10), files_format.StringEndsWith(("path",), ".csv"), files_format.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [x[0].rpartition("/")[2] for p in reader.partitions() for x in p.files] == ["b.csv"]
    assert files_format.load(spark, str(tmp_path / "deep")).where("status = 'skipped'").count() == 0
