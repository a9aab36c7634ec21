"""The operators against plain versions on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns included."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import classify, imatch, langid, mixing, packing, simhash, substrings, topk, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, component string, fp string, row int, __kept string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows] if schema == DOCS else rows, schema).repartition(3)


def corpus(seed=1, n=40, words=60):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.choice('xyzuvw')}{k}" for k in range(200)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    return texts, passage, vocabulary


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a null id, a very long text."""
    texts, passage, vocabulary = corpus()
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n\t "), (103, None), (0, texts[0]), (None, texts[1]), (None, None)]
    rng = random.Random(2)
    rows.append((104, " ".join(rng.choice(vocabulary) for _ in range(20_000))))
    rows += [(110 + k, f"{texts[k]} {passage} {texts[k + 1]}") for k in range(4)]
    rows += [(120, passage.upper()), (121, "Ünï\u00a0cödé wörds\u2003here"), (122, "one"), (123, "ONE"), (124, "<|endoftext|> two  spaces ")]
    return rows


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    parent = list(range(len(ids)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, x in enumerate(ids):
        least.setdefault(root(k), []).append(x)
    return [min((x for x in least[root(k)] if x is not None), default=None) for k in range(len(ids))]


def test_simhash_matches_plain_version(spark):
    rows = odd_rows()
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = Counter(zip([k for k, _ in rows], prints, components([k for k, _ in rows], prints)))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component"]) for r in found) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_links_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints)[:20]:  # chains: neighbours at 1 and 2 bits, the ends farther apart
        for _ in range(6):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all((e["a"] % (1 << 64) ^ e["b"] % (1 << 64)).bit_count() <= 2 for e in edges)
    from corpusmill.llm.graph import connected_components

    root = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([(e["a"], e["b"]) for e in edges], "a long, b long")).collect()}
    assert [root.get(x, x) for x in signed] == components(signed, prints)


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns[:2] == ["doc_id", "text"] and len(kept.columns) == 6
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = components(list(range(len(rows))), prints)
    assert kept.count() == len(set(groups))
    assert {r["doc_id"] for r in kept.collect()} - {None} <= {k for k, _ in rows}


def plain_repeats(texts, window=35):
    parted = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[k : k + window]) for w in parted for k in range(len(w) - window + 1))
    for w in parted:
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        yield b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), len(w), len(gone)


@pytest.mark.parametrize("flush", [1 << 10, 12 << 20])
def test_substrings_match_plain_version(spark, flush, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH_BYTES", flush)
    rows = [*odd_rows(), (130, " ".join(["same"] * 90)), (131, "x " * 36), (132, " ".join(map(str, range(35))))]
    docs = frame(spark, rows)
    found = substrings.without_repeats(docs)
    assert sorted(found.columns) == sorted(docs.columns)  # __kept is replaced
    got = Counter((r["doc_id"], r["__kept"]["kept"], r["__kept"]["n_words"], r["__kept"]["n_removed"]) for r in found.collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, plain_repeats([t for _, t in rows])))
    assert substrings.without_repeats(frame(spark, [])).count() == 0


def test_packing_is_gapless_and_keeps_every_id(spark):
    from tokenizers import Tokenizer

    rows = odd_rows()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.pack(frame(spark, rows)).collect()
    want, parts = Counter(), 0
    for key, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
        parts += len(ids)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= parts / 2048 * 1.1 + 2
    assert packing.pack(frame(spark, [])).count() == 0


def test_encoding_by_words_equals_encoding_at_once():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(3)
    marks = [" ", "  ", "\n", " \n ", "'s", "don't", "é", "ß", ",", ".", "word", "Ab1", "\u00a0", "\u2003x", "|", "<|endoftext|>", "12", "!!", " '", "日本"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = packing.encode_all(texts, packing.default_tokenizer())
    assert got == [struct.pack(f"<{len(x)}I", *x) for x in (plain.encode(t, add_special_tokens=False).ids for t in texts)]


def test_best_fit_fills_the_fullest_and_closes_it_first():
    assert packing.best_fit([6, 5, 4, 5], size=10) == ([0, 1, 0, 1], [0, 0, 6, 5])
    where, _ = packing.best_fit([9, 2, 1], size=10, open_bins=1)
    assert where == [0, 1, 1]  # the bin of 9 closed when 2 opened another


def test_top_k_matches_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(150)]
    rows += [(k, (40 * rng.normal(size=8)).tolist()) for k in range(150, 160)] + [(200 + k, rows[k][1]) for k in range(10)]
    rows += [(k, [0.0] * 8) for k in (300, 301)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank").repartition(3)
    sound = {k: np.floor(1024 * np.array(v)).astype(int) for k, v in rows if k is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (k for k in sound if k % 10 == 0):
        best = sorted(((-int(sound[q] @ v), k) for k, v in sound.items() if k != q))[:10]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    for block in (8192, 16):
        found = topk.top_k(frame_, F.col("vec_id") % 10 == 0, block=block).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want)
    assert topk.top_k(frame_.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_fingerprints_and_edited_texts(spark):
    rows = [(k, t) for k, t in odd_rows() if k is not None and not (k == 0 and t == odd_rows()[0][1])] + [(0, odd_rows()[0][1])]
    found = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    ordered = sorted(rows)
    for k, (key, text) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        assert found[key]["n_chars"] == len(text)
        assert found[key]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + other[:n]).encode()).hexdigest()
        assert 0 <= found[key]["near_edited"] <= 1 and 0 <= found[key]["near_next"] <= 1
    assert found[100]["fingerprint"] == found[101]["fingerprint"] and found[122]["fingerprint"] == found[123]["fingerprint"]
    assert found[101]["near_edited"] == 1.0
    edited = [found[k]["near_edited"] for k, _ in rows if found[k]["n_chars"] > 200]
    beside = [found[k]["near_next"] for k, _ in rows if found[k]["n_chars"] > 200]
    assert np.mean(edited) > np.mean(beside)
    repeated = imatch.fingerprints(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)]))
    assert repeated.count() == 4
    assert imatch.fingerprints(frame(spark, [])).count() == 0


def test_next_rows_across_ranges(spark):
    rows = spark.createDataFrame([(k * 7 % 101, f"t{k * 7 % 101}") for k in range(101)], "id long, text string").repartition(5)
    for ranges in (imatch.id_ranges(rows, "id", 9), imatch.id_ranges(rows, "id", 30, most=4), imatch.id_ranges(rows, "id", 1)):
        found = imatch.beside_next(rows, "id", "text", [], ranges).select("id", "__next.text").collect()
        assert {r["id"]: r["text"] for r in found} == {k: f"t{(k + 1) % 101}" for k in range(101)}


def test_ranges_keep_the_order_and_split_a_hot_id(spark):
    """A third of the rows share an id and another third have none: both are dealt to several ranges, in the order of (id, tie)."""
    rng = random.Random(12)
    ids = [7] * 400 + [None] * 400 + [rng.randrange(-1000, 1000) for _ in range(400)]
    rows = spark.createDataFrame([(k, f"t{n}") for n, k in enumerate(ids)], "id long, text string").repartition(3)
    for most in (4096, 8):
        ranges = imatch.id_ranges(rows, "id", 40, most)
        placed = rows.selectExpr("id", "text", "xxhash64(text) AS tie").select("*", imatch.range_of(F.col("id"), F.col("tie"), *ranges).alias("at")).collect()
        ordered = sorted(placed, key=lambda r: (r["id"] is not None, r["id"] or 0, r["tie"]))
        assert [r["at"] for r in ordered] == sorted(r["at"] for r in ordered)
        assert max(Counter(r["at"] for r in placed).values()) < 300
        found = imatch.beside_next(rows, "id", "text", [], ranges).select("text", "__next.text").collect()
        names = [r["text"] for r in ordered]
        assert {r[0]: r[1] for r in found} == dict(zip(names, [*names[1:], names[0]]))


def test_warc_round_trip(spark):
    big = "<p>" + "long " * 50_000
    rows = [(5, "http://a/", "<p>same"), (2, "http://b/ x\r\ny", "<p>same"), (9, None, "<p>same"), (1, "u", None), (3, "u", ""), (7, "u", "ünï"), (8, "u", big), (7, "u", "ünï"), (None, "u", "<p>same"), (None, "u", "alone")]
    rows += [(100 + k, f"http://h/{k}", f"<html>common words of page {k}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS revisit").repartition(3)
    for least in (0, 6):
        found = warc.records_of(warc.archive(pages, least_bytes=least), payloads=True).collect()
        assert len(found) == len(rows)
        first = {}
        for key, _, html in rows:
            first.setdefault(html or "", []).append(key)
        turns = Counter()
        for r in found:
            key = r["page"] and int(r["page"])
            options = [h or "" for k, _, h in rows if k == key]
            text = next(h for h in options if warc.digest(h.encode()) == r["payload_digest"])
            assert r["payload_bytes"] == len(text.encode())
            if r["record_type"] == "response":
                assert r["payload"] == text.encode() and r["refers_to"] is None
                turns[text] += 1
            else:
                least_id = min((k for k in first[text] if k is not None), default=None)
                assert r["refers_to"] == (None if least_id is None else str(least_id)) and len(text.encode()) >= least
        assert all(n == (len(first[t]) if len(t.encode()) < least else 1) for t, n in turns.items()) and set(turns) == set(first)
    assert warc.records_of(warc.archive(pages.limit(0))).count() == 0


def test_warc_names_are_unique_and_small_files_have_no_dictionary():
    rows = [("5", b"a", 1), ("5", b"a", 2), ("5", b"b", 1), (None, b"a", 1), ("x:y", b"a", 1)]
    out = io.BytesIO()
    warc.write(out, iter([warc.record(page, None, payload, "5", turn > 1, "" if turn == 1 else f"-.{turn}") for page, payload, turn in rows]))
    assert struct.unpack("<I", out.getvalue()[:4])[0] != warc.SKIPPABLE  # under 8 records there is nothing to build one from
    found = list(warc.read(io.BytesIO(out.getvalue())))
    names = [h["warc-record-id"] for h, _ in found]
    assert len(set(names)) == len(rows) and [warc._page(x) for x in names] == ["5", "5", "5", None, "x:y"]
    assert found[1][0]["warc-refers-to"] == names[0]


def test_warc_file_leads_with_its_dictionary():
    records = [warc.record(str(k), "u", f"<html>a page much like the others, number {k}".encode(), None, False) for k in range(300)]
    out = io.BytesIO()
    assert warc.write(out, iter(records))[0] == 300
    raw = out.getvalue()
    assert struct.unpack("<I", raw[:4])[0] == warc.SKIPPABLE and len(raw) < sum(map(len, records)) / 2
    assert [block.partition(b"\r\n\r\n")[2] for _, block in warc.read(io.BytesIO(raw))] == [f"<html>a page much like the others, number {k}".encode() for k in range(300)]


def test_warc_dictionary_whatever_the_first_records_are():
    small = [warc.record(str(k), "u", f"<html>a page much like the others, number {k}".encode(), None, False) for k in range(2999)]
    for records in ([warc.record("big", "u", b"x" * (2 << 20), None, False), *small], small[:8], [b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"] * 8):
        out = io.BytesIO()
        assert warc.write(out, iter(records))[0] == len(records)
        assert struct.unpack("<I", out.getvalue()[:4])[0] == warc.SKIPPABLE
        assert len(list(warc.read(io.BytesIO(out.getvalue())))) == len(records)


def test_warc_rows_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 7)
    rows = [(None, None, "")] * 40 + [(None, "u", "")] * 3 + [(4, "a", "p")] * 30 + [(4, "b", "p")] * 9 + [(3, "c", "q"), (2, None, "q"), (2, "z", "q")]
    made = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    found = warc.records_of(made).collect()
    assert Counter((r["page"], r["payload_bytes"]) for r in found) == Counter((None if p is None else str(p), len(h)) for p, _, h in rows)
    assert Counter((r["record_type"], r["payload_digest"]) for r in found if r["record_type"] == "response") == Counter(("response", warc.digest(x)) for x in (b"", b"p", b"q"))
    assert {(r["payload_digest"], r["refers_to"]) for r in found if r["record_type"] == "revisit"} == {(warc.digest(b""), None), (warc.digest(b"p"), "4"), (warc.digest(b"q"), "2")}
    names = []
    for folder, path in made.select("folder", "path").collect():
        with open(path if path.startswith("/") else folder.removeprefix("file://") + path, "rb") as source:
            names += [h["warc-record-id"] for h, _ in warc.read(source)]
    assert len(set(names)) == len(rows)


def test_warc_files_on_disk_lead_with_the_dictionary(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<html>common words of page {k}") for k in range(60)], "page_id long, url string, html string").coalesce(1)
    for folder, path in warc.archive(pages).select("folder", "path").collect():
        with open(path if path.startswith("/") else folder.removeprefix("file://") + path, "rb") as source:
            assert struct.unpack("<I", source.read(4))[0] == warc.SKIPPABLE


def test_sample_is_bounded_whatever_ids_repeat(spark):
    docs = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 7 ELSE id END AS doc_id", "concat('t', id) AS text")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0), (None, 1), (8, None)] + [(k, k % 2) for k in range(4000, 4200)], "doc_id long, label int")
    rows = classify.sample(docs, labels, "doc_id", "text", limit=100).collect()
    assert len(rows) <= 100 and len(set(rows)) == len(rows)
    everything = classify.sample(docs, labels, "doc_id", "text", limit=10_000).collect()
    assert len(everything) == 202 and len({r["text"] for r in everything}) == 201


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    docs = spark.createDataFrame([(k, "some words", f"l{k % 4}") for k in range(8)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3 languages"):
        langid.identify(docs, F.lit(False))


RULES = [urlfilter.Rule(*x) for x in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bad.net"))]


def test_url_rules_match_plain_version(spark):
    hosts = ["example.org", "a.example.org", "notexample.org", "EXAMPLE.com", "org", "x.bad.net", "bad.net", "worse.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/de/", "/fr/x#y", "/de/z", "/en/2"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "http://É.org/x", "a://b://c/d"]
    rows = [(k, u) for k, u in enumerate(urls + urls[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule").repartition(3)

    def plain(url):
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].partition("?")[0].partition("#")[0]
        fits = [r for r in RULES if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.key), default=None)
        return host, path, best and best.key, best.verdict if best else "allow"

    found = urlfilter.judge(pages, RULES).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {k: plain(u) for k, u in rows}
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact_over_its_universe():
    universe = [f"key{k}" for k in range(20_000)]
    listed = set(universe[::37])
    first = urlfilter.Bloom(listed, 0.05, 0)
    wrong = [x for x in universe if x in first and x not in listed]
    assert len(wrong) > 100
    made = urlfilter.Cascade(first, listed, wrong)
    assert len(made.levels) > 2 and all((x in made) == (x in listed) for x in universe)


def labelled(spark, n=600):
    rng = random.Random(7)
    neutral = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        words = [rng.choice(neutral) for _ in range(rng.randint(5, 40))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scumbag", "moronic"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(0, rng.choice(["muslims", "women"]))
        rows.append((k, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").selectExpr("*", "'x' AS label", "0 AS score")
    return rows, docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, label int")


def test_toxicity_learns_and_levels_identity_terms(spark):
    rows, docs, labels = labelled(spark)
    found = toxicity.detect(docs, labels.where("doc_id % 5 <> 0")).select("doc_id", "__score").collect()
    score = {r["doc_id"]: r["__score"] for r in found}
    held = [(k, y) for k, _, y in rows if k % 5 == 0]
    assert np.mean([(score[k] >= 0.5) == bool(y) for k, y in held]) > 0.95
    gaps = []
    for penalty in (0.0, toxicity.PENALTY):
        names, weights, _, pairs = toxicity.fit(docs, labels, penalty=penalty)
        assert pairs > 100
        made = classify.Features(names, False)
        value = lambda t: 1 / (1 + np.exp(-(weights[made.numbers(t)].sum() + weights[-1])))  # noqa: B023, E731
        gaps.append(abs(value("w1 w2 muslims w3.") - value("w1 w2 christians w3.")))
    assert gaps[1] < gaps[0] / 2
    odd = frame(spark, [(1, None), (2, ""), (None, "idiot"), (2, "")])
    scores = toxicity.detect(odd.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True), labels).select("__score").collect()
    assert len(scores) == 604 and all(0 <= r[0] <= 1 for r in scores)
    assert toxicity.detect(docs.limit(0), labels.limit(0)).count() == 0


def test_swapped_sentences():
    assert toxicity.swapped("We met Women. Fine. Old men!", copies=1) == [("We met Women.", "We met Men."), (" Old men!", " Young girls!")]
    assert toxicity.swapped("Nothing here.") == []
    assert toxicity.swapped("the cats", (("cats", "dogs"),), copies=2) == [("the cats", "the dogs")]


def test_language_mixtures(spark):
    rng = random.Random(8)
    sounds = {"aa": ["bol", "kra", "tum", "zor"], "bb": ["lie", "sui", "nee", "fio"], "cc": ["x", "qu", "ych", "ght"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, say(lang, rng.randint(3, 60)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    mixed = f"{say('aa', 60)} {say('bb', 30)}"
    rows += [(500, mixed, None), (501, None, "aa"), (502, "", "bb"), (503, "123 !?", None), (504, "k", None), (None, rows[0][1], None), (505, " ".join([say("cc", 50)] * 200), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    found = {r["doc_id"]: r["__lang"] for r in langid.identify(docs, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))).collect()}
    assert np.mean([found[k]["lang_pred"] == lang for k, _, lang in rows[:180]]) > 0.95
    assert [found[k]["lang_pred"] for k in (501, 502, 503)] == ["und"] * 3 and found[501]["score"] == 0.0
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert langid.identify(docs.limit(0), F.lit(False)).count() == 0
    names, model = langid.fit(docs.where("doc_id < 180"), "text", "lang", "doc_id")
    share = langid.mixture(langid.trigrams(mixed), model)
    assert abs(share[0] - 2 / 3) < 0.12 and abs(share[1] - 1 / 3) < 0.12 and share[2] == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(9)
    rows = []
    for k in range(900):
        domain = ["news", "code", "chat"][k % 3 if k % 2 else 0]
        rows.append((k, " ".join(f"{domain}{rng.randrange(30)}" if rng.random() < 0.5 else f"any{rng.randrange(50)}" for _ in range(rng.randint(10, 80))), domain))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, None), (5000, ""), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS p0")
    labels = spark.createDataFrame([(k, d) for k, _, d in rows if k % 5 < 3] + [(7, None), (8, "other")], "doc_id long, label string")
    targets = {"news": 0.5, "code": 0.3, "chat": 0.2}
    found = mixing.mix(docs, labels, targets).collect()
    assert len(found) == 903 and all(r["__rate"] >= 0 for r in found)
    total = {d: sum(r["__tokens"] * r["__posterior"][d] * r["__rate"] for r in found) for d in targets}
    whole = sum(total.values())
    assert all(abs(total[d] / whole - x) < 0.01 for d, x in targets.items())
    assert mixing.mix(docs.limit(0), labels, targets).count() == 0
