"""Fill-in-middle, source divergence and near-duplicate vectors against plain versions on small fixtures."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import divergence, fim, itq


def plain_fim(doc_id, text, units=fim.LINES, seed=7, rate=100, spm=50):
    text = text or ""
    found = re.findall(units, text, re.ASCII)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(found) + 1), h[1] % (len(found) + 1)))
    prefix, middle, suffix = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(found), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(found), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(found), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_matches_plain_version(spark):
    rng = random.Random(4)
    texts = [None, "", "\n", "a", "a\n", "\n\n\n", "<P>x\ny", "a <S>", "<M>", "<", "<<S", "ü\n😀😀\r\nß", "x\ty z\x85\n", "line\n" * 3000, "w" * 200_000 + "\nend"]
    texts += ["".join(rng.choice(["ab", "<", "P>", "\n", "é", " ", "<S", ">"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null\nid\n"), (None, None), (3, "other\ntext"), (3, "other\ntext"), (3, "a")] + [(8, "many\nrows\nshare\nthis")] * 300
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, form string, output int").repartition(5)
    for options in ({}, {"rate": 40, "spm": 20, "seed": 3}, {"units": r"\S+|\s+"}):
        found = fim.transform(docs, **options).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
        assert Counter(tuple(r)[2:7] + (r["doc_id"],) for r in found) == Counter((*plain_fim(*r, **options), r[0]) for r in rows)
        assert all(r["back"] == r["text"] for r in found)
        assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def plain_audit(rows, least, ranks):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    seen, counts, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups.add((lang, source))
        seen.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = set()
    share = lambda c, n, v: 1 + Fraction(10**9 * (c + 5), n + 5 * v).__floor__()
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), n in seen.items() if la == lang and n >= least]
        sources = sorted(s for la, s in groups if la == lang)
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s, t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            over = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t])
            out |= {(lang, s, part, item.decode(), -value, k + 1) for part, ranked in (("pair", pairs), ("term", over[:ranks])) for k, (value, item) in enumerate(ranked)}
    return out


def test_audit_matches_plain_version_however_terms_are_split(spark, monkeypatch):
    rng = random.Random(5)
    common, rare = [f"{a}{b}" for a in "abcdefg" for b in "xyzuvw"], [f"r{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["l1", "l1", "l2", None, ""]), f"s{min(rng.randrange(12), rng.randrange(12))}"
        own = [w for j, w in enumerate(rare) if j % 12 == hash_of(source) % 12 or j % 7 == 0]
        rows.append((lang, rng.choice([source] * 9 + [None]), " ".join(rng.choice(common).title() if rng.random() < 0.7 else rng.choice(own) for _ in range(rng.randint(0, 40)))))
    rows += [("l1", "s1", None), ("l3", "alone", "few terms"), ("l4", "a", "x"), ("l4", "b", ""), ("l1", "only nulls", None), ("l2", "é", "ÀÉ àé 'tis don't"), ("l2", "z", "word\x00word[w]^_`{q}~")] + [rows[3]] * 20 + [("l2", "s0", "ax " * 30_000)]
    docs = spark.createDataFrame([(k, *r, 3, "y") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, g int, term string").repartition(4)
    monkeypatch.setattr(divergence, "GROUPS", 4)
    monkeypatch.setattr(divergence, "TERMS", 16)
    monkeypatch.setattr(divergence, "HELD", 50)
    want = plain_audit(rows, 5, 6)
    assert {x[2] for x in want} == {"pair", "term"}
    for light in (0, 3, 100):
        found = [tuple(r) for r in divergence.audit(docs, least=5, ranks=6, light=light).collect()]
        assert len(found) == len(want) and set(found) == want, light
    assert divergence.audit(docs.limit(0)).count() == 0


def hash_of(x):
    return int(hashlib.md5(x.encode()).hexdigest(), 16)


def test_shares_are_exact_beyond_doubles_and_longs(spark):
    n, total, size = 8_123_456_789_012_345_678, 9_223_372_036_854_775_807, 123_456_789
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(size)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(7)).alias("q")).first()
    assert tuple(got) == (1 + 10**9 * (n + 5) // (total + 5 * size), 1 + 10**9 * 5 // 35)


def plain_links(rows, cosine=0.95):
    n = len(rows)
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    degree, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    degree[i], degree[j] = degree[i] + 1, degree[j] + 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    return Counter((rows[i][0], degree[i], least.get(root(i))) for i in range(n))


def test_vectors_match_plain_version(spark, monkeypatch):
    monkeypatch.setattr(itq, "VISITORS", 8)
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng, rows = np.random.default_rng(3), []
    for d in (1, 2, 3, 8, 64):
        for _ in range(25):
            x = rng.normal(size=d)
            rows.append(x)
            rows += [x + rng.normal(size=d) * rng.choice([0, 0.01, 0.1, 0.2]) * np.linalg.norm(x) / np.sqrt(d) for _ in range(rng.integers(0, 4))]
    x = rng.normal(size=16)
    rows += [x + 0.1 * rng.normal(size=16) for _ in range(60)] + [x] * 30 + [x * 3] * 5 + [x * 1e200, x * 1e-200]
    rows = [(k, [float(z) for z in v]) for k, v in enumerate(rows)]
    rows += [(None, [1.0, 0.0]), (None, None), (5, None), (6, []), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0]), (3, rows[3][1]), (3, rows[3][1]), (4000, [5.0]), (4001, [-5.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n_links int, num int").repartition(3)
    assert Counter(map(tuple, itq.near_duplicates(vectors).collect())) == plain_links(rows)
    assert itq.near_duplicates(vectors.limit(0)).count() == 0


def test_recall_at_the_threshold_itself(spark):
    """Pairs just above the threshold, moved any way, at any number of rows that keys are made for: at least 0.97 meet; the contract
    asks for 0.9 of all pairs, most of which are nearer."""
    rng = np.random.default_rng(8)
    x = itq.unit(rng.normal(size=(4000, 64)))
    for rows in (4000, 10_000_000):
        codes = itq.fit(x, 64, rows, 0.95)
        a, b = itq._neighbours(itq.unit(rng.normal(size=(800, 64))), 0.951, rng)
        (bits_a, sq_a), (bits_b, sq_b) = codes.bits(a), codes.bits(b)
        met = np.zeros(len(a), bool)
        for t in range(codes.tables):
            (ca, pa_), (cb, pb) = codes.cells(bits_a, sq_a, t), codes.cells(bits_b, sq_b, t)
            met |= [bool(set(i[p <= codes.budget]) & set(j[q <= codes.budget])) for i, p, j, q in zip(ca, pa_, cb, pb)]
        apart = (bits_a[:, :64] != bits_b[:, :64]).sum(axis=1) <= codes.apart(np.array([np.arccos(0.95)]))[0]
        assert (met & apart).mean() >= 0.97
    turn = itq._rotation(x - x.mean(axis=0), 64, rng)
    assert np.allclose(turn.T @ turn, np.eye(64), atol=1e-8)


def test_a_group_of_copies_makes_few_rows(spark):
    """A third of the rows lie close together: what meets is clumps, not pairs of rows."""
    rng = np.random.default_rng(9)
    x, rest = rng.normal(size=32), rng.normal(size=(800, 32))
    rows = [(k, [float(z) for z in v]) for k, v in enumerate([*(x + 0.08 * rng.normal(size=(400, 32))), *rest])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {r["vec_id"]: r for r in itq.near_duplicates(vectors).collect()}
    assert Counter((k, r["n_links"], r["component"]) for k, r in found.items()) == plain_links(rows)
    assert sum(r["n_links"] for r in found.values()) > 100_000
    each = vectors.selectExpr("monotonically_increasing_id() AS num", "size(embedding) AS d", "embedding AS v", "1L AS weight", "vec_id AS least")
    models, n = itq.fitted(each, 0.95)
    clumps = itq._clumps(itq._coded(each, models, n, 0.95), 0.95)
    assert clumps.count() == 1200 and clumps.select("clump").distinct().count() < 1000
