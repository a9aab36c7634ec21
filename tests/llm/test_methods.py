"""Each operator's method beside a plain version of it, or a figure that only the method can bring about."""

import itertools
import random
import struct
import warnings
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import classify, imatch, langid, mixing, packing, substrings, topk, toxicity
from corpusmill.llm.base import crc_fold, table

SF = "/root/testdata/sf0.01"


# ---- toxicity


@pytest.fixture(scope="module")
def real(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return docs, labels


def test_penalty_levels_terms_that_the_corpus_has(spark, real):
    """On the real tables identity groups are found, sentences are paired, and the penalty lowers the held-out score gaps."""
    docs, labels = real
    gaps, right = {}, {}
    held = docs.where(crc_fold("doc_id", 5) == 0).join(labels, "doc_id").collect()
    for penalty in (0.0, toxicity.PENALTY):
        names, weights, groups, pairs = toxicity.fit(docs, labels.where(crc_fold("doc_id", 5) != 0), penalty=penalty)
        found = groups[len(toxicity.IDENTITIES) :]
        assert found and pairs > 100
        made = classify.Features(names, False)
        value = lambda t: 1 / (1 + np.exp(-(weights[made.numbers(t)].sum() + weights[-1])))  # noqa: B023, E731
        gaps[penalty] = np.mean([(value(a) - value(b)) ** 2 for r in held for a, b in toxicity.swapped(r["text"] or "", groups)])
        right[penalty] = np.mean([(value(r["text"] or "") >= 0.5) == bool(r["label"]) for r in held])
    assert 0 < gaps[toxicity.PENALTY] < 0.8 * gaps[0.0]
    assert right[toxicity.PENALTY] > 0.95


def test_weights_are_those_of_a_plain_descent():
    """Few features, all rows in each step: batches and pairs must come near the minimum that plain gradient descent finds."""
    rng = random.Random(4)
    rows = [(sorted({k for k in range(6) if rng.random() < (0.5 if k else 0.3 + 0.4 * y)}), y) for y in (rng.randrange(2) for _ in range(300))]
    found, label = [r for r, _ in rows], np.array([y for _, y in rows], float)
    x = np.array([[k in r for k in range(6)] + [True] for r in found], float)
    pairs = [([0, 2], [1, 2]), ([0], [1])] * 20
    a, b = (np.array([[k in p[side] for k in range(6)] + [True] for p in pairs], float) for side in (0, 1))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def loss(w):
        p = sigmoid(x @ w)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + 4 * np.mean((sigmoid(a @ w) - sigmoid(b @ w)) ** 2) + 0.5e-4 * w @ w

    w = np.zeros(7)
    for _ in range(20_000):
        p, pa, pb = sigmoid(x @ w), sigmoid(a @ w), sigmoid(b @ w)
        w -= 0.3 * (x.T @ (p - label) / len(label) + 8 / len(pairs) * (a.T @ ((pa - pb) * pa * (1 - pa)) - b.T @ ((pa - pb) * pb * (1 - pb))) + 1e-4 * w)
    import pandas as pd

    got = toxicity.fit_weights(pd.Series(found), label, pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]), 6, 4.0)
    assert loss(got) < loss(w) + 1e-3 and np.abs(got - w).max() < 0.1


# ---- mixing


def plain_rates(tokens, p, want, steps=30_000):
    """Projected gradient on the dense problem, unweighted misses, without momentum."""
    a = (p * tokens[:, None]).T / tokens.sum()
    r, goal = np.ones(len(tokens)), want / tokens.sum()
    pace = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):
        r = np.maximum(0, r - pace * a.T @ (a @ r - goal))
    return r, np.abs(a @ r - goal).max()


@pytest.mark.parametrize("shares, settled", [((0.5, 0.3, 0.2), True), ((0.9, 0.05, 0.05), True), ((0.98, 0.01, 0.01), False), ((0.34, 0.33, 0.33), True)])
def test_rates_meet_what_a_plain_solver_meets(spark, shares, settled):
    rng = np.random.default_rng(5)
    p = rng.dirichlet((0.6, 0.5, 0.4), 400) * 0.9 + 0.1 / 3  # no document is all of one domain
    tokens = rng.integers(0, 300, 400).astype(float)
    scored = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(tokens, p)], "tokens long, p0 double, p1 double, p2 double").repartition(3)
    fit = mixing.fit_rates(scored, ["p0", "p1", "p2"], np.array(shares))
    ours = mixing.rates(p, fit.steps)[0]
    plain, miss = plain_rates(tokens, p, np.array(shares) * tokens.sum())
    reached = (tokens * ours) @ p
    assert np.allclose(reached, fit.have) and (ours >= 0).all() and fit.settled == settled
    if settled:
        assert miss < 5e-3 and (np.abs(reached - fit.want) <= mixing.NEAR * np.maximum(fit.want, mixing.LEAST * tokens.sum()) + 1e-9).all()
    else:
        weigh = np.linalg.inv((p * tokens[:, None]).T @ p)
        off = lambda x: (x - fit.want) @ weigh @ (x - fit.want)
        assert miss > 5e-3 and off(reached) <= 1.1 * off((tokens * plain) @ p)


def test_unreachable_targets_are_reported(spark):
    rows = [(k, f"any{k % 7} word{k % 5}", "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __m string")
    labels = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(60)], "doc_id long, label string")
    with pytest.warns(UserWarning, match="out of reach"):
        found = mixing.mix(docs, labels, {"a": 0.98, "b": 0.02})
    assert found.where("__m = 'x'").count() == 60
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).count() == 60


# ---- exact top-k


def test_pruning_verifies_fewer_products_than_pairs():
    rng = np.random.default_rng(6)
    flat, unit = rng.normal(size=(4000, 2)), rng.normal(size=(4000, 16))
    uneven = np.floor(1024 * flat * rng.lognormal(0, 1, (4000, 1))).astype(np.int64)
    even = np.floor(1024 * unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.int64)
    for some, way in ((uneven, "length"), (even, "coordinate")):
        lengths = np.sqrt((some.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        some, lengths, ids = some[order], lengths[order], order.astype(np.int64)
        q = some[::50]
        scores = q @ some.T
        floor = np.sort(scores, axis=1)[:, -11]
        tally = {}
        got = list(topk.block_top(ids[::50], q, lengths[::50], ids, some, lengths, 10, floor, tally))
        assert tally["verified"] < 0.7 * scores.size and tally.get(way, 0) > 0
        for k, query in enumerate(ids[::50].tolist()):
            best = sorted((-int(s), int(i)) for s, i in zip(scores[k], ids) if i != query)[:10]
            assert sorted((-s, v) for x, v, s in got if x == query)[:10] == best


def test_mixed_dimensions_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5]), (100, [2.0]), (200, []), (3, []), (300, None), (400, [1.0, float("nan")]), (100, [2.0]), (500, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS d", "2 AS bucket", "3 AS id").repartition(2)
    found = sorted(map(tuple, topk.top_k(docs, F.col("vec_id") % 100 == 0).collect()))
    one = 1024 * 1024
    assert found == [(0, 1, 1, 5 * one), (0, 2, 500, 3 * one), (100, 1, 2, one), (200, 1, 3, 0), (500, 1, 1, 4 * one), (500, 2, 0, 3 * one)]
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e16]), (1, [1.0])], docs.select("vec_id", "embedding").schema), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e7]), (1, [1e7])], docs.select("vec_id", "embedding").schema), F.col("vec_id") == 0).collect()


# ---- fingerprints


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fold(values, seed=42):
    for y in values:
        seed = h64(struct.pack("<q", y), seed)
    return seed


def plain_prints(texts):
    """(whole, slots) of a text, by the definition, with the lexicon's table as Python integers."""
    words = lambda t: {h64(w.encode()) for w in t.lower().replace("\n", " ").replace("\t", " ").split(" ") if w}
    df = Counter(h for t in texts for h in words(t))
    n = len(texts)
    band = [h for h, k in df.items() if max(2, n / imatch.RARE) <= k <= max(2, n * imatch.COMMON)]
    size = max(10, (imatch.BITS_EACH * len(band) - 1).bit_length())
    places = lambda h: [h >> k * (64 - size) // 2 & (1 << size) - 1 for k in range(3)]
    bits = {x for h in band for x in places(h)}

    def of(text):
        seen = words(text)
        held = [h for h in seen if all(x in bits for x in places(h))]
        held = sorted(signed(h64(b"lexicon", h64(struct.pack("<q", signed(h))))) for h in (held if len(held) >= imatch.FEW else seen))
        return fold(held), [fold([y for y in held if y % (1 << 64) >> 9 * s & (1 << m) - 1 == 0]) for s in range(imatch.SERIES) for m in imatch.SHARES]

    return of


def shown(x):
    return ":".join([f"{x[0]:016x}", *("-" if y == 42 else f"{y & 0xFFFFFF:06x}" for y in x[1])])


def like(x, y):
    if x == y:
        return 1.0
    held = [(a, b) for a, b in zip(x[1], y[1]) if a != 42 or b != 42]
    return sum(a == b != 42 for a, b in held) / len(held) if held else 0.0


def test_fingerprints_are_those_of_a_plain_version(spark):
    rng = random.Random(10)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["", "one", "two\nTwo\t three"]
    texts += texts[:3]
    rows = [(5 * k - 40, t) for k, t in enumerate(texts)]
    of = plain_prints(texts)
    found = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __id", "2 AS __tie").repartition(4)).collect()
    assert len(found) == len(rows)
    at = {k: n for n, (k, _) in enumerate(rows)}
    for r in found:
        n = at[r["doc_id"]]
        text, after = texts[n], texts[(n + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(of(text)), shown(of(edited)))
        assert r["near_edited"] == pytest.approx(like(of(text), of(edited))) and r["near_next"] == pytest.approx(like(of(text), of(after)))
    with pytest.raises(ValueError):
        imatch.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ---- languages


def test_mixtures_are_those_of_all_language_sets():
    """Every set of languages, its proportions by a long plain expectation-maximisation, the best penalised likelihood."""
    rng = random.Random(3)
    sounds = {"aa": ["bol", "kra", "tum", "zor"], "bb": ["lie", "sui", "nee", "fio"], "cc": ["x", "qu", "ych", "ght"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    model = []
    for lang in sounds:
        counts = np.bincount(langid.trigrams(say(lang, 3000)), minlength=langid.BUCKETS) + langid.SMOOTH
        model.append(np.log(counts / counts.sum()))
    model = np.array(model, np.float32)

    def plain(text):
        codes = langid.trigrams(text)
        prob, best = np.exp(model[:, codes].astype(float)), (-np.inf, None)
        for size in (1, 2, 3):
            for some in itertools.combinations(range(3), size):
                share = np.full(size, 1 / size)
                for _ in range(400):
                    drawn = share[:, None] * prob[list(some)]
                    share = (drawn / drawn.sum(axis=0)).mean(axis=1)
                value = np.log(share @ prob[list(some)]).sum() - (size - 1) * langid.PENALTY * np.log(len(codes) + 1)
                if value > best[0]:
                    best = value, dict(zip(some, share))
        return best[1]

    texts = [say(x, rng.randint(2, 60)) for x in sounds] + [f"{say(a, rng.randint(5, 80))} {say(b, rng.randint(5, 80))}" for a, b in itertools.permutations(sounds, 2)]
    texts.append(" ".join(say(x, 50) for x in sounds))
    for text in texts:
        got, want = langid.mixture(langid.trigrams(text), model), plain(text)
        assert set(np.flatnonzero(got)) == set(want)
        assert all(abs(got[k] - x) < 0.01 for k, x in want.items())


# ---- substrings


def test_windows_around_a_common_line_are_spread(spark):
    rng = random.Random(13)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = "all rights reserved by the owner of this page and of its texts"
    texts = [f"{new(30)} {line} {new(30)}" for _ in range(300)] + [new(70) for _ in range(600)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    hot = substrings.hot_grams(frame, sum(map(len, texts)), 3)
    lines = substrings.Lines("\n".join(texts).encode(), 35)
    assert len(hot) == len(line.split()) - 2
    most = []
    for known in (hot, hot[:0]):
        first, last, least = substrings.super_kmers(lines, 35, 3, known)
        size = Counter()
        for a, b, m in zip(lines.starts[first].tolist(), lines.ends[last + 34].tolist(), least.tolist()):
            size[m] += b - a
        most.append(max(size.values()))
    assert most[0] < 3000 < 30_000 < most[1]


# ---- packing


def test_bins_close_on_real_lengths_and_few_are_needed(spark):
    texts = [r["text"] or "" for r in table(spark, SF, "documents").select("text").collect()]
    sizes = [len(x) // 4 + 1 for x in packing.encode_all(texts, packing.default_tokenizer())]
    lengths = [x for n in sizes for x in [(n - 1) % packing.SEQUENCE + 1, *[packing.SEQUENCE] * ((n - 1) // packing.SEQUENCE)]]
    random.Random(1).shuffle(lengths)
    turns = [x for a in range(0, len(lengths), packing.LOOK_AHEAD) for x in sorted(lengths[a : a + packing.LOOK_AHEAD], reverse=True)]
    where, _ = packing.best_fit(turns)
    unbound, _ = packing.best_fit(turns, open_bins=1 << 30)
    assert where != unbound  # the bound was reached: bins have closed
    total = Counter()
    for at, n in zip(where, turns):
        total[at] += n
    assert max(total.values()) <= packing.SEQUENCE
    assert len(total) <= 1.015 * sum(lengths) / packing.SEQUENCE + 8


def test_topk_takes_no_product_twice_on_the_real_table():
    """On a table of one block the operator takes at most as many products as there are pairs."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    v = np.floor(1024 * np.array(table["embedding"], float)).astype(np.int64)
    ids, lengths = np.array(table["vec_id"]), np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, v, lengths = ids[order], v[order], lengths[order]
    asks, tally = ids % 100 == 0, {}
    query, vec, score, floor = topk.seeded(ids[asks], v[asks], lengths[asks], ids, v, lengths, 10, tally)
    assert tally["verified"] <= asks.sum() * len(ids)
    every = v[asks] @ v.T
    for k, q in enumerate(ids[asks].tolist()):
        best = sorted(((-int(s), int(i)) for s, i in zip(every[k], ids) if i != q))[:10]
        assert [(-int(s), int(i)) for s, i in zip(score[query == q], vec[query == q])] == best and floor[k] == -best[-1][0]
