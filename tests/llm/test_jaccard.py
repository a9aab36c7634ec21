"""The pipeline's near-duplicates beside a comparison of all pairs."""

import random

import pytest

from corpusmill.llm import jaccard


def plain_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) > n else {tuple(words)}


def plain_groups(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(root(k), set()).add(k)
    return set(map(frozenset, groups.values()))


def families(seed=11):
    """Texts with copies edited in few or many places, chains of edits, one larger family, exact copies and texts without words."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    edited = lambda words, n: [f"e{rng.randrange(9999)}" if k in at else w for at in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    texts = []
    for _ in range(60):
        base = new(rng.randint(12, 260))
        texts.append(base)
        texts += [edited(base, rng.randint(0, max(1, len(base) // 30))) for _ in range(3)]
        for _ in range(2):
            base = edited(base, max(1, len(base) // 60))
            texts.append(base)
    base = new(200)
    texts += [edited(base, rng.randint(1, 8)) for _ in range(150)]
    return [" ".join(x) for x in texts] + ["", None, " \n", "a b", "A  b", "a b c d e f", "a b c d e g"]


@pytest.mark.parametrize("members", [1024, 20])
def test_groups_are_those_of_all_pairs(spark, members, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    texts = families()
    rows = jaccard.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["root"], set()).add(r["id"])
    assert len(rows) == len(texts)
    assert set(map(frozenset, groups.values())) == plain_groups(texts)


def test_members_that_the_least_one_does_not_link_are_compared(spark):
    base = [f"w{k}" for k in range(100)]
    a, b, c = (" ".join([*base[:k], *(f"{x}{j}" for j in range(100 - k))]) for x, k in (("a", 30), ("b", 95), ("c", 96)))
    import numpy as np
    import pandas as pd

    sets = [jaccard.shingles(t).tobytes() for t in (a, b, c)]
    found = jaccard._meet(pd.DataFrame({"node": [1, 2, 3], "root": [1, 2, 3], "side": [0, 0, 0], "x": sets}))
    assert found.to_numpy().tolist() == [[2, 3]] and found["a"].dtype == np.int64


def test_the_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    texts = families(12)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (0, texts[0], "y")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(min, plain_groups(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
