"""Stored indexes: vectors beside all pairs, with recall, filters and the shards that they read; keywords beside a scan of all documents,
before and after updates."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.index import keywords, vectors
from corpusmill.index.embeddings import EmbeddingCache
from corpusmill.index.keywords import KeywordIndex
from corpusmill.index.vectors import VectorIndex

SF = "/root/testdata/sf0.1"


def all_pairs(ids, v, asks, k, able=None, least=-2.0):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for a in asks:
        score = np.round(u @ u[a], 10)
        some = [i for i in range(len(ids)) if (able is None or able[i]) and score[i] >= least]
        out[int(ids[a])] = [int(ids[i]) for i in sorted(some, key=lambda i: (-score[i], ids[i]))[:k]]
    return out


def found_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def embedded(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    return table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float), table["label"].to_numpy()


def asked(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_every_row_is_indexed_and_walks_recall_nine_tenths(spark, embedded, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 900)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 500)
    ids, v, _ = embedded
    made = VectorIndex(spark, str(tmp_path / "ix")).build(spark.read.parquet(f"{SF}/embeddings.parquet"))
    lists, shards, n = made.size().first()
    assert n == len(ids) and lists == 3 and shards > 3
    held = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in spark.read.parquet(str(tmp_path / "ix/shards")).select("ids").collect()])
    assert sorted(held.tolist()) == sorted(ids.tolist())
    want = all_pairs(ids, v, np.flatnonzero(ids % 20 == 0), 10)
    assert found_of(made.search(asked(spark), 10, exact=True).collect()) == want
    monkeypatch.undo()
    large = VectorIndex(spark, str(tmp_path / "large")).build(spark.read.parquet(f"{SF}/embeddings.parquet"))
    for index, options, most in ((made, {"breadth": 40}, 1.0), (large, {"breadth": 20}, 0.5), (large, {}, 0.65)):
        rows = index.search(asked(spark), 10, **options).collect()
        found = found_of(rows)
        recall = np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want])
        looked = np.mean([r["looked"] for r in rows if r["rank"] == 1]) / len(ids)
        print(f"recall {recall:.3f}, {looked:.2f} of all pairs")
        assert recall >= 0.9 and looked < most and len(found) == len(want), (recall, looked)
    fewer = made.search(asked(spark), 10, probe=1, exact=True).collect()
    assert np.mean([r["looked"] for r in fewer]) < 0.6 * len(ids)


def test_filters_read_matching_shards_only(spark, embedded, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 300)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    ids, v, label = embedded
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), F.when(F.col("vec_id") == 777, F.array(F.lit("rare"), F.lit("odd"))).when(F.col("vec_id") % 2 == 1, F.array(F.lit("odd"))).alias("tags"))
    made = VectorIndex(spark, str(tmp_path / "ix")).build(rows, payload=["label", "tags"])
    asks = np.flatnonzero(ids % 20 == 0)
    for where, able, least in (({"label": ["1", "3"]}, np.isin(label, [1, 3]), -2.0), ({"label": ["1", "3"], "tags": ["odd"]}, np.isin(label, [1, 3]) & (ids % 2 == 1), 0.1)):
        found = made.search(asked(spark), 10, exact=True, where=where, least=least).collect()
        assert found_of(found) == {q: x for q, x in all_pairs(ids, v, asks, 10, able, least).items() if x}
        near = made.search(asked(spark), 10, breadth=400, where=where).collect()
        want = all_pairs(ids, v, asks, 10, able)
        got = found_of(near)
        assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9 and all(able[np.searchsorted(ids, i)] for x in got.values() for i in x)
    assert made.matching({"tags": ["rare"]}).count() == 1 < made.size().first()["shards"]  # one shard is read, in one folder of many
    assert made.matching({"tags": ["rare"], "label": ["nowhere"]}).count() == 0 and made.matching({"label": []}).count() == 0
    assert {r["vec_id"] for r in made.search(asked(spark), 10, where={"tags": ["rare"]}).collect()} == {777}


def test_unsound_vectors_take_no_part(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0])]
    made = VectorIndex(spark, str(tmp_path / "ix")).build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0])], "query_id long, query_vector array<double>")
    assert {(r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in made.search(queries, 5).collect()} == {(1, 1, 1.0, 1), (1, 8, 1.0, 2), (1, 2, 0.6, 3)}
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>"))


def test_a_search_holds_one_shard_and_some_queries_at_a_time(spark, embedded, tmp_path, monkeypatch):
    """One list with many shards and more queries than a task takes: each group that workers get is one shard beside a part of the queries,
    where whole lists of shards and groups of queries used to come as one Arrow batch."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "ASKED", 30)
    ids, v, _ = embedded
    made = VectorIndex(spark, str(tmp_path / "ix")).build(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert made.size().first()["lists"] == 1 and made.size().first()["shards"] == 20
    for options in ({"exact": True}, {"exact": True, "where": None, "probe": 1}):
        found = made.search(asked(spark), 10, **options)
        assert found_of(found.collect()) == all_pairs(ids, v, np.flatnonzero(ids % 20 == 0), 10)
        assert {r["looked"] for r in found.collect()} == {len(ids)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")


def plain_bm25(docs, queries, k):
    terms = {i: (t or "").lower().split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(t for x in terms.values() for t in set(x))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = set()
    for q, text in queries:
        score = {}
        for i, x in terms.items():
            tf = Counter(x)
            s = round(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for t in text.lower().split() if t in tf), 10)
            if s > 0:
                score[i] = s
        out |= {(q, i, r) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1)}
    return out, {(t, d, round(idf[t], 6)) for t, d in df.items()}


def test_keywords_match_a_scan_before_and_after_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "RARE", 10)
    monkeypatch.setattr(keywords, "BLOCK", 40)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([4, 30, 120])]) for _ in range(rng.randint(0, 40)))
    docs = [(k, text()) for k in range(400)] + [(1000, None), (1001, ""), (1002, "Only HERE")]
    queries = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for k in range(40)] + [(99, "nothing like it"), (98, "only here w1"), (97, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asks = spark.createDataFrame(queries, "query_id long, question string")
    made = KeywordIndex(spark, str(tmp_path / "ix")).build(frame(docs))

    def same(now):
        want, stats = plain_bm25(now, queries, 5)
        for whole in (False, True, None) if now is docs else (False,):
            got = {(r["query_id"], r["doc_id"], r["rank"]) for r in made.search(asks, 5, whole=whole).collect()}
            assert got == want, whole
        assert {(r["term"], r["df"], round(r["idf"], 6)) for r in made.statistics().collect()} == stats

    same(docs)
    later = [(k, text()) for k in range(350, 500)]  # 350 to 399 and 1000 are replaced
    made.update(frame([*later, (1000, "w5 w5 now it has words")]), frame([(k, None) for k in range(0, 100, 3)] + [(777, None)]))
    now = [(i, t) for i, t in docs if not (i < 100 and i % 3 == 0) and not 350 <= i < 400 and i != 1000] + [*later, (1000, "w5 w5 now it has words")]
    same(now)
    made.update(None, frame([(k, None) for k in (360, 1000, 1001)]))
    now = [x for x in now if x[0] not in (360, 1000, 1001)]
    same(now)
    again = KeywordIndex(spark, str(tmp_path / "again")).build(frame(now))
    assert Counter(map(tuple, again.search(asks, 5).collect())) == Counter(map(tuple, made.search(asks, 5).collect()))
    with pytest.raises(ValueError):
        KeywordIndex(spark, str(tmp_path / "none")).search(asks, 5)


def test_segments_are_parsed_where_they_lie_and_summed_in_arrays(spark, tmp_path, monkeypatch):
    """Segments of several tasks, blocks cut by weight and number, scores of a few documents at a time: as a plain scan has it. Building
    shuffles no posting, a plain search makes no row for a posting and a query, and an update none for a posting."""
    for name, most in (("RARE", 3), ("BLOCK", 4), ("DOCS", 3), ("QUERIES", 2)):
        monkeypatch.setattr(keywords, name, most)
    docs = [(k, " ".join(f"W{k * j % (5 if j % 2 else 40)}" for j in range(k % 23))) for k in range(90)] + [(200, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    queries = [(1, "w1 w3 w3"), (2, "w0 w38"), (3, "none"), (4, "w2"), (5, "w4 w12 w1")]
    asks = spark.createDataFrame(queries, "query_id long, question string")
    made = KeywordIndex(spark, str(tmp_path / "ix")).build(frame)
    stored = spark.read.parquet(str(tmp_path / "ix/postings")).where("term IS NOT NULL")
    assert stored.select("segment").distinct().count() == 4 and stored.agg(F.max("n")).first()[0] == 4 and stored.where("step > 0 AND part > 0").count()
    assert stored.where("n <> size(ids) OR max_tf <> array_max(tfs) OR min_dl <> array_min(dls)").count() == 0
    found = made.search(asks, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "explode(arrays_zip" not in plan
    monkeypatch.setattr(KeywordIndex, "_postings", None)
    same = lambda now: {(r["query_id"], r["doc_id"], r["rank"]) for r in made.search(asks, 7).collect()} == plain_bm25(now, queries, 7)[0] and {(r["term"], r["df"], round(r["idf"], 6)) for r in made.statistics().collect()} == plain_bm25(now, queries, 7)[1]
    assert same(docs)
    made.update(frame.where("doc_id = 5").withColumn("text", F.lit("w1 w1 new")), frame.where("doc_id % 3 = 0"))
    assert same([(k, "w1 w1 new" if k == 5 else t) for k, t in docs if k % 3 or k == 5])


def test_lasting_cache_embeds_each_text_once(spark, tmp_path):
    asked = tmp_path / "asked"

    def load():
        def run(texts):
            with open(asked, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return run

    docs = spark.createDataFrame([(k, f"text {k % 30}") for k in range(90)] + [(100, None), (101, "")], "doc_id long, text string").repartition(4)
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", "m", load, 2, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for _ in range(2):
            rows = cache.embedded(docs).collect()
            assert len(rows) == 92 and all(r["vector"] == (None if r["text"] is None else [len(r["text"]), 1.0]) for r in rows)
            assert sorted(asked.read_text().splitlines()) == sorted(["", *{f"text {k}" for k in range(30)}])  # the second run asks for nothing
        plan = cache.embedded(docs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the texts'; the cache's side is read as it lies
        spark.createDataFrame([(x["key"], [9e9, 1.0]) for x in cache.read().limit(3).collect()], "key string, vector array<float>").write.insertInto(cache.table)  # another run's
        assert cache.read().count() == 31
        cache.compact()
        assert spark.table(cache.table).count() == 31 == cache.read().count()
        again = EmbeddingCache(spark, f"file://{tmp_path}/cache", "m", load, 2, buckets=4)
        assert again.missing(docs).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
