"""The pipeline and the registered queries on the smallest tables."""

from collections import Counter
import random

import duckdb
import pytest

from corpusmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_answers_for_every_document(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_languages"](spark, SF).where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert got > 0.95


def plain_groups(texts):
    """Groups of texts whose five-word shingle sets are alike at 0.8, by all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)})
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(texts))]


def test_stages_take_effect(spark):
    import corpus_pipeline as P
    from corpusmill.llm.base import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = docs
    before = kept["languages"].select("doc_id", "text").collect()
    least = {}
    for r, group in zip(before, plain_groups([r["text"] for r in before])):
        least[group] = min(r["doc_id"], least.get(group, r["doc_id"]))
    one = kept["near_duplicates"]
    assert {r["doc_id"] for r in one.collect()} == set(least.values()) and one.count() == len(least)
    assert kept["repeats"].count() == one.count()
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    over = packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count()
    assert over == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __kept string, __rate string, __id string, __content string, fp long, node string, component string, __m string, __tokens int, __copy int"


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with the operators' own names."""
    rng = random.Random(5)
    sounds = {"en": ["the", "ing", "wh", "tion", "ed"], "de": ["sch", "ung", "zu", "keit", "ver"]}
    say = lambda x, n: " ".join("".join(rng.choice(sounds[x]) for _ in range(4)) for _ in range(n))
    rows = [(k, say(x, 60), x, "s", 60) for k, x in enumerate(["en", "de"] * 30)]
    rows += [(100, None, "en", None, None), (101, "", "de", "s", 0), (102, " \n ", None, "s", 3), (None, rows[0][1], None, None, None), (None, None, None, None, None), rows[4], rows[4]]
    rows += [(103, say("en", 20_000), "en", "s", 1), (104, f"{say('en', 30)} {say('de', 30)}", None, "s", 1)]
    return spark.createDataFrame([(*r, "x", "y", "z", "i", "c", 1, "n", "p", "m", 2, 3) for r in rows], ODD).repartition(3)


def test_stages_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as P

    docs = odd_documents(spark)
    spark.createDataFrame([(k, k % 4 != 1, int(k % 9 == 0)) for k in range(60)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "int(quality) AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    found = P.languages(spark, docs, folder)
    assert found.columns == docs.columns and found.where("__lang = 'x' AND node = 'n'").count() == found.count()
    texts = [r["text"] for r in found.collect()]
    assert len(texts) == docs.count() - 4 and all(t and any(map(str.isalpha, t)) for t in texts)  # null, empty and letterless ones go
    one = P.near_duplicates(spark, docs, folder)
    rows = docs.collect()
    assert one.columns == docs.columns and one.count() == len(set(plain_groups([r["text"] for r in rows])))
    assert one.where("doc_id IS NULL").count() == 0  # a known id is kept before an unknown one
    cut = P.repeats(spark, docs, folder)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = {r["doc_id"]: r for r in cut.collect()}
    assert left[4]["text"] == "" and left[4]["n_chars"] == 0 and left[100]["text"] is None and left[102]["text"] == " \n "
    mixed = P.mixture(spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.where("__copy = 3 AND __tokens = 2").count() == mixed.count() > 0
    times = {}
    for r in mixed.collect():
        times.setdefault((r["doc_id"], r["text"]), []).append(r)
    repeated = [(key, n) for key, n in Counter((r["doc_id"], r["text"]) for r in rows).items() if n > 1]
    assert repeated and all(len(times.get(key, [])) % n == 0 for key, n in repeated)  # repeated rows have equal numbers of copies
    packed = P.sequences(spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
