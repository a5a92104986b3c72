"""Stored indexes and sparse-vector search: additions, pruning, brute force, lists left unread."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbago.functions.text import tokens
from plumbago.operators import index as I
from plumbago.operators import retrieval as R
from plumbago.runtime import scratch


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    names = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.randint(0, 50)))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 w1"), (903, "w1 w1")]
    return spark.createDataFrame(rows, "id long, text string")


def test_additions_equal_one_build(spark, docs):
    t = tokens(F.col("text"), r"\S+")
    whole = I.Store(spark, scratch(spark, "s")).add(docs, "id", t)
    parts = I.Store(spark, scratch(spark, "s")).add(docs.where("id < 100"), "id", t)
    before = {p for p in parts.postings().inputFiles()}
    parts.add(docs.where("id >= 100"), "id", t)
    assert before < set(parts.postings().inputFiles())
    assert sorted(whole.postings().collect()) == sorted(parts.postings().collect())
    assert whole.statistics().collect() == parts.statistics().collect() and whole.statistics().first().n_docs == 304
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("q"), F.explode(t).alias("term")).distinct()
    found = [sorted(map(tuple, R.top_k(R.bm25(s.postings(asked.select("term").distinct()), s.statistics(), asked), 5).collect())) for s in (whole, parts)]
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]]


def test_only_the_terms_folders_are_read(spark, docs):
    s = I.Store(spark, scratch(spark, "s")).add(docs, "id", tokens(F.col("text"), r"\S+"))
    terms = spark.createDataFrame([("w3",)], "term string")
    got = s.postings(terms)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    files = {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()}
    assert {r.term for r in got.collect()} == {"w3"} and len(files) > 0
    scanned = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scanned is not None


def brute(docs, asked, k):
    tf = {i: Counter(t.lower().split()) for i, t in docs if t}
    df = Counter(x for c in tf.values() for x in c)
    idf = {x: math.log((1 + len(tf)) / (1 + n)) + 1 for x, n in df.items()}

    def unit(c):
        v = {x: (1 + math.log(n)) * idf[x] for x, n in c.items() if x in idf}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / norm for x, y in v.items()} if norm else {}

    vec = {i: unit(c) for i, c in tf.items()}
    out = set()
    for q, t in asked:
        u = unit(Counter((t or "").lower().split()))
        s = [(i, sum(y * v.get(x, 0) for x, y in u.items())) for i, v in vec.items()]
        s = sorted((x for x in s if x[1] > 0), key=lambda x: (-round(x[1], 9), x[0]))
        out |= {(q, i, r + 1) for r, (i, _) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("k", [1, 3, 500])
def test_most_similar_brute_force(spark, docs, k):
    t = tokens(F.col("text"), r"\S+")
    v = I.Vectors(docs, "id", t)
    asked = docs.where("id % 20 = 0 OR id >= 900")
    got = {(r.q, r.doc, r["rank"]) for r in I.most_similar(v, v.queries(asked, "id", t), k).collect()}
    rows = [tuple(r) for r in docs.collect()]
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0 or r[0] >= 900], k)


def test_long_lists_stay_unread(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([f"c{j}" for j in range(4)] + [f"r{rng.randrange(150)}" for _ in range(12)])) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, text string")
    t = tokens(F.col("text"), r"\S+")
    v = I.Vectors(d, "id", t)
    q = v.queries(d.where("id % 20 = 0"), "id", t)
    assert I.unread_share(v, I.bounds(v, q, 2)) > 0.5
    got = I.most_similar(v, q, 2).groupBy("q").agg(F.collect_set("doc").alias("d")).collect()
    assert all(set(r.d) == {r.q % 1000, r.q % 1000 + 1000} for r in got)


def test_no_row_a_pair_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 64)
    d = spark.createDataFrame([(i, f"the of a w{i} v{i // 2}") for i in range(400)], "id long, text string")
    t = tokens(F.col("text"), r"\S+")
    v = I.Vectors(d, "id", t)
    got = I.most_similar(v, v.queries(d, "id", t), 2)
    assert {(r.q, r.doc, r["rank"]) for r in got.collect()} == {(q, q, 1) for q in range(400)} | {(q, q ^ 1, 2) for q in range(400)}
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "HashAggregate" not in plan


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, docs):
    t = tokens(F.col("text"), r"\S+")
    s = I.Store(spark, scratch(spark, "s")).add(docs, "id", t)
    asked = docs.where("id % 20 = 0").select(F.col("id").alias("q"), F.explode(t).alias("term")).distinct()
    plan = R.bm25(s.postings(), s.statistics(), asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")]


def test_rounds_of_blocks_keep_few_copies_on_disk(spark, docs, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    monkeypatch.setattr(I, "ADDED", 64)
    monkeypatch.setattr(I, "AT_ONCE", 7)
    kept, stored = [], I._stored
    monkeypatch.setattr(I, "_stored", lambda s, df, *by: kept.append(df.columns) or stored(s, df, *by))
    t = tokens(F.col("text"), r"\S+")
    v = I.Vectors(docs, "id", t)
    got = I.most_similar(v, v.queries(docs, "id", t), 3)
    # the rounds before the last are done and stored when the last one is asked for
    assert kept.count(["q", "doc", "score", "rank"]) > 5
    rows = [tuple(r) for r in docs.collect()]
    assert {(r.q, r.doc, r["rank"]) for r in got.collect()} == brute(rows, rows, 3)


def test_a_written_tables_shuffle_is_deleted(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    shuffled = lambda: sum("shuffle_" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files()))
    spark.range(1000).repartition(8, "id").write.parquet(scratch(spark, "s"))
    left = shuffled()
    out = I._stored(spark, spark.range(1000).repartition(9, "id"))
    for _ in range(50):
        if shuffled() <= left:
            break
        time.sleep(0.1)
    assert out.count() == 1000 and shuffled() <= left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_search_without_an_index(spark, docs, monkeypatch):
    monkeypatch.setattr(R, "ASKED", 3)
    t = tokens(F.col("text"), r"\S+")
    every = docs.withColumn("text", F.concat(F.lit("All "), "text"))  # a term of all texts but the null one
    for d in (docs, every.where("text IS NOT NULL"), docs.unionByName(docs.where("id < 40")), docs.withColumn("id", F.concat(F.lit("k"), "id"))):
        asked = docs.where("id % 20 = 0").select(F.col("id").alias("q"), F.explode(t).alias("term")).union(spark.createDataFrame([(7, "all"), (8, "none"), (9, "w1")], "q long, term string")).distinct()
        stats = d.agg(F.count("*").alias("n_docs"), F.avg(F.size(t)).alias("avgdl"))
        want = R.top_k(R.bm25(R.postings(d, "id", t), stats, asked), 4)
        got = R.bm25_search(d, "id", "text", asked, 4, r"\S+")
        rounded = lambda df: sorted((r.q, r["rank"], r.doc, round(r.score, 9)) for r in df.collect())
        assert rounded(got) == rounded(want) and got.count() > 50
    # texts are neither exploded nor shuffled
    plan = R.bm25_search(docs, "id", "text", asked, 4, r"\S+")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_relevance_brute_force(spark):
    rng = random.Random(3)
    words = [f"{c}{i}" for c in "ab\xe9" for i in range(6)]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)] + [None, "", " "]
    asked = [t[a : a + rng.choice([1, 4, 9, 25])] for t in texts[:60] for a in [rng.randrange(len(t))]] + ["", "no such words are here at all", None, texts[3], texts[3]]
    d = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "q long, text string")
    got = R.relevance(q, d)
    want = sorted((i, j) for i, a in enumerate(asked) for j, t in [*enumerate(texts), (3, texts[3])] if a is not None and t is not None and a in t)
    assert sorted((r.q, r.doc) for r in got.collect()) == want
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_all_texts_ask(spark):
    from plumbago.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    asked = {r.q for r in QUERIES["ret9_code_for_text"](spark, sf).select("q").distinct().collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '(?i)[a-z0-9]{8}'").count()
    assert len(asked) > 0.9 * texts and any(q % 20 for q in asked)
    turns = {r.q for r in QUERIES["ret12_tutorials_for_cells"](spark, sf).select("q").distinct().collect()}
    assert {q % 1000 for q in turns} >= {0, 1} and any(q // 1000 % 20 for q in turns)
