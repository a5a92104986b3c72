"""Trained operators: held-out accuracy, constants without labels, and what the pipeline's stages do."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbago.llm import entries, mixing, quality, simhash, toxicity
from plumbago.llm.quality import isotonic

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    x = entries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = x[x.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95
    assert (x[x.toxic == 1].predicted == 1).mean() > 0.85


def test_quality_held_out(spark):
    x = entries.op3_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.93
    assert x.score.between(0, 1).all()


def test_models_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(toxicity.labelled_rows(odd_docs, none))
    got = toxicity.score(odd_docs, m, keep=["doc_id", "h"]).collect()
    assert len(got) == 11 and {r.predicted for r in got} == {0}
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.0}
    mix = mixing.fit(odd_docs, none)
    assert mixing.apply(odd_docs, mix, keep=odd_docs.columns).count() == 11


def test_models_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (7, 1, 0), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    m = toxicity.fit(toxicity.labelled_rows(odd_docs, labels))
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd_docs, m, keep=["doc_id"]).collect())
    empty = odd_docs.limit(0)
    assert quality.classify(empty, labels).collect() == []
    assert mixing.apply(empty, mixing.fit(empty, labels), keep=["doc_id"]).collect() == []


def test_isotonic_brute_force():
    rng = np.random.default_rng(1)
    x, n = np.arange(30.0), rng.integers(1, 9, 30).astype(float)
    ones = rng.binomial(n.astype(int), 0.5).astype(float)
    knots = isotonic(x, n, ones)
    assert (np.diff(knots[1]) > 0).all() and abs((ones.sum() - sum(0 for _ in x)) - ones.sum()) < 1e-9
    # the least-squares monotone fit by the min-max formula
    best = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert sorted(set(np.round(best, 9))) == sorted(set(np.round(knots[1], 9)))


def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    mix = mixing.fit(docs, labels)
    x = mixing.apply(docs, mix, keep=["doc_id"]).toPandas()
    tokens = {d: (x[f"p_{d}"] * x.rate * x.n_tokens).sum() for d in mixing.TARGETS}
    for d, share in mixing.TARGETS.items():
        assert abs(tokens[d] / sum(tokens.values()) - share) < 0.005
    assert (x.rate >= 0).all()
    assert abs(x.copies.sum() - x.rate.sum()) < 0.05 * len(x)


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = entries.stage_toxicity(spark, docs, SF)
    scored = entries.op2_toxicity(spark, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert clean.columns == docs.columns
    cut = entries.stage_line_dedup(spark, clean, SF)
    assert cut.columns == docs.columns and cut.count() == clean.count()
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    one = entries.stage_simhash(spark, cut, SF)
    groups = simhash.near_duplicates(cut, words=5, similarity=0.8).toPandas()
    assert {r.doc_id for r in one.collect()} == set(groups.component_id)
    mixed = entries.stage_mixing(spark, one, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0.8 * one.count()
    last = entries.stage_sentencepiece(spark, mixed, SF)
    assert last.count() == mixed.count() and last.where("NOT round_trip").count() == 0


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_all_labelled_rows_are_counted(spark):
    n = 250_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4000 == 0, "zyxw").otherwise("plain").alias("text"))
    rows = toxicity.labelled_rows(docs, docs.select("doc_id", (F.col("doc_id") % 4000 == 0).cast("int").alias("toxic")))
    assert rows.count() == n
    assert {(r.text, r.toxic): r["count"] for r in rows.groupBy("text", "toxic").count().collect()} == {("zyxw", 1): 63, ("plain", 0): n - 63}


def test_toxicity_pairs_at_any_size(spark):
    """The same proportions in more rows never lower the log ratio of a pair that only toxic texts have (it rises, as the other class's backoff gets surer)."""
    got = []
    for n in (2000, 40000):
        rng = np.random.default_rng(4)
        names = np.array(["".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(3000)])
        words = names[rng.integers(0, 3000, (n, 12))]
        rows = [(" ".join([*w[:6], "vile", "thing", *w[6:]] if i % 10 == 0 else [*w[:6], "vile", *w[6:9], "thing", *w[9:]]), int(i % 10 == 0)) for i, w in enumerate(words)]
        docs = spark.createDataFrame(pd.DataFrame(rows, columns=["text", "toxic"]))
        counts = toxicity.ngram_counts(docs.selectExpr("text", "toxic AS y"))
        model = toxicity.from_counts(counts)
        w, ids = toxicity.expressions([b"vile thing"])
        key = (toxicity.contexts(w, ids) << np.uint64(32) | ids)[1]
        [place] = np.flatnonzero(model.pairs.keys == key)
        got.append(model.pairs.values[place])
    assert 2 < got[0] <= got[1], got


def test_toxicity_keeps_all_ngrams_that_pass(spark, monkeypatch):
    """With hardly any key in memory the model is the same: none that pass the test is left out."""
    rng = np.random.default_rng(5)
    vile, names = ([f"{c}{''.join(chr(97 + (i // 26**k) % 26) for k in range(4))}" for i in range(300)] for c in "vn")
    rows = [(" ".join([*rng.choice(names, 20), *(rng.choice(vile, 10) if i % 4 == 0 else []), "ab", "cd"]), int(i % 4 == 0)) for i in range(3000)]
    rows = [(f"{t} nasty {'word' if y else 'wound'}", y) for t, y in rows]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["text", "y"]))
    counts = toxicity.ngram_counts(docs)
    whole = toxicity.from_counts(counts)
    monkeypatch.setattr(toxicity, "FILE_KEYS", 64)
    few = toxicity.from_counts(counts, max_keys=1)
    assert len(whole.words.keys) > 200 and isinstance(few.words, toxicity.Mapped) and abs(whole.base - few.base) < 1e-9
    for a, b in ((whole.words, few.words), (whole.contexts, few.contexts), (whole.pairs, few.pairs)):
        assert (a.keys == b.keys).all() and np.allclose(a.values, b.values, atol=1e-9)
    texts = [t.encode() for t, _ in rows[:200]]
    assert np.allclose(whole.difference(texts), few.difference(texts), atol=1e-9)
    scored = [[r.score for r in toxicity.score(docs.limit(200), m, text_col="text", keep=["y"]).collect()] for m in (whole, few)]
    assert np.allclose(*scored, atol=1e-9)


def test_mixing_against_direct_least_squares(spark):
    """Rates of scarce domains rise as far as they have to; the gap is that of a long projected gradient descent."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([8, 1, 0.2], 3000)
    n = rng.integers(1, 400, 3000)
    soft = spark.createDataFrame(pd.DataFrame({"id": range(3000), "n_tokens": n, "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]}))
    for targets, most in (({"plain": 0.6, "low": 0.1, "toxic": 0.3}, np.inf), ({"plain": 0.6, "low": 0.3, "toxic": 0.1}, np.inf), ({"plain": 0.75, "low": 0.15, "toxic": 0.1}, 12.0)):
        mixture = mixing.Mixture(list(targets), toxicity.Model(), None, most)
        mixing.project(soft, mixture, targets, "plain", 1.0, 16)
        a = p * n[:, None]
        share = np.array(list(targets.values()))
        want = share * a[:, 0].sum() / share[0]
        r, step = np.ones(3000), 1 / np.linalg.eigvalsh(a.T @ a)[-1]
        for _ in range(20000):
            r = np.clip(r - step * a @ (a.T @ r - want), 0, most)
        got = mixture.rates(p)
        assert (got >= 0).all() and (got <= most).all()
        direct, ours = (float(np.abs(a.T @ x - want).max() / want.sum()) for x in (r, got))
        assert ours <= direct + 2e-3 and abs(mixture.gap - ours) < 1e-9, (targets, most, ours, direct, mixture.gaps)


def test_texts_without_labels_stay_out_of_the_shuffle(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.where("doc_id % 100 = 7").selectExpr("doc_id", "1 AS toxic")
    rows = toxicity.labelled_rows(docs, labels)
    assert {r.text for r in rows.collect()} == {f"text {i}" for i in range(7, 2000, 100)}
    assert "run(" in rows._jdf.queryExecution().executedPlan().toString()
    # other types are compared as a join compares them
    assert toxicity.labelled_rows(docs, labels.withColumn("doc_id", F.col("doc_id").cast("double"))).count() == 20
