"""Stemming, token-set scores, and the fuzzy join against all pairs."""

import random

import pytest
from plumbago.functions.stem import stem
from plumbago.operators import fuzzy as Z


@pytest.mark.parametrize("word,want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"),
    ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"),
    ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("rolling", "roll"), ("sky", "sky"), ("generalizations", "gener"), ("oscillators", "oscil"), ("is", "is"), ("", ""),
])
def test_stem(word, want):
    assert stem(word) == want


def test_fuzzy_join_finds_all_pairs(spark):
    rng = random.Random(7)
    words = ["load", "loading", "data", "the", "plots", "plot", "model", "models", "visualization", "visualisation", "characteristic", "characteristics", "a", "regression", "internationalisation", "internationalization"]
    labels = {" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(250)}
    labels |= {"x" * n for n in range(1, 40)} | {"ab" * 12 + c for c in "pqr"} | {"", "--", "Load Data!", "load  data", "very long label about the regression model of data", "very long label about the regressions model of dats"}
    df = spark.createDataFrame([(x,) for x in labels] + [(None,), ("load data",), ("load data",)], "label string")
    got = Z.fuzzy_parents(df, "label").collect()
    labels.add("load data")
    assert sorted(r.child for r in got if r.kind == "root") == sorted(labels)
    keys = dict(zip(labels, Z.stemmed_set.__wrapped__(list(labels)) if hasattr(Z.stemmed_set, "__wrapped__") else [key_of(x) for x in labels]))
    first = {}
    for x in sorted(labels, key=lambda x: (len(x), x)):
        if keys[x]:
            first.setdefault(keys[x], x)
    assert {(r.parent, r.child) for r in got if r.kind == "same"} == {(first[keys[x]], x) for x in labels if keys[x] and first[keys[x]] != x}
    want, every = set(), sorted(first.values(), key=lambda x: (len(x), x))
    for i, a in enumerate(every):
        want |= {(a, b) for b in every[i + 1 :] if Z.token_set_score(keys[a], keys[b]) >= 95}
    like = [(r.parent, r.child) for r in got if r.kind == "like"]
    assert len(like) == len(set(like)) and set(like) == want and len(want) > 100


def key_of(x):
    kept = "".join(c if c.isalnum() else " " for c in " ".join(stem(w) for w in x.lower().split()))
    return " ".join(sorted(set(kept.split())))


def test_few_candidates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(500)]
    df = spark.createDataFrame([(" ".join(sorted({"the", "of", *rng.sample(words, 3)})),) for _ in range(1500)], "key string").distinct()
    n = df.count()
    assert Z.candidates(df).count() < n * (n - 1) / 2 / 5


def test_common_words_make_few_candidates(spark):
    rng = random.Random(5)
    colours = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(30)]
    keys = {" ".join(sorted(rng.sample(colours, 5))) for _ in range(400)}
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    n = len(keys)
    assert Z.candidates(df).count() < n * (n - 1) / 2 / 50


def test_alike_keys_meet_in_blocks(spark, monkeypatch):
    """Pairs that share frequent parts are compared in blocks, none is a row before it passes."""
    monkeypatch.setattr(Z, "BLOCK", 40)
    monkeypatch.setattr(Z, "AT_ONCE", 7)
    rng = random.Random(11)
    keys = {" ".join(sorted({"".join(rng.choices(["an", "the", "er", "on"], k=4)) for _ in range(7)})) for _ in range(120)}
    keys |= {k[:9] + "x" + k[10:] for k in list(keys)[:60]}
    keys = {" ".join(sorted(set(k.split()))) for k in keys}
    got = Z.candidates(spark.createDataFrame([(k,) for k in keys], "key string"))
    pairs = {(r.x, r.y) for r in got.collect()}
    every = sorted(keys)
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if Z.token_set_score(a, b) >= 95}
    assert len(want) > 30 and want <= pairs
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().toString()
