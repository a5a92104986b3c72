"""Operators on small literal tables, with nulls, ties and empty input."""

from pyspark.sql import functions as F

from plumbago.functions import code as C
from plumbago.functions import numbers as N
from plumbago.functions import text as T
from plumbago.operators import aggregates, cells, graph, hierarchy, metrics, retrieval, sequences


def one(df):
    return [tuple(r) for r in df.collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs(spark):
    cases = [(list("abcbdab"), list("bdcaba")), ([], list("ab")), (list("ab"), []), (list("aaa"), list("aa"))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    assert {r.i: r.n for r in df.select("i", sequences.lcs(F.col("a"), F.col("b")).alias("n")).collect()} == {i: lcs(a, b) for i, (a, b) in enumerate(cases)}


def test_squeeze_and_prefix(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"], ["a ", "a", "c"])], "x array<string>, y array<string>")
    assert one(df.select(F.array_join(cells.squeezed(F.col("x")), ""), cells.common_prefix(F.slice("x", 1, 3), F.col("y")))) == [("aba", 2)]


def test_parents_and_paths(spark):
    df = spark.createDataFrame([(1, 0, "# A"), (1, 1, "## B"), (1, 2, "x"), (1, 3, "# C"), (1, 4, "y")], "nb_id int, pos int, content string")
    tree = hierarchy.parents(df)
    assert {r.pos: r.parent for r in tree.collect()} == {0: None, 1: 0, 2: 1, 3: None, 4: 3}
    assert sorted(r.path for r in hierarchy.leaf_paths(tree).collect()) == ["# A->## B->x", "# C->y"]


def test_metric_numbers(spark):
    df = spark.createDataFrame([("12.5M",), ("87%",), ("-",), (None,), ("x",)], "x string")
    assert [r[0] for r in df.select(N.metric(F.col("x"))).collect()] == [12.5e6, 87.0, None, None, None]


def test_facts_of_broken_code():
    assert C.facts("x = (")["error"] == "SyntaxError"
    assert C.facts(None)["ok"]


def test_majority_tie_goes_to_first(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, l string, r int")
    assert one(aggregates.majority(df, "k", "l", "r")) == [(1, "b", 2)]


def test_match_and_reach(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a"), ("b", "q", "c")], "sub string, rel string, obj string")
    assert one(graph.match(e, [("?x", "p", "?y"), ("?y", "q", "c")]).select("x")) == [("a",)]
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted(one(graph.reach(e, start, 5))) == [("a", 0), ("b", 1), ("c", 2)]
    assert one(graph.reach(e.limit(0), start, 5)) == [("a", 0)]


def test_vector_search_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(20, [0.0, 1.0])], "id long, v array<double>")
    got = retrieval.vector_top_k(df.where("id = 0"), df, 3, "id", "v", exclude_self=True)
    assert sorted(r.doc for r in got.collect()) == [1, 2, 3]


def test_bleu_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "id int, pred array<string>, true array<string>")
    assert one(metrics.corpus_bleu(df)) == [(100.0,)]
    assert one(metrics.rouge_l(df)) == [(1, 1.0, 1.0, 1.0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("parseHTTPUrl",)], "x string")
    assert one(df.select(F.array_join(T.identifier_terms(F.col("x")), " "))) == [("parse http url",)]
    assert one(df.limit(0).select(T.clean_step(F.col("x")))) == []


def test_next_step_brute_force(spark):
    corpus = {1: list("abcab"), 2: list("bcd"), 3: ["a"], 4: list("ccabd"), 5: []}
    prompts = {0: list("abc"), 7: list("cd"), 8: [], 9: ["z"]}
    want = {}
    for i, p in prompts.items():
        best = min((-lcs(p, s[:d]), k, d, s[d]) for k, s in corpus.items() for d in range(1, len(s)))
        want[i] = (best[3], -best[0])
    p = spark.createDataFrame(list(prompts.items()), "id int, prefix array<string>")
    c = spark.createDataFrame(list(corpus.items()), "seq_id int, seq array<string>")
    assert {r.id: (r.next, r.score) for r in sequences.next_step(p, c).collect()} == want


def test_sequences_in_blocks(spark):
    rows = [(i % 2, i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "s int, id int, v array<double>")
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    whole, cut = (one(sequences.sequence_similarity(df, pairs, "s", "id", "v", n)) for n in (1000, 3))
    assert whole == cut and len(whole) == 1


def test_rouge_w_favours_runs(spark):
    df = spark.createDataFrame([(1, list("abcd"), list("abcd")), (2, list("abcd"), list("axbycz")), (3, list("abcd"), list("abcxyz")), (4, [], list("a"))], "id int, pred array<string>, true array<string>")
    got = {r.id: r.f1 for r in metrics.rouge_w(df).collect()}
    assert got[1] == 1.0 and got[4] == 0.0 and 0 < got[2] < got[3] < 1


def test_compound_labels(spark):
    labels = ["plot it", "load data and plot it", "use it to plot it", "fit the big model & plot its large errors", "a and b", "set the index to a datetimeindex type", "one to two to plot it", "load", "", None]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r.parts for r in T.compound_parts(df).collect()}
    assert got == {
        "plot it": ["plot it"], "load data and plot it": ["load data", "plot it"], "use it to plot it": ["use it", "plot it"], "a and b": ["a and b"],
        "fit the big model & plot its large errors": ["fit the big model & plot its large errors"], "set the index to a datetimeindex type": ["set the index to a datetimeindex type"],
        "one to two to plot it": ["one to two to plot it"], "load": ["load"],
    }
    assert "load" not in {r.label for r in T.simple_labels(df).collect()}


def test_sums_in_another_order_tie(spark):
    from plumbago.operators import metrics as M

    ranked = spark.createDataFrame([(1, 1, 0.1 + 0.2 + 0.3), (1, 2, 0.3 + 0.2 + 0.1)], "q long, doc long, score double")
    relevant = spark.createDataFrame([(1, 1)], "q long, doc long")
    assert M.ranking_precision(ranked, relevant).first().lrap == 0.5
