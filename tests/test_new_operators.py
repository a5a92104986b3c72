"""Next steps by depth, the merge tree, shared prefixes, sharded reads and comment removal against brute force."""

import ast
import json
import random

import numpy as np
import pytest

from plumbago.functions.code import bare_python
from plumbago.operators import cells as C
from plumbago.operators import ml
from plumbago.operators import sequences as S
from plumbago.sources.files import read_shards


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_foretold_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 9)
    monkeypatch.setattr(S, "PROMPTS", 3)
    rng = random.Random(1)
    seqs = {i: (i % 2, [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for i in range(80)}
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in seqs.items()], "seq_id long, intent int, seq array<string>")
    got = {(r.id, r.depth): (r.next, r.told) for r in S.foretold(df.where("seq_id < 15").withColumnRenamed("seq_id", "id"), df.where("seq_id >= 15")).collect()}
    want = {}
    for i in range(15):
        intent, s = seqs[i]
        others = [(j, t) for j, (n, t) in seqs.items() if j >= 15 and n == intent and t]
        for n in range(1, len(s)):
            best = max(others, key=lambda o: (lcs(o[1][:n], s[:n]), -o[0]))[1]
            want[i, n] = (s[n], best[n] if len(best) > n else None)
    assert got == want


def test_few_sequences_are_aligned():
    rng = random.Random(2)
    seqs = [[rng.choice("abcdefgh") for _ in range(8)] for _ in range(400)]
    prompt = seqs[3]
    best, aligned = S.best_by_depth(prompt, seqs, np.arange(400))
    assert best[-1][1:3] == (7, 3) and aligned < 60


def test_blocks_align_long_sequences_at_once():
    rng = random.Random(3)
    seqs = [[rng.choice("abcde") for _ in range(rng.choice((0, 1, 63, 64, 65, 130, 150)))] for _ in range(60)]
    block = S.Block(seqs, np.arange(60))
    for n in (0, 1, 64, 65, 140):
        prompt = [rng.choice("abcdez") for _ in range(n)]
        assert dict(zip(block.ids.tolist(), block.common(prompt).tolist())) == {i: lcs(prompt, x) for i, x in enumerate(seqs)}
    full = [x for x in seqs if x]
    for depth, score, key, _ in S.best_by_depth(prompt, full, np.arange(len(full)))[0][::23]:
        common = [lcs(prompt[:depth], x[:depth]) for x in full]
        assert (score, key) == (max(common), common.index(max(common)))


def ward(points):
    """Greedy merges by the formula on centroids."""
    cl = {i: (1, np.array(p, float), {i}) for i, p in enumerate(points)}
    out, name = [], -1
    while len(cl) > 1:
        pairs = [(round(2 * cl[a][0] * cl[b][0] / (cl[a][0] + cl[b][0]) * float(((cl[a][1] - cl[b][1]) ** 2).sum()), 12), a, b) for a in cl for b in cl if a < b]
        d, a, b = min(pairs)
        n = cl[a][0] + cl[b][0]
        merged = (n, (cl[a][0] * cl[a][1] + cl[b][0] * cl[b][1]) / n, cl[a][2] | cl[b][2])
        out.append((round(d**0.5, 4), sorted(merged[2])))
        del cl[a], cl[b]
        cl[name], name = merged, name - 1
    return out


def test_merge_tree_is_wards(spark):
    points = np.random.default_rng(4).normal(size=(60, 5))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = sorted(ml.merge_tree(df).collect(), key=lambda r: r.step)
    want = ward(points)
    assert [(round(r.height, 4), list(r.leaves)) for r in got] == want
    below = {-1 - r.step: set(r.leaves) for r in got} | {i: {i} for i in range(60)}
    assert all(below[r.a] | below[r.b] == set(r.leaves) and not below[r.a] & below[r.b] and r.size == len(r.leaves) for r in got)
    assert ml.merge_tree(df.limit(1)).count() == 0


def test_prefixes_and_overlaps(spark):
    rng = random.Random(3)
    seqs = {i: (i % 3, [rng.choice(["a", " a", "b"]) for _ in range(rng.randint(0, 6))]) for i in range(90)}
    df = spark.createDataFrame([(g, i, s) for i, (g, s) in seqs.items()], "grp int, id long, s array<string>")
    trim = {i: [x.strip() for x in s] for i, (_, s) in seqs.items()}
    common, prefix, counts = set(), set(), {}
    for i in seqs:
        for j in seqs:
            if i < j and seqs[i][0] == seqs[j][0]:
                k = next((k for k, (x, y) in enumerate(zip(trim[i], trim[j])) if x != y), min(len(trim[i]), len(trim[j])))
                counts[seqs[i][0], k] = counts.get((seqs[i][0], k), 0) + 1
                if k:
                    common.add((seqs[i][0], i, j, min(len(trim[i]), len(trim[j])), max(len(trim[i]), len(trim[j])), k))
                if k == min(len(trim[i]), len(trim[j])):
                    a, b = sorted((i, j), key=lambda x: (len(trim[x]), x))
                    prefix.add((seqs[i][0], a, b))
    assert {tuple(r) for r in C.overlaps(df, "grp", "id", "s").collect()} == common
    assert {tuple(r) for r in C.prefix_pairs(df, "grp", "id", "s").collect()} == prefix
    assert {(r.grp, r.common_len): r.n_pairs for r in C.overlap_lengths(df, "grp", "id", "s").collect()} == counts


def test_shards_add_up(spark, tmp_path):
    lines = {}
    for f in range(3):
        rows = []
        for i in range(50):
            row = json.dumps({"language": ["python", "java", None][i % 3], "code": f"x = {i}", "n": i})
            rows.append(row if i % 7 else row[:15])
        (tmp_path / f"python_train_{f}.jsonl").write_text("\n".join(rows) + "\n")
        lines |= {(f"python_train_{f}.jsonl", i + 1): r for i, r in enumerate(rows)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        good, bad = read_shards(spark, f"file://{tmp_path}/*.jsonl", "language string, code string, n long", "language = 'python'")
        g, b = good.collect(), bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file, r.line) for r in g} | {(r.file, r.line) for r in b} == set(lines) and len(g) + len(b) == 150
    assert all(json.loads(lines[r.file, r.line])["n"] == r.n and r.language == "python" for r in g)
    assert all(lines[r.file, r.line] == r.text and r.reason == ("parse" if (r.line - 1) % 7 == 0 else "expectation") for r in b)


@pytest.mark.parametrize("code", [
    '"""Mod."""\nimport os  # why\n\n# alone\nx = "# no" \'"""\'\n', 'def f():\n    """Only."""\n\nclass A:\n    """D\n    e"""  # c\n    y = """kept"""\n    def g(self): "doc"; return 1\n',
    "def f(a):\n    'é doc'\n    # note\n    return f'{a} # {a!r}'\n", "x = 1\\\n  + 2  # end", "", "async def h():\n    '''d'''\n    await x\n",
])
def test_bare_python_parses_to_the_same_tree(code):
    def plain(text):
        tree = ast.parse(text)
        for n in ast.walk(tree):
            if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                if n.body and ast.get_docstring(n, False) is not None:
                    n.body = n.body[1:]
                n.body = [s for s in n.body if not isinstance(s, ast.Pass)]
        return ast.dump(tree)

    out = bare_python(code)
    assert plain(out) == plain(code)
    assert "why" not in out and "# c" not in out and "note" not in out and "# end" not in out


def test_bare_python_of_broken_code():
    assert bare_python("x = (1,\n") is None and bare_python(None) == ""


def test_steps_of_any_depth(spark):
    from plumbago.operators import graph as G

    rows = [(f"n{i}", "HAS STEP", f"n{i + 1}") for i in range(25)] + [("n25", "HAS STEP", "n3"), ("n0", "OTHER", "x"), ("n2", "HAS STEP", "leaf")]
    got = {(r.name, r.depth) for r in G.steps_below(spark.createDataFrame(rows, "sub string, rel string, obj string"), "n0", "HAS STEP").collect()}
    assert got == {(f"n{i}", i) for i in range(26)} | {("leaf", 3)}


def test_pairs_of_members_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(C, "MEMBERS", 7)
    df = spark.createDataFrame([(0, i, ["a", "b"][: 1 + i % 2]) for i in range(300)], "grp int, id long, s array<string>")
    for pairs, n in ((C.prefix_pairs(df, "grp", "id", "s"), 300 * 299 // 2), (C.overlaps(df, "grp", "id", "s"), 300 * 299 // 2)):
        rows = [tuple(r) for r in pairs.collect()]
        assert len(rows) == len(set(rows)) == n
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange") and "Aggregate" not in plan[: plan.index("Exchange")]


def test_blocks_of_equal_sequences_are_small(spark):
    """The pairs of two blocks are held at once when they are made, so a large class has many blocks."""
    df = spark.range(900).selectExpr("0 AS g", "id", "array('a', 'b') AS s")
    _, blocks = C._classes(df, "g", "id", "s")
    sizes = [len(r.ids) for r in blocks.collect()]
    assert sum(sizes) == 900 and max(sizes) ** 2 < 1 << 18
    assert C.prefix_pairs(df, "g", "id", "s").count() == 900 * 899 // 2
