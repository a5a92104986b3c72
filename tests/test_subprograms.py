"""Sub-programs: hand-made slices, renamed code that runs alike, slices that compute what the whole function does."""

import ast

import pytest

from plumbago.functions import subprograms as S

FUNCTIONS = [
    ("def f(xs, k=2):\n    total = 0\n    for x in xs:\n        if x > k:\n            total += x\n        else:\n            total -= math.floor(x)\n    return total", ([1, 5, 2.5],)),
    ("def f(a, *rest, b=1, **more):\n    out = {i: a + i for i in rest}\n    out[b] = [j for j in sorted(more)]\n    n = len(out)\n    return out, n", (1, 2, 3)),
    ("def f(s):\n    \"\"\"Doc.\"\"\"\n    import json as js\n    try:\n        v = js.loads(s)\n    except ValueError as e:\n        v = str(type(e))\n    finally:\n        w = 1\n    return v", ("{",)),
    ("def f(n):\n    a, b = 0, 1\n    while n:\n        a, b = b, a + b\n        n -= 1\n    g = lambda q: q * b\n    return g(a)", (9,)),
    ("def f(x):\n    box = [3, 1]\n    box.sort()\n    box[0] += x\n    with io.StringIO('ab') as h:\n        t = h.read()\n    return t + str(box)", (4,)),
    ("def f():\n    return", ()),
]


@pytest.mark.parametrize("code,given", FUNCTIONS)
def test_renamed_runs_alike(code, given):
    import io
    import math

    d = S.decomposed(code)
    results = []
    for text in (code, d["simplified"], d["renamed"]):
        env = {"math": math, "io": io, "__MODULE_math": math, "__MODULE_io": io}
        exec(compile(ast.parse(text), "t", "exec"), env)
        results.append(env["f"](*given))
    assert results[0] == results[1] == results[2]
    for name, role in d["roles"].items():
        assert role.startswith(("INP", "OUT", "VAR")) or role == "__MODULE_" + name


def test_roles_and_steps():
    d = S.decomposed("def f(prices, rate):\n    '''Doc.'''\n    base = sum(prices)\n    for p in prices:\n        base += p * rate\n    if base > 10:\n        base = np.clip(base, 3)\n    other = str(rate)\n    return base, len(prices)")
    assert d["arguments"] == ["prices", "rate"] and d["returned"] == [S.RETURNED]
    assert d["roles"] == {S.RETURNED: "OUT0", "prices": "INP0", "rate": "INP1", "base": "VAR0", "p": "VAR1", "np": "__MODULE_np", "other": "VAR2"}
    steps = [(s["inputs"], s["outputs"], s["ops"], s["needs"]) for s in d["steps"]]
    assert steps == [
        (["INP0"], ["VAR0"], ["sum"], []), (["INP0"], ["VAR1"], [], []), (["VAR1", "INP1"], ["VAR0"], ["ADD"], [0, 1]), (["VAR0"], [], [], [0, 2]),
        (["VAR0", "np"], ["VAR0"], ["clip"], [0, 2, 3]), (["INP1"], ["VAR2"], [], []), (["VAR0", "INP0"], ["OUT0"], ["len"], [0, 2, 4]), (["OUT0"], [], [], [6]),
    ]
    assert d["stream"] == (
        "[I] INP0 INP1 [O] OUT0 [ops] FUNCDEF [STEP] [I] INP0 [O] VAR0 [ops] sum [STEP] FOR(target=VAR1, iter=INP0) [STEP] [I] VAR1 INP1 [O] VAR0 [ops] ADD [STEP] ENDFOR [STEP] "
        "IF(test=COMPARE(left=VAR0, ops=[GT], comparators=[[]])) [STEP] [I] VAR0 np [O] VAR0 [ops] clip [STEP] ENDIF [STEP] NEWLINE [STEP] [I] INP1 [O] VAR2 [ops] [STEP] NEWLINE [STEP] "
        "[I] VAR0 INP0 [O] OUT0 [ops] len [STEP] NEWLINE [STEP] RETURN"
    )


def test_slices_by_hand():
    d = S.decomposed("def f(a, b):\n    x = a + 1\n    y = b\n    if x:\n        y = go(y)\n        x = 0\n    z = [y]\n    z.append(q.r)\n    return x")
    got = {s["step"]: (s["outputs"], s["inputs"], s["members"], s["code"]) for s in d["slices"]}
    assert got[0] == (["OUT0"], ["INP0"], [0], "OUT0 = INP0 + 1")
    assert got[3] == (["VAR0"], ["INP0", "INP1"], [0, 1, 2, 3], "OUT0 = INP0 + 1\nVAR0 = INP1\nif OUT0:\n    VAR0 = go(VAR0)")
    assert got[6] == (["VAR1"], ["INP0", "INP1", "q"], [0, 1, 2, 3, 5, 6], "OUT0 = INP0 + 1\nVAR0 = INP1\nif OUT0:\n    VAR0 = go(VAR0)\nVAR1 = [VAR0]\nVAR1.append(__MODULE_q.r)")


def test_values_of_the_turn_before():
    d = S.decomposed("def f(xs):\n    last = None\n    out = []\n    for x in xs:\n        out.append(last)\n        last = x\n    return out")
    assert d["steps"][3]["needs"] == [0, 1, 2, 4]


@pytest.mark.parametrize("code,given", FUNCTIONS[:5])
def test_slice_of_the_result_is_enough(code, given):
    import io
    import math

    d = S.decomposed(code)
    env = {"math": math, "io": io, "__MODULE_math": math, "__MODULE_io": io}
    whole = ast.parse(d["renamed"]).body[0]
    whole.body = ast.parse(d["slices"][-1]["code"]).body
    exec(compile(ast.fix_missing_locations(ast.Module([whole], [])), "t", "exec"), env)
    part = env["f"](*given)
    exec(compile(ast.parse(code), "t", "exec"), env)
    assert part == env["f"](*given)


@pytest.mark.parametrize("code", [None, "", "x = (1,\n", "x = 1", "\0"])
def test_no_function(code):
    d = S.decomposed(code)
    assert not d["ok"] and d["steps"] == [] and d["stream"] is None


def test_only_what_is_asked_for_is_worked_out(monkeypatch):
    code = "def f(a, b):\n    x = a.b.go(b)[0](1)\n    for y in x:\n        x += y\n    return x + 1"
    whole = S.decomposed(code)
    for name in S.WHOLE:
        assert S.decomposed(code, (name,))[name] == whole[name]
    for name in ("steps", "slices"):
        facts = S.decomposed(code, (name[:-1] + "_facts",))[name[:-1] + "_facts"]
        assert facts == [{k: v for k, v in r.items() if k != "code"} for r in whole[name]]
    monkeypatch.setattr(S.ast, "unparse", lambda n: (_ for _ in ()).throw(AssertionError("unparsed")) if isinstance(n, S.ast.stmt) else "f")
    assert S.decomposed(code, ("roles", "slice_facts"))["ok"] and not S.decomposed("x = 1", ("roles",))["ok"]


def test_cells_go_to_python_once_and_in_many_tasks(spark):
    from plumbago.queries.code import functions

    d = functions(spark, "/root/testdata/sf0.001", "roles").select("pos", "d.roles")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_earlier_names_join_nothing(spark):
    from plumbago.queries import QUERIES

    plan = QUERIES["syn9_agg3_uses_earlier_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1, plan


def test_a_cell_is_parsed_once_and_walked_once(monkeypatch):
    """Facts and renaming cost one parse, and functions of the library's walk, which is three times as slow, are not called."""
    from plumbago.functions import code as C

    code, parse, parsed = 'def f(a, b=1):\n    """Doc."""\n    x = [i + b for i in a]\n    x.sort()\n    return x, len(a)', ast.parse, []
    with monkeypatch.context() as m:
        m.setattr(C.ast, "parse", lambda *a, **k: parsed.append(a) or parse(*a, **k))
        m.setattr(C.ast, "walk", lambda n: (_ for _ in ()).throw(AssertionError("walked")))
        f, new, broken = C.facts(code), C.renamed(code), C.renamed("x = (")
    assert (f["calls"], f["variables"], f["returned"], f["docstrings"]) == (["x.sort", "len"], ["x", "i", "b", "a"], ["x", "len", "a"], ["Doc."])
    assert new.startswith("def OBF_FUNC_0(OBF_VAR_3, OBF_VAR_2=1):") and broken is None
    assert len(parsed) == 3


def test_names_of_parsed_cells_do_not_add_up_in_workers(spark):
    import psutil
    from pyspark.sql import functions as F

    from plumbago.functions import code as C

    def held():
        jvm = [p for p in psutil.Process().children(recursive=True) if p.name() == "java"]
        return sum(p.memory_full_info().uss for j in jvm for p in j.children(recursive=True) if "python" in p.name()) / 1e6

    # 20,000 names of 5,000 characters, then 20,000 others
    cell = F.concat(F.lit("x"), F.col("id").cast("string"), F.repeat(F.lit("y"), 5000), F.lit(" = 1"))
    for made in (lambda c: C.code_facts(c)["ok"], lambda c: F.size(C.chunks(c)) == 1):
        count = lambda a, b: spark.range(a, b).repartition(4).select(made(cell).alias("x")).agg(F.count_if("x")).first()[0]
        assert count(0, 20_000) == 20_000
        before = held()
        assert count(20_000, 40_000) == 20_000
        assert held() - before < 60


def test_errors_in_a_batch_come_back():
    import pandas as pd

    from plumbago.functions import code as C

    assert C.apart(len, pd.Series(["a", "bc"])) == [1, 2] and C.apart(len, pd.Series([], dtype=object)) == []
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        C.apart(lambda x: 1 / x, pd.Series([1, 0]))
