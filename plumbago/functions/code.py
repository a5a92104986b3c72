"""Facts of Python source cells, read from its syntax tree in Arrow batches.

Each function gives one row per cell; Spark explodes, counts and joins what it
returns. A cell that doesn't parse has ok = false, the error's name, and empty
lists. Null is an empty cell.
"""

from __future__ import annotations

import ast
import builtins
import difflib
import io
import os
import pickle
import tokenize
from operator import attrgetter

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbago.runtime import ship

from .text import drop_magics, print_to_call

FACTS = (
    "ok boolean, error string, calls array<string>, functions array<string>, variables array<string>, definitions array<string>, "
    "imports array<string>, constructs array<string>, docstrings array<string>, arguments array<string>, returned array<string>"
)
BUILTIN = set(dir(builtins))
STATEMENTS = {
    ast.FunctionDef, ast.ClassDef, ast.Return, ast.Assign, ast.AugAssign, ast.For, ast.While, ast.If, ast.With, ast.Raise, ast.Try,
    ast.Assert, ast.Import, ast.ImportFrom, ast.Expr, ast.Call, ast.Lambda, ast.ListComp,
}


#: Rows of an Arrow batch: what Python makes of a batch of cells or texts is many times its size.
BATCH = 1000


def vectorised(ddl: str, once: bool = False):
    """A pandas UDF that is made when it is called, as its type needs a session.

    once: a filter on its result is not pushed below it, which would run it twice.
    """

    def wrap(fn):
        def call(*columns):
            spark = SparkSession.active()
            ship(spark)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
            udf = F.pandas_udf(fn, ddl)
            return (udf.asNondeterministic() if once else udf)(*columns)

        call.__doc__ = fn.__doc__
        return call

    return wrap


def apart(fn, cells: pd.Series) -> list:
    """What `fn` gives for each cell of a batch, worked out in a process of its own.

    Python keeps every name that it has parsed until its process ends, and a worker is used for task after task: there
    the names of all its cells would add up.
    """
    ours, theirs = os.pipe()
    child = os.fork()
    if not child:
        status = 1
        try:
            os.close(ours)
            with open(theirs, "wb") as out:
                try:
                    got = [fn(c) for c in cells], None
                except Exception as e:
                    got = None, f"{type(e).__name__}: {e}"
                pickle.dump(got, out, pickle.HIGHEST_PROTOCOL)
            status = 0
        finally:
            os._exit(status)
    os.close(theirs)
    try:
        with open(ours, "rb") as f:
            got, error = pickle.load(f)
    except EOFError:
        error = "the process ended early"
    finally:
        os.waitpid(child, 0)
    if error:
        raise RuntimeError(f"in a batch of {len(cells)} cells: {error}")
    return got


def each(fn, cells: pd.Series) -> pd.Series:
    """The same as a column."""
    return pd.Series(apart(fn, cells), dtype=object)


def dotted(node: ast.AST) -> str:
    """`a.b.c` of a name or attribute; other bases are left out."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return ""


PLACE = attrgetter("lineno", "col_offset")


def walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk in its order, but for the marks of loads and stores; in a third of its time."""
    todo = [node]
    for n in todo:
        if isinstance(n, (ast.Name, ast.Constant)):
            continue
        for field in n._fields:
            value = getattr(n, field, None)
            if isinstance(value, list):
                todo += [v for v in value if isinstance(v, ast.AST)]
            elif isinstance(value, ast.AST) and field != "ctx":
                todo.append(value)
    return todo


def facts(code: str | None) -> dict:
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return _no_facts() | {"ok": False, "error": type(e).__name__}
    return _facts_of(tree)


def _no_facts() -> dict:
    return {"ok": True, "error": None} | {k: [] for k in ("calls", "functions", "variables", "definitions", "imports", "constructs", "docstrings", "arguments", "returned")}


def _facts_of(tree: ast.AST) -> dict:
    out, called, names = _no_facts(), set(), []
    for n in sorted((n for n in walk(tree) if "lineno" in n._attributes), key=PLACE):
        kind = type(n)
        if kind is ast.Name:
            names.append(n.id)
            continue
        if kind in STATEMENTS:
            out["constructs"].append(kind.__name__)
        if kind is ast.Call:
            if name := dotted(n.func):
                out["calls"].append(name)
                called.add(name.split(".")[0] if isinstance(n.func, ast.Name) else name.split(".")[-1])
        elif kind in (ast.Import, ast.ImportFrom):
            out["imports"] += [a.asname or a.name for a in n.names]
        elif kind in (ast.FunctionDef, ast.AsyncFunctionDef):
            out["definitions"].append(n.name)
            out["arguments"] += [a.arg for a in n.args.args]
            out["returned"] += [x.id for r in walk(n) if isinstance(r, ast.Return) and r.value for x in walk(r.value) if isinstance(x, ast.Name)]
            if doc := ast.get_docstring(n):
                out["docstrings"].append(doc)
    skip = BUILTIN | set(out["imports"]) | called
    out["variables"] = list(dict.fromkeys(x for x in names if x not in skip))
    out["functions"] = [x for x in dict.fromkeys(c.split(".")[-1] for c in out["calls"]) if x not in BUILTIN]
    return out


@vectorised(FACTS, once=True)
def _facts(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(apart(facts, code))


def code_facts(code):
    """Struct of a cell's facts, after magics and old print statements are mended."""
    return _facts(print_to_call(drop_magics(code)))


class _Renamer(ast.NodeTransformer):
    def __init__(self, functions: list[str], variables: list[str]):
        self.names = {x: f"OBF_FUNC_{i}" for i, x in enumerate(functions)} | {x: f"OBF_VAR_{i}" for i, x in enumerate(variables)}

    def visit_Name(self, node):
        node.id = self.names.get(node.id, node.id)
        return node

    def visit_FunctionDef(self, node):
        node.name = self.names.get(node.name, node.name)
        return self.generic_visit(node)

    def visit_arg(self, node):
        node.arg = self.names.get(node.arg, node.arg)
        return node

    def visit_Constant(self, node):
        return ast.copy_location(ast.Constant(""), node) if isinstance(node.value, str) else node


def renamed(code: str | None) -> str | None:
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return None
    f = _facts_of(tree)
    local = [x for x in f["variables"] + f["arguments"] if x not in f["definitions"]]
    return ast.unparse(_Renamer(f["definitions"], list(dict.fromkeys(local))).visit(tree))


@vectorised("string")
def obfuscated(code: pd.Series) -> pd.Series:
    """Names of defined functions and of variables numbered by first use, string constants blanked; null if it doesn't parse."""
    return each(renamed, code)


@vectorised("array<struct<name:string,first:int,last:int>>")
def variable_blocks(code: pd.Series) -> pd.Series:
    """For each name that an assignment sets: the lines from its first to its last occurrence, where these are several."""
    def one(c):
        try:
            nodes = list(ast.walk(ast.parse(c or "")))
        except (SyntaxError, ValueError):
            return []
        own = {n.id for s in nodes if isinstance(s, ast.Assign) for t in s.targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        seen: dict[str, list[int]] = {x: [] for x in sorted(own)}
        for n in nodes:
            if isinstance(n, ast.Name) and n.id in seen:
                seen[n.id].append(n.lineno)
        return [{"name": k, "first": min(at), "last": max(at)} for k, at in seen.items() if min(at) < max(at)]

    return each(one, code)


@vectorised("array<struct<kind:string,line:int,end_line:int,col:int,parent:int,code:string>>", once=True)
def chunks(code: pd.Series) -> pd.Series:
    """Statements in order of place, each with the index of the statement around it (-1: none)."""
    def one(c):
        try:
            tree = ast.parse(c or "")
        except (SyntaxError, ValueError):
            return []
        out = []

        def walk(node, parent):
            for child in ast.iter_child_nodes(node):
                mine = parent
                if isinstance(child, ast.stmt):
                    out.append({"kind": type(child).__name__, "line": child.lineno, "end_line": child.end_lineno, "col": child.col_offset, "parent": parent, "code": ast.get_source_segment(c, child)})
                    mine = len(out) - 1
                walk(child, mine)

        walk(tree, -1)
        return out

    return each(one, code)


@vectorised("array<struct<name:string,line:int,kind:string,sources:array<string>>>")
def dataflow(code: pd.Series) -> pd.Series:
    """Where values come from, statement by statement: `computedFrom` for what an assignment or loop target takes, `comesFrom` for reads."""
    def reads(node):
        return list(dict.fromkeys(n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)))

    def one(c):
        try:
            tree = ast.parse(c or "")
        except (SyntaxError, ValueError):
            return []
        out = []
        for s in ast.walk(tree):
            targets, value = [], None
            if isinstance(s, ast.Assign):
                targets, value = s.targets, s.value
            elif isinstance(s, (ast.AugAssign, ast.AnnAssign)):
                targets, value = [s.target], s.value
            elif isinstance(s, ast.For):
                targets, value = [s.target], s.iter
            elif isinstance(s, ast.Expr):
                out += [{"name": x, "line": s.lineno, "kind": "comesFrom", "sources": [x]} for x in reads(s.value)]
            if value is not None:
                for t in targets:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                            out.append({"name": n.id, "line": s.lineno, "kind": "computedFrom", "sources": reads(value)})
        return sorted(out, key=lambda x: (x["line"], x["name"]))

    return each(one, code)


@vectorised("string")
def parsable_part(code: pd.Series) -> pd.Series:
    """The longest run of leading lines that parses."""
    def one(c):
        lines = (c or "").split("\n")
        while lines:
            try:
                ast.parse("\n".join(lines))
                break
            except (SyntaxError, ValueError):
                lines.pop()
        return "\n".join(lines)

    return each(one, code)


@vectorised("double")
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fuzzy score 0..100 of two texts by their sorted common and remaining words."""
    def ratio(x, y):
        return 100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0

    def one(x, y):
        s, t = set((x or "").lower().split()), set((y or "").lower().split())
        both = " ".join(sorted(s & t))
        left, right = f"{both} {' '.join(sorted(s - t))}".strip(), f"{both} {' '.join(sorted(t - s))}".strip()
        return round(max(ratio(both, left), ratio(both, right), ratio(left, right)), 4)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@vectorised("array<struct<sign:string,line:string>>")
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Changed lines between two texts: `-` for the first, `+` for the second."""
    def one(x, y):
        d = difflib.ndiff((x or "").splitlines(), (y or "").splitlines())
        return [{"sign": z[0], "line": z[2:]} for z in d if z[0] in "+-"]

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def patch_lines(patch):
    """Lines of a unified diff after its header, as structs (line, label): 0 deleted, 1 added, 2 kept."""
    lines = F.filter(F.split(patch, "\n"), lambda x: ~x.startswith("@@"))
    label = lambda x: F.when(x.startswith("-"), 0).when(x.startswith("+"), 1).otherwise(2)
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_replace(x, "^[-+ ]", "")).alias("line"), label(x).alias("label")))


def tagged_patch(patch):
    """A patch as one text: each line that isn't blank after its tag."""
    tag = lambda k: F.element_at(F.array(F.lit("<del>"), F.lit("<add>"), F.lit("<keep>")), k + 1)
    some = F.filter(patch_lines(patch), lambda x: x["line"] != "")
    return F.array_join(F.transform(some, lambda x: F.concat(tag(x["label"]), x["line"])), " ")


def bare_python(code: str | None) -> str | None:
    """Python code without its comments and docstrings, found by their places in the token stream; all else keeps its layout, but lines that are left empty go. Null if it has no tokens to the end."""
    code = code or ""
    lines = code.split("\n")
    spans = []
    try:
        tree = ast.parse(code)
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.COMMENT:
                spans.append((t.start, t.end, ""))
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return None
    for n in ast.walk(tree):
        body = getattr(n, "body", None)
        if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n, False) is not None:
            d = body[0].value
            row, end = lines[d.lineno - 1].encode(), lines[d.end_lineno - 1].encode()
            places = (d.lineno, len(row[: d.col_offset].decode())), (d.end_lineno, len(end[: d.end_col_offset].decode()))
            alone = len(body) == 1 and not isinstance(n, ast.Module)
            spans.append((*places, "pass" if alone or lines[d.end_lineno - 1][places[1][1] :].lstrip().startswith(";") else ""))
    touched = set()
    for (a, i), (b, j), instead in sorted(spans, reverse=True):
        lines[a - 1 : b] = [lines[a - 1][:i] + instead + lines[b - 1][j:]] + [None] * (b - a)
        touched.add(a - 1)
    out = []
    for k, line in enumerate(lines):
        if line is None:
            continue
        if k in touched and not line.strip():
            continue
        out.append(line.rstrip() if k in touched else line)
    return "\n".join(out)


@vectorised("string")
def without_comments_and_docstrings(code: pd.Series) -> pd.Series:
    return each(bare_python, code)
