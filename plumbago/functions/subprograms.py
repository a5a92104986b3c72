"""Sub-programs of Python functions: roles of names, steps with inputs and outputs, def-use edges, and slices along them.

A cell's function is rewritten so that it returns names only, its names are
resolved and replaced by their roles (INP0.. arguments, OUT0.. returned names,
VAR0.. other local names, __MODULE_x names from outside), and each statement becomes
a step. Edges lead from a step to the earlier steps whose values it may read:
branches join, and loops are gone through twice, so that values from the turn before are seen.
A slice is what one step needs, all edges followed. One Arrow call gives all
of a cell; Spark explodes, joins and counts the rows.
"""

from __future__ import annotations

import ast
import builtins
import copy

import pandas as pd

from .code import apart, vectorised, walk

#: The name that stands for a returned expression, the mark of outside names, builtin types (which are no operators and keep their names).
RETURNED, OUTSIDE = "__SIMPLIFIED_RETURN_VARIABLE", "__MODULE_"
TYPES = {n for n in dir(builtins) if isinstance(getattr(builtins, n), type)}

STEP = "step:int,parent:int,kind:string,inputs:array<string>,outputs:array<string>,ops:array<string>,needs:array<int>"
SLICE = "step:int,outputs:array<string>,inputs:array<string>,members:array<int>"
#: All fields. Steps and slices have the code of each row too, which costs more than all else; their facts leave it out.
FIELDS = {
    "arguments": "array<string>", "returned": "array<string>", "simplified": "string", "renamed": "string", "roles": "map<string,string>",
    "steps": f"array<struct<{STEP},code:string>>", "slices": f"array<struct<{SLICE},code:string>>", "stream": "string",
    "step_facts": f"array<struct<{STEP}>>", "slice_facts": f"array<struct<{SLICE}>>",
}
WHOLE = ("arguments", "returned", "simplified", "renamed", "roles", "steps", "slices", "stream")


def first_function(tree: ast.AST) -> ast.FunctionDef | None:
    return next((n for n in walk(tree) if isinstance(n, ast.FunctionDef)), None)


def arguments(f: ast.FunctionDef) -> list[str]:
    """Ordinary, positional-only and keyword-only arguments, then ** and *."""
    a = f.args
    return [x.arg for x in (*a.args, *a.posonlyargs, *a.kwonlyargs, *filter(None, (a.kwarg, a.vararg)))]


def simplify_returns(f: ast.FunctionDef) -> None:
    """Give the value of each return of the function's own body a name first, unless it is one."""
    body = []
    for s in f.body:
        if isinstance(s, ast.Return) and s.value is not None and not isinstance(s.value, ast.Name):
            body.append(ast.Assign([ast.Name(RETURNED, ast.Store())], s.value, lineno=s.lineno))
            s = ast.Return(ast.Name(RETURNED, ast.Load()))
        body.append(s)
    f.body = body


def returned(f: ast.FunctionDef) -> list[str]:
    """Names in the first return of the function's own body."""
    for s in f.body:
        if isinstance(s, ast.Return):
            return list(dict.fromkeys(names(s.value))) if s.value else []
    return []


def names(node: ast.AST | None) -> list[str]:
    """All names below a node, each once, those nearest to it first."""
    return list(dict.fromkeys(n.id for n in walk(node) if isinstance(n, ast.Name))) if node is not None else []


def is_role(name: str) -> bool:
    return name.startswith(("INP", "OUT", "VAR", OUTSIDE))


class Roles(ast.NodeTransformer):
    """Replaces the names of one function by their roles; calls of plain names, builtins and global names keep theirs."""

    def __init__(self, f: ast.FunctionDef, outputs: list[str]):
        own = arguments(f)
        nodes = [n for s in f.body for n in walk(s)]
        kept = {n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)} | TYPES
        kept |= {x for n in nodes if isinstance(n, (ast.Global, ast.Nonlocal)) for x in n.names}
        kept |= {n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        kept |= {a.name.split(".")[0] for n in nodes if isinstance(n, ast.Import) for a in n.names if not a.asname and "." in a.name}
        imported = {a.asname or a.name for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} - kept
        local = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}
        local |= {n.arg for n in nodes if isinstance(n, ast.arg)} | {n.name for n in nodes if isinstance(n, ast.ExceptHandler) and n.name}
        self.kept, self.local, self.imported = kept - set(own), local - imported, imported
        self.of: dict[str, str] = {x: f"OUT{i}" for i, x in enumerate(outputs) if x not in self.kept} | {x: f"INP{i}" for i, x in enumerate(own)}
        self.locals = 0

    def role(self, name: str) -> str:
        if name in self.of:
            return self.of[name]
        if name in self.kept or (hasattr(builtins, name) and name not in self.local):
            return name
        if name in self.local:
            self.of[name] = f"VAR{self.locals}"
            self.locals += 1
            return self.of[name]
        self.of[name] = OUTSIDE + name
        return self.of[name]

    def visit_Name(self, node):
        node.id = self.role(node.id)
        return node

    def visit_arg(self, node):
        node.arg = self.role(node.arg)
        return self.generic_visit(node)

    def visit_alias(self, node):
        if (node.asname or node.name) in self.imported:
            node.asname = self.role(node.asname or node.name)
        return node

    def visit_ExceptHandler(self, node):
        if node.name:
            node.name = self.role(node.name)
        return self.generic_visit(node)


def operators(node: ast.AST) -> list[str]:
    """Called names (their last part) and comprehensions, the innermost first; calls of builtin types aren't operators."""
    found = []
    for n in walk(node):
        if isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ast.unparse(n.func).split(".")[-1].strip()
            found += [name] if name not in TYPES else []
        elif isinstance(n, (ast.ListComp, ast.DictComp)):
            found.append(type(n).__name__.upper())
    return found[::-1]


def field_text(value) -> str:
    """A syntax field as text: names as they are, operators by name, compound expressions by their parts."""
    if value is None:
        return "NONE"
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return f"[{', '.join(dict.fromkeys(field_text(v) for v in value))}]"
    if isinstance(value, ast.Name):
        return value.id
    if isinstance(value, (ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
        return type(value).__name__.upper()
    parts = {ast.Subscript: ("slice", "value"), ast.Compare: ("left", "ops", "comparators"), ast.BinOp: ("op", "left", "right"), ast.UnaryOp: ("op", "operand"), ast.BoolOp: ("op", "values")}.get(type(value))
    if parts:
        return f"{type(value).__name__.upper()}({', '.join(f'{p}={field_text(getattr(value, p))}' for p in parts)})"
    if isinstance(value, ast.withitem):
        return f"WITHITEM(context_expr={field_text(value.context_expr)}, optional_vars={field_text(value.optional_vars)})"
    return f"[{', '.join(names(value))}]"


class Steps:
    """The steps of a function's body, with the steps that each one needs."""

    def __init__(self):
        self.rows: list[dict] = []
        self.nodes: list[ast.stmt] = []
        self.taken: list[list[str]] = []  # arguments and outside names that each step reads
        self.stream: list[str] = []
        self.defined: dict[str, set[int]] = {}

    def add(self, node: ast.AST, parent: int, kind: str, inputs: list[str], outputs: list[str], ops: list[str], also: list[str] = (), lasting: bool = False) -> int:
        """A row, or what a further turn of a loop adds to it; `also` names are read though they aren't inputs."""
        at, made = self.place.get(id(node)), outputs
        needs = set().union(*(self.defined.get(x, ()) for x in (*inputs, *also)))
        if at is None:
            at = self.place[id(node)] = len(self.rows)
            self.nodes.append(node)
            self.taken.append([x for x in inputs if x.startswith(("INP", OUTSIDE))])
            inputs, outputs = ([x.removeprefix(OUTSIDE) for x in part if is_role(x)] for part in (inputs, outputs))
            self.rows.append({"step": at, "parent": parent, "kind": kind, "inputs": inputs, "outputs": outputs, "ops": ops, "needs": set()})
        row = self.rows[at]
        row["needs"] |= needs | ({parent} if parent >= 0 else set())
        for x in made:
            self.defined[x] = {at} | (self.defined.get(x, set()) if lasting else set())
        return at

    def of(self, body: list[ast.stmt]) -> None:
        self.body, self.place = body, {}
        self.block(body, -1)
        for r in self.rows:
            r["needs"] = sorted(r["needs"] - {r["step"]})

    def block(self, body: list[ast.stmt], parent: int, quiet: bool = False) -> None:
        first = True
        for s in body:
            compound = isinstance(getattr(s, "body", None), list)
            if not first and not compound and not quiet:
                self.stream.append("NEWLINE")
            first = first and compound
            (self.compound if compound else self.simple)(s, parent, quiet)

    def simple(self, s: ast.stmt, parent: int, quiet: bool) -> None:
        ops, also, kind = operators(s), [], "STEP"
        if isinstance(s, (ast.Assign, ast.AnnAssign)):
            targets = s.targets if isinstance(s, ast.Assign) else [s.target]
            inputs, outputs = names(s.value), list(dict.fromkeys(x for t in targets for x in names(t)))
            # a part of an object that is set leaves the rest as it was
            also = [x for t in targets for x in names(t) if not isinstance(t, ast.Name)]
        elif isinstance(s, ast.AugAssign):
            inputs, outputs, ops = names(s.value), names(s.target), [*ops, type(s.op).__name__.upper()]
            also = outputs
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            # a call for its effect may change the object whose method it is
            inputs, outputs = names(s.value), names(s.value.func) if isinstance(s.value.func, ast.Attribute) else []
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            inputs, outputs, kind = [], [a.asname or a.name for a in s.names], type(s).__name__.upper()
        else:
            inputs, outputs, kind = names(s), [], "STEP" if isinstance(s, ast.Expr) else type(s).__name__.upper()
        at = self.add(s, parent, kind, inputs, outputs, ops, also)
        if not quiet:
            self.stream.append(serialised(self.rows[at]) if kind == "STEP" else f"{kind}(test={field_text(s.test)}, msg={field_text(s.msg)})" if isinstance(s, ast.Assert) else kind)

    def compound(self, s: ast.stmt, parent: int, quiet: bool) -> None:
        kind = type(s).__name__.upper()
        heads = [f for f in s._fields if f in ("target", "iter", "test", "items", "subject")]
        read = [x for f in heads if f != "target" for v in (getattr(s, f) if isinstance(getattr(s, f), list) else [getattr(s, f)]) for x in names(v)]
        set_here = names(s.target) if "target" in heads else [n.id for i in getattr(s, "items", []) for n in walk(i) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        text = f"{kind}({', '.join(f'{f}={field_text(getattr(s, f))}' for f in heads)})"
        loop = isinstance(s, (ast.For, ast.AsyncFor, ast.While))
        at = self.add(s, parent, text, [x for x in dict.fromkeys(read) if x not in set_here], set_here, [op for f in heads for v in (getattr(s, f) if isinstance(getattr(s, f), list) else [getattr(s, f)]) for op in operators(v)])
        if not quiet:
            self.stream.append(text)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.defined[s.name] = {at}
        before = {x: set(v) for x, v in self.defined.items()}
        self.block(s.body, at, quiet)
        if loop:
            self.meet(before)
            self.add(s, parent, text, list(dict.fromkeys(read)), set_here, [])
            self.block(s.body, at, True)
        ends = [self.defined] if not loop else [self.defined, before]
        for handler in getattr(s, "handlers", []):
            # an error may come at any point of the body
            self.defined = {x: set(v) | before.get(x, set()) for x, v in ends[0].items()}
            self.block(handler.body, at, quiet)
            ends.append(self.defined)
        if getattr(s, "orelse", []):
            if not quiet:
                self.stream.append("ELSE")
            self.defined = {x: set(v) for x, v in (before if isinstance(s, ast.If) else ends[0]).items()}
            self.block(s.orelse, at, quiet)
            ends.append(self.defined)
        elif isinstance(s, ast.If):
            ends.append(before)
        self.defined = {}
        for e in ends:
            self.meet(e)
        if getattr(s, "finalbody", []):
            self.block(s.finalbody, at, quiet)
        if not quiet:
            self.stream.append("END" + kind)

    def meet(self, other: dict[str, set[int]]) -> None:
        """Both ways may have been gone."""
        for x, v in other.items():
            self.defined[x] = self.defined.get(x, set()) | v


def serialised(row: dict) -> str:
    return f"[I] {' '.join(row['inputs'])}".strip() + " " + f"[O] {' '.join(row['outputs'])}".strip() + " " + f"[ops] {' '.join(row['ops'])}".strip()


def part_of(body: list[ast.stmt], place: dict[int, int], members: set[int]) -> list[ast.stmt]:
    """The members among some statements, compound ones with the members inside them."""
    out = []
    for s in body:
        if place.get(id(s)) not in members:
            continue
        if isinstance(getattr(s, "body", None), list):
            s = copy.copy(s)
            s.body = part_of(s.body, place, members) or [ast.Pass()]
            for field in ("orelse", "finalbody"):
                if getattr(s, field, []):
                    setattr(s, field, part_of(getattr(s, field), place, members))
            if getattr(s, "handlers", []):
                s.handlers = [ast.ExceptHandler(h.type, h.name, part_of(h.body, place, members) or [ast.Pass()]) for h in s.handlers]
        out.append(s)
    return out


def sliced(steps: Steps, codes: bool = True) -> list[dict]:
    """For each step with outputs and each return: all steps it needs, in order, the arguments and outside names they read, and (if asked) their code with the statements around them."""
    out = []
    for s in steps.rows:
        if not s["outputs"] and s["kind"] != "RETURN":
            continue
        members, todo = {s["step"]}, [s["step"]]
        while todo:
            new = set(steps.rows[todo.pop()]["needs"]) - members
            members |= new
            todo += new
        taken = dict.fromkeys(x.removeprefix(OUTSIDE) for m in sorted(members) for x in steps.taken[m])
        out.append({"step": s["step"], "outputs": s["outputs"] or s["inputs"], "inputs": list(taken), "members": sorted(members)})
        if codes:
            out[-1]["code"] = ast.unparse(ast.Module(part_of(steps.body, steps.place, members), []))
    return out


def decomposed(code: str | None, fields: tuple[str, ...] = WHOLE) -> dict:
    """The `fields` of one cell; ok is false for a cell that doesn't parse or has no function. What no field asks for is not worked out."""
    none = {"ok": False} | {k: {} if k == "roles" else None if FIELDS[k] == "string" else [] for k in fields}
    if "def" not in (code or ""):
        return none
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return none
    f = first_function(tree)
    if f is None:
        return none
    if ast.get_docstring(f) is not None:
        f.body = f.body[1:] or [ast.Pass()]
    simplify_returns(f)
    own, out = arguments(f), returned(f)
    row = none | {"ok": True}

    def fill(name, make):
        if name in row:
            row[name] = make()

    fill("arguments", lambda: own)
    fill("returned", lambda: out)
    fill("simplified", lambda: ast.unparse(f))
    if set(fields) <= {"arguments", "returned", "simplified"}:
        return row
    roles = Roles(f, out)
    f.args = roles.visit(f.args)
    f.body = [roles.visit(s) for s in f.body]
    head = {"inputs": [roles.of[x] for x in own], "outputs": [roles.role(x) for x in out], "ops": ["FUNCDEF"]}
    fill("renamed", lambda: ast.unparse(f))
    fill("roles", lambda: roles.of)
    if set(fields) <= {"arguments", "returned", "simplified", "renamed", "roles"}:
        return row
    steps = Steps()
    steps.of(f.body)
    fill("step_facts", lambda: steps.rows)
    fill("steps", lambda: [r | {"code": ast.unparse(n)} for r, n in zip(steps.rows, steps.nodes)])
    fill("slice_facts", lambda: sliced(steps, False))
    fill("slices", lambda: sliced(steps))
    fill("stream", lambda: " [STEP] ".join([serialised(head), *steps.stream]))
    return row


def decompose(code, *fields: str):
    """Struct of ok and the `fields` (all but the facts, if none are named) of a cell's sub-programs; see decomposed. Null is an empty cell."""
    fields = fields or WHOLE

    @vectorised(", ".join(["ok boolean", *(f"{k} {FIELDS[k]}" for k in fields)]), once=True)
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(apart(lambda c: decomposed(c, fields), code), columns=["ok", *fields])

    return run(code)
