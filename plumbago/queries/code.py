"""Source-code and fuzzy-match queries over code cells derived from orders; the SQL tells what each kind of cell has."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import code as C
from plumbago.functions import subprograms as S
from plumbago.functions.text import docstring_types, drop_magics, print_to_call
from plumbago.operators.fuzzy import fuzzy_parents
from plumbago.runtime import scratch
from plumbago.sources.files import read_shards

from . import derived
from .derived import facts_sql, listed_sql
from .registry import query, read

def cells(spark, sf):
    """Code cells of all orders, with their facts."""
    return derived.code_cells(spark, sf).withColumn("f", C.code_facts(F.col("code")))


def values(rows, cols):
    def one(x):
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({cols})"


def by_cell(name, columns, select, where="true"):
    """A query of one row a cell; `columns` has what each kind of cell must give."""

    @query(name, facts_sql(columns, where))
    def q(spark, sf):
        return select(cells(spark, sf))

    return q


def joined(c, *names):
    return c.select("nb_id", "pos", *[F.array_join(f"f.{n}", ",").alias(n) for n in names])


FUNCTION_KINDS = "pos % 6 IN (1, 4)"
by_cell("syn1_parsed", {"error": ["", "", "SyntaxError", "", "", ""]}, lambda c: c.select("nb_id", "pos", F.coalesce("f.error", F.lit("")).alias("error")))
by_cell("syn5_variables_and_functions", {"variables": ["x{c}", "base,prices,p,rate,np", "", "rows,z{c},w", "best,items,out,i", ""], "functions": ["mean", "clip", "", "load,sort", "reverse", ""]},
        lambda c: joined(c, "variables", "functions"))
by_cell("syn6_definitions", {"definitions": ["", "total{c}", "", "", "pick{c}", ""], "arguments": ["", "prices,rate", "", "", "items,n", ""], "returned": ["", "base,len,prices", "", "", "out", ""]},
        lambda c: joined(c.where(F.size("f.definitions") > 0), "definitions", "arguments", "returned"), FUNCTION_KINDS)
CONSTRUCTS = [["Import", "Assign", "Call", "Expr", "Call"], ["FunctionDef", "Expr", "Assign", "Call", "For", "AugAssign", "If", "Assign", "Call", "Return", "Call"], [],
              ["Assign", "Call", "Expr", "Call", "Assign", "Expr"], ["FunctionDef", "Assign", "Call", "Expr", "Call", "Assign", "ListComp", "Return"], []]
by_cell("syn8_constructs", {"constructs": [">".join(k) for k in CONSTRUCTS]}, lambda c: c.select("nb_id", "pos", F.array_join("f.constructs", ">").alias("constructs")))
CALLS = [["np.mean", "print"], ["sum", "np.clip", "len"], [], ["load", "rows.sort"], ["sorted", "best.reverse"], []]


@query("syn2_syn7_call_terms", f"SELECT nb_id, call, count(*) AS n FROM ({listed_sql(['call'], [[(x,) for x in k] for k in CALLS])}) GROUP BY nb_id, call")
def syn2(spark, sf):
    return cells(spark, sf).select("nb_id", F.explode("f.calls").alias("call")).groupBy("nb_id", "call").agg(F.count("*").alias("n"))


@query("agg27_construct_counts", f"SELECT construct, count(*) AS n FROM ({listed_sql(['construct'], [[(x,) for x in k] for k in CONSTRUCTS])}) GROUP BY construct")
def agg27(spark, sf):
    return cells(spark, sf).select(F.explode("f.constructs").alias("construct")).groupBy("construct").agg(F.count("*").alias("n"))


VARIABLES = [["x{c}"], ["base", "prices", "p", "rate", "np"], [], ["rows", "z{c}", "w"], ["best", "items", "out", "i"], []]


@query("syn9_agg3_uses_earlier_names", f"""WITH v AS ({listed_sql(['name'], [[(x,) for x in k] for k in VARIABLES])}),
u AS (SELECT DISTINCT b.nb_id, b.pos FROM v a JOIN v b ON a.nb_id = b.nb_id AND a.name = b.name AND a.pos < b.pos)
SELECT o_custkey AS nb_id, count(*) AS n_cells, count(u.pos) AS n_using_context FROM orders LEFT JOIN u ON u.nb_id = o_custkey AND u.pos = o_orderkey GROUP BY o_custkey""")
def syn9(spark, sf):
    """A cell uses earlier names if one of its own was first used before it: one minimum a name. Dealt out by notebook once, which all steps keep to; nothing is joined."""
    x = cells(spark, sf).select("nb_id", "pos", F.posexplode_outer("f.variables").alias("i", "name")).repartition("nb_id")
    x = x.withColumn("first", F.min("pos").over(W.partitionBy("nb_id", "name")))
    # a cell's first row, or its only one if it has no names, counts it
    own = x.groupBy("nb_id", "pos").agg(F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("n"), F.max(F.col("name").isNotNull() & (F.col("first") < F.col("pos"))).alias("using"))
    return own.groupBy("nb_id").agg(F.sum("n").alias("n_cells"), F.sum(F.when(F.col("using"), F.col("n")).otherwise(0)).alias("n_using_context"))


OBFUSCATED = [
    "import numpy as np\nOBF_VAR_0 = np.mean([{p}, {p}])\nprint(OBF_VAR_0)",
    "def OBF_FUNC_0(OBF_VAR_1, OBF_VAR_3):\n    \"\"\"\"\"\"\n    OBF_VAR_0 = sum(OBF_VAR_1)\n    for OBF_VAR_2 in OBF_VAR_1:\n        OBF_VAR_0 += OBF_VAR_2 * OBF_VAR_3\n    if OBF_VAR_0 > {p}:\n        OBF_VAR_0 = OBF_VAR_4.clip(OBF_VAR_0, {p})\n    return (OBF_VAR_0, len(OBF_VAR_1))",
    "", "OBF_VAR_0 = load('')\nOBF_VAR_0.sort()\nOBF_VAR_1 = OBF_VAR_0[0].size + OBF_VAR_2\nOBF_VAR_1",
    "def OBF_FUNC_0(OBF_VAR_1, OBF_VAR_4=3):\n    OBF_VAR_0 = sorted(OBF_VAR_1)\n    OBF_VAR_0.reverse()\n    OBF_VAR_2 = [OBF_VAR_3 for OBF_VAR_3 in OBF_VAR_0 if OBF_VAR_3 > {p}]\n    return OBF_VAR_2", "",
]
by_cell("syn4_obfuscated", {"code": OBFUSCATED}, lambda c: c.select("nb_id", "pos", F.coalesce(C.obfuscated(mended()), F.lit("")).alias("code")))


def mended():
    return print_to_call(drop_magics(F.col("code")))


@query("syn10_variable_blocks", listed_sql(["name", "first", "last"], [[("x{c}", 2, 4)], [("base", 6, 11)], [], [("rows", 1, 3), ("z{c}", 3, 4)], [("best", 2, 4), ("out", 4, 5)], []]).replace("SELECT nb_id, pos, i,", "SELECT nb_id, pos,"))
def syn10(spark, sf):
    b = cells(spark, sf).select("nb_id", "pos", F.explode(C.variable_blocks(print_to_call(drop_magics(F.col("code"), True)))).alias("b"))
    return b.select("nb_id", "pos", "b.name", F.col("b.first").cast("string").alias("first"), F.col("b.last").cast("string").alias("last"))


CHUNKS = [
    [("Import", 1, 1, -1), ("Assign", 2, 2, -1), ("Expr", 3, 3, -1)],
    [("FunctionDef", 1, 11, -1), ("Expr", 2, 5, 0), ("Assign", 6, 6, 0), ("For", 7, 8, 0), ("AugAssign", 8, 8, 3), ("If", 9, 10, 0), ("Assign", 10, 10, 5), ("Return", 11, 11, 0)],
    [], [("Assign", 1, 1, -1), ("Expr", 2, 2, -1), ("Assign", 3, 3, -1), ("Expr", 4, 4, -1)], [("FunctionDef", 1, 5, -1), ("Assign", 2, 2, 0), ("Expr", 3, 3, 0), ("Assign", 4, 4, 0), ("Return", 5, 5, 0)], [],
]


@query("syn11_syn12_chunks", listed_sql(["kind_of", "line", "end_line", "parent"], CHUNKS))
def syn11(spark, sf):
    c = cells(spark, sf).select("nb_id", "pos", F.posexplode(C.chunks(mended())).alias("i", "c"))
    return c.select("nb_id", "pos", "i", F.col("c.kind").alias("kind_of"), *[F.col(f"c.{n}").cast("string").alias(n) for n in ("line", "end_line", "parent")])


FLOW = [
    [("print", 3, "comesFrom", "print"), ("x{c}", 2, "computedFrom", "np"), ("x{c}", 3, "comesFrom", "x{c}")],
    [("base", 6, "computedFrom", "sum,prices"), ("base", 8, "computedFrom", "p,rate"), ("base", 10, "computedFrom", "base,np"), ("p", 7, "computedFrom", "prices")],
    [], [("rows", 1, "computedFrom", "load"), ("rows", 2, "comesFrom", "rows"), ("z{c}", 3, "computedFrom", "w,rows"), ("z{c}", 4, "comesFrom", "z{c}")],
    [("best", 2, "computedFrom", "sorted,items"), ("best", 3, "comesFrom", "best"), ("out", 4, "computedFrom", "i,best")], [],
]


@query("syn17_dataflow", listed_sql(["name", "line", "flow", "sources"], FLOW).replace("SELECT nb_id, pos, i,", "SELECT nb_id, pos,"))
def syn17(spark, sf):
    d = cells(spark, sf).select("nb_id", "pos", F.explode(C.dataflow(mended())).alias("d"))
    return d.select("nb_id", "pos", "d.name", F.col("d.line").cast("string").alias("line"), F.col("d.kind").alias("flow"), F.array_join("d.sources", ",").alias("sources"))


def functions(spark, sf, *fields):
    """These fields of the sub-programs of the cells that have a function."""
    return with_functions(derived.code_cells(spark, sf), *fields)


def with_functions(c, *fields):
    """Cells without the keyword have no function, and are not sent to Python."""
    return c.where(F.contains("code", F.lit("def"))).withColumn("d", S.decompose(F.col("code"), *fields)).where("d.ok")


def by_function(name, columns, fields, select):
    @query(name, facts_sql(columns, FUNCTION_KINDS))
    def q(spark, sf):
        return select(functions(spark, sf, *fields))

    return q


by_function("syn13_function_io", {
    "arguments": ["", "prices,rate", "", "", "items,n", ""], "returned": ["", "__SIMPLIFIED_RETURN_VARIABLE", "", "", "out", ""],
    "last_lines": ["", "    __SIMPLIFIED_RETURN_VARIABLE = (base, len(prices))\n    return __SIMPLIFIED_RETURN_VARIABLE", "", "", "    out = [i for i in best if i > {p}]\n    return out", ""],
}, ["arguments", "returned", "simplified"], lambda f: f.select("nb_id", "pos", F.array_join("d.arguments", ",").alias("arguments"), F.array_join("d.returned", ",").alias("returned"), F.regexp_extract("d.simplified", r"([^\n]*\n[^\n]*)$", 1).alias("last_lines")))
RENAMED = ["", "def total{c}(INP0, INP1):\n    VAR0 = sum(INP0)\n    for VAR1 in INP0:\n        VAR0 += VAR1 * INP1\n    if VAR0 > {p}:\n        VAR0 = __MODULE_np.clip(VAR0, {p})\n    OUT0 = (VAR0, len(INP0))\n    return OUT0", "", "",
           "def pick{c}(INP0, INP1=3):\n    VAR0 = sorted(INP0)\n    VAR0.reverse()\n    OUT0 = [VAR1 for VAR1 in VAR0 if VAR1 > {p}]\n    return OUT0", ""]
by_function("syn14_renamed", {"renamed": RENAMED}, ["renamed"], lambda f: f.select("nb_id", "pos", "d.renamed"))


@query("syn14_roles", listed_sql(["name", "role"], [[], [("prices", "INP0"), ("rate", "INP1"), ("base", "VAR0"), ("p", "VAR1"), ("np", "__MODULE_np"), ("__SIMPLIFIED_RETURN_VARIABLE", "OUT0")], [], [],
                                                    [("items", "INP0"), ("n", "INP1"), ("best", "VAR0"), ("i", "VAR1"), ("out", "OUT0")], []]).replace("SELECT nb_id, pos, i,", "SELECT nb_id, pos,"))
def syn14_roles(spark, sf):
    return functions(spark, sf, "roles").select("nb_id", "pos", F.explode("d.roles").alias("name", "role"))


STEPS = [
    [], [("STEP", "INP0", "VAR0", "sum", ""), ("FOR(target=VAR1, iter=INP0)", "INP0", "VAR1", "", ""), ("STEP", "VAR1 INP1", "VAR0", "ADD", "0 1"), ("IF(test=COMPARE(left=VAR0, ops=[GT], comparators=[[]]))", "VAR0", "", "", "0 2"),
         ("STEP", "VAR0 np", "VAR0", "clip", "0 2 3"), ("STEP", "VAR0 INP0", "OUT0", "len", "0 2 4"), ("RETURN", "OUT0", "", "", "5")],
    [], [], [("STEP", "INP0", "VAR0", "sorted", ""), ("STEP", "VAR0", "VAR0", "reverse", "0"), ("STEP", "VAR1 VAR0", "OUT0", "LISTCOMP", "1"), ("RETURN", "OUT0", "", "", "2")], [],
]


@query("syn15_steps_and_operators", listed_sql(["step_kind", "inputs", "outputs", "ops", "needs"], STEPS))
def syn15(spark, sf):
    """Statements with their inputs, outputs, operators and the earlier steps that they read from."""
    d = functions(spark, sf, "step_facts").select("nb_id", "pos", F.explode("d.step_facts").alias("s"))
    return d.select("nb_id", "pos", F.col("s.step").alias("i"), F.col("s.kind").alias("step_kind"), *[F.array_join(F.col(f"s.{n}").cast("array<string>"), " ").alias(n) for n in ("inputs", "outputs", "ops", "needs")])


STREAMS = [
    "", "[I] INP0 INP1 [O] OUT0 [ops] FUNCDEF [STEP] [I] INP0 [O] VAR0 [ops] sum [STEP] FOR(target=VAR1, iter=INP0) [STEP] [I] VAR1 INP1 [O] VAR0 [ops] ADD [STEP] ENDFOR [STEP] "
    "IF(test=COMPARE(left=VAR0, ops=[GT], comparators=[[]])) [STEP] [I] VAR0 np [O] VAR0 [ops] clip [STEP] ENDIF [STEP] NEWLINE [STEP] [I] VAR0 INP0 [O] OUT0 [ops] len [STEP] NEWLINE [STEP] RETURN",
    "", "", "[I] INP0 INP1 [O] OUT0 [ops] FUNCDEF [STEP] [I] INP0 [O] VAR0 [ops] sorted [STEP] NEWLINE [STEP] [I] VAR0 [O] VAR0 [ops] reverse [STEP] NEWLINE [STEP] [I] VAR1 VAR0 [O] OUT0 [ops] LISTCOMP [STEP] NEWLINE [STEP] RETURN", "",
]
by_function("syn15_syn16_statement_stream", {"stream": STREAMS}, ["stream"], lambda f: f.select("nb_id", "pos", "d.stream"))
SLICES = [
    [], [("0", "VAR0", "INP0"), ("0 1 2", "VAR0", "INP0 INP1"), ("0 1 2 3 4", "VAR0", "INP0 INP1 np"), ("0 1 2 3 4 5", "OUT0", "INP0 INP1 np"), ("0 1 2 3 4 5 6", "OUT0", "INP0 INP1 np"), ("1", "VAR1", "INP0")],
    [], [], [("0", "VAR0", "INP0"), ("0 1", "VAR0", "INP0"), ("0 1 2", "OUT0", "INP0"), ("0 1 2 3", "OUT0", "INP0")], [],
]


@query("syn16_sub_programs", listed_sql(["members", "outputs", "inputs"], SLICES).replace("SELECT nb_id, pos, i,", "SELECT nb_id, pos,"))
def syn16(spark, sf):
    d = functions(spark, sf, "slice_facts").select("nb_id", "pos", F.explode("d.slice_facts").alias("s"))
    return d.select("nb_id", "pos", *[F.array_join(F.col(f"s.{n}").cast("array<string>"), " ").alias(n) for n in ("members", "outputs", "inputs")])


@query("syn16_shared_sub_programs", f"""WITH s AS (SELECT DISTINCT nb_id, md5(inputs || '>' || ops) AS x FROM ({listed_sql(['inputs', 'ops'], [[(s[1], s[3]) for s in k] for k in STEPS])}))
SELECT x AS shape, count(*) AS n_notebooks FROM s GROUP BY x""")
def syn16_shared(spark, sf):
    """In how many notebooks a step of the same inputs and operators is found."""
    d = functions(spark, sf, "step_facts").select("nb_id", F.explode("d.step_facts").alias("s"))
    shape = F.md5(F.concat(F.array_join("s.inputs", " "), F.lit(">"), F.array_join("s.ops", " ")))
    return d.select("nb_id", shape.alias("shape")).distinct().groupBy("shape").agg(F.count("*").alias("n_notebooks"))


BARE = ["", "def total{c}(prices, rate):\n    base = sum(prices)\n    for p in prices:\n        base += p * rate\n    if base > {p}:\n        base = np.clip(base, {p})\n    return base, len(prices)", "", *derived.CODE[3:]]
BARE[0] = derived.CODE[0].replace("%matplotlib inline\nprint x{c}", "print(x{c})")
by_cell("str23_python_without_comments", {"code": BARE}, lambda c: c.select("nb_id", "pos", F.coalesce(C.without_comments_and_docstrings(mended()), F.lit("")).alias("code")))


def shards(spark, sf):
    """The code cells in 14 files of JSON Lines, those of kind 3 in another language and those of kind 2 cut off; read again with an expectation."""
    c = derived.code_cells(spark, sf)
    line = F.to_json(F.struct(F.when(F.col("pos") % 6 == 3, "java").otherwise("python").alias("language"), "nb_id", "pos", "code"))
    path = scratch(spark, "shards")
    c.select(F.when(F.col("pos") % 6 == 2, F.substring(line, 1, 20)).otherwise(line).alias("value"), (F.col("pos") % 14).alias("shard")).write.partitionBy("shard").text(path)
    return read_shards(spark, f"{path}/*/*.txt", "language string, nb_id long, pos long, code string", "language = 'python'")


@query("ext7_shards_and_quarantine", "SELECT CASE pos % 6 WHEN 2 THEN 'parse' WHEN 3 THEN 'expectation' ELSE 'good' END AS outcome, count(*) AS n, count(*) AS n_places FROM (SELECT o_orderkey AS pos FROM orders) GROUP BY 1".replace("pos % 6", "(pos % 6)"))
def ext7(spark, sf):
    good, bad = shards(spark, sf)
    both = good.select(F.lit("good").alias("outcome"), "file", "line").union(bad.select("reason", "file", "line"))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("file", "line").alias("n_places"))


@query("ext7_shard_streams", facts_sql({"stream": STREAMS}, FUNCTION_KINDS))
def ext7_streams(spark, sf):
    return with_functions(shards(spark, sf)[0], "stream").select("nb_id", "pos", "d.stream")


def as_lines(x):
    return f"string_split({x}, chr(10))"


@query("syn20_line_diff", f"""WITH l AS (SELECT nb_id, pos, {as_lines('code')} AS l FROM {derived.CODE_SQL})
SELECT nb_id, pos, '-' AS sign, l[len(l)] AS line FROM l WHERE pos % 6 NOT IN (2, 5) UNION ALL SELECT nb_id, pos, '+', '# ' || l[len(l)] FROM l WHERE pos % 6 NOT IN (2, 5)""")
def syn20(spark, sf):
    """Each cell against itself with the last line commented out; broken and empty cells left out."""
    x = derived.code_cells(spark, sf).where("pos % 6 NOT IN (2, 5)")
    x = x.withColumn("other", F.regexp_replace("code", r"([^\n]*)$", "# $1")).withColumn("other", F.regexp_replace("other", r"\n?# $", ""))
    return x.select("nb_id", "pos", F.explode(C.line_diff("code", "other")).alias("d")).select("nb_id", "pos", "d.sign", "d.line")


PARSABLE = [derived.CODE[0].split("\n%")[0], derived.CODE[1], "", *derived.CODE[3:]]
by_cell("syn21_parsable_part", {"code": PARSABLE}, lambda c: c.select("nb_id", "pos", C.parsable_part("code").alias("code")))
by_cell("syn22_docstring_types", {"types": ["", "prices:list", "", "", "", ""]}, lambda c: c.where("size(f.docstrings) > 0").select("nb_id", "pos", F.array_join(docstring_types(F.get("f.docstrings", F.lit(0))), ",").alias("types")), "pos % 6 = 1")


PATCH = "@@ -1,3 +1,3 @@\n a = 1\n-b = 2\n+b = 3\n"
PATCH_SQL = "(SELECT string_split('" + PATCH.replace("\n", "' || chr(10) || '") + "', chr(10)) AS l)"


@query("syn23_patch_lines", f"SELECT row_number() OVER () - 1 AS pos, trim(regexp_replace(x, '^[-+ ]', '')) AS line, CASE WHEN starts_with(x, '-') THEN 0 WHEN starts_with(x, '+') THEN 1 ELSE 2 END AS label FROM (SELECT unnest(list_filter(l, lambda x: NOT starts_with(x, '@@'))) AS x FROM {PATCH_SQL})")
def syn23(spark, sf):
    x = spark.createDataFrame([(PATCH,)], "patch string")
    return x.select(F.posexplode(C.patch_lines(F.col("patch"))).alias("pos", "x")).select("pos", "x.line", "x.label")


@query("syn28_tagged_patch", values([("<keep>a = 1 <del>b = 2 <add>b = 3",)], "y"))
def syn28(spark, sf):
    return spark.createDataFrame([(PATCH,)], "patch string").select(C.tagged_patch(F.col("patch")).alias("y"))


@query("str21_str22_best_fuzzy_match")
def str21(spark, sf):
    """Best fuzzy match of a conversation's first text with its others."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    a, b = c.where("turn = 0"), c.where("turn > 0").select("conv_id", F.col("t").alias("u"))
    x = a.join(b, "conv_id", "left").withColumn("score", F.when(F.col("u").isNotNull(), C.token_set_ratio("t", F.coalesce("u", F.lit("")))))
    return x.groupBy("conv_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))


@query("jon11_fuzzy_parents")
def jon11(spark, sf):
    """Titles of pages and part names as labels; see operators.fuzzy."""
    titles = read(spark, sf, "pages").select(F.regexp_extract("html", "<title>([^<]*)", 1).alias("label"))
    return fuzzy_parents(titles.union(read(spark, sf, "part").select("p_name")), "label")


@query("jon14_names_in_markdown", f"""WITH v AS ({listed_sql(['term'], [[(x,) for x in v] + [(f,) for f in fs] for v, fs in zip(VARIABLES, (['mean'], ['clip', 'total{c}'], [], ['load', 'sort'], ['reverse', 'pick{c}'], []))])}),
m AS (SELECT DISTINCT nb_id, unnest(regexp_split_to_array(md, '[^A-Za-z0-9_]+')) AS term FROM {derived.MARKDOWN_SQL}) SELECT DISTINCT m.nb_id, m.term FROM m JOIN v ON v.nb_id = m.nb_id AND v.term = m.term""")
def jon14(spark, sf):
    """Words of a notebook's markdown that are names of its code."""
    names = cells(spark, sf).select("nb_id", F.explode(F.concat("f.variables", "f.functions", "f.definitions")).alias("term"))
    words = derived.markdown_cells(spark, sf).select("nb_id", F.explode(F.split("md", "[^A-Za-z0-9_]+")).alias("term"))
    return words.join(names, ["nb_id", "term"], "left_semi").distinct()
