"""Tables that Spark derives from the given ones: code cells and headings of notebooks, one an order, so that their work grows with the data.

A customer is a notebook, an order a cell; the cell's kind is the order's number
modulo the number of templates. The same templates are told to DuckDB, as are, kind by kind, the
expected facts of a cell, written by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import read

#: Code cells by kind; {c} is the customer's number, {p} the whole part of the order's price.
CODE = [
    "import numpy as np\nx{c} = np.mean([{p}, {p}])\n%matplotlib inline\nprint x{c}",
    'def total{c}(prices, rate):\n    """Total.\n\n    prices (list): amounts\n    """\n    base = sum(prices)  # all "of" them\n    for p in prices:\n        base += p * rate\n    if base > {p}:\n        base = np.clip(base, {p})\n    return base, len(prices)',
    "y{c} = ({p},\n",
    "rows = load('{p}')\nrows.sort()\nz{c} = rows[0].size + w\nz{c}",
    "def pick{c}(items, n=3):\n    best = sorted(items)\n    best.reverse()\n    out = [i for i in best if i > {p}]\n    return out",
    "",
]
#: Markdown cells by kind.
MARKDOWN = ["# Shop {c}", "## Load the data", "plain text of {p}", "### Clean {p}", "## Plot\n\nMore text.", "Question {c}: what is total{c}?"]


def orders(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("nb_id"), F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("p"))


def filled(templates: list[str]):
    """The template of a row's kind, with the row's numbers in it."""
    text = F.element_at(F.array(*map(F.lit, templates)), (F.col("pos") % len(templates) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{c}"), F.col("nb_id").cast("string")), F.lit("{p}"), F.col("p").cast("string"))


def code_cells(spark, sf):
    """nb_id, pos, code; dealt out, as the orders are few bytes, so few tasks, and each cell costs Python much."""
    return orders(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "pos").select("nb_id", "pos", filled(CODE).alias("code"))


def markdown_cells(spark, sf):
    """nb_id, pos, md."""
    return orders(spark, sf).select("nb_id", "pos", filled(MARKDOWN).alias("md"))


ORDERS_SQL = "(SELECT o_custkey AS nb_id, o_orderkey AS pos, o_custkey AS c, floor(o_totalprice)::BIGINT AS p FROM orders)"


def text_sql(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def filled_sql(templates: list[str]) -> str:
    """The same in SQL, over ORDERS_SQL."""
    return f"replace(replace([{', '.join(map(text_sql, templates))}][pos % {len(templates)} + 1], '{{c}}', c::VARCHAR), '{{p}}', p::VARCHAR)"


CODE_SQL = f"(SELECT nb_id, pos, {filled_sql(CODE)} AS code FROM {ORDERS_SQL})"
MARKDOWN_SQL = f"(SELECT nb_id, pos, {filled_sql(MARKDOWN)} AS md FROM {ORDERS_SQL})"


def facts_sql(columns: dict[str, list[str]], where: str = "true") -> str:
    """SQL of nb_id, pos and the expected texts of each kind of code cell."""
    return f"SELECT nb_id, pos, {', '.join(f'{filled_sql(v)} AS {n}' for n, v in columns.items())} FROM {ORDERS_SQL} WHERE {where}"


def listed_sql(columns: list[str], kinds: list[list[tuple]]) -> str:
    """SQL of nb_id, pos and several expected rows for each kind of code cell; all values are texts."""
    rows = ", ".join(f"({k}, {i}, {', '.join(text_sql(str(v)) for v in row)})" for k, of in enumerate(kinds) for i, row in enumerate(of))
    named = ", ".join(f"replace(replace({c}, '{{c}}', c::VARCHAR), '{{p}}', p::VARCHAR) AS {c}" for c in columns)
    return f"SELECT nb_id, pos, i, {named} FROM {ORDERS_SQL} JOIN (VALUES {rows}) AS v(kind, i, {', '.join(columns)}) ON kind = pos % {len(kinds)}"
