"""Knowledge graphs as edge rows (sub, rel, obj): building, pruning, patterns, walks, ontologies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.runtime import checkpoints

#: Relations and their inverses, either way round, and the inverse of all others.
INVERSE = {
    "has part(s)": "part of", "influenced by": "influences", "uses": "used by", "has instance": "instance of", "modeled by": "can model", "superclass of": "subclass of",
    "evaluated by": "evaluates", "has language": "has dataset", "better than": "worse than",
}
DEFAULT_INVERSE = "IS A PART OF"


def inverse(rel: Column) -> Column:
    """The inverse relation in capitals; letter case and spaces around the relation are ignored."""
    both = [(k.upper(), v.upper()) for pair in INVERSE.items() for k, v in (pair, pair[::-1])]
    known = F.create_map(*[F.lit(x) for kv in both for x in kv])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(rel))), F.lit(DEFAULT_INVERSE))


def with_inverse(edges: DataFrame) -> DataFrame:
    return edges.select("sub", "rel", "obj").union(edges.select(F.col("obj").alias("sub"), inverse(F.col("rel")).alias("rel"), F.col("sub").alias("obj")))


def steps_to_triples(steps: DataFrame) -> DataFrame:
    """steps: parent, pos, name. First, last, next, previous and part-of edges."""
    by = W.partitionBy("parent").orderBy("pos")
    x = steps.withColumns({"nxt": F.lead("name").over(by), "prv": F.lag("name").over(by)})
    edge = lambda sub, rel, obj, keep=F.lit(True): x.where(keep).select(F.col(sub).alias("sub"), F.lit(rel).alias("rel"), F.col(obj).alias("obj"))
    parts = [
        edge("parent", "HAS FIRST STEP", "name", F.col("prv").isNull()), edge("parent", "HAS LAST STEP", "name", F.col("nxt").isNull()),
        edge("parent", "HAS STEP", "name"), edge("name", "IS STEP OF", "parent"),
        edge("name", "HAS NEXT STEP", "nxt", F.col("nxt").isNotNull()), edge("name", "HAS PREVIOUS STEP", "prv", F.col("prv").isNotNull()),
    ]
    return reduce(DataFrame.union, parts).distinct()


def cross_edges(records: DataFrame, left: str, rel: str, back: str, right: str) -> DataFrame:
    """Edges of each record's left items with its right ones, in both directions; both are arrays of the record."""
    x = records.select(F.explode(left).alias("a"), right).select("a", F.explode(right).alias("b")).distinct()
    return x.select(F.col("a").alias("sub"), F.lit(rel).alias("rel"), F.col("b").alias("obj")).union(x.select(F.col("b").alias("sub"), F.lit(back).alias("rel"), F.col("a").alias("obj")))


def merge_sources(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples (seq, source, sub, sub_type, rel, obj, obj_type, weight).

    A node takes its first type, the set of its sources and an id by first
    place; an edge its last weight.
    """
    ends = triples.select("seq", F.lit(0).alias("side"), F.col("sub").alias("name"), F.col("sub_type").alias("type"), "source").union(
        triples.select("seq", F.lit(1), "obj", "obj_type", "source"))
    nodes = ends.groupBy("name").agg(
        F.min(F.struct("seq", "side")).alias("first"), F.min_by("type", F.struct("seq", "side")).alias("type"), F.sort_array(F.collect_set("source")).alias("sources"))
    edges = triples.groupBy("sub", "rel", "obj").agg(F.max_by("weight", "seq").alias("weight"), F.count("*").alias("n"))
    return nodes.select("name", "type", F.col("first.seq").alias("first_seq"), F.col("first.side").alias("first_side"), "sources"), edges


def match(edges: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a conjunction of triple patterns; terms that start with `?` are variables, others constants.

    Each pattern is a scan with its constants filtered; patterns that share
    variables are equi-joined in the order given.
    """
    out: DataFrame | None = None
    for pattern in patterns:
        x, cols = edges, {}
        for column, term in zip(("sub", "rel", "obj"), pattern):
            if not term.startswith("?"):
                x = x.where(F.col(column) == term)
            elif term[1:] in cols:
                x = x.where(F.col(column) == F.col(cols[term[1:]]))
            else:
                cols[term[1:]] = column
        x = x.select(*[F.col(c).alias(v) for v, c in cols.items()])
        if out is None:
            out = x
        else:
            shared = [v for v in x.columns if v in out.columns]
            out = out.join(x, shared) if shared else out.crossJoin(x)
    return out.distinct()


def prune_subjects(edges: DataFrame, stop: DataFrame) -> DataFrame:
    """All edges of a subject go if one of its edges is a stop (rel, obj)."""
    bad = edges.join(F.broadcast(stop.distinct()), ["rel", "obj"], "left_semi").select("sub").distinct()  # a stop list: a configuration, not data
    return edges.join(bad, "sub", "left_anti")


def split_by_subject(edges: DataFrame, drops_subject: Column, drops_edge: Column, triggers: Column) -> DataFrame:
    """Edges with `kept`: false for a subject that a predicate names, one with a triggering edge or no edge left, and for dropped edges.

    Kept and dropped rows partition the input.
    """
    by = W.partitionBy("sub")
    subject = drops_subject | F.bool_or(triggers).over(by) | ~F.bool_or(~drops_edge).over(by)
    return edges.withColumn("kept", ~F.coalesce(subject, F.lit(False)) & ~F.coalesce(drops_edge, F.lit(False)))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    out = edges.groupBy(F.col("sub").alias("node")).agg(F.count("*").alias("n_out"))
    inc = edges.groupBy(F.col("obj").alias("node")).agg(F.count("*").alias("n_in"))
    both = out.join(inc, "node", "full_outer")
    return both.select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def reach(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(node, depth): breadth-first distances from the start nodes (column node), up to `most`; cycles are no trouble.

    One join a level; only the new frontier is expanded, and each level is
    checkpointed, so that the plan does not grow.
    """
    spark = edges.sparkSession
    checkpoints(spark)
    seen = start.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(edges.select(F.col("sub").alias("node"), F.col("obj").alias("next")), "node").select(F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if not frontier.head(1):
            break
        seen = seen.union(frontier)
    return seen


def steps_below(edges: DataFrame, root: str, relation: str) -> DataFrame:
    """(name, depth, path): the tree below a node along one relation, however deep; a node on its own path is not followed again.

    One join a level, each level checkpointed, until a level is empty.
    """
    spark = edges.sparkSession
    checkpoints(spark)
    below = edges.where(F.col("rel") == relation).select("sub", "obj").distinct().checkpoint()
    level = spark.createDataFrame([(root, 0, [root])], "name string, depth int, way array<string>")
    out = level
    while True:
        step = level.join(below, F.col("name") == F.col("sub")).where(~F.array_contains("way", F.col("obj")))
        level = step.select(F.col("obj").alias("name"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.array("obj")).alias("way")).checkpoint()
        if not level.head(1):
            return out.select("name", "depth", F.concat(F.lit("/"), F.array_join("way", "/"), F.lit("/")).alias("path"))
        out = out.union(level)


def reduce_ontology(edges: DataFrame) -> DataFrame:
    """Parent-child edges without those that a grandparent path already gives."""
    e = edges.select("parent", "child").distinct()
    two = e.alias("a").join(e.alias("b"), F.col("a.child") == F.col("b.parent")).select(F.col("a.parent").alias("parent"), F.col("b.child").alias("child")).distinct()
    return e.join(two, ["parent", "child"], "left_anti")


def neighbour_sum(edges: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """(node, value): one hop of message passing with self loops, (A + I) x."""
    x = features.select("node", value)
    sent = edges.select(F.col("sub").alias("node"), F.col("obj").alias("to")).join(x, "node").select(F.col("to").alias("node"), value)
    return sent.union(x).groupBy("node").agg(F.round(F.sum(value), 6).alias(value))


def classify(nodes: DataFrame, edges: DataFrame, rules: list[tuple[Column, str]], inherits: str) -> DataFrame:
    """(node, type): ordered rules on a node's name, then untyped nodes take the least type of a parent along one relation, until nothing changes."""
    checkpoints(nodes.sparkSession)
    kind = F.lit(None).cast("string")
    for test, name in reversed(rules):
        kind = F.when(test, F.lit(name)).otherwise(kind)
    now = nodes.select("node", kind.alias("type")).checkpoint()
    up = edges.where(F.col("rel") == inherits).select(F.col("sub").alias("node"), F.col("obj").alias("parent"))
    while True:
        known = now.where("type is not null").select(F.col("node").alias("parent"), F.col("type").alias("t"))
        got = up.join(known, "parent").groupBy("node").agg(F.min("t").alias("t"))
        more = now.join(got, "node", "left").select("node", F.coalesce("type", "t").alias("type"), (F.col("type").isNull() & F.col("t").isNotNull()).alias("new")).checkpoint()
        now = more.select("node", "type")
        if not more.where("new").head(1):
            return now
