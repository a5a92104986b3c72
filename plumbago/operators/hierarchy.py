"""Heading hierarchies of notebooks and pages, as adjacency rows, paths and step indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions.text import heading_level, strip_tags


def parents(cells: DataFrame) -> DataFrame:
    """(nb_id, pos, level, parent, content): the nearest cell before with a smaller level; null for a root.

    Cells without heading have level 1000, so the last heading is their parent.
    """
    x = cells.withColumn("level", heading_level(F.col("content")).cast("int"))
    # of each level, the last cell before: levels are few, so this is a map as wide as the levels
    by = W.partitionBy("nb_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(by) for k in range(1, 7)}
    x = x.withColumns({f"__l{k}": c for k, c in last.items()})
    best = F.greatest(*[F.when(F.col("level") > k, F.col(f"__l{k}")) for k in range(1, 7)])
    return x.select("nb_id", "pos", "level", best.alias("parent"), "content")


def leaf_paths(tree: DataFrame, most: int = 8) -> DataFrame:
    """(nb_id, pos, depth, path) of each leaf; a heading has at most six ancestors, so the walk up is that many joins."""
    up = tree.select("nb_id", F.col("pos").alias("__p"), F.col("parent").alias("__up"), F.col("content").alias("__c"))
    inner = tree.where("parent is not null").select("nb_id", F.col("parent").alias("pos")).distinct()
    now = tree.join(inner, ["nb_id", "pos"], "left_anti").select("nb_id", "pos", "parent", F.lit(1).alias("depth"), F.col("content").alias("path"))
    for _ in range(most - 1):
        now = now.join(up, (now["nb_id"] == up["nb_id"]) & (now["parent"] == up["__p"]), "left").select(
            now["nb_id"], "pos", F.col("__up").alias("parent"),
            (F.col("depth") + F.col("__p").isNotNull().cast("int")).alias("depth"),
            F.when(F.col("__p").isNotNull(), F.concat("__c", F.lit("->"), "path")).otherwise(F.col("path")).alias("path"),
        )
    return now.select("nb_id", "pos", "depth", "path")


def step_index(paths: DataFrame) -> DataFrame:
    """(nb_id, pos, depth, step, next_step) of every step of every path."""
    x = paths.select("nb_id", "pos", F.split("path", "->").alias("__x"))
    x = x.select("nb_id", "pos", "__x", F.posexplode("__x").alias("depth", "step"))
    return x.select("nb_id", "pos", "depth", "step", F.get("__x", F.col("depth") + 1).alias("next_step"))


def search_step(index: DataFrame, steps: list[str], depth: int) -> DataFrame:
    """Exact matches of steps, nearest in depth first."""
    return index.where(F.col("step").isin(steps)).select("nb_id", "pos", "depth", F.abs(F.col("depth") - depth).alias("gap")).orderBy("gap", "nb_id", "pos")


def relative_rank(tree: DataFrame) -> DataFrame:
    return tree.select("nb_id", "pos", (F.dense_rank().over(W.partitionBy("nb_id").orderBy("level")) - 1).alias("rank"))


def html_cells(pages: DataFrame, id_col: str, html: str, tags: tuple[str, ...] = ("h1", "h2", "p", "pre")) -> DataFrame:
    """(id, pos, tag, content): the elements of some tags in order, their inner tags dropped."""
    pattern = "(?s)" + "|".join(f"<{t}>.*?</{t}>" for t in tags)
    x = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 0)).alias("pos", "x"))
    return x.select(id_col, "pos", F.regexp_extract("x", "^<([a-z0-9]+)>", 1).alias("tag"), F.trim(strip_tags(F.col("x"))).alias("content"))
