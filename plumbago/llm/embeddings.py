"""Near-duplicate vectors: an exact metric range join over pivot cells.

Unit vectors with cosine >= t lie within Euclidean distance r = sqrt(2 - 2t).
Each vector belongs to the cell of its nearest pivot; by the triangle
inequality a vector within r of a member of cell j has d(x, p_j) <=
min(d(x, own pivot) + 2r, radius_j + r), so it is copied to those cells and to
no others. A cell then holds every partner of its own members, and cells are
joined independently. Cells over `cell_rows` rows are cut into blocks, and each
block of members meets each block of rows: no row is dropped and no task grows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tune
from .graph import components, union

EPS = 1e-9


def _unit(rows) -> np.ndarray:
    v = np.array(list(rows), dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(
    df: DataFrame,
    threshold: float = 0.98,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cell_rows: int = 2000,
    max_pivots: int = 4096,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are
    equal and their cosine in double precision is at least `threshold`. Null,
    empty and zero vectors, and those with a null or non-finite component, link
    with nothing and are kept. Equal vectors of one label are one class with a
    count: copies are joined once and counted as links of each other. Repeated
    ids count as separate vectors. A null id takes no part in component_id
    (the least id that is not null) and is never kept unless it stands for no
    group, in which case kept is null-safe equality of the two. An empty table
    gives an empty result. Columns other than the three are ignored.
    `max_pivots` bounds what is sent to the tasks (max_pivots vectors).
    """
    spark = df.sparkSession
    tune(spark)
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.coalesce(
        F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    good = rows.where(valid)
    # copies are one class, grouped by the vector itself
    classes = good.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("m"))
    classes = table(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))

    r = math.sqrt(max(0.0, 2 - 2 * threshold)) + EPS
    pivots = _pivots(classes, cell_rows, max_pivots)
    cells = table(_assign(classes, pivots))
    radius = {
        (x.label, x.dim, x.cell): x.radius
        for x in cells.where("pivoted").groupBy("label", "dim", "cell").agg(F.max("d").alias("radius")).collect()
    }  # at most max_pivots rows
    placed = _replicate(cells, pivots, radius, r)
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    placed = placed.join(sizes, ["label", "dim", "cell"]).withColumn("k", blocks)
    mine = F.pmod(F.xxhash64("cls"), F.col("k").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    left = placed.where("own").select("label", "dim", "cell", mine.alias("i"), F.explode(every).alias("j"), "cls", "m", "vec", F.lit(True).alias("own"))
    right = placed.select("label", "dim", "cell", F.explode(every).alias("i"), mine.alias("j"), "cls", "m", "vec", F.lit(False).alias("own"))
    met = (
        left.select("label", "dim", "cell", "i", "j", "cls", "m", "vec", "own")
        .union(right.select("label", "dim", "cell", "i", "j", "cls", "m", "vec", "own"))
        .groupBy("label", "dim", "cell", "i", "j")
        .applyInPandas(_meet(threshold), "cls long, n long, root long")
    )
    met = table(met)
    counts = met.groupBy("cls").agg(F.sum("n").alias("n"))
    # components over classes, named by the least id of each class
    comp = components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    of = classes.select("cls", "label", "vec", "low").join(counts, "cls", "left").join(
        comp.select(F.col("node").alias("cls"), "component"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select(
        F.col("label").alias("l2"), F.col("vec").alias("v2"), (F.coalesce("n", F.lit(1)) - 1).alias("n"), "component_id"
    )
    linked = rows.join(of, valid & (F.col("label") == F.col("l2")) & (F.col("vec") == F.col("v2")), "left")
    component = F.coalesce("component_id", "id")
    return linked.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _pivots(classes: DataFrame, cell_rows: int, max_pivots: int) -> dict:
    """Pivot vectors of the labels that need more than one cell: a bounded hash sample."""
    large = (
        classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
        .orderBy(F.desc("n"), "label", "dim").limit(max_pivots // 2).collect()
    )
    wanted, left = {}, max_pivots
    for x in large:
        k = min(-(-x.n // cell_rows), max(2, max_pivots // max(1, len(large))), left)
        if k > 1:
            wanted[x.label, x.dim] = (k, x.n)
            left -= k
    if not wanted:
        return {}
    spark = classes.sparkSession
    plan = spark.createDataFrame([(a, b, k, min(1.0, 4.0 * k / n)) for (a, b), (k, n) in wanted.items()], "label long, dim int, k int, p double")
    pick = F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(1 << 30)) < F.col("p") * (1 << 30)
    from pyspark.sql import Window as W

    ranked = classes.join(F.broadcast(plan), ["label", "dim"]).where(pick).withColumn(
        "rank", F.row_number().over(W.partitionBy("label", "dim").orderBy(F.xxhash64("cls", F.lit(11))))
    )
    out: dict = {}
    for x in ranked.where("rank <= k").select("label", "dim", "vec").collect():
        out.setdefault((x.label, x.dim), []).append(x.vec)
    return {k: _unit(v) for k, v in out.items() if len(v) > 1}


def _distances(pdf: pd.DataFrame, pivots: dict):
    for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
        p = pivots.get((label, dim))
        if p is None:
            yield part, None, None
        else:
            x = _unit(part["vec"])
            yield part, np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T))), p


def _assign(classes: DataFrame, pivots: dict) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for part, d, _ in _distances(pdf, pivots):
                part = part[["cls", "label", "dim", "m", "vec"]]
                if d is None:
                    yield part.assign(cell=0, d=0.0, pivoted=False)
                else:
                    yield part.assign(cell=d.argmin(axis=1), d=d.min(axis=1), pivoted=True)

    return classes.select("cls", "label", "dim", "m", "vec").mapInPandas(
        run, "cls long, label long, dim int, m long, vec array<double>, cell int, d double, pivoted boolean"
    )


def _replicate(cells: DataFrame, pivots: dict, radius: dict, r: float) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for part, d, p in _distances(pdf, pivots):
                base = part[["cls", "label", "dim", "m", "vec"]]
                yield base.assign(cell=part["cell"].to_numpy(), own=True)
                if d is None:
                    continue
                label, dim = int(part["label"].iloc[0]), int(part["dim"].iloc[0])
                own = part["cell"].to_numpy()
                mine = part["d"].to_numpy()
                gap = np.sqrt(np.maximum(1e-300, 2 - 2 * (p @ p.T)))
                for j in range(len(p)):
                    reach = radius.get((label, dim, j))
                    if reach is None:
                        continue
                    near = (own != j) & (d[:, j] <= np.minimum(mine + 2 * r, reach + r) + EPS)
                    # in Euclidean space the bisecting plane of two pivots gives a tighter bound as well
                    near &= (d[:, j] ** 2 - mine**2) <= 2 * gap[own, j] * r + EPS
                    if near.any():
                        yield base[near].assign(cell=j, own=False)

    return cells.mapInPandas(run, "cls long, label long, dim int, m long, vec array<double>, cell int, own boolean")


def _meet(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["own"]], pdf[~pdf["own"]]
        if a.empty or b.empty:
            return pd.DataFrame({"cls": [], "n": [], "root": []}, dtype="int64")
        x, y = _unit(a["vec"]), _unit(b["vec"])
        weight = b["m"].to_numpy()
        names, where = np.unique(np.concatenate([a["cls"], b["cls"]]), return_inverse=True)
        ia, ib = where[: len(a)], where[len(a) :]
        parent, n = np.arange(len(names)), np.zeros(len(a), np.int64)
        for s in range(0, len(a), 256):
            hit = x[s : s + 256] @ y.T >= threshold
            hit |= ia[s : s + 256, None] == ib[None, :]  # a class meets itself, whatever rounding says
            n[s : s + 256] = hit @ weight
            i, j = np.nonzero(hit)
            union(parent, ia[s : s + 256][i], ib[j])
        return pd.DataFrame({"cls": np.concatenate([names[ia], names]), "n": np.concatenate([n, np.zeros(len(names), np.int64)]), "root": np.concatenate([names[ia], names[parent]])})

    return run
