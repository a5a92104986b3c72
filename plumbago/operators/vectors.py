"""Vector joins in blocks: exact top k of a query set, and pairs within a range pruned by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.runtime import scratch, ship

#: Rows of a block of queries, of a block of vectors, and of one side of a block of pairs.
QUERIES, ROWS, SIDE = 2048, 8192, 2048
#: Rows of a block that are multiplied at once: what a task holds is this times the other side.
AT_ONCE = 128
#: Cells that a vector is sent to on average at most; where it would be more, a group is one cell.
COPIES = 8
#: Pivots of a group at most, and of all groups together (they are broadcast).
GROUP_PIVOTS, PIVOTS = 64, 4096


def _unit(x: pd.Series) -> np.ndarray:
    m = np.stack(x.to_numpy())
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, np.nan)


def block_tops(queries: DataFrame, docs: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q, doc, score): at least the k best documents by cosine of each query in each block of documents, with all that tie with the last of them.

    queries: (q, v), docs: (doc, v), v of doubles. Both sides are cut into blocks by the hash of their ids, each block of queries meets
    each block of documents in one task, and only tops leave it. Vectors of length zero are near nothing.
    """
    ship(queries.sparkSession)
    n_q, n_d = queries.count() // QUERIES + 1, docs.count() // ROWS + 1
    q = queries.select(F.pmod(F.xxhash64("q"), F.lit(n_q)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("j"), "q", "v")
    d = docs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("doc"), F.lit(n_d)).cast("int").alias("j"), "doc", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "doc": [], "score": []})
        ids, doc, u, v = a["q"].to_numpy(), b["doc"].to_numpy(), _unit(a["v"]), _unit(b["v"]).T
        out = []
        for at in range(0, len(ids), AT_ONCE):
            mine = ids[at : at + AT_ONCE]
            s = np.nan_to_num(u[at : at + AT_ONCE] @ v, nan=-np.inf)
            if exclude_self:
                s[mine[:, None] == doc[None, :]] = -np.inf
            n = min(k, s.shape[1])
            cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            i, j = np.nonzero((s >= cut[:, None] - 1e-9) & np.isfinite(s))
            out.append((mine[i], doc[j], s[i, j]))
        q, found, score = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"q": q, "doc": found, "score": score})

    return q.groupBy("i", "j").cogroup(d.groupBy("i", "j")).applyInPandas(run, "q long, doc long, score double")


def pairs_in_range(df: DataFrame, group: str, id_col: str, vec_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, score) with a < b: all pairs of a group of cosine >= `least`; and (compared, possible): how many were compared, of how many.

    Angles between vectors are a metric. Each group has some pivots; a vector's home is the cell
    of its nearest one, and it is also sent to every cell whose pivot is no further than its
    own plus twice the range: no pair in range is parted by that. A cell's vectors that are at home
    there meet those sent there, in blocks of bounded size, and of these only the ones whose
    angles to the pivot differ by no more than the range are multiplied. Null groups, null vectors and
    vectors of length zero are in no pair; ids must be distinct.
    """
    spark = df.sparkSession
    ship(spark)
    x = df.select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    x = _stored(x.where(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y) > 0).withColumn("g", F.xxhash64("g")))
    n_groups = max(1, x.select("g").distinct().count())
    each = max(1, min(GROUP_PIVOTS, PIVOTS // n_groups))
    order = W.partitionBy("g").orderBy(F.xxhash64("id", F.lit(7)), "id")
    chosen = x.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("g", "v").toPandas() if n_groups <= PIVOTS else pd.DataFrame({"g": [], "v": []})
    reach = float(np.arccos(np.clip(least, -1, 1))) + 1e-9
    pivots = spark.sparkContext.broadcast({g: apart(_unit(rows["v"]), reach) for g, rows in chosen.groupby("g")})

    def place(batches):
        for pdf in batches:
            for g, every in pdf.groupby("g"):
                for at in range(0, len(every), AT_ONCE):
                    rows = every.iloc[at : at + AT_ONCE]
                    u, ids = _unit(rows["v"]), rows["id"].to_numpy()
                    p = pivots.value.get(g)
                    angle = np.arccos(np.clip(u @ p.T, -1, 1)) if p is not None else np.zeros((len(u), 1))
                    own = angle.argmin(axis=1)
                    i, c = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + 2 * reach)
                    yield pd.DataFrame({"g": g, "cell": c, "id": ids[i], "angle": angle[i, c], "home": own[i] == c, "v": list(u[i])})

    placed = _stored(x.mapInPandas(place, "g long, cell int, id long, angle double, home boolean, v array<double>"))
    sizes = placed.groupBy("g", "cell").agg((F.floor(F.count_if("home") / SIDE) + 1).cast("int").alias("m"), (F.floor(F.count("*") / SIDE) + 1).cast("int").alias("n"))
    placed = placed.join(sizes, ["g", "cell"])
    mine, theirs = F.pmod(F.xxhash64("id", F.lit(1)), F.col("m")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("n")).cast("int")
    at_home = placed.where("home").select("g", "cell", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "id", "angle", "v")
    sent = placed.select("g", "cell", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), theirs.alias("j"), "id", "angle", "v")
    sent = sent.select(*[F.col(c).alias(f"to_{c}") for c in sent.columns])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "score": [], "compared": []})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values("to_angle")
        at, ids, va, vb = b["to_angle"].to_numpy(), b["to_id"].to_numpy(), np.stack(a["v"]), np.stack(b["to_v"])
        lo, hi = np.searchsorted(at, a["angle"] - reach), np.searchsorted(at, a["angle"] + reach, "right")
        found, compared = [], 0
        for k, (mine, s, e) in enumerate(zip(a["id"], lo, hi)):
            later = s + np.flatnonzero(ids[s:e] > mine)
            compared += len(later)
            score = vb[later] @ va[k]
            near = score >= least
            if near.any():
                found.append((np.full(near.sum(), mine), ids[later[near]], score[near]))
        mine, theirs, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        # the last row has the count only
        return pd.DataFrame({"a": _with_null(mine), "b": _with_null(theirs), "score": np.append(score, np.nan), "compared": np.append(np.zeros(len(mine), int), compared)})

    keys = ["g", "cell", "i", "j"]
    met = _stored(at_home.groupBy(keys).cogroup(sent.groupBy([f"to_{k}" for k in keys])).applyInPandas(meet, "a long, b long, score double, compared long"))
    n = x.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("possible"))
    return met.where("a IS NOT NULL").select("a", "b", "score"), met.agg(F.sum("compared").alias("compared")).crossJoin(n)  # one row each


def apart(p: np.ndarray, reach: float) -> np.ndarray:
    """The pivots, or the first only, where each vector would be sent to most cells: judged by the pivots, each against the others, that are a sample of the group."""
    if len(p) < 2:
        return p
    angle = np.arccos(np.clip(p @ p.T, -1, 1))
    np.fill_diagonal(angle, np.inf)
    sent = (angle <= angle.min(axis=1, keepdims=True) + 2 * reach).sum(axis=1).mean()
    return p if sent <= COPIES else p[:1]


def _with_null(x: np.ndarray) -> pd.arrays.IntegerArray:
    """The numbers and a null after them."""
    return pd.arrays.IntegerArray(np.append(x, 0).astype(np.int64), np.append(np.zeros(len(x), bool), True))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "vectors")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
