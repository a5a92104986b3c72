"""Quality classifier: random Fourier features over document statistics.

Statistics of each text's shape are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel. Normal equations are summed in
each partition, added up pairwise in Spark, and solved as a ridge regression on
the driver (one small square matrix). Scores are calibrated by isotonic
regression over a histogram that Spark sums.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop, named, per_text, schema_with, table, tune

STATS = [
    "log_words", "word_bytes", "symbols", "upper", "digits", "beyond_ascii", "breaks", "punctuation",
    "distinct", "top_word", "repeated_lines", "longest_word", "pairs_distinct",
]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for name, members in ((1, b"#*$%&|<>@^~=_{}[]\\"), (2, bytes(range(65, 91))), (3, bytes(range(48, 58))), (5, b"\n"), (6, b".,;:!?'\"-()")):
        kind[list(members)] = name
    kind[128:] = 4
    return kind


KIND = _classes()


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS a text; a text without words has zeros."""
    w = Words(texts)
    n = w.counts.astype(float)
    some = np.maximum(n, 1)
    out = np.zeros((len(texts), len(STATS)))
    out[:, 0] = np.log1p(n)
    length = w.ends - w.starts
    size = np.bincount(w.text, weights=length, minlength=len(texts))
    out[:, 1] = size / some
    kinds = KIND[w.data]
    bounds = np.append(w.text_starts, len(w.data))
    for k, col, per in ((1, 2, some), (5, 6, some), (6, 7, some), (2, 3, size), (3, 4, size), (4, 5, size)):
        out[:, col] = np.diff(np.searchsorted(np.flatnonzero(kinds == k), bounds)) / np.maximum(per, 1)
    for i, (a, b) in enumerate(zip(w.first, w.last)):
        if b > a:
            _, c = np.unique(w.hash[a:b], return_counts=True)
            out[i, 8], out[i, 9] = len(c) / (b - a), c.max() / (b - a)
            out[i, 11] = np.log1p(length[a:b].max())
            out[i, 12] = len(np.unique(w.hash[a : b - 1] * np.uint64(3) + w.hash[a + 1 : b])) / max(1, b - a - 1)
        lines = [x for x in texts[i].split(b"\n") if x.strip()]
        out[i, 10] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    out[n == 0] = 0
    return out


def with_statistics(df: DataFrame, *, text_col: str = "text", keep: list[str], more=None) -> DataFrame:
    """`keep`, n_words, x (array of STATS, and one number more if `more(texts)` is given) for each row."""
    def run(texts):
        x = statistics(texts)
        n = np.rint(np.expm1(x[:, 0])).astype(np.int64)
        if more is not None:
            x = np.concatenate([x, more(texts)[:, None]], axis=1)
        return {"n_words": n, "x": list(x)}

    tune(df.sparkSession)
    return per_text(df, run, "n_words long, x array<double>", text=text_col, keep=keep)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None  # (features + 1) x targets
    knots: np.ndarray | None = None  # raw score, calibrated score

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        f = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x)[:, 0], self.knots[0], self.knots[1]), 0.0, 1.0)


def fit(rows: DataFrame, n_targets: int, *, n_features: int = 160, width: float = 0.25, ridge: float = 1e-3, seed: int = 5) -> Model | None:
    """Ridge on random Fourier features; rows: x array, y array of n_targets doubles. None without rows."""
    size = len(rows.select("x").first()[0]) if rows.head(1) else 0
    if not size:
        return None
    stats = rows.agg(*[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{k}"] for k in range(size)])
    spread = np.array([stats[f"s{k}"] for k in range(size)])
    spread[~(spread > 1e-12)] = 1.0
    rng = np.random.default_rng(seed)
    model = Model(mean, spread, rng.normal(0.0, width, (size, n_features)), rng.uniform(0, 2 * np.pi, n_features))

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                z, y = model.features(np.stack(pdf["x"])), np.stack(pdf["y"])
                add = np.concatenate([z.T @ z, z.T @ y], axis=1)
                total = add if total is None else total + add
        if total is not None:
            yield pd.DataFrame({"sums": [pickle.dumps((len(total), total))]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(pickle.loads(b)[1] for b in pdf["sums"])
        return pd.DataFrame({"sums": [pickle.dumps((len(total), total))]})

    sums = rows.select("x", "y").mapInPandas(partial, "sums binary").withColumn("part", F.spark_partition_id())
    for groups in (4096, 64, 1):  # a tree of sums: no task holds more than some of the matrices
        sums = sums.groupBy(F.pmod("part", F.lit(groups)).alias("part")).applyInPandas(lambda k, pdf: added(pdf).assign(part=int(k[0])), "sums binary, part int")
    total = pickle.loads(sums.first()["sums"])[1]
    a, b = total[:, :-n_targets], total[:, -n_targets:]
    n = a[-1, -1]
    model.weights = np.linalg.solve(a + ridge * n / n_features * np.eye(len(a)), b)
    return model


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray, ends: bool = False) -> np.ndarray:
    """Pool adjacent violators over bins in ascending x: (x, value) knots that never fall.

    A block's knot is its mean x; with `ends`, a block has knots at its first and last x.
    """
    blocks: list[list[float]] = []
    for p, m, o in zip(x, n, ones):
        blocks.append([m, o, p * m, p, p])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            first = blocks[-1]
            blocks[-1] = [first[0] + last[0], first[1] + last[1], first[2] + last[2], first[3], last[4]]
    if ends:
        return np.array([[p for *_, a, b in blocks for p in (a, b)], [o / m for m, o, *_ in blocks for _ in (0, 1)]])
    return np.array([[c / m for m, _, c, *_ in blocks], [o / m for m, o, *_ in blocks]])


def calibrate(rows: DataFrame, model: Model, bins: int = 1001) -> Model:
    """Isotonic calibration of the first target over a histogram of raw scores (at most `bins` rows reach the driver)."""
    def run(batches):
        for pdf in batches:
            raw = np.clip(model.raw(np.stack(pdf["x"]))[:, 0], -0.5, 1.5) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"bin": np.rint((raw + 0.5) / 2 * (bins - 1)).astype(int), "one": [float(y[0]) for y in pdf["y"]]})

    got = rows.select("x", "y").mapInPandas(run, "bin int, one double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("one").alias("ones")).toPandas().sort_values("bin")
    model.knots = isotonic(got["bin"].to_numpy() / (bins - 1) * 2 - 0.5, got["n"].to_numpy(float), got["ones"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model | None, *, keep: list[str], threshold: float) -> DataFrame:
    """`keep`, score, predicted for each row of a table with x. Without a model every score is 0."""
    schema = schema_with(stats, keep, "score double, predicted int")
    if model is None:
        return stats.select(*keep, F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"))

    def run(batches):
        for pdf in batches:
            s = model.calibrated(np.stack(pdf["x"])) if len(pdf) else np.zeros(0)
            yield pdf[keep].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return stats.select(*keep, "x").mapInPandas(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (score >= threshold).

    `labels` (id, 0 or 1) are the rows to learn from, all of them; other values
    and nulls are left out, and of several labels of one id the greatest holds.
    A null or empty text has all statistics zero and gets that point's score.
    Repeated rows and null ids are scored on their own; texts are read whole.
    Empty tables: an empty result, or score 0 where nothing can be learnt.
    Every fourth labelled row by its id's hash serves the calibration only (all
    rows serve for both where a part would be empty).
    """
    stats = table(with_statistics(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), keep=["id"]))
    one = labels.where(named(id_col).isNotNull() & named(label_col).isin(0, 1)).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).cast("double").alias("one"))
    train = table(stats.join(one, "id").select("x", F.array("one").alias("y"), (F.pmod(F.xxhash64("id", F.lit(29)), F.lit(4)) == 0).alias("later")))
    parts = {r.later for r in train.select("later").distinct().collect()}
    model = fit(train.where("NOT later") if len(parts) == 2 else train, 1)
    if model is not None:
        calibrate(train.where("later") if len(parts) == 2 else train, model)
    drop(train)
    return score(stats, model, keep=["id"], threshold=threshold).withColumnRenamed("id", id_col)
