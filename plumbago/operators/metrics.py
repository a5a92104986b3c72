"""Ranking, classification and text-overlap metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions.code import vectorised


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall, precision): share of queries with a relevant document in the first k, and the mean share of k that is relevant."""
    hit = relevant.withColumn("rel", F.lit(1))
    x = ranked.join(hit, ["q", "doc"], "left")
    n = relevant.select("q").distinct().agg(F.count("*").alias("n"))
    out = None
    for k in ks:
        per = x.where((F.col("rank") <= k) & (F.col("rel") == 1)).groupBy("q").agg(F.count("*").alias("hits"))
        row = per.agg(F.count("*").alias("found"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).crossJoin(n)  # single rows
        row = row.select(F.lit(k).alias("k"), F.round(F.col("found") / F.col("n"), 6).alias("recall"), F.round(F.col("hits") / (F.col("n") * k), 6).alias("precision"))
        out = row if out is None else out.union(row)
    return out


def ranking_precision(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q, lrap): mean over relevant documents of (rank among relevant) / rank, missing ones 0; ties share the last rank. Scores are rounded to 9 digits, as in top_k: sums in another order still tie."""
    by = W.partitionBy("q").orderBy(F.desc(F.round("score", 9))).rangeBetween(W.unboundedPreceding, 0)
    x = ranked.withColumn("r", F.count("*").over(by)).join(relevant.withColumn("rel", F.lit(1)), ["q", "doc"])
    x = x.withColumn("rr", F.count("*").over(by))
    found = x.groupBy("q").agg(F.sum(F.col("rr") / F.col("r")).alias("s"))
    n = relevant.groupBy("q").agg(F.count("*").alias("n"))
    return n.join(found, "q", "left").select("q", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n"), 6).alias("lrap"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    hit = (F.col(truth) == F.col(guess)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


def grams(words: Column, n: int) -> Column:
    """n-grams of an array, joined by spaces; none if it is shorter."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_overlap(pairs: DataFrame, n: int) -> DataFrame:
    """(id, n_match, n_pred, n_true): clipped n-gram matches of columns pred and true (word arrays)."""
    def counts(c: str) -> DataFrame:
        return pairs.select("id", F.explode(grams(F.col(c), n)).alias("g")).groupBy("id", "g").agg(F.count("*").alias(f"n_{c}"))

    m = counts("pred").join(counts("true"), ["id", "g"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.groupBy("id").agg(
        F.sum(F.least(zero("n_pred"), zero("n_true"))).alias("n_match"), F.sum(zero("n_pred")).alias("n_pred"), F.sum(zero("n_true")).alias("n_true")
    )


def corpus_bleu(pairs: DataFrame, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """One row (bleu): clipped precisions of the whole corpus, their weighted geometric mean, brevity penalty; times 100."""
    size = pairs.agg(F.sum(F.size("pred")).alias("lp"), F.sum(F.size("true")).alias("lt"))
    total, zero = F.lit(0.0), F.lit(False)
    for k, w in enumerate(weights, 1):
        if w:
            s = gram_overlap(pairs, k).agg(F.coalesce(F.sum("n_match"), F.lit(0)).alias(f"m{k}"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias(f"p{k}"))
            size = size.crossJoin(s)  # single rows
            zero = zero | (F.col(f"m{k}") == 0)
            total = total + w * F.log(F.when(F.col(f"m{k}") > 0, F.col(f"m{k}") / F.col(f"p{k}")).otherwise(1.0))
    brevity = F.when(F.col("lp") > F.col("lt"), 1.0).otherwise(F.exp(1 - F.col("lt") / F.col("lp")))
    return size.select(F.round(F.when(zero, 0.0).otherwise(100 * brevity * F.exp(total)), 4).alias("bleu"))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(id, p, r, f1) of n-gram overlap; 0 where there is none."""
    x = gram_overlap(pairs, n)
    p = F.when(F.col("n_pred") > 0, F.col("n_match") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("n_match") / F.col("n_true")).otherwise(0.0)
    f = F.when(F.col("n_match") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, p, r, f1) by the longest common subsequence."""
    from .sequences import lcs

    x = pairs.select("id", lcs(F.col("pred"), F.col("true")).alias("m"), F.size("pred").alias("a"), F.size("true").alias("b"))
    p, r = F.try_divide("m", "a"), F.try_divide("m", "b")
    f = F.when(F.col("m") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("id", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("p"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("r"), F.round(f, 6).alias("f1"))


WEIGHT = 1.2


@vectorised("double")
def weighted_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greatest sum of k ** WEIGHT over runs of k equal neighbours in a common subsequence, as ROUGE-W counts it."""
    def one(x, y):
        score, run = [0.0] * (len(y) + 1), [0] * (len(y) + 1)
        for u in x:
            new, now = [0.0], [0]
            for j, v in enumerate(y):
                k = run[j] + 1 if u == v else 0
                now.append(k)
                new.append(score[j] + k**WEIGHT - (k - 1) ** WEIGHT if k else max(score[j + 1], new[j]))
            score, run = new, now
        return score[-1]

    return pd.Series([one(list(x), list(y)) for x, y in zip(a, b)], dtype=float)


def rouge_w(pairs: DataFrame) -> DataFrame:
    """(id, p, r, f1) by the longest common subsequence that favours runs."""
    x = pairs.select("id", weighted_lcs("pred", "true").alias("m"), F.size("pred").alias("a"), F.size("true").alias("b"))
    share = lambda n: F.coalesce(F.pow(F.try_divide("m", F.pow(n, F.lit(WEIGHT))), F.lit(1 / WEIGHT)), F.lit(0.0))
    p, r = share(F.col("a")), share(F.col("b"))
    f = F.when(F.col("m") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("id", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


def set_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of the first sets' members that the second sets have, over all rows, in percent."""
    return df.agg(
        F.sum(F.size(F.array_intersect(a, b))).alias("common"), F.sum(F.size(F.array_distinct(a))).alias("total"),
        F.round(100.0 * F.sum(F.size(F.array_intersect(a, b))) / F.sum(F.size(F.array_distinct(a))), 6).alias("pct"),
    )
