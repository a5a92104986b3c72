"""Counts, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def shares(df: DataFrame, *by: str, within: list[str] | None = None) -> DataFrame:
    """Counts with their share of the total (of each `within` group)."""
    n = value_counts(df, *by)
    over = W.partitionBy(*within) if within else None
    if over is None:
        total = n.agg(F.sum("n").alias("__total"))
        return n.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("__total"), 6)).drop("__total")  # one row
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(over), 6))


def without_everywhere(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts by group and value, less the values that all groups have."""
    n = value_counts(df, group, value)
    groups = n.select(group).distinct().agg(F.count("*").alias("all"))
    common = n.groupBy(value).agg(F.count("*").alias("k")).crossJoin(F.broadcast(groups)).where("k = all").select(value)
    return n.join(common, value, "left_anti")


def vocabulary(words: DataFrame, word: str, first: str, size: int) -> DataFrame:
    """(word, n, id): the size - 2 most frequent words by frequency, then first place; ids from 1."""
    n = words.groupBy(word).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    top = n.orderBy(F.desc("n"), "first", word).limit(size - 2)
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "first", word))).drop("first")  # at most size rows


def turn_statistics(turns: DataFrame, dialog: str, turn: str, speaker: str, text: str) -> DataFrame:
    """Turn changes and utterance lengths (words) of each dialogue."""
    by = W.partitionBy(dialog).orderBy(turn)
    x = turns.withColumn("__change", (F.col(speaker) != F.lag(speaker).over(by)).cast("int"))
    n = F.size(F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != ""))
    x = x.withColumn("__n", n)
    return x.groupBy(dialog).agg(
        F.count("*").alias("n_turns"), F.coalesce(F.sum("__change"), F.lit(0)).alias("changes"), F.countDistinct(speaker).alias("n_speakers"),
        F.round(F.avg("__n"), 6).alias("mean_words"), F.round(F.stddev_pop("__n"), 6).alias("sd_words"), F.round(F.median("__n"), 6).alias("median_words"),
        F.min("__n").alias("min_words"), F.max("__n").alias("max_words"),
    )


def best_by(df: DataFrame, key: str, value: str, score: Column, seq: Column) -> DataFrame:
    """The value of each key with the greatest score; of equal ones the first."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(score, -seq)).alias(value), F.max(score).alias("best"))


def majority(df: DataFrame, key: str, label: str, rank: str, least: int | None = None, unknown: str = "U") -> DataFrame:
    """Most frequent label of each key, the earliest on ties; `unknown` if it has fewer than `least` votes."""
    n = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(rank).alias("first"))
    best = n.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"), F.max("n").alias("votes"))
    if least is None:
        return best
    return best.withColumn("label", F.when(F.col("votes") < least, F.lit(unknown)).otherwise(F.col("label").cast("string")))


def running_accuracy(df: DataFrame, hit: Column, weight: Column) -> DataFrame:
    return df.agg(F.round(F.sum(hit.cast("double") * weight) / F.sum(weight), 6).alias("accuracy"), F.count("*").alias("n"))


def stratified(df: DataFrame, stratum: str, key: Column, n: int) -> DataFrame:
    """At most n rows of each stratum, the first by a seeded hash."""
    by = W.partitionBy(stratum).orderBy(key)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def seeded(row_id: Column, seed: str) -> Column:
    """A hash that both engines have: order by it to sample with a seed."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(seed)))


def split_of(row_id: Column, seed: str, test_share_of_16: int) -> Column:
    """`test` for so many sixteenths of the ids, else `train`."""
    return F.when(F.substring(seeded(row_id, seed), 1, 1) < F.lit(f"{test_share_of_16:x}"), "test").otherwise("train")
