"""Clustering and topic queries: checked by row counts and tests, as SQL can't say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.functions.text import tokens
from plumbago.operators import ml

from .registry import query, read


def words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tokens(F.col("text"), "[a-z]{3,}").alias("w"))


@query("ml1_phrase_clusters")
def clusters(spark, sf):
    return ml.phrase_clusters(words(spark, sf), "doc_id", "w")


@query("ml3_topics")
def topics(spark, sf):
    return ml.topics(words(spark, sf), "doc_id", "w")


@query("ml4_merge_tree")
def tree(spark, sf):
    e = read(spark, sf, "embeddings").where("label is not null")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = c.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return ml.merge_tree(c)


@query("ml8_prefix_batches", "SELECT conv_id, turn, i AS n, array_to_string(w[1:i], ' ') AS prefix, w[i + 1] AS target FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), unnest(range(1, len(w))) AS t(i)")
def batches(spark, sf):
    x = read(spark, sf, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    x = x.select("conv_id", "turn", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("n"))
    return x.select("conv_id", "turn", "n", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("prefix"), F.get("w", F.col("n")).alias("target"))
