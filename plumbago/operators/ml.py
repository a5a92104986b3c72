"""Clusters and topics with Spark's ML library."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.runtime import scratch


def phrase_clusters(docs: DataFrame, doc_id: str, words: str, k: int = 8, seed: int = 7, vocabulary: int = 4096) -> DataFrame:
    """(id, cluster): k-means on length-one word counts."""
    counted = CountVectorizer(inputCol=words, outputCol="__counts", vocabSize=vocabulary, minDF=2).fit(docs).transform(docs)
    unit = Normalizer(inputCol="__counts", outputCol="__unit").transform(counted)
    return KMeans(featuresCol="__unit", predictionCol="cluster", k=k, seed=seed).fit(unit).transform(unit).select(doc_id, "cluster")


def topics(docs: DataFrame, doc_id: str, words: str, k: int = 10, seed: int = 7, vocabulary: int = 2048, steps: int = 5) -> DataFrame:
    """(id, topic, weight): the strongest topic of each document."""
    counted = CountVectorizer(inputCol=words, outputCol="features", vocabSize=vocabulary, minDF=2).fit(docs).transform(docs)
    model = LDA(k=k, seed=seed, maxIter=steps, optimizer="online").fit(counted)
    from pyspark.ml.functions import vector_to_array

    p = model.transform(counted).withColumn("__p", vector_to_array("topicDistribution"))
    weight = F.array_max("__p")
    return p.select(doc_id, (F.array_position("__p", weight) - 1).alias("topic"), F.round(weight, 6).alias("weight"))


def vector_clusters(df: DataFrame, id_col: str, vec_col: str, k: int = 10, seed: int = 7) -> DataFrame:
    v = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(v).transform(v).select(id_col, "cluster")


def merge_tree(centres: DataFrame) -> DataFrame:
    """(step, a, b, height, size, leaves): Ward's merges of a bounded set of centres, lowest first; centres: id (long), v.

    Leaves keep their ids; the merge of step k is node -1 - k. Each round merges all clusters that are each other's nearest
    (Ward's distance is reducible, so that the tree is the greedy one), at equal distance by the lesser ids. The distances to merged clusters follow from those to
    their parts by the Lance-Williams rule, in joins, first for one side of the table of distances, then the other. The table
    has the square of the centres' number of rows: give it the outcome of a clustering. Ids must be distinct.
    """
    spark = centres.sparkSession
    c = _stored(centres.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    a, b = c.select(F.col("id").alias("x"), F.col("v").alias("p")), c.select(F.col("id").alias("y"), F.col("v").alias("q"))
    square = F.aggregate(F.zip_with("p", "q", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t)
    far = _stored(a.join(b, F.col("x") != F.col("y")).select("x", "y", square.alias("d")))
    sizes, of = _stored(c.select("id", F.lit(1).cast("long").alias("n"))), _stored(c.select(F.col("id").alias("leaf"), "id"))
    merges, made = None, 0
    while not far.isEmpty():
        near = far.groupBy("x").agg(F.min(F.struct(F.round("d", 12).alias("d"), F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))).alias("m")).select("x", "m.*")
        mutual = near.groupBy("lo", "hi").agg(F.count("*").alias("k"), F.min("d").alias("d")).where("k = 2")
        now = mutual.join(sizes.select(F.col("id").alias("lo"), F.col("n").alias("ni")), "lo").join(sizes.select(F.col("id").alias("hi"), F.col("n").alias("nj")), "hi")
        # provisional numbers of merged clusters: below all leaves' and earlier ones
        number = F.row_number().over(W.orderBy("d", "lo")) + made
        now = _stored(now.select("lo", "hi", "d", "ni", "nj", (-number).cast("long").alias("new")))
        parts = _stored(now.select(F.col("lo").alias("id"), "new", "d", (F.col("ni") + F.col("nj")).alias("both")).union(now.select("hi", "new", "d", F.col("ni") + F.col("nj"))))
        of = _stored(of.join(parts.select("id", "new"), "id", "left").select("leaf", F.coalesce("new", "id").alias("id")))
        leaves = of.groupBy(F.col("id").alias("new")).agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
        done = _stored(now.join(leaves, "new").select("new", "lo", "hi", F.sqrt("d").alias("height"), (F.col("ni") + F.col("nj")).alias("size"), "leaves"))
        merges, made = done if merges is None else merges.union(done), made + now.count()
        far = _stored(_merged(far, parts, sizes))
        sizes = _stored(sizes.union(parts.select("new", "both").distinct()))
        far = _stored(_merged(far.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"), parts, sizes))
    if merges is None:
        return spark.createDataFrame([], "step int, a long, b long, height double, size long, leaves array<long>")
    # numbers by height; a merge is never lower than those it is made of
    order = merges.select("new", (F.row_number().over(W.orderBy("height", F.desc("new"))) - 1).alias("step"))
    name = lambda side: order.select(F.col("new").alias(side), (-1 - F.col("step")).cast("long").alias(f"{side}_node"))
    out = merges.join(order, "new").join(name("lo"), "lo", "left").join(name("hi"), "hi", "left")
    p, q = F.coalesce("lo_node", "lo"), F.coalesce("hi_node", "hi")
    return out.select("step", F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.round("height", 6).alias("height"), "size", "leaves")


def _merged(far: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distances (x, y, d) after merges on the side of x; sizes has those of clusters before on that side, and of y as they are."""
    x = far.join(parts.select(F.col("id").alias("x"), "new", F.col("d").alias("within"), "both"), "x", "left")
    kept = x.where("new IS NULL").select("x", "y", "d")
    own, other = sizes.select(F.col("id").alias("x"), F.col("n").alias("nx")), sizes.select(F.col("id").alias("y"), F.col("n").alias("ny"))
    mates = parts.select(F.col("id").alias("y"), F.col("new").alias("yn"))
    moved = x.where("new IS NOT NULL").join(mates, "y", "left").where("yn IS NULL OR yn <> new").join(own, "x").join(other, "y")
    sums = moved.groupBy("new", "y").agg(F.sum((F.col("nx") + F.col("ny")) * F.col("d")).alias("s"), F.first("within").alias("w"), F.first("ny").alias("ny"), F.first("both").alias("both"))
    return kept.union(sums.select("new", "y", (F.col("s") - F.col("ny") * F.col("w")) / (F.col("both") + F.col("ny"))))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
