"""Lexical and vector retrieval, fused rankings, and relevance tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.runtime import scratch, ship, shuffles_dropped

from .vectors import block_tops, pairs_in_range

#: Rows of an Arrow batch of texts, and queries whose scores for a batch are held at once.
BATCH, ASKED = 1000, 256
#: Slack of comparisons of scores.
SLACK = 1e-9


def postings(docs: DataFrame, doc_id: str, tokens, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf, dl): an inverted index as rows; of the distinct `terms` (term) only, where given: the others are left out before any shuffle."""
    x = docs.select(F.col(doc_id).alias("doc"), tokens.alias("t")).select("doc", F.size("t").alias("dl"), F.explode("t").alias("term"))
    if terms is not None:
        x = x.join(terms, "term", "left_semi")
    return x.groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """(q, doc, score): sum over distinct query terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), idf = ln(N / df).

    index: postings; stats: one row (n_docs, avgdl); queries: (q, term), distinct.
    Give postings the query terms, so that only they are shuffled: by document, once. The queries' terms, a stated
    set, go to all executors, so a document's scores are summed where its postings are, and pairs of a query and a document are
    not shuffled (top_k then takes each task's best first).
    """
    # reads tf, so that both uses of the index have one exchange
    df = index.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    wanted = queries.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    wanted = wanted.select("q", "term", F.log(F.col("n_docs") / F.col("df")).alias("idf"), "avgdl")
    hit = index.repartition("doc").join(F.broadcast(wanted), "term")
    score = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("q", "doc").agg(F.sum(score).alias("score"))


def bm25_search(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, k: int, pattern: str, k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """(q, doc, score, rank): bm25's k best documents, without an index: the lower-cased texts' matches of `pattern` are read once.

    queries: (q, term), distinct, a stated set that goes to all executors. Texts are not shuffled: a first pass keeps each document's
    length and counts of the queries' terms, a second one adds up a batch of documents for all queries and keeps a task's k best.
    Rows of one id are one document only in postings and bm25, which serve where ids repeat or are no numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    asked = queries.where("q IS NOT NULL AND term IS NOT NULL").orderBy("q", "term").collect()
    terms = {t: i for i, t in enumerate(sorted({r.term for r in asked}), 1)}
    shared, find = spark.sparkContext.broadcast(terms), re.compile(pattern)

    def counted(batches):
        known = shared.value.get
        for batch in batches:
            sizes, ends, ids, tfs = [], [0], [], []
            for t in batch.column(1).to_pylist():
                words = [] if t is None else find.findall(t.lower())
                n = Counter(filter(None, map(known, words)))
                sizes.append(None if t is None else len(words))
                ids += n.keys()
                tfs += n.values()
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], ["doc", "dl", "ids", "tfs"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    path = scratch(spark, "counts")
    docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(counted, f"doc {kind}, dl int, ids array<int>, tfs array<int>").write.parquet(path)
    rows = spark.read.schema(f"doc {kind}, dl int, ids array<int>, tfs array<int>").parquet(path)
    with shuffles_dropped(spark):
        total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        again = kind not in ("tinyint", "smallint", "int", "bigint") or rows.groupBy("doc").count().where("doc IS NULL OR count > 1").head(1)
    if again:
        words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
        stats = spark.createDataFrame([(total.n, total.avgdl)], "n_docs long, avgdl double")
        return top_k(bm25(postings(docs, doc_id, words, queries.select("term").distinct()), stats, queries, k1, b), k)
    df = np.zeros(len(terms) + 1)
    for r in rows.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # the queries' terms
        df[r["id"]] = r["count"]
    idf = np.log(total.n / np.maximum(df, 1))
    names = sorted({r.q for r in asked})
    place = {q: i for i, q in enumerate(names)}
    of, term = (np.array(x, np.int64) for x in zip(*[(place[r.q], terms[r.term]) for r in asked])) if asked else (np.zeros(0, np.int64),) * 2
    given = spark.sparkContext.broadcast((of, term, idf))
    n_q, avgdl = len(names), total.avgdl or 1.0

    def scored(batches):
        of, term, idf = given.value
        # a term that all documents have adds nothing, but makes a pair of its own
        everywhere = bool((idf[term] <= 0).any())
        least, kept = np.full(n_q, -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            doc, dl = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            row = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
            ids, tfs = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(float)
            if not len(ids):
                continue
            here, at = np.unique(ids, return_inverse=True)
            weight = np.zeros((len(doc), len(here)))
            weight[row, at] = idf[ids] * tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * dl[row] / avgdl))
            column = np.full(len(idf), -1)
            column[here] = np.arange(len(here))
            for first in range(0, n_q, ASKED):
                mine = slice(*np.searchsorted(of, [first, first + ASKED]))
                some = column[term[mine]] >= 0
                wanted = np.zeros((len(here), min(ASKED, n_q - first)))
                wanted[column[term[mine]][some], of[mine][some] - first] = 1
                score = weight @ wanted
                met = (score > 0) if not everywhere else _marked(weight.shape, row, at) @ wanted > 0
                d, q = np.nonzero(met & (score >= least[first : first + wanted.shape[1]] - SLACK))
                kept.append((q + first, doc[d].astype(np.int64), score[d, q]))
            if sum(len(x[0]) for x in kept) > 2 * k * n_q:
                kept = [_best(kept, k)]
                n = np.bincount(kept[0][0], minlength=n_q)
                last = np.cumsum(n) - 1
                least[n >= k] = kept[0][2][last[n >= k]]
        q, doc, score = _best(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc), pa.array(score)], ["at", "doc", "score"])

    found = top_k(rows.mapInArrow(scored, "at long, doc long, score double"), k, "at")
    asked_ids = spark.createDataFrame(list(enumerate(names)), f"at long, q {queries.schema['q'].dataType.simpleString()}")
    return found.join(F.broadcast(asked_ids), "at").select("q", F.col("doc").cast(kind).alias("doc"), "score", "rank")


def _marked(shape: tuple[int, int], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(shape)
    out[row, at] = 1
    return out


def _best(kept: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query's place, doc, score), by place, then best first; ties as in top_k."""
    q, doc, score = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((doc, -np.round(score, 9), q))
    q, doc, score = q[order], doc[order], score[order]
    n = np.bincount(q)
    some = np.arange(len(q)) - (np.cumsum(n) - n)[q] < k
    return q[some], doc[some], score[some]


def corpus_statistics(docs: DataFrame, tokens) -> DataFrame:
    return docs.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def top_k(scored: DataFrame, k: int, q: str = "q", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best rows of each query, with their rank; ties by the least id. Scores are rounded to 9 digits to rank alike on any engine."""
    by = W.partitionBy(q).orderBy(F.desc(F.round(score, 9)), tie)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Rankings (q, doc, score) fused by adding scores; one that lacks a document adds nothing."""
    both = lists[0].select("q", "doc", "score")
    for x in lists[1:]:
        both = both.unionByName(x.select("q", "doc", "score"))
    return top_k(both.groupBy("q", "doc").agg(F.sum("score").alias("score"), F.count("*").alias("n_lists")), k)


def vector_top_k(queries: DataFrame, docs: DataFrame, k: int, id_col: str, vec_col: str, *, exclude_self: bool = False) -> DataFrame:
    """(q, doc, score, rank): exact top k by cosine.

    A stated query set meets all rows in blocks of both, and the blocks' tops are ranked together; see vectors.block_tops.
    """
    q = queries.select(F.col(id_col).alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
    d = docs.select(F.col(id_col).alias("doc"), F.col(vec_col).cast("array<double>").alias("v"))
    return top_k(block_tops(q, d, k, exclude_self), k)


def similar_in_group(df: DataFrame, group: str, id_col: str, vec_col: str, threshold: float) -> DataFrame:
    """(a, b, score), a < b: pairs of one group with cosine at least a threshold; see vectors.pairs_in_range."""
    return pairs_in_range(df, group, id_col, vec_col, threshold)[0]


def shifted_negatives(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    """(positive, negative): each row with its neighbour in a seeded hash order, bucket by bucket; never itself."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    x = df.select(F.col(id_col).alias("positive"), key.alias("k"), F.substring(key, 1, 2).alias("bucket"))
    by = W.partitionBy("bucket").orderBy("k", "positive")
    first = F.first("positive").over(by)
    return x.withColumn("negative", F.coalesce(F.lead("positive").over(by), first)).where("negative <> positive").select("positive", "negative")


def relevance(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, doc): documents that contain a query's text.

    queries: (q, text), a stated set that goes to all executors; docs: (doc, text). Each text is read once, and no text is shuffled: the
    queries that it may contain are those one of whose inner words (its first and last may be parts of
    words in a document) is among the text's words, and they are looked for byte by byte. Queries of under three
    words are looked for in all texts.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    asked = queries.where("q IS NOT NULL AND text IS NOT NULL").select("q", "text").collect()
    texts = [r.text.encode() for r in asked]
    inner = [t.split()[1:-1] for t in texts]
    common = Counter(w for x in inner for w in set(x))
    by_word: dict[bytes, list[int]] = {}
    for i, x in enumerate(inner):
        # the word that fewest queries have, of these the longest
        by_word.setdefault(min(x, key=lambda w: (common[w], -len(w), w)) if x else b"", []).append(i)
    shared = spark.sparkContext.broadcast((texts, by_word))

    def run(column: pa.Array) -> pa.Array:
        texts, by_word = shared.value
        out = []
        for t in column.cast(pa.binary()).to_pylist():
            if t is None:
                out.append(None)
                continue
            may = [i for w in by_word.keys() & {*t.split(), b""} for i in by_word[w]]
            out.append([i for i in may if texts[i] in t] or None)
        return pa.array(out, pa.list_(pa.int32()))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    found = docs.select("doc", F.explode(F.arrow_udf(run, "array<int>")("text")).alias("at"))
    ids = spark.createDataFrame([(i, r.q) for i, r in enumerate(asked)], f"at int, q {queries.schema['q'].dataType.simpleString()}")
    return found.join(F.broadcast(ids), "at").select("q", "doc")
