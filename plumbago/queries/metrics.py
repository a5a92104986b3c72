"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.functions.text import tokens
from plumbago.operators import metrics as M

from .registry import query, read
from .retrieval import BM25, bm25_top, relevant

REL = ", rel AS (SELECT item_id AS q, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)) "


@query("met1_met3_recall_at_k", BM25 + REL + """, h AS (SELECT k, q, count(*) AS hits FROM top JOIN rel USING (q, doc), unnest([1, 5, 10]) AS t(k) WHERE rank <= k GROUP BY k, q)
SELECT k, round(count(h.q) / (SELECT count(DISTINCT q) FROM rel), 6) AS recall, round(coalesce(sum(hits), 0) / ((SELECT count(DISTINCT q) FROM rel) * k), 6) AS precision FROM h GROUP BY k""")
def met1(spark, sf):
    return M.recall_at(bm25_top(spark, sf, 10), relevant(spark, sf), [1, 5, 10])


@query("met2_ranking_precision", BM25 + REL + """, c AS (SELECT q, doc, score, count(*) OVER (PARTITION BY q ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS r FROM top WHERE rank <= 50),
j AS (SELECT c.*, count(*) OVER (PARTITION BY q ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS rr FROM c JOIN rel USING (q, doc)), z AS (SELECT q, sum(rr / r) AS z FROM j GROUP BY q)
SELECT q, round(coalesce(z, 0) / n, 6) AS lrap FROM (SELECT q, count(*) AS n FROM rel GROUP BY q) LEFT JOIN z USING (q)""")
def met2(spark, sf):
    ranked = bm25_top(spark, sf, 50).withColumn("score", F.col("score"))
    return M.ranking_precision(ranked, relevant(spark, sf))


@query("met5_confusion", "SELECT quality AS truth, toxic AS guess, count(*) AS n FROM labels GROUP BY quality, toxic")
def met5(spark, sf):
    return M.confusion(read(spark, sf, "labels"), "quality", "toxic")


@query("met4_accuracy", "SELECT lang, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def met4(spark, sf):
    x = read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id")
    return M.accuracy(x, "quality", "toxic", "lang")


@query("met11_tag_accuracy", "SELECT count(*) AS n, round(avg((CASE WHEN role = 'system' THEN 'user' ELSE role END = 'user')::INT), 6) AS accuracy FROM conversations")
def met11(spark, sf):
    x = read(spark, sf, "conversations").select(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("truth"), F.lit("user").alias("guess"))
    return M.accuracy(x, "truth", "guess")


PAIRS = """WITH x AS (SELECT a.conv_id AS id, regexp_extract_all(lower(a.text), '[a-z]+'){n} AS pred, regexp_extract_all(lower(b.text), '[a-z]+'){n} AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 1 AND b.turn = 0) """


def answers(spark, sf, n=None):
    """Answers and what they answer, as words; the first n of them where the metric has such a limit."""
    w = tokens(F.col("text"))
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", (w if n is None else F.slice(w, 1, n)).alias("w"))
    return c.where("turn = 1").select("id", F.col("w").alias("pred")).join(c.where("turn = 0").select("id", F.col("w").alias("true")), "id")


def _gram_sql(n):
    def g(c):
        return f"(SELECT id, array_to_string({c}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM x, unnest(range(1, len({c}) - {n - 2})) AS t(i) GROUP BY id, g)"

    return f"(SELECT id, sum(least(coalesce(p.n, 0), coalesce(r.n, 0)))::DOUBLE AS m, sum(coalesce(p.n, 0))::DOUBLE AS np, sum(coalesce(r.n, 0))::DOUBLE AS nt FROM {g('pred')} p FULL JOIN {g('ref')} r USING (id, g) GROUP BY id)"


#: The metric's own limit of words.
ROUGE_WORDS = 100


def _on_grams(k):
    sql = PAIRS.format(n="[1:100]") + f"SELECT id, round(CASE WHEN np > 0 THEN m / np ELSE 0 END, 6) AS p, round(CASE WHEN nt > 0 THEN m / nt ELSE 0 END, 6) AS r, round(CASE WHEN m > 0 THEN 2 * (m / np) * (m / nt) / (m / np + m / nt) ELSE 0 END, 6) AS f1 FROM {_gram_sql(k)}"

    @query(f"met8_rouge_{k}", sql)
    def q(spark, sf):
        return M.rouge_n(answers(spark, sf, ROUGE_WORDS), k)


for _k in (1, 2, 3, 4):
    _on_grams(_k)


@query("met8_rouge_l")
def met8_l(spark, sf):
    return M.rouge_l(answers(spark, sf, ROUGE_WORDS))


@query("met8_rouge_w")
def met8_w(spark, sf):
    return M.rouge_w(answers(spark, sf, ROUGE_WORDS))


def _bleu_sql(weights, n=""):
    used = [(k, w) for k, w in enumerate(weights, 1) if w]
    sums = ", ".join(f"(SELECT sum(m) FROM {_gram_sql(k)}) AS m{k}, (SELECT sum(np) FROM {_gram_sql(k)}) AS p{k}" for k, _ in used)
    logs = " + ".join(f"{w} * ln(m{k} / p{k})" for k, w in used)
    zero = " OR ".join(f"m{k} = 0" for k, _ in used)
    return PAIRS.format(n=n) + f", s AS (SELECT sum(len(pred))::DOUBLE AS lp, sum(len(ref))::DOUBLE AS lt, {sums} FROM x) SELECT round(CASE WHEN {zero} THEN 0 ELSE 100 * CASE WHEN lp > lt THEN 1 ELSE exp(1 - lt / lp) END * exp({logs}) END, 4) AS bleu FROM s"


@query("met6_corpus_bleu", _bleu_sql((0.5, 0.5, 0, 0), "[1:100]"))
def met6(spark, sf):
    return M.corpus_bleu(answers(spark, sf, 100), (0.5, 0.5, 0, 0))


def _on_order(k):
    weights = tuple(float(j == k) for j in (1, 2, 3, 4))

    @query(f"met7_bleu_b{k}", _bleu_sql(weights))
    def q(spark, sf):
        return M.corpus_bleu(answers(spark, sf), weights)


for _k in (1, 2, 3, 4):
    _on_order(_k)


@query("met9_set4_overlap", PAIRS.format(n="") + "SELECT sum(len(list_intersect(pred, ref)))::BIGINT AS common, sum(len(list_distinct(pred)))::BIGINT AS total, round(100.0 * sum(len(list_intersect(pred, ref))) / sum(len(list_distinct(pred))), 6) AS pct FROM x")
def met9(spark, sf):
    return M.set_overlap(answers(spark, sf), "pred", "true")


@query("met10_level_agreement", "SELECT count(*) AS n, sum((a.role = b.role)::INT)::BIGINT AS agree FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def met10(spark, sf):
    c = read(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    return c.join(nxt, ["conv_id", "turn"]).agg(F.count("*").alias("n"), F.count_if(F.col("role") == F.col("before")).alias("agree"))
