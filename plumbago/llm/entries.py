"""Queries over the synthetic tables, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, divergence, embeddings, lines, mixing, pieces, quality, rules, search, simhash, substrings, toxicity, urls
from .common import fresh, named, read, table, tune, with_text

#: The tokenizer file that the queries use; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


#: Both turns of the conversation that op13 adds.
PLANTED = r"\### Assistant: </turn> ok"

#: Target shares after the toxicity stage.
CLEAN = {"plain": 0.92, "low": 0.08}


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), 0.98)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the rows of documents and labels that aren't held out."""
    labels = read(spark, sf_dir, "labels").where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    return toxicity.fit(toxicity.labelled_rows(read(spark, sf_dir, "documents"), labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; a null id is never held out. Texts, nulls and repeated rows: see toxicity.score."""
    out = toxicity.score(read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir), keep=["doc_id"], threshold=0.7)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held)
    out = quality.classify(read(spark, sf_dir, "documents"), labels, threshold=0.3)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), PIECES)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cascade(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.rewrite(docs, **options)
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op6_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of repeated passages, as the pipeline's stage removes them."""
    return op6_line_dedup(spark, sf_dir, passages=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, budget=3)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed URLs: the canonical URLs of pages whose title has a run of three junk symbols."""
    pages = read(spark, sf_dir, "pages")
    junk = F.col("html").rlike(r"<title>[^<]*(###|\*\*\*|\$\$\$|%%%)")
    listed = pages.where(junk).select(urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("canonical"))
    return urls.judge(pages, listed, RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(read(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; rows of equal item_id are one item. The index is written first, over all documents; see search."""
    index = search.build(read(spark, sf_dir, "documents"))
    return search.ranked(index, read(spark, sf_dir, "benchmark"), 10)


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of documents by lang and source; see divergence.audit."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, logged as events, folded, rendered and read back; see chats.rendered for nulls and ties."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chats.read_back(chats.format_turns(turns.unionByName(planted)))


# -- stages of the pipeline: (spark, docs, sf_dir) -> rows with the columns of docs, but for the last


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the model of toxicity_model doesn't reject.

    Null and empty texts stay unless a text without words is rejected. Every
    row is judged on its own. Columns pass through, whatever their names; an
    empty table gives an empty one.
    """
    tune(spark)
    name = fresh(docs, "__judged")
    judged = with_text(docs, *toxicity.scorer(docs, toxicity_model(spark, sf_dir), 0.7), text="text", name=name)
    return judged.where(named(name)["predicted"] == 0).select(*map(named, docs.columns))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines of repeated passages, n_chars (if there) counted anew; see lines.rewrite."""
    return lines.deduplicate(docs, passages=True, length_col="n_chars")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more; see simhash.deduplicate."""
    return simhash.deduplicate(docs, words=5, budget=3, similarity=0.8)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies say; documents at rate 0 copies go.

    Rates are those of mixing.fit for these docs and the labels table, with the
    targets CLEAN, as toxic documents have been removed before. Columns
    pass through, whatever their names; an empty table gives an empty one.
    """
    mixture = mixing.fit(docs, read(spark, sf_dir, "labels"), CLEAN)
    name = fresh(docs, "__mixed")
    many = mixing.rated(docs, mixture, name).where(named(name)["copies"] > 0)
    again = fresh(many, "__copy")
    return many.select(*map(named, docs.columns), F.explode(F.array_repeat(F.lit(0), named(name)["copies"])).alias(again)).drop(again)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; see pieces.encode."""
    return pieces.encode(docs, PIECES)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]


def run_stages(spark: SparkSession, sf_dir: str, stages=STAGES) -> DataFrame:
    """The stages one after the other, from documents; each result but the last is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = table(docs)
    return docs


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_toxicity, op3_quality_classifier, op4_sentencepiece, op5_quality_rules,
        op6_line_dedup, op6_line_passages, op7_simhash, op8_url_filters, op9_substring_dedup, op10_mixing,
        op11_ranked_search, op12_divergence_audit, op13_chat_formatting,
    )
}

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
   AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.c, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM d, unnest(range(1, len(w) - 3)) AS t(i)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM again, unnest([0, 1, 2, 3, 4]) AS t(j) GROUP BY doc_id
), line AS (
  SELECT doc_id, l FROM d, unnest(string_split(text, chr(10))) AS t(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), lined AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup,
         sum((l LIKE '%...')::INT) AS dots FROM line GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lined.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lined.n, 0) AS n_lines, coalesce(lined.dots, 0) AS dots,
         len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[a-z]')) AS lower
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lined USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words)
       OR 10 * n_dup_lines > 3 * n_lines OR upper > lower OR 10 * dots > 3 * n_lines) AS kept
FROM judged
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i] AS line, ('0x' || substr(md5(l[i]), 1, 8))::BIGINT AS h FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
cut AS (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS ends FROM line),
part AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_no FROM cut),
chunk AS (SELECT doc_id, part_no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM part GROUP BY doc_id, part_no),
gone AS (
  SELECT doc_id, part_no FROM (SELECT doc_id, part_no, row_number() OVER (PARTITION BY body ORDER BY doc_id, part_no) AS k FROM chunk WHERE n > 1) WHERE k > 1
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM part p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.part_no = g.part_no GROUP BY p.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM part JOIN gone USING (doc_id, part_no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP6_PASSAGES = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i] AS line FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
pair AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] AS body FROM d, unnest(range(1, len(l))) AS t(i)),
traced AS (SELECT *, first_value(doc_id) OVER w AS src_doc, first_value(i) OVER w AS src_i FROM pair WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM traced, unnest([0, 1]) AS t(j)
  WHERE (src_doc <> doc_id OR src_i <> i) AND NOT (j = 0 AND src_doc = doc_id AND src_i = i - 1)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, (coalesce(len(d.l), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP8 = r"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical FROM p
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(html, '<title>[^<]*(###|\*\*\*|\$\$\$|%%%)')
), r(rule, said) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM c JOIN r
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.said, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical, listed.canonical IS NOT NULL AS listed
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed ON listed.canonical = c.canonical
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, unnest(range(0, 20)) AS t(j)),
word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), size AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d), total AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS words FROM size),
post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
item AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total
), score AS (
  SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words)))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN post USING (term) JOIN size USING (r), total GROUP BY item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score JOIN size USING (r) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, {_ASCII}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 3),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (
  SELECT * FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) USING (lang, source)
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, (1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(g.n, 0) + l.v))::HUGEINT AS p,
         (1 + (1000000000 * (k.n + 1)::HUGEINT) // (l.n + l.v))::HUGEINT AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM part)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_OP13 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</turn>|#')) - len(regexp_extract_all(text, '#+'))
    + length(role) + len(regexp_extract_all(role, '[\\:]|</turn>|#')) - len(regexp_extract_all(role, '#+')) + length('### : </turn>_') AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLE_SQL = {
    "op1_embedding_near_dedup": _OP1,
    "op5_quality_rules": _OP5,
    "op6_line_dedup": _OP6,
    "op6_line_passages": _OP6_PASSAGES,
    "op8_url_filters": _OP8,
    "op9_substring_dedup": _OP9,
    "op11_ranked_search": _OP11,
    "op12_divergence_audit": _OP12,
    "op13_chat_formatting": _OP13,
}
