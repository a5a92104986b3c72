"""Sequence, hierarchy and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.operators import aggregates as A
from plumbago.operators import hierarchy as H
from plumbago.operators import sequences as S

from .cells import WITH, cells
from plumbago.operators.cells import squeezed

from .derived import MARKDOWN_SQL, markdown_cells
from .registry import query, read

PAIRS = "WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), n AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b) "


@query("seq1_bigrams", PAIRS + "SELECT a, b, n FROM n")
def seq1(spark, sf):
    return S.bigrams(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("seq2_transitions", PAIRS + "SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM n")
def seq2(spark, sf):
    return S.transitions(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("seq2_likely_walk", PAIRS.replace("WITH", "WITH RECURSIVE", 1) + """, best AS (SELECT a, b FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
walk(step, symbol) AS (SELECT 0, 'view' UNION ALL SELECT step + 1, b FROM walk JOIN best ON a = symbol WHERE step < 8) SELECT step, symbol FROM walk""")
def seq2_walk(spark, sf):
    return S.likely_walk(S.transitions(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type"), "view", 8)


@query("agg22_next_step_shares", PAIRS + "SELECT b AS next_step, n, round(n / sum(n) OVER (), 6) AS share FROM n WHERE a = 'click'")
def agg22(spark, sf):
    n = S.bigrams(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").where("a = 'click'")
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(F.col("b").alias("next_step"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("seq5_question_blocks", WITH + """, q AS (SELECT *, cell_type = 'markdown' AS isq, cell_type = 'code' AS isa FROM c),
g AS (SELECT *, sum(isq::INT) OVER (PARTITION BY nb_id ORDER BY pos) AS qa_id FROM q),
s AS (SELECT *, sum((NOT isq AND NOT isa)::INT) OVER (PARTITION BY nb_id, qa_id ORDER BY pos) AS stop FROM g)
SELECT nb_id, qa_id::BIGINT AS qa_id, max(content) FILTER (isq) AS question, coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (NOT isq), '') AS answer FROM s WHERE qa_id > 0 AND stop = 0 GROUP BY nb_id, qa_id""")
def seq5(spark, sf):
    return S.question_blocks(cells(spark, sf), F.col("cell_type") == "markdown", F.col("cell_type") == "code")


@query("seq4_align", WITH + """, s AS (SELECT *, count(*) OVER (PARTITION BY nb_id) AS n FROM c), r AS (SELECT pos AS rp, content AS rc FROM c WHERE nb_id = 0),
m AS (SELECT s.*, (SELECT count(*) FROM r) AS n_ref FROM s),
x AS (SELECT m.*, coalesce(m.content = a.rc, false) AS head, coalesce(m.content = b.rc, false) AS tail FROM m LEFT JOIN r a ON m.pos = a.rp LEFT JOIN r b ON m.pos - m.n + m.n_ref = b.rp),
y AS (SELECT *, bool_and(head) OVER (PARTITION BY nb_id ORDER BY pos) AS up, bool_and(tail) OVER (PARTITION BY nb_id ORDER BY pos DESC) AS down FROM x)
SELECT nb_id, pos, content FROM y WHERE CASE WHEN n = n_ref THEN NOT head ELSE NOT up AND NOT down END""")
def seq4(spark, sf):
    c = cells(spark, sf)
    return S.align(c, c.where("nb_id = 0").select("pos", "content"))


def symbol_sequences(spark, sf):
    seq = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return read(spark, sf, "events").groupBy("user_id").agg(seq.alias("s"))


@query("num9_lcs_length")
def num9(spark, sf):
    s = symbol_sequences(spark, sf)
    a, b = s.alias("a"), s.alias("b")
    pair = a.join(b, F.col("b.user_id") == F.col("a.user_id") + 1)
    return pair.select(F.col("a.user_id").alias("user_id"), S.lcs(F.col("a.s"), F.col("b.s")).alias("n"))


def corpus(s):
    return s.where("user_id % 20 <> 0").select(F.col("user_id").alias("seq_id"), F.col("s").alias("seq"))


@query("seq6_next_step")
def seq6(spark, sf):
    s = symbol_sequences(spark, sf)
    return S.next_step(s.where("user_id % 20 = 0").select(F.col("user_id").alias("id"), F.col("s").alias("prefix")), corpus(s)).select("id", "next", "score")


@query("seq7_accuracy_by_depth")
def seq7(spark, sf):
    """How often the step foretold comes, for all prefixes of the query set's sequences: by depth, by intent (here the user's number modulo 3) and in all; steps of a score over 20, repeats squeezed."""
    e = read(spark, sf, "events").where("value > 20")
    s = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    s = s.select("user_id", (F.col("user_id") % 3).alias("intent"), squeezed("s").alias("seq"))
    told = S.foretold(s.where("user_id % 20 = 0").withColumnRenamed("user_id", "id"), s.where("user_id % 20 <> 0").withColumnRenamed("user_id", "seq_id"))
    # the last step is not asked for
    told = told.join(s.select(F.col("user_id").alias("id"), "intent", F.size("seq").alias("n")), "id").where("depth < n - 1").withColumn("hit", F.coalesce(F.col("told") == F.col("next"), F.lit(False)).cast("int"))
    sides = [told.select(F.lit(kind).alias("kind"), key.cast("long").alias("key"), "hit") for kind, key in (("depth", F.col("depth")), ("intent", F.col("intent")), ("all", F.lit(0)))]
    return sides[0].union(sides[1]).union(sides[2]).groupBy("kind", "key").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("seq8_sequence_similarity", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.label AS a, b.label AS b, a.vec_id AS x, b.vec_id AS y, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM e a JOIN e b ON b.label = a.label + 1),
r AS (SELECT a, b, avg(m) AS m FROM (SELECT a, b, x, max(s) AS m FROM d GROUP BY a, b, x) GROUP BY a, b), c AS (SELECT a, b, avg(m) AS m FROM (SELECT a, b, y, max(s) AS m FROM d GROUP BY a, b, y) GROUP BY a, b)
SELECT a, b, round(r.m + c.m, 6) AS similarity FROM r JOIN c USING (a, b)""")
def seq8(spark, sf):
    """Each label's vectors as one sequence, against the next label's."""
    e = read(spark, sf, "embeddings").where("label is not null and embedding is not null")
    labels = e.select(F.col("label").alias("a")).distinct()
    kind = dict(e.dtypes)["label"]
    pairs = labels.select("a", (F.col("a") + 1).cast(kind).alias("b")).join(labels.select(F.col("a").alias("b")), "b").select("a", "b")
    return S.sequence_similarity(e, pairs, "label", "vec_id", "embedding")


LEVELS = f"WITH RECURSIVE l AS (SELECT *, CASE WHEN content LIKE '#%' THEN length(regexp_extract(content, '^(#*)', 1))::INT ELSE 1000 END AS level FROM (SELECT nb_id, pos, md AS content FROM {MARKDOWN_SQL})), " \
    "t AS (SELECT c.nb_id, c.pos, c.level, c.content, (SELECT max(p.pos) FROM l p WHERE p.nb_id = c.nb_id AND p.pos < c.pos AND p.level < c.level) AS parent FROM l c)"


def tree(spark, sf):
    """The markdown cells of all notebooks under their headings."""
    return H.parents(markdown_cells(spark, sf).withColumnRenamed("md", "content"))


@query("hie1_parents", LEVELS + " SELECT nb_id, pos, level, parent, content FROM t")
def hie1(spark, sf):
    return tree(spark, sf)


PATHS = LEVELS + ", p(nb_id, pos, depth, path) AS (SELECT nb_id, pos, 1, content FROM t WHERE parent IS NULL UNION ALL SELECT t.nb_id, t.pos, p.depth + 1, p.path || '->' || t.content FROM t JOIN p ON t.nb_id = p.nb_id AND t.parent = p.pos), " \
    "leaf AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.nb_id = p.nb_id AND t.parent = p.pos))"


@query("hie3_root_to_leaf_paths", PATHS + " SELECT nb_id, pos, depth, path FROM leaf")
def hie3(spark, sf):
    return H.leaf_paths(tree(spark, sf))


@query("hie4_target_path", PATHS + " SELECT nb_id, arg_max(path, pos) AS path FROM leaf GROUP BY nb_id")
def hie4(spark, sf):
    return H.leaf_paths(tree(spark, sf)).groupBy("nb_id").agg(F.max_by("path", "pos").alias("path"))


@query("hie6_module_prefix", PATHS + " SELECT 'module->' || path AS path FROM leaf")
def hie6(spark, sf):
    return H.leaf_paths(tree(spark, sf)).select(F.concat(F.lit("module->"), "path").alias("path"))


@query("hie7_step_index", PATHS + ", s AS (SELECT nb_id, pos, string_split(path, '->') AS x FROM leaf) SELECT nb_id, pos, i - 1 AS depth, x[i] AS step, x[i + 1] AS next_step FROM s, unnest(range(1, len(x) + 1)) AS u(i)")
def hie7(spark, sf):
    return H.step_index(H.leaf_paths(tree(spark, sf)))


@query("hie8_step_search", PATHS + ", s AS (SELECT nb_id, pos, string_split(path, '->') AS x FROM leaf) SELECT nb_id, pos, i - 1 AS depth, abs(i - 1 - 1) AS gap FROM s, unnest(range(1, len(x) + 1)) AS u(i) WHERE x[i] = '## Load the data' OR x[i] = '# Shop 1'")
def hie8(spark, sf):
    return H.search_step(H.step_index(H.leaf_paths(tree(spark, sf))), ["## Load the data", "# Shop 1"], 1)


@query("hie10_relative_rank", LEVELS + " SELECT nb_id, pos, dense_rank() OVER (PARTITION BY nb_id ORDER BY level) - 1 AS rank FROM t")
def hie10(spark, sf):
    return H.relative_rank(tree(spark, sf))


@query("hie11_html_cells", r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<h1>.*?</h1>|<h2>.*?</h2>|<p>.*?</p>|<pre>.*?</pre>') AS x FROM pages)
SELECT page_id, i - 1 AS pos, regexp_extract(x[i], '^<([a-z0-9]+)>', 1) AS tag, trim(regexp_replace(x[i], '<.*?>', '', 'g')) AS content FROM m, unnest(range(1, len(x) + 1)) AS t(i)""")
def hie11(spark, sf):
    return H.html_cells(read(spark, sf, "pages"), "page_id", "html")


@query("hie13_url_without_fragment", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))::INT AS n_links FROM pages")
def hie13(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    return read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), F.size(links).alias("n_links"))


@query("agg10_path_weights", PATHS + ", s AS (SELECT string_split(path, '->') AS x FROM leaf) SELECT i - 1 AS depth, x[i] AS step, count(*) AS weight FROM s, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY depth, step")
def agg10(spark, sf):
    return H.step_index(H.leaf_paths(tree(spark, sf))).groupBy("depth", "step").agg(F.count("*").alias("weight"))


@query("agg15_path_statistics", PATHS + " SELECT count(*) AS n_paths, count(DISTINCT nb_id) AS n_modules, round(avg(depth), 6) AS mean_depth, max(depth) AS max_depth, min(depth) AS min_depth FROM leaf")
def agg15(spark, sf):
    return H.leaf_paths(tree(spark, sf)).agg(
        F.count("*").alias("n_paths"), F.countDistinct("nb_id").alias("n_modules"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"))


@query("smp1_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || 's1'), doc_id LIMIT 50")
def smp1(spark, sf):
    return read(spark, sf, "documents").select("doc_id").orderBy(A.seeded(F.col("doc_id"), "s1"), "doc_id").limit(50)


@query("smp2_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || 's2'), doc_id) <= 5")
def smp2(spark, sf):
    return A.stratified(read(spark, sf, "documents"), "source", F.concat(A.seeded(F.col("doc_id"), "s2"), F.lpad(F.col("doc_id").cast("string"), 20, "0")), 5).select("source", "doc_id")


@query("smp3_factorial", """SELECT lang, size, doc_id FROM (SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS size, doc_id FROM documents WHERE lang IN ('en', 'de'))
QUALIFY row_number() OVER (PARTITION BY lang, size ORDER BY md5(doc_id || 's3'), doc_id) <= 10""")
def smp3(spark, sf):
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long")
    d = read(spark, sf, "documents").where(F.col("lang").isin("en", "de")).select("lang", size.alias("size"), "doc_id")
    d = d.withColumn("cell", F.concat_ws("/", "lang", "size"))
    return A.stratified(d, "cell", F.concat(A.seeded(F.col("doc_id"), "s3"), F.lpad(F.col("doc_id").cast("string"), 20, "0")), 10).select("lang", "size", "doc_id")


@query("smp5_sampled_keys_expanded", "SELECT s.source, doc_id FROM (SELECT DISTINCT source FROM documents ORDER BY md5(source || 's5') LIMIT 4) s JOIN documents USING (source)")
def smp5(spark, sf):
    d = read(spark, sf, "documents")
    keys = d.select("source").distinct().orderBy(A.seeded(F.col("source"), "s5")).limit(4)
    return d.join(F.broadcast(keys), "source").select("source", "doc_id")  # four keys


@query("smp7_step_classes", "SELECT regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS form, count(*) AS n FROM conversations GROUP BY form")
def smp7(spark, sf):
    return read(spark, sf, "conversations").groupBy(F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("form")).agg(F.count("*").alias("n"))


@query("smp4_jon17_negatives", """WITH p AS (SELECT doc_id, md5(doc_id || 'neg') AS k FROM documents),
r AS (SELECT *, substr(k, 1, 2) AS bucket, row_number() OVER (PARTITION BY substr(k, 1, 2) ORDER BY k, doc_id) - 1 AS i, count(*) OVER (PARTITION BY substr(k, 1, 2)) AS n FROM p)
SELECT a.doc_id AS positive, b.doc_id AS negative FROM r a JOIN r b ON a.bucket = b.bucket AND b.i = (a.i + 1) % a.n AND a.n > 1""")
def smp4(spark, sf):
    from plumbago.operators.retrieval import shifted_negatives

    return shifted_negatives(read(spark, sf, "documents"), "doc_id", "neg")


@query("ml6_split", "SELECT doc_id, CASE WHEN substr(md5(doc_id || 'split'), 1, 1) < '3' THEN 'test' ELSE 'train' END AS part FROM documents")
def ml6(spark, sf):
    return read(spark, sf, "documents").select("doc_id", A.split_of(F.col("doc_id"), "split", 3).alias("part"))
