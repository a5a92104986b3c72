"""Notebook queries: conversations stand for notebooks, turns for cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.operators import cells as C

from .registry import query, read

CELLS = """SELECT conv_id AS nb_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS cell_type, text AS content FROM conversations"""
WITH = f"WITH c AS ({CELLS}) "


def flat(spark, sf):
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("nb_id"), F.col("turn").alias("pos"), kind.alias("cell_type"), F.col("text").alias("content"))


def nested(spark, sf):
    return C.notebooks_from_cells(flat(spark, sf), "nb_id", "pos", "cell_type", "content")


def cells(spark, sf):
    return C.cell_rows(nested(spark, sf), F.col("target_type"))


@query("prj1_cell_rows", WITH + "SELECT nb_id, pos, cell_type, content FROM c")
def prj1(spark, sf):
    return cells(spark, sf)


@query("prj2_type_ids", WITH + """, m AS (SELECT *, max(pos) OVER (PARTITION BY nb_id) AS last FROM c)
SELECT nb_id, '0,' || coalesce(string_agg(CASE WHEN pos < last THEN CASE cell_type WHEN 'raw' THEN '1,' WHEN 'code' THEN '2,' ELSE '3,' END ELSE '' END, '' ORDER BY pos), '') || '2,5' AS ids
FROM m GROUP BY nb_id""")
def prj2(spark, sf):
    return C.type_ids(nested(spark, sf)).select("nb_id", F.array_join("ids", ",").alias("ids"))


@query("prj3_content_and_type", WITH + "SELECT nb_id, pos, CASE cell_type WHEN 'raw' THEN 1 WHEN 'code' THEN 2 ELSE 3 END AS type_id, content FROM c")
def prj3(spark, sf):
    known = F.create_map(*[F.lit(x) for kv in C.TYPE_IDS.items() for x in kv])
    return cells(spark, sf).select("nb_id", "pos", known[F.col("cell_type")].alias("type_id"), "content")


@query("prj4_query_answer_pairs", WITH + """, m AS (SELECT *, max(pos) OVER (PARTITION BY nb_id) AS last FROM c)
SELECT nb_id, coalesce(max_by(content, pos) FILTER (cell_type = 'markdown' AND pos < last), '') AS query, max(content) FILTER (pos = last) AS answer FROM m GROUP BY nb_id""")
def prj4(spark, sf):
    return C.query_answer_pairs(nested(spark, sf))


WRAP = "CASE WHEN cell_type = 'markdown' THEN '<text>' || chr(10) || content || chr(10) || '</text>' ELSE '<cell>' || chr(10) || content || chr(10) || '</cell>' END"


@query("prj5_wrapped_cells", WITH + f"SELECT nb_id, pos, {WRAP} AS wrapped FROM c")
def prj5(spark, sf):
    return cells(spark, sf).select("nb_id", "pos", C.wrapped(F.col("cell_type"), F.col("content")).alias("wrapped"))


WINDOW = WITH + f""", w AS (SELECT nb_id, pos, {WRAP} AS t, cell_type FROM c),
j AS (SELECT a.nb_id, a.pos, count(*) AS n_context, string_agg(b.t, chr(10) ORDER BY b.pos) AS input, any_value(a.cell_type) AS label
  FROM w a JOIN w b ON a.nb_id = b.nb_id AND b.pos BETWEEN a.pos - 5 AND a.pos - 1 GROUP BY a.nb_id, a.pos) """


@query("prj6_context_windows", WINDOW + "SELECT nb_id, pos, n_context, input, label FROM j")
def prj6(spark, sf):
    return C.context_windows(cells(spark, sf))


@query("prj7_infill_windows", WINDOW + "SELECT nb_id, pos, n_context, input || chr(10) || '<text>' AS input, label FROM j WHERE label = 'markdown'")
def prj7(spark, sf):
    return C.context_windows(cells(spark, sf), only="markdown")


@query("prj8_last_cells", WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY nb_id ORDER BY pos DESC) AS back FROM c)
SELECT nb_id, w AS width, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS text FROM r, unnest([2, 5, 10]) AS t(w) WHERE back <= w GROUP BY nb_id, w""")
def prj8(spark, sf):
    c = cells(spark, sf)
    parts = [C.last_cells(c, w).select("nb_id", F.lit(w).alias("width"), "n", "text") for w in (2, 5, 10)]
    return parts[0].union(parts[1]).union(parts[2])


@query("prj9_unique_mentions", WITH + """SELECT content, count(*) AS n, min_by(nb_id, nb_id * 1000 + pos) AS first_nb, min_by(pos, nb_id * 1000 + pos) AS first_pos,
string_agg(nb_id || ':' || pos, ' ' ORDER BY nb_id, pos) AS mentions FROM c WHERE cell_type = 'markdown' GROUP BY content""")
def prj9(spark, sf):
    out = C.mentions(cells(spark, sf).where("cell_type = 'markdown'"))
    return out.withColumn("mentions", F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["nb_id"], m["pos"])), " "))


@query("prj10_cell_look_up", WITH + """SELECT d.content, count(c.nb_id) AS n_places, count(DISTINCT c.nb_id) AS n_notebooks
FROM (SELECT DISTINCT text AS content FROM documents) d LEFT JOIN c USING (content) GROUP BY d.content""")
def prj10(spark, sf):
    kb = read(spark, sf, "documents").select(F.col("text").alias("content")).distinct()
    return C.look_up(kb, cells(spark, sf))


@query("prj11_previous_markdown", WITH + """SELECT nb_id, pos, last_value(CASE WHEN cell_type = 'markdown' THEN content END IGNORE NULLS)
OVER (PARTITION BY nb_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM c""")
def prj11(spark, sf):
    return C.previous_of_type(cells(spark, sf)).select("nb_id", "pos", "previous")


@query("prj12_content_by_type", WITH + "SELECT nb_id, pos, trim(content) AS content FROM c")
def prj12(spark, sf):
    kind, x = F.col("cell_type"), F.col("content")
    c = cells(spark, sf).select("nb_id", "pos", kind, *[F.when(kind == k, x).alias(k) for k in ("code", "markdown", "raw")])
    return c.select("nb_id", "pos", C.content_by_type(kind, F.col("code"), F.col("markdown"), F.col("raw")).alias("content"))


@query("prj13_title_from_path", """SELECT page_id, array_to_string(list_transform(string_split(lower(regexp_replace(regexp_replace(replace(split_part(string_split(url, '/')[-1], '.', 1), '_', ' '),
 '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM pages""")
def prj13(spark, sf):
    return read(spark, sf, "pages").select("page_id", C.title_from_path(F.col("url")).alias("title"))


@query("prj14_function_body", WITH + "SELECT nb_id, pos, 'def func():' || chr(10) || chr(9) || replace(content, chr(10), chr(10) || chr(9)) AS body FROM c WHERE cell_type = 'code'")
def prj14(spark, sf):
    return cells(spark, sf).where("cell_type = 'code'").select("nb_id", "pos", C.as_function_body(F.col("content")).alias("body"))


@query("flt1_longest_per_key", "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def flt1(spark, sf):
    return C.longest_per_key(read(spark, sf, "documents"), "source", F.col("n_chars"), "doc_id").select("source", "doc_id", "n_chars")


@query("flt2_duplicates_by_key", "SELECT text, count(*) AS n, string_agg(doc_id || ':' || n_chars, ' ' ORDER BY doc_id) AS members FROM documents GROUP BY text")
def flt2(spark, sf):
    out = C.duplicates(read(spark, sf, "documents"), "text", "doc_id", F.col("n_chars"))
    return out.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["id"], m["size"])), " "))


@query("flt3_merge_duplicates", WITH + """, s AS (SELECT *, nb_id % 10 AS grp, count(*) OVER (PARTITION BY nb_id) AS size FROM c),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, content ORDER BY size DESC, nb_id, pos) = 1)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY size DESC, nb_id, pos) - 1 AS pos, content FROM f""")
def flt3(spark, sf):
    return C.merge_duplicates(cells(spark, sf).withColumn("grp", F.col("nb_id") % 10), "grp", "nb_id")


@query("flt4_has_key", "SELECT doc_id, toxic IS NOT NULL AS is_labelled FROM documents LEFT JOIN labels USING (doc_id)")
def flt4(spark, sf):
    out = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return out.select("doc_id", F.col("toxic").isNotNull().alias("is_labelled"))


@query("flt5_groups_of_many", "SELECT text, count(*) AS n, count(DISTINCT doc_id) AS n_distinct FROM documents GROUP BY text HAVING count(DISTINCT doc_id) >= 2")
def flt5(spark, sf):
    return C.groups_of_many(read(spark, sf, "documents"), "text", "doc_id")


@query("flt15_squeezed_types", WITH + """SELECT nb_id, string_agg(cell_type, '>' ORDER BY pos) AS types FROM (
SELECT *, lag(cell_type) OVER (PARTITION BY nb_id ORDER BY pos) AS p FROM c) WHERE p IS DISTINCT FROM cell_type GROUP BY nb_id""")
def flt15(spark, sf):
    seq = cells(spark, sf).groupBy("nb_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cell_type"))).alias("s"))
    return seq.select("nb_id", F.array_join(C.squeezed(F.transform("s", lambda c: c["cell_type"])), ">").alias("types"))


@query("agg4_interleaving", WITH + """, m AS (SELECT *, CASE WHEN cell_type IS DISTINCT FROM lag(cell_type) OVER (PARTITION BY nb_id ORDER BY pos) THEN 1 ELSE 0 END AS n FROM c),
r AS (SELECT nb_id, sum(n) OVER (PARTITION BY nb_id ORDER BY pos) AS run FROM m), g AS (SELECT nb_id, run, count(*) AS length FROM r GROUP BY nb_id, run)
SELECT nb_id, sum(length)::BIGINT AS n_cells, count(*) - 1 AS switches, max(length) AS longest, round(avg(length), 6) AS mean_run FROM g GROUP BY nb_id""")
def agg4(spark, sf):
    return C.interleaving(cells(spark, sf))


@query("jon10_prefix_pairs", WITH + """, s AS (SELECT nb_id, list(cell_type ORDER BY pos) AS s FROM c GROUP BY nb_id)
SELECT 0 AS grp, a.nb_id AS shorter, b.nb_id AS longer FROM s a JOIN s b ON len(a.s) < len(b.s) OR (len(a.s) = len(b.s) AND a.nb_id < b.nb_id) WHERE b.s[1:len(a.s)] = a.s""")
def jon10(spark, sf):
    seq = cells(spark, sf).groupBy("nb_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cell_type"))).alias("s"))
    seq = seq.select(F.lit(0).alias("grp"), "nb_id", F.transform("s", lambda c: c["cell_type"]).alias("types"))
    return C.prefix_pairs(seq, "grp", "nb_id", "types")


def type_sequences(spark, sf):
    seq = cells(spark, sf).groupBy("nb_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cell_type", "content"))).alias("s"))
    return seq.select((F.col("nb_id") % 10).alias("topic"), "nb_id", F.transform("s", lambda c: c["cell_type"]).alias("types"), F.transform("s", lambda c: c["content"]).alias("texts"))


TOPICS = WITH + """, s AS (SELECT nb_id % 10 AS topic, nb_id, list(cell_type ORDER BY pos) AS t, list(content ORDER BY pos) AS x FROM c GROUP BY nb_id),
p AS (SELECT a.topic, a.nb_id AS a, b.nb_id AS b, least(len(a.t), len(b.t))::INT AS min_len, greatest(len(a.t), len(b.t))::INT AS max_len,
 coalesce(list_position(list_transform(range(1, least(len(a.{x}), len(b.{x})) + 1), lambda i: trim(a.{x}[i]) = trim(b.{x}[i])), false) - 1, least(len(a.{x}), len(b.{x})))::INT AS common_len FROM s a JOIN s b ON a.topic = b.topic AND a.nb_id < b.nb_id) """


@query("agg16_topic_overlap", TOPICS.format(x="t") + "SELECT * FROM p WHERE common_len > 0")
def agg16(spark, sf):
    return C.overlaps(type_sequences(spark, sf), "topic", "nb_id", "types")


@query("agg16_overlap_lengths", TOPICS.format(x="t") + "SELECT topic, common_len, count(*) AS n_pairs FROM p GROUP BY topic, common_len")
def agg16_lengths(spark, sf):
    return C.overlap_lengths(type_sequences(spark, sf), "topic", "nb_id", "types")


@query("num10_common_prefix", WITH + """, s AS (SELECT nb_id, list(cell_type ORDER BY pos) AS s FROM c GROUP BY nb_id)
SELECT a.nb_id, coalesce(list_position(list_transform(range(1, least(len(a.s), len(b.s)) + 1), lambda i: a.s[i] = b.s[i]), false) - 1, least(len(a.s), len(b.s)))::INT AS n
FROM s a JOIN s b ON b.nb_id = a.nb_id + 1""")
def num10(spark, sf):
    seq = cells(spark, sf).groupBy("nb_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cell_type"))).alias("s"))
    seq = seq.select("nb_id", F.transform("s", lambda c: c["cell_type"]).alias("types"))
    a, b = seq.alias("a"), seq.alias("b")
    n = F.least(F.size("a.types"), F.size("b.types"))
    pair = a.join(b, F.col("b.nb_id") == F.col("a.nb_id") + 1)
    return pair.select("a.nb_id", C.common_prefix(F.slice("a.types", F.lit(1), n), F.slice("b.types", F.lit(1), n)).alias("n"))
