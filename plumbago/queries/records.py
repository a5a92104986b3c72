"""Queries over nested records, small literal tables and rankings that the other modules don't hold."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.functions import code as C
from plumbago.functions.text import tokens, topic_name
from plumbago.operators import hierarchy as H
from plumbago.operators import records as R
from plumbago.operators import retrieval as V

from .code import cells as code_cells
from .code import mended, values
from .derived import facts_sql
from .registry import query, read
from .sequences import PATHS, tree
from .text import SPACED

@query("kg5_evaluation_triples", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, 'm' || c_nationkey AS m FROM customer)
SELECT 't' || k AS sub, 'HAS DATASET' AS rel, seg AS obj FROM c UNION SELECT seg, 'EVALUATES', m FROM c UNION SELECT m, 'CAN MODEL', 't' || k FROM c UNION SELECT 's' || k, 'SUBTASK OF', 't' || k FROM c
UNION SELECT 's' || k, 'HAS DATASET', 'd' || k FROM c UNION SELECT 'd' || k, 'EVALUATES', 'yolo' FROM c UNION SELECT 'yolo', 'CAN MODEL', 's' || k FROM c""")
def kg5(spark, sf):
    """A task with one subtask a customer."""
    k, seg, m = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.concat(F.lit("m"), "c_nationkey")
    sub = F.concat(F.lit('[{"task":"s'), k, F.lit('","datasets":[{"dataset":"d'), k, F.lit('","models":["yolo"]}],"subtasks":null}]'))
    sets = F.array(F.struct(seg.alias("dataset"), F.array(m).alias("models")))
    return R.evaluation_triples(read(spark, sf, "customer").select(F.concat(F.lit("t"), k).alias("task"), sets.alias("datasets"), sub.alias("subtasks")))


@query("kg6_kg7_array_triples", """SELECT c_name AS sub, 'HAS TASK' AS rel, c_mktsegment AS obj FROM customer UNION SELECT c_name, 'HAS MODALITY', 'n' || c_nationkey FROM customer UNION SELECT c_name, 'HAS MODALITY', 'text' FROM customer""")
def kg6(spark, sf):
    x = read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tasks"), F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("text")).alias("modalities"))
    return R.array_triples(x, "name", {"tasks": "HAS TASK", "modalities": "HAS MODALITY"})


def nested(spark, sf):
    """An object of objects a customer."""
    parts = ['{"a::T": {"b::M::USES": {"DESC": "', "c_name", '"}, "plain": "', "c_mktsegment", '"}, "n', "c_nationkey", '::T": "z"}']
    j = F.concat(*[F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])
    return R.paths_of_objects(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), j.alias("j")), "id", "j")


@query("num11_hie5_paths_of_objects", """SELECT c_custkey AS id, 'a::T->b::M::USES->DESC' AS path, '"' || c_name || '"' AS value FROM customer UNION ALL SELECT c_custkey, 'a::T->plain', '"' || c_mktsegment || '"' FROM customer
UNION ALL SELECT c_custkey, 'n' || c_nationkey || '::T', '"z"' FROM customer""")
def num11(spark, sf):
    return nested(spark, sf)


@query("kg3_bad_keys", "SELECT c_custkey AS id, 'plain' AS key FROM customer")
def kg3(spark, sf):
    return R.bad_keys(nested(spark, sf))


@query("num12_collapsed_lists", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def num12(spark, sf):
    t = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return read(spark, sf, "conversations").groupBy("conv_id").agg(R.collapsed(t).alias("text"))


@query("num13_inverted_map", "SELECT lang AS value, string_agg(DISTINCT source, ',' ORDER BY source) AS keys FROM documents GROUP BY lang")
def num13(spark, sf):
    m = read(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return R.inverted(m, "source", "langs").withColumn("keys", F.array_join("keys", ","))


@query("num14_later_map_wins", "SELECT doc_id, coalesce(toxic, 0) AS v FROM documents LEFT JOIN labels USING (doc_id)")
def num14(spark, sf):
    first = read(spark, sf, "documents").select("doc_id", F.lit(0).alias("v"))
    return R.later_wins([first, read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("v"))], "doc_id", "v")


@query("jon6_truth_in_ranked_list", "SELECT doc_id, quality = 1 AS is_rel FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) JOIN labels USING (doc_id)")
def jon6(spark, sf):
    top = read(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return top.join(read(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("is_rel"))


@query("jon8_joined_parts", "SELECT n_name, coalesce(string_agg(s_name, chr(10) ORDER BY s_name), '') AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def jon8(spark, sf):
    x = read(spark, sf, "nation").join(read(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return x.groupBy("n_name").agg(F.concat_ws("\n", F.sort_array(F.collect_list("s_name"))).alias("suppliers"))


@query("jon16_metadata_look_up", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'")
def jon16(spark, sf):
    o = read(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1"))
    return o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("str32_ids_to_text", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, ' +'), lambda w: NOT contains(w, '<') AND w <> ''), ' ') AS text FROM benchmark")
def str32(spark, sf):
    w = F.filter(F.split("text", " +"), lambda x: ~x.contains("<") & (x != ""))
    return read(spark, sf, "benchmark").select("item_id", F.array_join(w, " ").alias("text"))


@query("ext9_fresh_phrases", values([(1, "load data|plot data|fit")], "id, phrases"))
def ext9(spark, sf):
    x = spark.createDataFrame([(1, ["load data", "data", "plot data", "load plot", "fit"])], "id int, p array<string>")
    return x.select("id", F.array_join(R.fresh_phrases(F.col("p")), "|").alias("phrases"))


@query("hie2_ext10_printed_tree")
def hie2(spark, sf):
    t = tree(spark, sf)
    every = H.leaf_paths(t)
    depth = t.select("nb_id", "pos", F.when(F.col("parent").isNull(), 1).otherwise(2).alias("depth"))
    return R.nested_text(t, depth).join(every.groupBy("nb_id").agg(F.count("*").alias("n_leaves")), "nb_id")


@query("hie12_without_tables", "SELECT page_id, length(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', '', 'g'), '</?(span|div|li|ul|b)[^>]*>', '', 'g')) AS n FROM pages")
def hie12(spark, sf):
    drop = F.regexp_replace("html", "(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", "")
    return read(spark, sf, "pages").select("page_id", F.length(F.regexp_replace(drop, "</?(span|div|li|ul|b)[^>]*>", "")).cast("long").alias("n"))


@query("seq9_labelled_plan", PATHS + " SELECT nb_id, pos, CASE WHEN content LIKE '#%' THEN 'heading' ELSE 'step' END AS label FROM t")
def seq9(spark, sf):
    return tree(spark, sf).select("nb_id", "pos", F.when(F.col("content").startswith("#"), "heading").otherwise("step").alias("label"))


@query("top1_sorted_counts", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def top1(spark, sf):
    n = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    every = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "source")))  # one row a source
    return n.agg(every.alias("x")).select(F.posexplode("x").alias("p", "x")).select("x.source", (-F.col("x.m")).alias("n"), (F.col("p") + 1).cast("long").alias("place"))


@query("top2_global_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top2(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("top3_per_row_top", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top3(spark, sf):
    by = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").withColumn("n", F.row_number().over(by)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("top4_arg_max", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS c_custkey FROM customer GROUP BY c_nationkey")
def top4(spark, sf):
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


@query("top5_row_limit", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def top5(spark, sf):
    return read(spark, sf, "events").orderBy("ts", "event_id").limit(100).select("event_id")


@query("top6_by_length", "SELECT conv_id, string_agg(turn, ',' ORDER BY length(text) DESC, turn) AS turns FROM conversations GROUP BY conv_id")
def top6(spark, sf):
    x = F.sort_array(F.collect_list(F.struct((-F.length("text")).alias("n"), "turn")))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(x, lambda s: s["turn"].cast("string")), ",").alias("turns"))


TOPICS = ["Lab_DataFrames", "data-frames", "Week LinearRegression", "linear_regression", "Project", "HTMLParser exercises"]


@query("ml2_merged_topics", f"""WITH t AS (SELECT p_name AS x FROM part UNION ALL SELECT unnest({TOPICS}))
SELECT array_to_string(list_filter(regexp_split_to_array(lower({SPACED.format(x="translate(x, '_-', '  ')")}), '\\s+'), lambda w: w <> '' AND w NOT IN ('lab', 'labs', 'checkpoint', 'exercise', 'exercises', 'solution', 'solutions',
 'question', 'questions', 'assignment', 'assignments', 'week', 'weeks', 'project', 'problem', 'problems')), ' ') AS topic, count(*) AS n FROM t GROUP BY topic""")
def ml2(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_name").alias("x")).union(spark.createDataFrame([(x,) for x in TOPICS], "x string"))
    return t.groupBy(topic_name(F.col("x")).alias("topic")).agg(F.count("*").alias("n"))


@query("ext4_catalogue_rows", values([("load", "x = 1", "p"), ("load", "x = 2", "p"), ("plot", "y", "q")], "label, code, path"))
def ext4(spark, sf):
    x = spark.createDataFrame([("p", {"load": ["x = 1", "x = 2"]}), ("q", {"plot": ["y"]})], "path string, m map<string,array<string>>")
    return x.select("path", F.explode("m").alias("label", "codes")).select("label", F.explode("codes").alias("code"), "path")


@query("ext5_label_in_truth", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS q, a.label AS truth, b.label AS guess, row_number() OVER (PARTITION BY a.vec_id
ORDER BY round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT count(*) AS n, round(avg((truth = guess)::INT), 6) AS accuracy FROM s WHERE r = 1""")
def ext5(spark, sf):
    e = read(spark, sf, "embeddings")
    near = V.vector_top_k(e.where("vec_id % 20 = 0"), e, 1, "vec_id", "embedding", exclude_self=True)
    a, b = e.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), e.select(F.col("vec_id").alias("doc"), F.col("label").alias("guess"))
    return near.join(a, "q").join(b, "doc").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("guess")).cast("int")), 6).alias("accuracy"))


@query("ext6_many_chunks", facts_sql({"n": ["3", "8", "", "4", "5", ""]}, "pos % 6 NOT IN (2, 5)"))
def ext6(spark, sf):
    n = F.size(C.chunks(mended()))
    return code_cells(spark, sf).select("nb_id", "pos", n.alias("n")).where("n > 1").withColumn("n", F.col("n").cast("string"))


@query("ext11_node_key", "SELECT DISTINCT '{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}' AS key FROM events")
def ext11(spark, sf):
    key = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u")))
    return read(spark, sf, "events").select(key.alias("key")).distinct()


@query("ext13_token_views", "SELECT item_id, 'query' AS side, len(regexp_extract_all(lower(text), '[a-z]+'))::INT AS n FROM benchmark UNION ALL SELECT doc_id, 'doc', len(regexp_extract_all(lower(text), '[a-z]+'))::INT FROM documents")
def ext13(spark, sf):
    n = F.size(tokens(F.col("text"))).alias("n")
    q = read(spark, sf, "benchmark").select("item_id", F.lit("query").alias("side"), n)
    return q.union(read(spark, sf, "documents").select("doc_id", F.lit("doc"), n))


@query("ext17_label_index", "SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS class FROM (SELECT DISTINCT lang FROM documents)")
def ext17(spark, sf):
    every = read(spark, sf, "documents").agg(F.sort_array(F.collect_set("lang")).alias("x"))  # a vocabulary
    return every.select(F.posexplode("x").alias("class", "lang")).select("lang", F.col("class").cast("long").alias("class"))


CELL_TOPICS = ["mean,print,x{c}", "base,clip,len,np,p,prices,rate,sum", "", "load,rows,sort,w,z{c}", "best,i,items,out,reverse,sorted", ""]
ACCEPTED = ["Import", "For,If,Return", "", "", "ListComp,Return", ""]


@query("syn3_topics_and_constructs", facts_sql({"topics": CELL_TOPICS, "constructs": ACCEPTED}))
def syn3(spark, sf):
    """A cell's terms in order, and which of the constructs that tell something about it (not calls, assignments or plain expressions) it has."""
    last = F.transform("f.calls", lambda c: F.substring_index(c, ".", -1))
    plain = F.array(*map(F.lit, ("Assign", "AugAssign", "Call", "Expr", "FunctionDef")))
    topics = F.array_sort(F.array_distinct(F.concat(last, "f.variables")))
    return code_cells(spark, sf).select("nb_id", "pos", F.array_join(topics, ",").alias("topics"), F.array_join(F.array_sort(F.array_except("f.constructs", plain)), ",").alias("constructs"))


@query("syn24_syn25_grown_context", values([(1, "2,3,4,5,6")], "id, lines"))
def syn24(spark, sf):
    x = spark.createDataFrame([(1, list(range(12)), 4)], "id int, labels array<int>, centre int")
    return x.select("id", F.array_join(R.grown_context(F.col("labels"), F.col("centre"), 5), ",").alias("lines"))


@query("syn26_refinement_pair", values([("a = 1<add>b <msg>rename", "a = 2<add>b")], "source, target"))
def syn26(spark, sf):
    x = spark.createDataFrame([("-a = 1\n b", "+a = 2\n b", "rename")], "o string, n string, c string")
    return x.select(R.refinement_pair(F.col("o"), F.col("n"), F.col("c")).alias("p")).select("p.source", "p.target")


@query("syn27_comments_and_classes", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'assistant' AND text <> ''")
def syn27(spark, sf):
    return read(spark, sf, "conversations").where("role = 'assistant' AND text <> ''").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
