"""Graph queries: the star schema as triples, and small literal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.operators import graph as G

from .registry import query, read

EDGES = """WITH e AS (SELECT 'n' || n_nationkey AS sub, 'in_region' AS rel, 'r' || n_regionkey AS obj FROM nation UNION ALL SELECT 'c' || c_custkey, 'in_nation', 'n' || c_nationkey FROM customer
UNION ALL SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders) """


def edges(spark, sf):
    def e(table, a, key, rel, b, other):
        x = read(spark, sf, table)
        return x.select(F.concat(F.lit(a), F.col(key)).alias("sub"), F.lit(rel).alias("rel"), F.concat(F.lit(b), F.col(other)).alias("obj"))

    return (
        e("nation", "n", "n_nationkey", "in_region", "r", "n_regionkey").union(e("customer", "c", "c_custkey", "in_nation", "n", "c_nationkey"))
        .union(e("supplier", "s", "s_suppkey", "in_nation", "n", "s_nationkey")).union(e("orders", "o", "o_orderkey", "placed_by", "c", "o_custkey"))
    )


@query("kg10_type_scan", EDGES + "SELECT sub FROM e WHERE rel = 'in_region'")
def kg10(spark, sf):
    return G.match(edges(spark, sf), [("?sub", "in_region", "?o")]).select("sub").distinct()


@query("kg11_chain_constant_object", EDGES + "SELECT DISTINCT a.sub AS x, b.sub AS y FROM e a JOIN e b ON a.obj = b.sub WHERE a.rel = 'in_nation' AND b.rel = 'in_region' AND b.obj = 'r1'")
def kg11(spark, sf):
    return G.match(edges(spark, sf), [("?y", "in_region", "r1"), ("?x", "in_nation", "?y")]).select("x", "y")


@query("kg12_variable_object", EDGES + "SELECT DISTINCT sub AS model, obj AS task FROM e WHERE rel = 'in_nation'")
def kg12(spark, sf):
    return G.match(edges(spark, sf), [("?model", "in_nation", "?task")])


@query("kg13_variable_predicate", EDGES + "SELECT DISTINCT sub AS s, upper(replace(rel, '_', ' ')) AS p FROM e WHERE obj = 'n3'")
def kg13(spark, sf):
    return G.match(edges(spark, sf), [("?s", "?p", "n3")]).select("s", F.upper(F.replace("p", F.lit("_"), F.lit(" "))).alias("p"))


@query("kg14_constant_pair", EDGES + "SELECT DISTINCT sub AS s FROM e WHERE rel = 'placed_by' AND obj = 'c7'")
def kg14(spark, sf):
    return G.match(edges(spark, sf), [("?s", "placed_by", "c7")])


@query("kg15_intersection", EDGES + "SELECT DISTINCT a.sub AS s FROM e a JOIN e b ON a.sub = b.sub WHERE a.rel = 'in_region' AND a.obj = 'r1' AND b.rel = 'in_region' AND b.obj = 'r2'")
def kg15(spark, sf):
    return G.match(edges(spark, sf), [("?s", "in_region", "r1"), ("?s", "in_region", "r2")])


@query("kg16_two_hops_best", """SELECT c_nationkey AS nation, arg_max(o_orderkey, o_totalprice * 1.0) AS best_order, round(max(o_totalprice), 2) AS best FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def kg16(spark, sf):
    x = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_nationkey").alias("nation")).agg(F.max_by("o_orderkey", "o_totalprice").alias("best_order"), F.round(F.max("o_totalprice"), 2).alias("best"))


STEP_SQL = """WITH RECURSIVE st AS (SELECT 'n' || c_nationkey AS parent, c_custkey::BIGINT AS pos, 'c' || c_custkey AS name FROM customer UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'o' || o_orderkey FROM orders
UNION ALL SELECT 'o' || l_orderkey, l_linenumber, 'l' || l_orderkey || '_' || l_linenumber FROM lineitem) """


def steps(spark, sf):
    """Customers as steps of nations, orders of customers, lines of orders."""
    c, o, l = (read(spark, sf, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    s = lambda df, parent, pos, name: df.select(parent.alias("parent"), F.col(pos).cast("long").alias("pos"), name.alias("name"))
    return (
        s(c, F.concat(F.lit("n"), "c_nationkey"), "c_custkey", F.concat(F.lit("c"), "c_custkey"))
        .union(s(o, F.concat(F.lit("c"), "o_custkey"), "o_orderkey", F.concat(F.lit("o"), "o_orderkey")))
        .union(s(l, F.concat(F.lit("o"), "l_orderkey"), "l_linenumber", F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber")))
    )


@query("kg1_kg22_step_triples", STEP_SQL + """, x AS (SELECT *, lead(name) OVER w AS nxt, lag(name) OVER w AS prv FROM st WINDOW w AS (PARTITION BY parent ORDER BY pos))
SELECT parent AS sub, 'HAS FIRST STEP' AS rel, name AS obj FROM x WHERE prv IS NULL UNION SELECT parent, 'HAS LAST STEP', name FROM x WHERE nxt IS NULL UNION SELECT parent, 'HAS STEP', name FROM x
UNION SELECT name, 'IS STEP OF', parent FROM x UNION SELECT name, 'HAS NEXT STEP', nxt FROM x WHERE nxt IS NOT NULL UNION SELECT name, 'HAS PREVIOUS STEP', prv FROM x WHERE prv IS NOT NULL""")
def kg1(spark, sf):
    return G.steps_to_triples(steps(spark, sf))


RELATIONS = "uses,used by,Has Part(s),part of,influenced by,influences,has instance,instance of,modeled by,can model,superclass of,subclass of,evaluated by,evaluates,has language,has dataset,better than,worse than,HAS STEP"


@query("kg2_inverse_relations", "SELECT * FROM (VALUES ('uses', 'USED BY'), ('used by', 'USES'), ('Has Part(s)', 'PART OF'), ('part of', 'HAS PART(S)'), ('influenced by', 'INFLUENCES'), ('influences', 'INFLUENCED BY'), ('has instance', 'INSTANCE OF'), ('instance of', 'HAS INSTANCE'), ('modeled by', 'CAN MODEL'), ('can model', 'MODELED BY'), ('superclass of', 'SUBCLASS OF'), ('subclass of', 'SUPERCLASS OF'), ('evaluated by', 'EVALUATES'), ('evaluates', 'EVALUATED BY'), ('has language', 'HAS DATASET'), ('has dataset', 'HAS LANGUAGE'), ('better than', 'WORSE THAN'), ('worse than', 'BETTER THAN'), ('HAS STEP', 'IS A PART OF')) AS v(rel, inverse)")
def kg2(spark, sf):
    return spark.createDataFrame([(r,) for r in RELATIONS.split(",")], "rel string").select("rel", G.inverse(F.col("rel")).alias("inverse"))


@query("kg17_ordered_children", STEP_SQL + "SELECT name, pos FROM st WHERE parent = 'c1'")
def kg17(spark, sf):
    return steps(spark, sf).where("parent = 'c1'").select("name", "pos").orderBy("pos")


@query("kg18_steps_below", STEP_SQL + """, walk(name, depth, path) AS (SELECT 'n1', 0, '/n1/' UNION ALL SELECT st.name, depth + 1, path || st.name || '/' FROM walk JOIN st ON st.parent = walk.name WHERE depth < 10 AND NOT contains(path, '/' || st.name || '/'))
SELECT DISTINCT name, depth, path FROM walk""")
def kg18(spark, sf):
    e = steps(spark, sf).select(F.col("parent").alias("sub"), F.lit("HAS STEP").alias("rel"), F.col("name").alias("obj"))
    return G.steps_below(e, "n1", "HAS STEP")


@query("kg19_kg20_reach", EDGES.replace("WITH e", "WITH RECURSIVE e", 1) + """, f AS (SELECT obj AS sub, sub AS obj FROM e WHERE rel <> 'placed_by'), walk(node, depth) AS (SELECT 'r1', 0 UNION SELECT f.obj, depth + 1 FROM walk JOIN f ON f.sub = walk.node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def kg19(spark, sf):
    down = edges(spark, sf).where("rel <> 'placed_by'").select(F.col("obj").alias("sub"), F.col("sub").alias("obj"))
    return G.reach(down, spark.createDataFrame([("r1",)], "node string"), 3)


@query("kg4_paper_edges", """WITH r AS (SELECT doc_id, lang, source FROM documents), x AS (SELECT DISTINCT lang AS a, source AS b FROM r)
SELECT a AS sub, 'USES' AS rel, b AS obj FROM x UNION ALL SELECT b, 'USED BY', a FROM x""")
def kg4(spark, sf):
    r = read(spark, sf, "documents").select(F.array("lang").alias("tasks"), F.array("source").alias("methods"))
    return G.cross_edges(r, "tasks", "USES", "USED BY", "methods")


@query("kg9_merged_edges", """SELECT user_id AS sub, event_type AS rel, (event_id % 7)::BIGINT AS obj, arg_max(value, event_id) AS weight, count(*) AS n FROM events GROUP BY ALL""")
def kg9(spark, sf):
    return G.merge_sources(_triples(spark, sf))[1]


@query("kg8_merged_nodes", """WITH t AS (SELECT event_id AS seq, 0 AS side, user_id AS name, 'U' AS type FROM events UNION ALL SELECT event_id, 1, event_id % 7, 'V' FROM events)
SELECT name, arg_min(type, seq * 2 + side) AS type, min(seq * 2 + side) // 2 AS first_seq FROM t GROUP BY name""")
def kg8(spark, sf):
    return G.merge_sources(_triples(spark, sf))[0].select("name", "type", "first_seq")


def _triples(spark, sf):
    return read(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.lit("s").alias("source"), F.col("user_id").alias("sub"), F.lit("U").alias("sub_type"), F.col("event_type").alias("rel"),
        (F.col("event_id") % 7).alias("obj"), F.lit("V").alias("obj_type"), F.col("value").alias("weight"))


@query("kg24_coverage", "SELECT count(*) AS n, count(toxic) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id)")
def kg24(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").agg(F.count("*").alias("n"), F.count("toxic").alias("n_labelled"))


@query("kg23_rule_types", EDGES.replace("WITH e", "WITH RECURSIVE e", 1) + """, n AS (SELECT sub AS node FROM e UNION SELECT obj FROM e), t AS (SELECT node, CASE WHEN node LIKE 'r%' THEN 'R' WHEN node LIKE 'n1%' THEN 'N' END AS type FROM n),
up AS (SELECT sub AS node, obj AS parent FROM e WHERE rel IN ('in_nation')), g AS (SELECT t.node, coalesce(t.type, min(p.type)) AS type FROM t LEFT JOIN up ON up.node = t.node LEFT JOIN t p ON p.node = up.parent GROUP BY t.node, t.type) SELECT node, type FROM g""")
def kg23(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("sub").alias("node")).union(e.select("obj")).distinct()
    rules = [(F.col("node").startswith("r"), "R"), (F.col("node").startswith("n1"), "N")]
    return G.classify(nodes, e, rules, "in_nation")


ONTOLOGY_SQL = """WITH o AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0) """


@query("kg28_reduced_ontology", ONTOLOGY_SQL + "SELECT parent, child FROM o WHERE NOT EXISTS (SELECT 1 FROM o a JOIN o b ON a.child = b.parent WHERE a.parent = o.parent AND b.child = o.child)")
def kg28(spark, sf):
    """Nations under regions, customers under nations, a third of the customers under regions, too."""
    e = edges(spark, sf).where("rel IN ('in_region', 'in_nation') AND sub NOT LIKE 's%'").select(F.col("obj").alias("parent"), F.col("sub").alias("child"))
    up = e.select(F.col("child").alias("parent"), F.col("parent").alias("top"))
    again = e.join(up, "parent").where(F.substring("child", 2, 20).cast("long") % 3 == 0).select(F.col("top").alias("parent"), "child")
    return G.reduce_ontology(e.union(again))


@query("flt7_prune_subjects", EDGES + "SELECT sub, rel, obj FROM e WHERE sub NOT IN (SELECT sub FROM e WHERE rel = 'in_nation' AND obj IN ('n1', 'n2'))")
def flt7(spark, sf):
    return G.prune_subjects(edges(spark, sf), spark.createDataFrame([("in_nation", "n1"), ("in_nation", "n2")], "rel string, obj string"))


@query("flt8_edge_lists", EDGES + "SELECT sub, rel, obj FROM e WHERE rel IN ('in_nation', 'in_region') AND obj NOT IN ('n4', 'r0')")
def flt8(spark, sf):
    return edges(spark, sf).where(F.col("rel").isin("in_nation", "in_region") & ~F.col("obj").isin("n4", "r0"))


@query("flt9_flt10_split_by_subject", EDGES + """, x AS (SELECT *, bool_or(obj = 'n5') OVER (PARTITION BY sub) AS trig, bool_or(obj <> 'n6') OVER (PARTITION BY sub) AS has_left FROM e)
SELECT sub, rel, obj, NOT (regexp_matches(lower(sub), 'c1|c22') OR trig OR NOT has_left) AND NOT obj = 'n6' AS kept FROM x""")
def flt9(spark, sf):
    return G.split_by_subject(edges(spark, sf), F.lower("sub").rlike("c1|c22"), F.col("obj") == "n6", F.col("obj") == "n5")


@query("agg11_degrees", EDGES + ", o AS (SELECT sub AS node, count(*) AS n_out FROM e GROUP BY sub), i AS (SELECT obj AS node, count(*) AS n_in FROM e GROUP BY obj) SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (node)")
def agg11(spark, sf):
    return G.degrees(edges(spark, sf))


@query("jon1_decoded_labels", "SELECT c_custkey, coalesce(n_name, 'n' || c_nationkey) AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jon1(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("c_custkey", F.coalesce("n_name", F.concat(F.lit("n"), "c_nationkey")).alias("nation"), F.col("r_name").alias("region"))


@query("jon2_later_map_wins", "SELECT s_suppkey, coalesce(b.c, a.c) AS class FROM supplier LEFT JOIN (VALUES (1, 'x'), (2, 'y')) AS a(k, c) ON s_nationkey = a.k LEFT JOIN (VALUES (2, 'z'), (3, 'w')) AS b(k, c) ON s_nationkey = b.k WHERE coalesce(b.c, a.c) IS NOT NULL")
def jon2(spark, sf):
    maps = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (2, "z", 1), (3, "w", 1)], "k int, c string, priority int")
    one = maps.groupBy("k").agg(F.max_by("c", "priority").alias("class"))
    return read(spark, sf, "supplier").join(F.broadcast(one), F.col("s_nationkey") == F.col("k")).select("s_suppkey", "class")  # a fixed list


@query("jon3_jon5_matched_only", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE text <> '' AND quality IS NOT NULL")
def jon3(spark, sf):
    return read(spark, sf, "documents").where("text <> ''").join(read(spark, sf, "labels").where("quality is not null"), "doc_id").select("doc_id", "quality", "toxic")


@query("jon7_expanded_hits", "SELECT p.p_brand AS brand, string_agg(DISTINCT l.l_suppkey, ',' ORDER BY l.l_suppkey) AS suppliers FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity = 50 GROUP BY p.p_brand")
def jon7(spark, sf):
    l = read(spark, sf, "lineitem").where("l_quantity = 50")  # noqa: E741
    x = l.join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ids = F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda k: k.cast("string"))
    return x.groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(ids, ",").alias("suppliers"))


@query("jon13_pairs_in_order", """WITH k AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{12,}'))) AS w FROM conversations)
SELECT a.w AS parent, b.w AS child, count(*) AS n FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.w < b.w GROUP BY a.w, b.w""")
def jon13(spark, sf):
    from plumbago.functions.text import tokens

    k = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(tokens(F.col("text"), "[a-z]{12,}"))).alias("w"))
    a, b = k.alias("a"), k.alias("b")
    pair = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")) & (F.col("a.w") < F.col("b.w")))
    return pair.groupBy(F.col("a.w").alias("parent"), F.col("b.w").alias("child")).agg(F.count("*").alias("n"))


@query("jon15_containing_blocks", "SELECT a.event_id, count(b.user_id) AS n FROM events a LEFT JOIN (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id) b ON b.user_id = a.user_id AND b.lo <= a.value AND a.value <= b.hi GROUP BY a.event_id")
def jon15(spark, sf):
    e = read(spark, sf, "events")
    b = e.groupBy(F.col("user_id").alias("u")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = e.join(b, (F.col("user_id") == F.col("u")) & (F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi")), "left")
    return x.groupBy("event_id").agg(F.count("u").alias("n"))


@query("ml9_neighbour_sum", EDGES + ", x AS (SELECT 'c' || c_custkey AS node, c_acctbal AS v FROM customer) SELECT node, round(sum(v), 6) AS v FROM (SELECT e.obj AS node, x.v FROM e JOIN x ON e.sub = x.node UNION ALL SELECT node, v FROM x) GROUP BY node")
def ml9(spark, sf):
    x = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").alias("v"))
    return G.neighbour_sum(edges(spark, sf), x, "v")


@query("ext2_empty_results", "SELECT count(*) AS n, sum((len(regexp_extract_all(text, '[0-9]+')) = 0)::INT)::BIGINT AS n_empty FROM documents")
def ext2(spark, sf):
    n = F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))
    return read(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(n == 0).alias("n_empty"))


@query("ext1_splits", "SELECT 'train' AS split, count(*) AS n FROM documents UNION ALL SELECT 'test', count(*) FROM benchmark")
def ext1(spark, sf):
    a, b = read(spark, sf, "documents").select(F.lit("train").alias("split")), read(spark, sf, "benchmark").select(F.lit("test").alias("split"))
    return a.union(b).groupBy("split").agg(F.count("*").alias("n"))


@query("set1_union_keep_best", "SELECT doc_id, max(s) AS score FROM (SELECT doc_id, quality::DOUBLE AS s FROM labels UNION ALL SELECT doc_id, toxic * 2.0::DOUBLE FROM labels) GROUP BY doc_id")
def set1(spark, sf):
    l = read(spark, sf, "labels")  # noqa: E741
    both = l.select("doc_id", (F.col("quality") * 1.0).alias("score")).unionByName(l.select("doc_id", (F.col("toxic") * 2.0).alias("score")))
    return both.groupBy("doc_id").agg(F.max("score").alias("score"))


@query("set3_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def set3(spark, sf):
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("set5_concatenated", "SELECT 'd' AS kind, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents UNION ALL SELECT 'b', count(*), NULL FROM benchmark")
def set5(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("d").alias("kind"), "n_chars")
    both = d.unionByName(read(spark, sf, "benchmark").select(F.lit("b").alias("kind")), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("set6_common_members", "SELECT a.lang AS a, b.lang AS b, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b ON a.source = b.source AND a.lang < b.lang GROUP BY a.lang, b.lang HAVING count(*) > 5")
def set6(spark, sf):
    d = read(spark, sf, "documents").select("lang", "source").distinct()
    a, b = d.alias("a"), d.alias("b")
    pair = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.lang") < F.col("b.lang")))
    return pair.groupBy(F.col("a.lang").alias("a"), F.col("b.lang").alias("b")).agg(F.count("*").alias("n")).where("n > 5")
