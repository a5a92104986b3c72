"""Text, number, count and filter queries over documents, pages, parts and small literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.functions import numbers as N
from plumbago.functions import text as T
from plumbago.operators import aggregates as A

from . import derived
from .registry import query, read

SPACED = "regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
IDS = ["HTMLParserFooBar", "readCsvFile", "pd.read_csv", "np.linalg.norm_L2", "NO_API_SEQUENCE", "plotXYData", "", "getHTTPResponseCode", "a_b.c"]
ID_VALUES = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(IDS)) + ") AS v(id, x)"

MD = [
    "# Load *data* from [the site](http://example.org/a) now", "## Clean `df.dropna()` and `  ` values!", "plain text http://example.org/x?y=1 end",
    "Q1.2 find the mean", "Problem 3.1 &nbsp; plot", "<b>bold</b> and <i>it</i> <img src='a.png'> image", "#### Step 1: how to convert a list", "", "!wow!",
    "lab load data lab", "points plot points 2 points", "solution to part one solution", "part two solutions", "problem question x", "convert a list to an array", "Compute the mean", "create a frame",
    "data filtering conditison", "iterate over rows", "# Week Assignment 3.2: (3 points) Plot \"it\" [now] = 5", "## Exercise load-data (TODO) | $x$ 7a.", "load data", "plot it", "fit the big model & plot its large errors", "use it to plot it",
    "step 2 plot 3d data of col1 in (2 ways)", "How to convert str to int? (fast)", "Question 4: Mean: compute it (3 points)", "load data and plot it", "drop x & sort y",
]
MD_VALUES = "(VALUES " + ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(MD)) + ") AS v(id, x)"


def literal(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x string")


#: All lines of documents and pages, and literal ones of each form.
LINES = f"""(SELECT 'fixed' AS src, id::BIGINT AS id, 0 AS pos, x FROM {MD_VALUES}
UNION ALL SELECT 'documents', doc_id, (i - 1)::INT, l[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
UNION ALL SELECT 'pages', page_id, (i - 1)::INT, l[i] FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)) AS v"""


def lines(spark, sf):
    out = literal(spark, MD).select(F.lit("fixed").alias("src"), F.col("id").cast("long").alias("id"), F.lit(0).alias("pos"), "x")
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        out = out.union(read(spark, sf, name).select(F.lit(name), F.col(key).cast("long"), F.posexplode(F.split(text, "\n"))))
    return out


def on_ids(name, column, sql):
    @query(name, f"SELECT x, {sql} AS y FROM (SELECT x FROM {ID_VALUES} UNION SELECT unnest(regexp_extract_all(text, '[A-Za-z_.]+')) FROM documents) AS u")
    def q(spark, sf):
        words = read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_.]+"), F.lit(0))).alias("x"))
        return literal(spark, IDS).select("x").union(words).distinct().select("x", column(F.col("x")).alias("y"))

    return q


def on_markdown(name, column, sql):
    @query(name, f"SELECT src, id, pos, {sql} AS y FROM {LINES}")
    def q(spark, sf):
        return lines(spark, sf).select("src", "id", "pos", column(F.col("x")).alias("y"))

    return q


on_ids("str1_camel_split", lambda x: F.array_join(T.camel_words(x), "|"), "replace(" + SPACED.format(x="x") + ", ' ', '|')")
on_ids("str2_identifier_terms", lambda x: F.array_join(T.identifier_terms(x), "|"),
       "CASE WHEN x = 'NO_API_SEQUENCE' THEN '' ELSE array_to_string(list_filter(regexp_split_to_array(lower(" + SPACED.format(x="translate(x, '._', '  ')") + "), ' +'), lambda w: w <> ''), '|') END")
on_markdown("str3_heading_level", T.heading_level, "CASE WHEN length(regexp_extract(trim(x), '^(#*)', 1)) = 0 THEN 1000 ELSE length(regexp_extract(trim(x), '^(#*)', 1))::INT END")
on_markdown("str3_heading_title", T.heading_title, "trim(substr(x, length(regexp_extract(trim(x), '^(#*)', 1)) + 1))")
on_markdown("str4_first_line_title", T.first_line_title, "CASE WHEN starts_with(trim(x), '#') THEN trim(split_part(regexp_replace(trim(x), '^#+', ''), chr(10), 1)) ELSE '' END")
on_markdown("str5_strip_tags", T.strip_tags, "regexp_replace(x, '<.*?>', '', 'g')")
on_markdown("str6_question_tags", T.strip_question_tags, r"regexp_replace(regexp_replace(regexp_replace(x, 'Q\d+\.\d+', ' ', 'g'), 'Problem \d+\.\d+', ' ', 'g'), '\d+\.\d+', ' ', 'g')")
on_markdown("str7_strip_urls", T.strip_urls, r"regexp_replace(x, 'http\S+', ' ', 'g')")
on_markdown("str8_links_to_text", T.links_to_text, r"regexp_replace(x, '\[([^]]+)\]\(\s*(http[s]?://[^)]+)\s*\)', '\1', 'g')")
on_markdown("str9_strip_images", T.strip_images, "regexp_replace(x, '(?is)<img.*?>', '', 'g')")
CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(regexp_replace(x, '[#`*]', '', 'g'), '!'), '&nbsp;', ''),
 '\[([^]]+)\]\(\s*(http[s]?://[^)]+)\s*\)', '\1', 'g'), 'http\S+', ' ', 'g'), '(?is)<img.*?>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"""
on_markdown("str10_clean_markdown", T.clean_markdown, CLEAN)
on_markdown("str11_code_fragments", lambda x: F.array_join(T.code_fragments(x), "|"), "array_to_string(list_filter(list_transform(regexp_extract_all(x, '`([^`]*)`', 1), lambda c: trim(c)), lambda c: c <> ''), '|')")
DROP_NUMBERS = r"array_to_string(list_transform(regexp_split_to_array({x}, '\s+'), lambda w: regexp_replace(w, '^\D*\d+\D*(\.)?\D*$', '')), ' ')"
PUNCT = r"""regexp_replace(regexp_replace(x, '<.*?>', '', 'g'), '[!"#$%&''()*+,\-/:;<=>?@\[\\\]^_`{|}~]', ' ', 'g')"""
on_markdown("str12_clean_step", T.clean_step, "lower(" + SPACED.format(x="array_to_string(list_filter(regexp_split_to_array(replace(" + DROP_NUMBERS.replace("{x}", PUNCT) + ", '.', ' '), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$') AND NOT (regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]'))), ' ')") + ")")
on_markdown("str13_drop_step_numbers", T.drop_step_numbers, DROP_NUMBERS.replace("{x}", "x"))
on_markdown("str14_letter_and_digit", T.has_letter_and_digit, "regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')")


def chain(source, *steps):
    """SQL that applies expressions of x one after the other."""
    parts = [f"s0 AS (SELECT src, id, pos, x FROM {source})"] + [f"s{k + 1} AS (SELECT src, id, pos, {e} AS x FROM s{k})" for k, e in enumerate(steps)]
    return "WITH " + ", ".join(parts) + f" SELECT src, id, pos, x AS y FROM s{len(steps)}"


@query("str15_strip_affixes", chain(LINES, "lower(x)", *[f"regexp_replace(x, '{p}', '')" for p in (
    "^lab ", " lab$", "^points ", " points$", "^point ", " point$", "^problem ", "^question ", "^part ", " solution$", " solutions$")]))
def str15(spark, sf):
    return lines(spark, sf).select("src", "id", "pos", T.strip_affixes(F.lower("x")).alias("y"))


@query("str16_clean_query", chain(
    LINES, r"regexp_replace(regexp_replace(x, '<.*?>', '', 'g'), '\(\d+ points\)', '', 'g')",
    "CASE WHEN starts_with(trim(x), '#') THEN trim(split_part(regexp_replace(trim(x), '^#+', ''), chr(10), 1)) ELSE '' END", CLEAN, DROP_NUMBERS.replace("{x}", "x"),
    r"trim(regexp_replace(replace(x, '(TODO)', ' '), '[\x22\x27]', ' ', 'g'))", "translate(replace(x, '(1.0 point)', ' '), '-', ' ')",
    r"regexp_replace(regexp_replace(regexp_replace(x, 'Q\d+\.\d+', ' ', 'g'), 'Problem \d+\.\d+', ' ', 'g'), '\d+\.\d+', ' ', 'g')", r"trim(regexp_replace(x, '[.!=–\x22\\$|\x27:)(\[\]}{]', ' ', 'g'))",
    *[f"trim(regexp_replace(x, '^{w} ', ''))" for w in ("COGS", "Exercise", "Aside", "Week", "Assignment", "Assignments", "Sheet")], r"lower(trim(regexp_replace(x, '\s+', ' ', 'g')))"))
def str16(spark, sf):
    return lines(spark, sf).select("src", "id", "pos", T.clean_query(F.col("x")).alias("y"))


on_markdown("str17_question_intent", T.intent_of_question, "trim(split_part(string_split(string_split(x, 'Question')[-1], ':')[-1], '(', 1))")
on_markdown("str18_html_residue", T.html_residue, "trim(translate(split_part(regexp_replace(x, '<dl.*?>', '', 'g'), chr(10), 1), '#¶', ''))")
on_markdown("str19_predicate", T.predicate_of, "translate(translate(lower(trim(x)), '()', ''), ' ', '_')")
on_markdown("str29_generalised", T.generalised, """CASE WHEN regexp_matches(x, '(?is)^convert .+? to .+$') THEN 'convert D1 to D2' WHEN regexp_matches(x, '(?is)^function to do .+$') THEN 'function to do X'
 WHEN regexp_matches(x, '(?is)^compute .+$') THEN 'compute S' WHEN regexp_matches(x, '(?is)^create .+$') THEN 'create D' WHEN regexp_matches(x, '(?is)^copy .+$') THEN 'copy D' WHEN regexp_matches(x, '(?is)^populate .+$') THEN 'populate D'
 WHEN regexp_matches(x, '(?is)^iterate over .+$') THEN 'iterate over D' WHEN lower(x) = 'data filtering conditison' THEN 'data filtering' ELSE x END""")


@query("str30_compound_parts", f"""WITH x AS (SELECT DISTINCT lower(x) AS label FROM {LINES} WHERE x <> ''),
c AS (SELECT label, instr(label, ' to ') AS o, CASE WHEN contains(label, ' & ') THEN string_split(label, ' & ') ELSE string_split(label, ' and ') END AS b FROM x WHERE contains(label, ' to ') OR contains(label, ' and ')),
p AS (SELECT label, CASE WHEN o > 0 THEN substr(label, 1, o - 1) ELSE '' END AS a1, CASE WHEN o > 0 THEN substr(label, o + 4) ELSE '' END AS a2, CASE WHEN len(b) = 2 THEN b[1] ELSE '' END AS b1, CASE WHEN len(b) = 2 THEN b[2] ELSE '' END AS b2 FROM c),
k AS (SELECT *, (a1 IN (SELECT label FROM x) OR a2 IN (SELECT label FROM x)) AS t, (b1 IN (SELECT label FROM x) OR b2 IN (SELECT label FROM x)) AS n FROM p)
SELECT x.label, CASE WHEN a1 IS NULL THEN x.label WHEN t THEN a1 || '|' || a2 WHEN n THEN b1 || '|' || b2 WHEN {{a1}} AND {{a2}} THEN a1 || '|' || a2 WHEN {{b1}} AND {{b2}} THEN b1 || '|' || b2 ELSE x.label END AS parts FROM x LEFT JOIN k USING (label)""".format(
    **{c: rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')) > 2" for c in ("a1", "a2", "b1", "b2")}))
def str30(spark, sf):
    return T.compound_parts(lines(spark, sf).select(F.lower("x").alias("label"))).select("label", F.array_join("parts", "|").alias("parts"))


on_markdown("str31_until_stop", lambda x: T.until_stop(x, ["(", ":", "<i>"]),
            "CASE WHEN list_min(list_filter([instr(x, '('), instr(x, ':'), instr(x, '<i>')], lambda p: p > 0)) IS NULL THEN x ELSE substr(x, 1, list_min(list_filter([instr(x, '('), instr(x, ':'), instr(x, '<i>')], lambda p: p > 0)) - 1) END")

def on_code(name, column, sql):
    """A query of one text a code cell; `sql` is of x."""

    @query(name, f"SELECT nb_id, pos, {sql} AS y FROM (SELECT nb_id, pos, code AS x FROM {derived.CODE_SQL})")
    def q(spark, sf):
        return derived.code_cells(spark, sf).select("nb_id", "pos", column(F.col("code")).alias("y"))

    return q


on_code("str33_docstring_types", lambda x: F.array_join(T.docstring_types(x), "|"),
        r"array_to_string(list_transform(list_zip(regexp_extract_all(x, '(\w+)\s*\(([^)]+)\)\s*:', 1), regexp_extract_all(x, '(\w+)\s*\(([^)]+)\)\s*:', 2)), lambda p: p[1] || ':' || p[2]), '|')")
on_code("str23_without_comments", T.without_comments, """regexp_replace(x, '("(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*'')|//[^\\n]*|(?s:/\\*.*?\\*/)', '\\1', 'g')""")
on_code("str24_print_to_call", T.print_to_call, r"regexp_replace(x, '(?m)^([ \t]*)print[ \t]+([^\n]+?)[ \t]*$', '\1print(\2)', 'g')")
on_code("str25_drop_magics", T.drop_magics, "array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches(trim(l), '^[!%]')), chr(10))")
on_code("str25_magics_to_pass", lambda x: T.drop_magics(x, True), "array_to_string(list_transform(string_split(x, chr(10)), lambda l: CASE WHEN regexp_matches(trim(l), '^[!%]') THEN regexp_extract(l, '^( *)', 1) || 'pass' ELSE l END), chr(10))")
on_code("str27_line_count", T.n_lines, "len(list_filter(string_split(x, chr(10)), lambda l: trim(l) <> ''))::INT")


def on_documents(name, column, sql):
    @query(name, f"SELECT doc_id, {sql} AS y FROM documents")
    def q(spark, sf):
        return read(spark, sf, "documents").select("doc_id", column(F.col("text")).alias("y"))

    return q


on_documents("str20_token_count", lambda x: F.size(T.tokens(x)), "len(regexp_extract_all(lower(text), '[a-z]+'))::INT")
on_documents("str35_context_of_word", lambda x: F.array_join(T.around(F.split(x, " "), F.lit(7), 3), " "), "array_to_string(string_split(text, ' ')[5:11], ' ')")
on_documents("str36_ascii_only", T.ascii_only, r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')")
on_documents("str28_token_distinct", lambda x: F.size(F.array_distinct(T.tokens(x, r"\S+"))), r"len(list_distinct(regexp_extract_all(lower(text), '\S+')))::INT")

TEXT_PAGES = "regexp_replace(html, '<.*?>', '', 'g')"


@query("str5_page_text_length", f"SELECT page_id, length({TEXT_PAGES}) AS n FROM pages")
def page_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.length(T.strip_tags(F.col("html"))).cast("long").alias("n"))


#: Texts of numbers by kind, one an order.
METRICS = ["{p}.5%", "1,{c}.25", "{c}M", "{c}.5 ± 0.2", "N/A", "{p} (top-1)", "{c}k", "1.{c}.3", "-", "{p}", "{c}B", "", "{c}MB", "{p}M+", "1:{c}", "{c}e", "{c},5 (a,b)"]
WITH_DELTA = ["{c}.5 ± 0.25", "{p}% ± 1%", "{p}", "1,{p} ± 2", "1±{c}±3"]
SEVERAL = ["{c}/3", "2 x {c} x 4", "10|{c}|{p}"]


def metric_cells(spark, sf, templates):
    return derived.orders(spark, sf).select("nb_id", "pos", derived.filled(templates).alias("x"))


def lenient_sql(x):
    t = f"replace(trim({x}), ',', '')"
    return f"TRY_CAST(split_part({t}, '.', 1) || '.' || replace(regexp_replace({t}, '^[^.]*\\.?', ''), '.', '') AS DOUBLE)"


@query("num1_lenient_number", f"SELECT nb_id, pos, {lenient_sql('x')} AS y FROM (SELECT nb_id, pos, {derived.filled_sql(METRICS)} AS x FROM {derived.ORDERS_SQL})")
def num1(spark, sf):
    return metric_cells(spark, sf, METRICS).select("nb_id", "pos", N.lenient(F.col("x")).alias("y"))


@query("num2_value_and_delta", f"""SELECT nb_id, pos, (CASE pos % 5 WHEN 0 THEN c + 0.5 WHEN 1 THEN p WHEN 3 THEN ('1' || p)::DOUBLE END)::DOUBLE AS value,
(CASE pos % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 1 WHEN 3 THEN 2 END)::DOUBLE AS delta FROM {derived.ORDERS_SQL}""")
def num2(spark, sf):
    return metric_cells(spark, sf, WITH_DELTA).select("nb_id", "pos", N.value_and_delta(F.col("x")).alias("v")).select("nb_id", "pos", "v.value", "v.delta")


@query("num3_metric_number", f"""SELECT nb_id, pos, (CASE pos % 17 WHEN 0 THEN p + 0.5 WHEN 1 THEN ('1' || c || '.25')::DOUBLE WHEN 2 THEN c * 1e6 WHEN 3 THEN c + 0.5 WHEN 5 THEN p WHEN 6 THEN c * 1e3 WHEN 7 THEN ('1.' || c || '3')::DOUBLE
WHEN 9 THEN p WHEN 10 THEN c * 1e9 WHEN 12 THEN c * 1e6 WHEN 13 THEN p * 1e6 WHEN 14 THEN ('1.' || c)::DOUBLE WHEN 15 THEN c WHEN 16 THEN (c || '5')::DOUBLE END)::DOUBLE AS y,
(CASE WHEN pos % 17 = 3 THEN 0.2 END)::DOUBLE AS delta FROM {derived.ORDERS_SQL}""")
def num3(spark, sf):
    """The number, and what follows a plus-minus sign."""
    x = F.col("x")
    return metric_cells(spark, sf, METRICS).select("nb_id", "pos", N.metric(x).alias("y"), F.when(x.contains("±"), N.value_and_delta(x)["delta"]).alias("delta"))


@query("num4_metric_values", f"""SELECT nb_id, pos, [2, 1, 3][pos % 3 + 1]::INT AS n, (CASE pos % 3 WHEN 0 THEN c + 3 WHEN 1 THEN 8 * c ELSE 10 + c + p END)::DOUBLE AS total FROM {derived.ORDERS_SQL}""")
def num4(spark, sf):
    values = N.metric_values(F.col("x"))
    return metric_cells(spark, sf, SEVERAL).select("nb_id", "pos", F.size(values).alias("n"), F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("num6_vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def num6(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(N.norm(F.col("embedding")), 6).alias("norm"))


@query("num7_padded", "SELECT doc_id, array_to_string(list_resize(w[1:12], 12, '<pad>'), ' ') AS y FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)")
def num7(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(N.padded(T.tokens(F.col("text")), 12, F.lit("<pad>")), " ").alias("y"))


VOCAB = """WITH w AS (SELECT doc_id, i, t[i] AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i)),
v AS (SELECT word, count(*) AS n, min(doc_id * 1000000 + i) AS first FROM w GROUP BY word), top AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, first, word)::INT AS id FROM v ORDER BY id LIMIT 998) """


def words(spark, sf):
    w = read(spark, sf, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "word"))
    return w.withColumn("i", F.col("i") + 1).withColumn("at", F.col("doc_id") * 1000000 + F.col("i"))


@query("agg23_vocabulary", VOCAB + "SELECT word, n, id FROM top")
def agg23(spark, sf):
    return A.vocabulary(words(spark, sf), "word", "at", 1000)


@query("num8_word_ids", VOCAB + "SELECT doc_id, string_agg(coalesce(id, 999), ' ' ORDER BY i) AS ids FROM w LEFT JOIN top USING (word) WHERE i <= 20 GROUP BY doc_id")
def num8(spark, sf):
    w = words(spark, sf)
    ids = A.vocabulary(w, "word", "at", 1000).select("word", "id")
    out = w.where("i <= 20").join(F.broadcast(ids), "word", "left")  # at most the vocabulary's size
    seq = F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("id", F.lit(999)).alias("id")))), lambda x: x["id"].cast("string"))
    return out.groupBy("doc_id").agg(F.array_join(seq, " ").alias("ids"))


@query("agg1_value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def agg1(spark, sf):
    return A.value_counts(read(spark, sf, "documents"), "lang", "source")


@query("agg5_counts_by_rank", "SELECT turn, role, count(*) AS n FROM conversations GROUP BY turn, role")
def agg5(spark, sf):
    return A.value_counts(read(spark, sf, "conversations"), "turn", "role")


@query("agg6_without_everywhere", """WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 12000 GROUP BY source, lang)
SELECT source, lang, n FROM n WHERE lang NOT IN (SELECT lang FROM n GROUP BY lang HAVING count(*) = (SELECT count(DISTINCT source) FROM n))""")
def agg6(spark, sf):
    return A.without_everywhere(read(spark, sf, "documents").where("n_chars > 12000"), "source", "lang")


@query("agg7_grouped_records", "SELECT source, count(*) AS n, string_agg(doc_id, ' ' ORDER BY doc_id) AS members FROM documents GROUP BY source")
def agg7(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_join(ids, " ").alias("members"))


@query("agg8_titles_by_level", f"SELECT length(regexp_extract(trim(md), '^(#*)', 1))::INT AS level, count(*) AS n FROM {derived.MARKDOWN_SQL} WHERE starts_with(md, '#') GROUP BY level")
def agg8(spark, sf):
    return derived.markdown_cells(spark, sf).where(F.col("md").startswith("#")).groupBy(T.heading_level(F.col("md")).alias("level")).agg(F.count("*").alias("n"))


@query("agg9_bag_of_words", "SELECT conv_id, w AS word, count(*) AS n FROM conversations, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t(w) GROUP BY conv_id, w")
def agg9(spark, sf):
    w = read(spark, sf, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"), "[a-z]{4,}")).alias("word"))
    return A.value_counts(w, "conv_id", "word")


@query("agg13_key_frequency", "SELECT unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY key")
def agg13(spark, sf):
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return read(spark, sf, "events").select(keys).groupBy("key").agg(F.count("*").alias("n"))


@query("agg14_turn_statistics", r"""WITH x AS (SELECT conv_id, turn, role, role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS change,
 len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> ''))::INT AS n FROM conversations)
SELECT conv_id, count(*) AS n_turns, coalesce(sum(change::INT), 0)::BIGINT AS changes, count(DISTINCT role) AS n_speakers, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS sd_words,
 round(median(n), 6) AS median_words, min(n) AS min_words, max(n) AS max_words FROM x GROUP BY conv_id""")
def agg14(spark, sf):
    return A.turn_statistics(read(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("agg2_summary", "SELECT round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars, sum(n_chars)::BIGINT AS total, round(100.0 * sum((lang = 'en')::INT) / count(*), 6) AS pct_en FROM documents")
def agg2(spark, sf):
    return read(spark, sf, "documents").agg(
        F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"), F.sum("n_chars").alias("total"),
        F.round(100.0 * F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("pct_en"))


@query("agg17_word_distribution", "SELECT w AS word, count(*) AS n FROM documents, unnest(regexp_extract_all(lower(text), '[a-z]{2,15}')) AS t(w) WHERE w NOT IN ('the', 'and', 'of', 'to') GROUP BY w")
def agg17(spark, sf):
    stop = spark.createDataFrame([("the",), ("and",), ("of",), ("to",)], "word string")
    w = read(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"), "[a-z]{2,15}")).alias("word"))
    return A.value_counts(w, "word").join(F.broadcast(stop), "word", "left_anti")  # a fixed list


@query("agg18_groups_with_any", "SELECT source, bool_or(n_chars > 8000) AS any_long, sum((n_chars > 8000)::INT)::BIGINT AS n_long, count(*) AS n FROM documents GROUP BY source")
def agg18(spark, sf):
    long = F.col("n_chars") > 8000
    return read(spark, sf, "documents").groupBy("source").agg(F.bool_or(long).alias("any_long"), F.count_if(long).alias("n_long"), F.count("*").alias("n"))


VOTES = """WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id, event_type),
b AS (SELECT user_id, event_type AS label, n AS votes FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1) """


@query("agg19_majority_with_unknown", VOTES + "SELECT user_id, CASE WHEN votes < 20 THEN 'U' ELSE label END AS label, votes FROM b")
def agg19(spark, sf):
    return A.majority(read(spark, sf, "events"), "user_id", "event_type", "event_id", 20)


@query("agg20_mode_label", VOTES + "SELECT user_id, label, votes FROM b")
def agg20(spark, sf):
    return A.majority(read(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("agg21_mode_length", "SELECT n_turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) GROUP BY n_turns ORDER BY n DESC, n_turns LIMIT 1")
def agg21(spark, sf):
    n = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return n.groupBy("n_turns").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_turns").limit(1)


@query("agg12_best_by_group", "SELECT source, arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id, max(n_chars) AS best FROM documents GROUP BY source")
def agg12(spark, sf):
    return A.best_by(read(spark, sf, "documents"), "source", "doc_id", F.col("n_chars"), F.col("doc_id"))


@query("agg24_running_accuracy", "SELECT round(sum((quality = toxic)::INT * 2.0) / sum(2.0), 6) AS accuracy, count(*) AS n FROM labels")
def agg24(spark, sf):
    return A.running_accuracy(read(spark, sf, "labels"), F.col("quality") == F.col("toxic"), F.lit(2.0))


@query("agg25_percent", "SELECT round(100.0 * sum((toxic = 1)::INT) / count(*), 6) AS pct FROM labels")
def agg25(spark, sf):
    return read(spark, sf, "labels").agg(F.round(100.0 * F.count_if(F.col("toxic") == 1) / F.count("*"), 6).alias("pct"))


@query("agg26_shares", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def agg26(spark, sf):
    return A.shares(read(spark, sf, "documents"), "lang")


@query("flt6_labels_with_fallback", "SELECT DISTINCT coalesce(nullif(trim(CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END), ''), 'orig-' || user_id) AS op FROM events WHERE event_type <> 'error'")
def flt6(spark, sf):
    human = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    op = F.coalesce(F.nullif(F.trim(human), F.lit("")), F.concat(F.lit("orig-"), F.col("user_id")))
    return read(spark, sf, "events").where("event_type <> 'error'").select(op.alias("op")).distinct().orderBy("op")


@query("flt11_without_empty", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::INT AS n FROM documents")
def flt11(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n"))


@query("flt12_confident", "SELECT event_id, event_type FROM events WHERE value > 80")
def flt12(spark, sf):
    return read(spark, sf, "events").where("value > 80").select("event_id", "event_type")


@query("flt13_keep_and_remove", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS ops FROM events WHERE event_type IN ('view', 'click', 'error') AND event_type NOT IN ('error') GROUP BY user_id")
def flt13(spark, sf):
    ops = read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("ops"))
    op = ops.select("user_id", F.explode(F.split("ops", ";")).alias("op")).where(F.col("op").isin("view", "click", "error") & ~F.col("op").isin("error"))
    return op.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("op")), ";").alias("ops"))


@query("flt14_first_rows", "SELECT item_id, text FROM benchmark WHERE item_id < 10")
def flt14(spark, sf):
    return read(spark, sf, "benchmark").where("item_id < 10").select("item_id", "text")


@query("flt16_words_and_members", r"SELECT conv_id, turn FROM conversations WHERE text <> '' AND len(regexp_split_to_array(text, '\s+')) <= 25 AND contains(text, 'the')")
def flt16(spark, sf):
    short = (F.col("text") != "") & (F.size(F.split("text", r"\s+")) <= 25) & F.col("text").contains("the")
    return read(spark, sf, "conversations").where(short).select("conv_id", "turn")


@query("flt17_last_writer", "SELECT user_id, min(event_id) AS first_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def flt17(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max_by("event_type", "event_id").alias("event_type"))
