"""Source and sink queries: tables are written out, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbago.runtime import scratch
from plumbago.sources import files

from .cells import WITH, cells
from .registry import query, read


@query("src1_snk1_jsonl", "SELECT doc_id, n_chars, lang FROM documents")
def jsonl(spark, sf):
    path = scratch(spark, "docs.jsonl")
    files.write_new(read(spark, sf, "documents").select("doc_id", "n_chars", "lang"), path)
    return files.read_jsonl(spark, path, "doc_id long, n_chars long, lang string")


@query("src2_tolerant_jsonl", "SELECT doc_id AS a FROM documents WHERE doc_id % 3 <> 0")
def tolerant(spark, sf):
    path = scratch(spark, "bad")
    line = F.to_json(F.struct(F.col("doc_id").alias("a"), "text"))
    cut = F.when(F.col("doc_id") % 3 == 0, F.substring(line, 1, 5)).otherwise(line)  # lines cut off
    read(spark, sf, "documents").select(cut.alias("value")).write.text(path)
    return files.read_jsonl_tolerant(spark, path, "a long").where("a is not null")


@query("src3_rows_by_id", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8)")
def by_id(spark, sf):
    ids = spark.createDataFrame([(3,), (5,), (8,)], "doc_id long")
    return read(spark, sf, "documents").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang")  # a fixed list


@query("src4_json_object", "SELECT n_name AS key, n_nationkey AS n FROM nation")
def whole(spark, sf):
    path = scratch(spark, "object")
    one = F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").alias("n"))))))  # one object is the feature
    read(spark, sf, "nation").agg(F.replace(one, F.lit("},"), F.lit("},\n ")).alias("value")).write.text(path)
    return files.read_json_object(spark, path, "struct<n:int>").select("key", "value.n")


@query("src5_src10_csv", "SELECT item_id, text FROM benchmark")
def csv(spark, sf):
    path = scratch(spark, "b.csv")
    files.write_new(read(spark, sf, "benchmark"), path, "csv", header=True, escape='"')
    return files.read_csv(spark, path, "item_id long, text string")


@query("src6_json_in_column", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_column(spark, sf):
    return read(spark, sf, "events").select("event_id", files.json_field("props", "$.k").cast("long").alias("k"))


@query("src8_n_triples", "SELECT 'Q' || o_orderkey AS sub, 'P31' AS rel, 'Q' || o_custkey AS obj FROM orders")
def triples(spark, sf):
    path = scratch(spark, "nt")
    sub = F.concat(F.lit("<http://w/entity/Q"), F.col("o_orderkey").cast("string"), F.lit("> "))
    edge = F.concat(sub, F.lit("<http://w/prop/direct/P31> <http://w/entity/Q"), F.col("o_custkey").cast("string"), F.lit("> ."))
    label = F.concat(sub, F.lit('<http://s/label> "'), "o_orderpriority", F.lit('"@en .'))
    read(spark, sf, "orders").select(F.explode(F.array(edge, label)).alias("value")).write.text(path)
    return files.read_triples(spark, path)


@query("src9_notebook_archives", "SELECT 0 AS pos, 'code' AS cell_type, 'x = 1' AS content")
def archives(spark, sf):
    import base64
    import io
    import json
    import tarfile

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        body = json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1"]}]}).encode()
        info = tarfile.TarInfo("a.ipynb")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    data = base64.b64encode(buffer.getvalue()).decode()
    one = spark.createDataFrame([("a", data)], "path string, content string").select("path", F.unbase64("content").alias("content"))
    path = scratch(spark, "archives")
    one.write.parquet(path)
    return files.cells_of_archives(spark.read.parquet(path)).select("pos", "cell_type", "content")


@query("src11_chat_log", "SELECT CASE WHEN user_id % 7 = 0 THEN 'Wizard' ELSE 'u' || user_id END AS speaker, event_type || ': ' || event_id AS utterance FROM events WHERE event_id % 5 <> 0")
def chat(spark, sf):
    path = scratch(spark, "chat")
    who = F.when(F.col("user_id") % 7 == 0, "me").otherwise(F.concat(F.lit("u"), "user_id"))
    said = F.concat(who, F.lit(" says: "), "event_type", F.lit(": "), "event_id", F.lit(" "))
    read(spark, sf, "events").select(F.when(F.col("event_id") % 5 == 0, "noise").otherwise(said).alias("value")).write.text(path)
    return files.read_chat_log(spark, path)


@query("src12_captions", "SELECT event_id AS fid, event_type || ', the data' AS text FROM events WHERE event_id % 5 <> 0")
def captions(spark, sf):
    path = scratch(spark, "captions")
    line = F.concat("event_id", F.lit(", <s> "), "event_type", F.lit(", the data </s>"))
    read(spark, sf, "events").select(F.when(F.col("event_id") % 5 == 0, "none").otherwise(line).alias("value")).write.text(path)
    return files.read_captions(spark, path)


@query("src13_column_extract", "SELECT text FROM benchmark")
def column(spark, sf):
    return read(spark, sf, "benchmark").select("text")


@query("snk2_grouped_objects", "SELECT source, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def grouped(spark, sf):
    path = scratch(spark, "grouped")
    files.write_new(files.grouped_objects(read(spark, sf, "documents").select("source", "doc_id"), "source"), path)
    back = files.read_jsonl(spark, path, "source string, rows array<struct<doc_id:long>>")
    return back.select("source", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["doc_id"].cast("string")), ",").alias("ids"))


@query("snk5_notebook_json", WITH + "SELECT nb_id, count(*) AS n, min_by(cell_type, pos) AS first_type FROM c GROUP BY nb_id")
def notebook(spark, sf):
    book = files.notebook_json(cells(spark, sf)).withColumn("cells", F.from_json("notebook", "cells array<struct<cell_type:string,source:array<string>>>")["cells"])
    return book.select("nb_id", F.size("cells").cast("long").alias("n"), F.get("cells", F.lit(0))["cell_type"].alias("first_type"))


@query("snk7_printed_context", WITH + "SELECT nb_id, coalesce(string_agg(CASE cell_type WHEN 'markdown' THEN '# ' || replace(content, chr(10), chr(10) || '# ') WHEN 'code' THEN content END, chr(10) ORDER BY pos), '') AS text FROM c GROUP BY nb_id")
def printed(spark, sf):
    return files.printed_context(cells(spark, sf))
