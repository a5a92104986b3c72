"""Reading and writing the formats that corpora come in, with explicit schemas."""

from __future__ import annotations

import io
import json
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, cutoff: int | None = None) -> DataFrame:
    out = spark.read.schema(schema).json(path)
    return out.limit(cutoff) if cutoff is not None else out


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON objects of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_object(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias("key", "value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def json_field(column: str, path: str):
    return F.get_json_object(column, path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(sub, rel, obj): entity ids of the lines of an N-Triples dump that link two entities by a direct property."""
    pattern = r"^<[^>]*/entity/(Q\d+)> <[^>]*/prop/direct/(P\d+)> <[^>]*/entity/(Q\d+)> \.$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("sub"), part(2).alias("rel"), part(3).alias("obj"))


def read_chat_log(spark: SparkSession, path: str, me: str = "me", name: str = "Wizard") -> DataFrame:
    """(speaker, utterance) of the lines `Name says:utterance`."""
    x = spark.read.text(path).where(F.contains("value", F.lit("says:")))
    who = F.trim(F.split_part("value", F.lit("says:"), F.lit(1)))
    said = F.trim(F.regexp_replace("value", "^.*?says:", ""))
    return x.select(F.when(who == me, name).otherwise(who).alias("speaker"), said.alias("utterance"))


def read_captions(spark: SparkSession, path: str, sep: str = ", ") -> DataFrame:
    """(fid, text) of `fid<sep>text` lines, sentence marks dropped."""
    x = spark.read.text(path).select(F.split("value", sep, 2).alias("p")).where(F.size("p") == 2)
    return x.select(F.trim(F.get("p", F.lit(0))).cast("long").alias("fid"), F.trim(F.regexp_replace(F.get("p", F.lit(1)), "</?s>", "")).alias("text"))


def read_notebook_archives(spark: SparkSession, path: str) -> DataFrame:
    return cells_of_archives(spark.read.format("binaryFile").load(path))


def cells_of_archives(files: DataFrame) -> DataFrame:
    """(path, pos, cell_type, content) of the notebooks in tar files; one that can't be read gives no row."""
    def cells(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                        for m in tar:
                            if m.name.endswith(".ipynb"):
                                for c in json.load(tar.extractfile(m)).get("cells", []):
                                    rows.append((p, len(rows), c.get("cell_type"), "".join(c.get("source", []))))
                except (tarfile.TarError, ValueError, OSError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "pos", "cell_type", "content"])

    return files.select("path", "content").mapInPandas(cells, "path string, pos int, cell_type string, content string")


def write_new(df: DataFrame, path: str, fmt: str = "json", **options) -> None:
    """Write a table, unless something is there already."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


def grouped_objects(df: DataFrame, key: str) -> DataFrame:
    """One row a key with the list of its rows, ready to be written as JSON."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))


def notebook_json(cells: DataFrame) -> DataFrame:
    """(nb_id, notebook): cells as a notebook file's text."""
    cell = F.struct(F.col("pos"), F.col("cell_type"), F.array("content").alias("source"))
    empty = F.create_map().cast("map<string,string>").alias("metadata")
    listed = F.transform(F.sort_array(F.collect_list(cell)), lambda c: F.struct(c["cell_type"].alias("cell_type"), empty, c["source"].alias("source")))
    book = F.struct(listed.alias("cells"), F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"))
    return cells.groupBy("nb_id").agg(F.to_json(book).alias("notebook"))


def printed_context(cells: DataFrame) -> DataFrame:
    """(nb_id, text): code as it is, markdown lines after `# `, other cells left out."""
    line = F.when(F.col("cell_type") == "markdown", F.concat(F.lit("# "), F.replace("content", F.lit("\n"), F.lit("\n# ")))).when(F.col("cell_type") == "code", F.col("content"))
    parts = F.transform(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("t"))))), lambda c: c["t"])
    return cells.groupBy("nb_id").agg(F.array_join(parts, "\n").alias("text"))


def read_shards(spark: SparkSession, paths: str, ddl: str, expect: str) -> tuple[DataFrame, DataFrame]:
    """JSON Lines files of a glob, line by line: the rows that parse and meet an expectation (SQL), and the others.

    Good rows have `ddl`'s columns, file (its name) and line (from 1); bad ones file, line, text and reason ('parse' or
    'expectation', an unknown outcome being one). Together they are all lines. Lines are numbered inside the blocks that files are
    read in and shifted by the counts of the blocks before, so a large file is read by many tasks.
    """
    raw = spark.read.text(paths).select(
        F.col("value"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.withColumn("nth", F.row_number().over(W.partitionBy("file", "block").orderBy("at"))).join(sizes.select("file", "block", before.alias("before")), ["file", "block"])
    numbered = numbered.select("value", "file", (F.col("before") + F.col("nth")).alias("line"))
    parsed = numbered.withColumn("row", F.from_json("value", f"{ddl}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    names = spark.createDataFrame([], ddl).columns
    flat = parsed.select("value", "file", "line", F.coalesce(F.col("row._broken").isNotNull() | F.col("row").isNull(), F.lit(True)).alias("__broken"), *[F.col(f"row.{n}").alias(n) for n in names])
    met = F.coalesce(F.expr(expect), F.lit(False))
    good = flat.where(~F.col("__broken") & met).select(*names, "file", "line")
    reason = F.when(F.col("__broken"), "parse").otherwise("expectation")
    return good, flat.where(F.col("__broken") | ~met).select("file", "line", F.col("value").alias("text"), reason.alias("reason"))
