"""Line dedup over content-defined chunks of lines.

A rolling hash over the last two line hashes says where a chunk of lines ends,
so boundaries depend on nearby lines alone and find their place again after an
insertion. Chunks of two or more lines that occur more than once in the corpus
are removed but for their first occurrence, after a comparison of their bytes.

Chunks miss the head and tail of a shared passage, and most short passages. With
`passages`, every two adjacent lines are a chunk instead: a line goes if a chunk
over it has an earlier occurrence, so all lines of repeated passages are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_flag, bit_table, drop, give_back, has_bit, named, slices, table, texts_of, tune

NO_ID = (1 << 63) - 1


def chunks(text: bytes, modulus: int = 4) -> list[list[bytes]]:
    """Chunks of `\\n`-split lines: a line ends one if its hash plus that of the line before is 0 modulo `modulus`.

    A line's hash is the first 32 bits of its MD5; before the first line it is 0.
    """
    out, now, before = [], [], 0
    for line in text.split(b"\n"):
        h = int.from_bytes(hashlib.md5(line, usedforsecurity=False).digest()[:4], "big")
        now.append(line)
        if (h + before) % modulus == 0:
            out.append(now)
            now = []
        before = h
    if now:
        out.append(now)
    return out


def _bodies(text: bytes, modulus: int, passages: bool) -> list[tuple[int, bytes]]:
    """(number, bytes) of each chunk of two or more lines; with `passages`, of every two adjacent lines, by the first one's number."""
    if passages:
        x = text.split(b"\n")
        return [(j, b"\n".join(pair)) for j, pair in enumerate(zip(x, x[1:]))]
    return [(j, b"\n".join(c)) for j, c in enumerate(chunks(text, modulus)) if len(c) > 1]


def _hashes(body: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(body), xxhash.xxh64_intdigest(body, 1)


def _removed(df: DataFrame, modulus: int, max_filter_bits: int, passages: bool) -> DataFrame:
    """(doc, th, gone) as a table: chunks to remove, by their numbers in the text; with `passages`, lines. df: doc, th, text.

    Bytes are compared once for each chunk and Arrow batch: a batch's first
    chunk of two equal hashes carries its bytes, and chunks of two equal hashes
    are copies only if all those bytes are equal.
    """

    def count(batches):
        for batch in batches:
            h = [_hashes(body)[0] for t in texts_of(batch.column(0)) for _, body in _bodies(t, modulus, passages)]
            h, n = np.unique(np.array(h, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        give_back()

    counted = df.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = table(counted.where("n > 1").select("h"))
    shared = df.sparkSession.sparkContext.broadcast(bit_table(repeated, max_filter_bits))
    drop(repeated)

    def again(batches):
        for batch in batches:
            texts, met = texts_of(batch.column(2)), {}
            for a, b in slices(texts):
                row, at, h, h2, body = [], [], [], [], []
                for k in range(a, b):
                    for j, c in _bodies(texts[k], modulus, passages):
                        x, y = _hashes(c)
                        row.append(k)
                        at.append(j)
                        h.append(x)
                        h2.append(y)
                        body.append(c)
                h, h2 = (np.array(v, np.uint64).view(np.int64) for v in (h, h2))
                hit = np.flatnonzero(has_bit(shared.value, h))
                # bytes that the batch has sent already for these hashes are not sent again
                sent = [None if met.setdefault((x, y), c) is not c and met[x, y] == c else c for x, y, c in ((h[i], h2[i], body[i]) for i in hit)]
                row = pa.array(np.array(row, np.int64)[hit])
                cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.array(at, np.int32)[hit]), pa.array(h[hit]), pa.array(h2[hit]), pa.array(sent, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "th", "at", "h", "h2", "body"])
        give_back()

    found = table(df.select("doc", "th", "text").mapInArrow(again, "doc long, th long, at int, h long, h2 long, body binary"))
    me = F.struct("doc", "th", "at")
    first = found.groupBy("h", "h2").agg(F.min(me).alias("src"), F.count("*").alias("n"), F.min("body").alias("x"), F.max("body").alias("y"))
    # a table of its own, so that Spark can split a frequent chunk's rows in the join
    first = table(first.where("n > 1 AND x = y").select("h", "h2", "src"))
    later = found.select("doc", "th", "at", "h", "h2").join(first, ["h", "h2"]).where(me != F.col("src"))
    if passages:
        # two equal lines after the first occurrence's first line share its second line, which stays
        own = F.col("src") == F.struct("doc", "th", (F.col("at") - 1).alias("at"))
        later = later.select("doc", "th", F.explode(F.when(own, F.array(F.col("at") + 1)).otherwise(F.array("at", F.col("at") + 1))).alias("at"))
    gone = table(later.groupBy("doc", "th").agg(F.collect_set("at").alias("gone")))  # at most one a line of the document
    drop(found, first)
    return gone


def _cut(modulus: int, passages: bool, spark):
    """An Arrow function of a text and the numbers of its chunks (or lines) to remove: what is left, and how many lines went."""

    def run(texts: pa.Array, gone: pa.Array) -> pa.Array:
        new, n_removed = [], []
        for text, drop in zip(texts.cast(pa.binary()).to_pylist(), gone.to_pylist()):
            if drop:
                drop = set(drop)
                parts = [[x] for x in text.split(b"\n")] if passages else chunks(text, modulus)
                kept = [x for j, c in enumerate(parts) if j not in drop for x in c]
                n_removed.append(sum(map(len, parts)) - len(kept))
                new.append(b"\n".join(kept))
            else:
                n_removed.append(0)
                new.append(text)
        return pa.StructArray.from_arrays([pa.array(new, pa.binary()).cast(pa.string()), pa.array(n_removed, pa.int64())], ["text", "n"])

    run.__annotations__ = {"texts": pa.Array, "gone": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "text string, n long")


def _rewritten(df: DataFrame, id_col: str, text_col: str, modulus: int, max_filter_bits: int, passages: bool) -> DataFrame:
    """(row: a struct of df's columns, the text as string; text, n_lines, n_removed).

    Only documents that lose lines, and the few that a bounded filter can't
    tell from them, are shuffled and go to Python; the others pass by.
    """
    spark = df.sparkSession
    tune(spark)
    t = named(text_col).cast("string")
    doc = F.coalesce(named(id_col).cast("long"), F.lit(NO_ID))
    gone = _removed(df.select(doc.alias("doc"), F.xxhash64(t).alias("th"), t.alias("text")), modulus, max_filter_bits, passages)
    flag = bit_flag(bit_table(gone.select(F.xxhash64("doc", "th").alias("h")), max_filter_bits), spark)
    rows = df.select(F.struct(*map(named, df.columns)).alias("row"), t.alias("text"), doc.alias("doc"), F.xxhash64(t).alias("th"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = rows.withColumn("n_lines", F.coalesce(breaks + 1, F.lit(0)).cast("long")).withColumn("hit", flag(F.xxhash64("doc", "th")))
    kept = rows.where("NOT hit").select("row", "text", "n_lines", F.lit(0).cast("long").alias("n_removed"))
    cut = rows.where("hit").join(gone, ["doc", "th"], "left").withColumn("cut", _cut(modulus, passages, spark)("text", "gone"))
    return kept.union(cut.select("row", F.col("cut.text").alias("text"), "n_lines", F.col("cut.n").alias("n_removed")))


def rewrite(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, max_filter_bits: int = 1 << 27, passages: bool = False,
    n_lines: str = "__n_lines", n_removed: str = "__n_removed",
) -> DataFrame:
    """The columns of `df` with the text rewritten, then the numbers of lines and of removed lines (longs, named as given).

    Of each multi-line chunk that occurs more than once, the occurrence with
    the smallest id (then text hash, then place) stays. With `passages`, two
    adjacent lines go wherever they occurred before in that order (but for what
    they share with that first occurrence). A null text stays null
    and has no lines; an empty text is one empty line. Rows of one id and equal
    text are one document: they lose the same lines. A null id counts as the
    greatest. Empty table: empty result. Texts are read whole. Other columns
    pass through, whatever their names.
    """
    out = _rewritten(df, id_col, text_col, modulus, max_filter_bits, passages)
    cols = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    return out.select(*cols, F.col("n_lines").alias(n_lines), F.col("n_removed").alias(n_removed))


def deduplicate(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, max_filter_bits: int = 1 << 27, passages: bool = False,
    length_col: str | None = None,
) -> DataFrame:
    """As rewrite, with the columns of `df` alone; `length_col`, if df has it, becomes the new text's length (null for a null text)."""
    out = _rewritten(df, id_col, text_col, modulus, max_filter_bits, passages)
    kinds = dict(df.dtypes)
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast(kinds[length_col])} if length_col in kinds else {})
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in df.columns])
