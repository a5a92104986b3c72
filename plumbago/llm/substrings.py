"""Substring dedup by De Bruijn compaction over token k-mers.

Every window of `window` words is an edge of a De Bruijn graph over the corpus;
an edge that occurs once can't be part of a repeat. So:

1. Minimizers pick one short k-mer in each window, by content alone; those that
   occur twice are set in a bit table of bounded size (a filter: it passes all
   windows of a repeat, and few others).
2. Windows that pass become edges, counted in each batch and then over all,
   with their first source coordinate (document, start).
3. Nonbranching paths are compacted: an edge follows its predecessor if all its
   occurrences have the same word before them and both occur equally often.
   Then all occurrences of the path are whole, and its first source is a run of
   consecutive coordinates.
4. Path heads are joined with their occurrences; each gives a span, and so does
   the source. The words at a span's and at its source's coordinates are read
   again from the texts and compared by a digest of 128 bits of their bytes; a
   span whose words differ from its source's is dropped. A document's spans,
   less the source itself, are its removed words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Rolling, Words, bit_flag, bit_table, drop, give_back, has_bit, named, signed, slices, table, texts_of, tune

KMER = Rolling(0xD1342543DE82EF95)
EDGE = Rolling(0xAF251AF3B0F025B5)
NO_ID = (1 << 63) - 1
EVEN = np.uint64((1 << 64) - 2)


class _Windows:
    """Windows of a slice of texts: index of the first word, and its minimizer's k-mer hash."""

    def __init__(self, texts: list[bytes], window: int, kmer: int):
        self.words = w = Words(texts)
        n, kmer = len(w.hash), min(kmer, window)
        starts = np.arange(max(0, n - window + 1))
        self.starts = starts = starts[w.text[starts] == w.text[starts + window - 1]] if len(starts) else starts
        if len(starts):
            at = np.arange(n - kmer + 1)
            h = KMER.spans(w.hash, at, at + kmer)
            least = np.lib.stride_tricks.sliding_window_view(h, window - kmer + 1).argmin(axis=1)
            self.anchor = starts + least[starts]
            self.kmers = h
        else:
            self.anchor, self.kmers = starts, np.zeros(0, np.uint64)


def _repeated_bits(df: DataFrame, text: str, window: int, kmer: int, max_bits: int) -> np.ndarray:
    """Bit table of the minimizers that occur at least twice.

    A row is one number: the hash without its last bit, which says whether the
    minimizer was met more than once already. Each batch is counted first, so a
    passage in every document is one row a batch.
    """

    def run(batches):
        for batch in batches:
            texts, found = texts_of(batch.column(0)), []
            for a, b in slices(texts):
                x = _Windows(texts[a:b], window, kmer)
                found.append(x.kmers[np.unique(x.anchor)] & EVEN)
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h | (n > 1).astype(np.uint64)))], ["h"])

    met = df.select(F.col(text).cast("string")).mapInArrow(run, "h long")
    key = F.shiftright("h", 1)
    met = met.repartition(key).groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.max(F.col("h").bitwiseAND(F.lit(1))).alias("more"))
    repeated = met.where("n > 1 OR more = 1").select(F.shiftleft("k", 1).alias("h"))
    repeated = table(repeated)
    bits = bit_table(repeated, max_bits)
    drop(repeated)
    return bits


def _edges(df: DataFrame, window: int, kmer: int, bitmap: np.ndarray, heads: np.ndarray | None = None) -> DataFrame:
    """Windows that pass the filter; df: doc, th, text.

    Without `heads`: (h, doc, th, pos, n, prev) with one row for each window
    text of a batch: its first place, its number of occurrences, and the hash
    of the word before all of them (null where they differ, or at a text's
    start). With the bit table of path heads: (h, doc, th, pos, v), each
    occurrence of a head, with a second hash.
    """
    sc = df.sparkSession.sparkContext
    shared, wanted = sc.broadcast(bitmap), sc.broadcast(heads)
    names = ["h", "doc", "th", "pos", *(["n", "prev"] if heads is None else [])]

    def run(batches):
        for batch in batches:
            texts, parts = texts_of(batch.column(2)), []
            for a, b in slices(texts):
                x = _Windows(texts[a:b], window, kmer)
                w = x.words
                s = x.starts[has_bit(shared.value, signed(x.kmers[x.anchor] & EVEN))]
                h = signed(EDGE.spans(w.hash, s, s + window))
                if wanted.value is not None:
                    hit = has_bit(wanted.value, h)
                    s, h = s[hit], h[hit]
                t = w.text[s]
                pos = s - w.first[t]
                parts.append((h, t + a, pos, signed(w.hash[np.maximum(s - 1, 0)])))
            h, t, pos, more = (np.concatenate([p[k] for p in parts]) for k in range(4)) if parts else [np.zeros(0, np.int64)] * 4
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if wanted.value is None:
                order = np.lexsort((pos, th[t], doc[t], h))
                h, t, pos, more = h[order], t[order], pos[order], more[order]
                first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ 1)) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(h)))
                start = (pos == 0) | (more != np.repeat(more[first], n))
                other = np.add.reduceat(start.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
                h, t, pos = h[first], t[first], pos[first]
                last = [pa.array(n.astype(np.int32)), pa.array(more[first], mask=other)]
            else:
                last = []
            cols = [pa.array(h), pa.array(doc[t]), pa.array(th[t]), pa.array(pos.astype(np.int32)), *last]
            yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    kinds = {"h": "long", "doc": "long", "th": "long", "pos": "int", "n": "int", "prev": "long"}
    return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def paths(edges: DataFrame) -> DataFrame:
    """Repeated nonbranching paths: head edge h, its source (doc, th, pos), and n_edges.

    Rows are dealt out by edge before they are counted, as batches have been
    counted already and aggregation buffers would only widen what is shuffled.
    """
    counted = edges.repartition("h").groupBy("h").agg(
        F.sum("n").alias("n"),
        F.min(F.struct("doc", "th", "pos")).alias("src"),
        ((F.count("prev") == F.count("*")) & (F.min("prev") == F.max("prev"))).alias("same"),
    ).where("n > 1").select("h", "n", F.coalesce("same", F.lit(False)).alias("same"), "src.*")
    by = W.partitionBy("doc", "th").orderBy("pos")
    follows = F.col("same") & (F.lag("pos").over(by) == F.col("pos") - 1) & (F.lag("n").over(by) == F.col("n"))
    runs = counted.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    runs = runs.withColumn("run", F.sum(F.col("head").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc", "th", "run").agg(F.min_by("h", "pos").alias("h"), F.min("pos").alias("pos"), F.count("*").cast("int").alias("n_edges")).drop("run")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, th, text): the id as it is, as a number (null: the greatest), and the text's hash, which tells rows of one id apart."""
    t = named(text_col).cast("string")
    return df.select(named(id_col).alias("id"), F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(t).alias("th"), t.alias("text"))


def _of_documents(spans: DataFrame, max_filter_bits: int) -> tuple[DataFrame, object]:
    """Spans by document (doc, th, spans) as a table, and a function of (doc, th) that says which documents may be in it."""
    cols = [c for c in spans.columns if c not in ("doc", "th")]
    by = table(spans.groupBy("doc", "th").agg(F.collect_set(F.struct(*cols)).alias("spans")))  # at most one a word of the document
    flag = bit_flag(bit_table(by.select(F.xxhash64("doc", "th").alias("h")), max_filter_bits), spans.sparkSession)
    return by, flag(F.xxhash64("doc", "th"))


def _digests(docs: DataFrame, spans: DataFrame, max_filter_bits: int) -> DataFrame:
    """(doc, th, start, end, h, own, x, y) as a table: spans with a digest of the words at their coordinates.

    Repeated rows of one id and text are one document.
    """
    by, some = _of_documents(spans, max_filter_bits)

    def run(batches):
        for batch in batches:
            texts, spans = texts_of(batch.column(2)), batch.column(3)
            n = spans.value_lengths().to_numpy()
            flat = spans.flatten()
            first = np.cumsum(n) - n
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            found = []
            for k, text in enumerate(texts):
                words = text.split()
                joined, off = b" ".join(words), np.zeros(len(words) + 1, np.int64)
                np.cumsum([len(w) + 1 for w in words], out=off[1:])
                mine = slice(first[k], first[k] + n[k])
                found += [xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(off[start[mine]].tolist(), (off[end[mine]] - 1).tolist())]
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            place = pa.array(np.repeat(np.arange(len(texts)), n))
            cols = [batch.column(0).take(place), batch.column(1).take(place), *[flat.field(c) for c in ("start", "end", "h", "own")], pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "th", "start", "end", "h", "own", "x", "y"])
        give_back()

    one = docs.where(some).join(by, ["doc", "th"]).select("doc", "th", "text", "spans")
    out = table(one.mapInArrow(run, "doc long, th long, start int, end int, h long, own boolean, x long, y long").distinct())
    drop(by)
    return out


def repeated_spans(
    df: DataFrame, window: int = 20, *, id_col: str = "doc_id", text_col: str = "text", kmer: int = 6, max_filter_bits: int = 1 << 28
) -> DataFrame:
    """Maximal runs of later copies: (doc, th, start, end) in words, per document.

    A run is covered by windows whose words also start earlier (smaller id, or
    the same document, earlier). Rows with one id but different texts are told
    apart by the text's hash `th` and ordered by it; equal rows are one
    document. A null id counts as the greatest; a null text has no words. Empty
    table: empty result.
    """
    docs = keyed(df, id_col, text_col).select("doc", "th", "text")
    tune(df.sparkSession)
    bitmap = _repeated_bits(docs, "text", window, kmer, max_filter_bits)
    heads = table(paths(_edges(docs, window, kmer, bitmap)))
    at = _edges(docs, window, kmer, bitmap, bit_table(heads.select("h"), max_filter_bits))
    src = heads.select("h", F.struct("doc", "th", "pos").alias("src"), "n_edges")
    found = at.join(src, "h").select(
        "doc", "th", F.col("pos").alias("start"), (F.col("pos") + F.col("n_edges") + window - 1).alias("end"), "h", (F.struct("doc", "th", "pos") == F.col("src")).alias("own")
    )
    found = table(found)
    spans = _digests(docs, found, max_filter_bits)
    drop(heads, found)
    # a span counts only if its words are those at its source's coordinates; sources are a table, so that Spark can split a frequent path's spans
    sources = table(spans.where("own").select("h", "x", "y"))
    return spans.where("NOT own").join(sources, ["h", "x", "y"], "left_semi").select("doc", "th", "start", "end")


def _kept(texts: list[bytes], spans: list) -> pa.StructArray:
    kept, n_words, n_removed = [], [], []
    for text, mine in zip(texts, spans):
        words = text.split()
        n_words.append(len(words))
        if mine is not None:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, mine.field("start").to_numpy(), 1)
            np.add.at(edge, mine.field("end").to_numpy(), -1)
            stays = np.cumsum(edge)[:-1] == 0
            words = [w for w, s in zip(words, stays) if s]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
    sha = [hashlib.sha256(x).hexdigest() for x in kept]
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
        ["n_words", "n_removed", "text", "kept_sha256"],
    )


def deduplicate(
    df: DataFrame, window: int = 20, *, id_col: str = "doc_id", text_col: str = "text", kmer: int = 6, max_filter_bits: int = 1 << 28
) -> DataFrame:
    """One row per document: id, n_words, n_removed, text (kept words joined by one space), kept_sha256.

    A null text has no words; its kept text is empty. Rows with fewer words
    than a window lose nothing. Repeated rows of one id and text are answered
    alike. Empty table: empty result. Columns other than the two are ignored.
    Texts are shuffled only where they lose words.
    """
    docs = keyed(df, id_col, text_col)
    by, some = _of_documents(repeated_spans(df, window, id_col=id_col, text_col=text_col, kmer=kmer, max_filter_bits=max_filter_bits), max_filter_bits)
    made = "n_words long, n_removed long, text string, kept_sha256 string"

    def whole(text: pa.Array) -> pa.Array:
        return _kept(texts_of(text), [None] * len(text))

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return _kept(texts_of(text), [spans[k].values if spans[k].is_valid else None for k in range(len(text))])

    whole.__annotations__ = {"text": pa.Array, "return": pa.Array}
    cut.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    docs = docs.withColumn("some", some)
    plain = docs.where("NOT some").select("id", F.arrow_udf(whole, made)("text").alias("made"))
    short = docs.where("some").join(by, ["doc", "th"], "left").select("id", F.arrow_udf(cut, made)("text", "spans").alias("made"))
    return plain.union(short).select(F.col("id").alias(id_col), "made.*")
